"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Training: labelled rows that are not held out, at most `max_rows` of them (the smallest hashes of their ids),
reduced to statistics by Spark; the driver sees those few numbers per row, never texts. Scoring: the trees are flattened
into arrays that numpy walks for many documents at once.
Defined results: a null text counts as empty and is scored; without any label of either class every score is the prior
(0.5 without any label); documents without a label are scored but not learnt from; repeated and null ids keep all their rows; equal texts get equal
scores; very long texts are counted whole; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, map_rows

FEATURES = (
    "log_bytes", "log_words", "word_len", "word_len_sd", "unique_words", "top_word", "top_pair", "repeats_next",
    "letters", "upper", "digits", "spaces", "wide", "marks", "bars", "stops", "commas", "breaks", "quotes",
    "lines", "line_len", "unique_lines", "upper_words", "marked_words", "short_words", "long_words", "byte_entropy", "exclaims", "hashes",
)
MAX_ROWS = 20_000


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256)
    m[list(chars)] = 1
    return m


_UPPER, _DIGIT, _SPACE = _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58))), _mask(b" \t\n\r\x0b\x0c")
_LETTER, _WIDE = _mask(bytes(range(65, 91)) + bytes(range(97, 123))), _mask(bytes(range(128, 256)))
_MARK = _mask(bytes(range(33, 127))) * (1 - _LETTER) * (1 - _DIGIT)
_CLASSES = np.stack([_LETTER, _UPPER, _DIGIT, _SPACE, _WIDE, _MARK, _mask(b"|"), _mask(b".?"), _mask(b",;"), _mask(b"\n"), _mask(b"\"'`"), _mask(b"!"), _mask(b"#$%&*@^~")], axis=1)


def statistics(text: str) -> list[float]:
    """The numbers in FEATURES for one whole text; all are finite, also for the empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, upper, digits, spaces, wide, marks, bars, stops, commas, breaks, quotes, exclaims, hashes = (counts @ _CLASSES / n).tolist()
    words = raw.split()
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    most = int(np.bincount(ids).max()) if words else 0
    most_pair = int(np.unique(ids[:-1] * len(number) + ids[1:], return_counts=True)[1].max()) if len(words) > 1 else 0
    same = int((ids[:-1] == ids[1:]).sum())
    lines = [x for x in raw.split(b"\n") if x]
    p = counts[counts > 0] / n
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(lengths.mean()) if words else 0.0, float(lengths.std()) if words else 0.0,
        len(number) / k, most / k, most_pair / k, same / k,
        letters, upper, digits, spaces, wide, marks, bars, stops, commas, breaks, quotes,
        np.log1p(len(lines)), np.log1p(len(raw) / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1),
        sum(w.isupper() for w in words) / k, sum(not (w[-1:].isalnum() or w[-1] > 127) for w in words) / k,
        float((lengths <= 2).mean()) if words else 0.0, float((lengths >= 12).mean()) if words else 0.0, float(-(p * np.log2(p)).sum()), exclaims, hashes,
    ]


def text_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns and `stats`, one row per document."""
    docs = documents(docs, *more)
    schema = ", ".join(["doc_id bigint", *(f"{c} {dict(docs.dtypes)[c]}" for c in more), "stats array<float>"])
    return map_rows(docs, lambda ids, *rest: (ids, *rest[:-1], [statistics(t) for t in rest[-1]]), schema, ["doc_id", *more, "text"])


@dataclass
class Forest:
    """Complete binary trees as arrays: node i of a tree has the children 2i+1 and 2i+2; a node without a split sends all left."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 2.0, least: int = 8) -> Forest:
    """Boosting on the log loss; splits come from histograms of gradients over `bins` quantile bins per feature."""
    n, d = x.shape if x.size else (0, len(FEATURES))
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    start = float(np.log(p / (1 - p)))
    inner = 2**depth - 1
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)), start)
    if n == 0 or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(n, start)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            local = node - first
            best_gain, best_f, best_b = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
            for j in range(d):
                at = local * bins + binned[:, j]
                g, h, c = (np.cumsum(np.bincount(at, w, width * bins).reshape(width, bins), axis=1) for w in (grad, hess, None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
                gain[(c < least) | (ct - c < least)] = -1
                gain[:, len(cuts[j]) :] = -1
                b = gain.argmax(axis=1)
                gain = gain[np.arange(width), b]
                better = gain > best_gain
                best_gain[better], best_f[better], best_b[better] = gain[better], j, b[better]
            for k in np.flatnonzero(best_b >= 0):
                forest.feature[t, first + k], forest.threshold[t, first + k] = best_f[k], cuts[best_f[k]][best_b[k]]
            right = (best_b[local] >= 0) & (binned[np.arange(n), best_f[local]] > best_b[local])
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        forest.leaf[t] = -rate * g / (h + l2)
        margin += forest.leaf[t][leaf]
    return forest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most `max_rows` labelled documents that are not held out, the smallest hashes of their ids: doc_id, text, y.

    The ids of the sample (8 bytes each) are broadcast; an id with several labels takes the largest.
    """
    picked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = picked.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return documents(docs).join(F.broadcast(picked), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **how) -> Forest:
    sample = labelled_sample(docs, labels, "quality", max_rows)
    rows = text_statistics(sample, "y").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return fit(np.array([r.stats for r in rows], np.float32), np.array([r.y for r in rows], float), **how)


def score_quality(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    forest_b = docs.sparkSession.sparkContext.broadcast(forest)  # a few hundred KB, whatever the input

    def read(ids, texts):
        x = np.array([statistics(t) for t in texts], np.float32).reshape(len(texts), len(FEATURES))
        return ids, forest_b.value.score(x).tolist()

    scored = map_rows(documents(docs), read, "doc_id bigint, score double", ["doc_id", "text"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
