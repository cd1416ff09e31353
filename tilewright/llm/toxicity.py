"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Characters: a bidirectional GRU reads the bytes of each word, all of them, from learnt embeddings, and its two last states are inputs of the word.
Words: beside them, weights of evidence (log odds of the label, from documents that hold the key) of the whole word and of its
leading four and six and last four bytes. A second bidirectional GRU reads windows of WINDOW words that overlap
(one every STRIDE words, to the end of the text), pools each window by attention and gives it a logit; both are trained together. A document's score
joins the largest, the mean of the three largest and the mean over all of its windows. A word of more than PIECE bytes is read as several.
Training runs on the driver in numpy over at most `max_rows` labelled documents of each class that are not held out and have at most
`max_chars` characters (the smallest hashes of their ids); scoring reads whole texts of all documents.
Defined results: empty and null texts, and texts without words, get the prior as their score; without rows of both classes every
score is near the prior, which is 0 without any label, so that nothing is rejected unlearnt; repeated and null ids keep all their rows; equal
texts get equal scores; very long texts are read whole, in windows; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, map_rows, word_table

WINDOW, STRIDE, HIDDEN, KEYS, SLOTS = 64, 48, 8, 4, 1 << 19
MAX_ROWS, MAX_CHARS = 1500, 20_000
PIECE, EMBED, SPELL = 32, 6, 4
_EVIDENCE = KEYS + 2
_INPUTS = _EVIDENCE + 2 * SPELL


@dataclass
class Words:
    """Words of some texts: slots of their keys (words x KEYS), bytes and lengths of the different ones, which one each is, and the first word of each text."""

    keys: np.ndarray
    size: np.ndarray
    letters: np.ndarray
    lengths: np.ndarray
    which: np.ndarray
    first: np.ndarray


def words_of(texts: list[str]) -> Words:
    data, begin, end, words, first = word_table(texts)
    parts = np.maximum(1, -(-(end - begin) // PIECE))
    if len(parts) and parts.max() > 1:
        ends = np.cumsum(parts)
        step = np.arange(ends[-1]) - np.repeat(ends - parts, parts)
        begin = np.repeat(begin, parts) + step * PIECE
        end = np.minimum(begin + PIECE, np.repeat(end, parts))
        words = np.repeat(words, parts) + step.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = np.concatenate([[0], ends])[first]
    size = end - begin
    head, tail = np.zeros((2, len(begin)), np.uint64)
    four = head
    for k in range(6):
        here = np.where(k < size, data[np.minimum(begin + k, len(data) - 1)], 0).astype(np.uint64)
        head = head << np.uint64(8) | here
        if k == 3:
            four = head.copy()
        if k < 4:
            tail |= np.where(k < size, data[np.maximum(end - 1 - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    keys = np.stack([words, four ^ np.uint64(1 << 60), head ^ np.uint64(2 << 60), tail ^ np.uint64(3 << 60)], axis=1)
    keys *= np.uint64(0x9E3779B97F4A7C15)
    _, own, which = np.unique(words, return_index=True, return_inverse=True)
    at = begin[own][:, None] + np.arange(PIECE)
    letters = np.where(at < end[own][:, None], data[np.minimum(at, len(data) - 1)], 0)
    return Words((keys >> np.uint64(64 - 19)).astype(np.int32), size, letters, size[own], which, first)


def joined_words(parts: list[Words]) -> Words:
    """The words of several lists of texts as of one."""
    shift = np.cumsum([0] + [len(p.letters) for p in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))])
    column = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Words(column("keys"), column("size"), column("letters"), column("lengths"), np.concatenate([p.which + s for p, s in zip(parts, shift, strict=False)]), first)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, document) of every window; each document has one at least, and its last reaches its end."""
    count = np.diff(first)
    n = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(count)), n)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[doc] + step * STRIDE
    return begin, np.minimum(WINDOW, first[doc + 1] - begin), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Evidence tables, the network's weights by name, and how windows make a document's logit."""

    evidence: np.ndarray
    weights: dict[str, np.ndarray]
    joined: np.ndarray
    prior: float
    #: Whether labels of both classes were there to learn from; else every text scores the prior.
    learnt: bool = False

    def evidence_of(self, keys: np.ndarray, size: np.ndarray) -> np.ndarray:
        x = np.empty((len(keys), _EVIDENCE), np.float32)
        for k in range(KEYS):
            x[:, k] = self.evidence[k, keys[:, k]]
        x[:, KEYS] = np.minimum(size, 32) / 16
        x[:, KEYS + 1] = x[:, :KEYS].max(axis=1)
        return x

    def inputs(self, evidence: np.ndarray, words: Words) -> np.ndarray:
        """Evidence and spelling of each word."""
        return np.concatenate([evidence, spell(self.weights, words.letters, words.lengths)[0][words.which]], axis=1)

    def batch(self, x: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps x windows x inputs, steps x windows) with the places beyond a window's end masked."""
        at, held = places(begin, size, len(x))
        padded = x[at] if len(x) else np.zeros((*at.shape, _INPUTS), np.float32)
        return padded * held[:, :, None], held

    def window_logits(self, x: np.ndarray, begin: np.ndarray, size: np.ndarray, rows: int = 2048) -> np.ndarray:
        out = np.empty(len(begin), np.float32)
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), rows):
            at = order[a : a + rows]
            out[at] = forward(self.weights, *self.batch(x, begin[at], size[at]))[0]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        words = words_of(texts)
        begin, size, doc = windows_of(words.first)
        x = self.inputs(self.evidence_of(words.keys, words.size), words)
        scores = _sigmoid(self.document_features(self.window_logits(x, begin, size), doc, len(texts)) @ self.joined)
        return np.where(np.diff(words.first) > 0, scores, self.prior)

    @staticmethod
    def document_features(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Largest, mean of the three largest and mean of each document's window logits, and a constant."""
        order = np.lexsort((-logits, doc))
        count = np.bincount(doc, minlength=n)
        start = np.cumsum(count) - count
        rank = np.arange(len(doc)) - np.repeat(start, count)
        ranked = logits[order].astype(float)
        top = np.bincount(doc[order], ranked * (rank < 3), n) / np.minimum(count, 3)
        return np.stack([ranked[start], top, np.bincount(doc[order], ranked, n) / count, np.ones(n)], axis=1)


def places(begin: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (steps x windows) among `n` words, and which of them lie within their window."""
    steps = max(int(size.max()), 1)
    at = begin[None, :] + np.arange(steps)[:, None]
    return np.minimum(at, max(n - 1, 0)), (np.arange(steps)[:, None] < size[None, :]).astype(np.float32)


def gru(w: dict[str, np.ndarray], layer: str, x: np.ndarray, held: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (steps x rows x both directions) of a layer, which stand still where nothing is held; with `keep`, what its gradients need."""
    steps, n, _ = x.shape
    size = len(w[f"{layer}rec0"])
    states = np.empty((steps, n, 2 * size), np.float32)
    kept = []
    for d, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
        p = x @ w[f"{layer}in{d}"] + w[f"{layer}bias{d}"]
        h = np.zeros((n, size), np.float32)
        for t in order:
            g = h @ w[f"{layer}rec{d}"]
            zr = _sigmoid(p[t, :, : 2 * size] + g[:, : 2 * size])
            z, r = zr[:, :size], zr[:, size:]
            c = np.tanh(p[t, :, 2 * size :] + r * g[:, 2 * size :])
            m = held[t][:, None]
            new = h + m * (1 - z) * (c - h)
            if keep:
                kept.append((d, t, h, z, r, c, g[:, 2 * size :]))
            h = new
            states[t, :, d * size : (d + 1) * size] = h
    return states, kept


def gru_back(w: dict[str, np.ndarray], layer: str, x: np.ndarray, held: np.ndarray, kept: list, dstates: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
    """Adds a layer's gradients to `g`; returns those of its inputs."""
    size = len(w[f"{layer}rec0"])
    dx = np.zeros_like(x)
    for d in (0, 1):
        dh = np.zeros((x.shape[1], size), np.float32)
        dp = np.zeros(x.shape[:2] + (3 * size,), np.float32)
        for _, t, h, z, r, c, gc in reversed([k for k in kept if k[0] == d]):
            dh = dh + dstates[t, :, d * size : (d + 1) * size]
            m = held[t][:, None]
            dc = dh * m * (1 - z) * (1 - c * c)
            dz = -dh * m * (c - h) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            dp[t] = np.concatenate([dz, dr, dc], axis=1)
            drec = np.concatenate([dz, dr, dc * r], axis=1)
            g[f"{layer}rec{d}"] += h.T @ drec
            dh = dh * (1 - m * (1 - z)) + drec @ w[f"{layer}rec{d}"].T
        g[f"{layer}in{d}"] += np.tensordot(x, dp, ((0, 1), (0, 1)))
        g[f"{layer}bias{d}"] += dp.sum(axis=(0, 1))
        dx += dp @ w[f"{layer}in{d}"].T
    return dx


def spell(w: dict[str, np.ndarray], letters: np.ndarray, lengths: np.ndarray, keep: bool = False, rows: int = 1024) -> tuple[np.ndarray, list]:
    """The two last states of the byte layer for each different word; words of like lengths are read together."""
    out, saved = np.zeros((len(letters), 2 * SPELL), np.float32), []
    order = np.argsort(lengths, kind="stable")
    for a in range(0, len(order), rows):
        at = order[a : a + rows]
        steps = max(int(lengths[at[-1]]), 1)
        spelt = letters[at, :steps].T
        x, held = w["letters"][spelt], (np.arange(steps)[:, None] < lengths[at][None, :]).astype(np.float32)
        states, kept = gru(w, "char", x, held, keep)
        out[at] = np.concatenate([states[-1, :, :SPELL], states[0, :, SPELL:]], axis=1)
        if keep:
            saved.append((at, spelt, x, held, kept))
    return out, saved


def spell_back(w: dict[str, np.ndarray], saved: list, dout: np.ndarray, g: dict[str, np.ndarray]) -> None:
    """Adds the byte layer's gradients to `g`."""
    for at, spelt, x, held, kept in saved:
        dstates = np.zeros(spelt.shape + (2 * SPELL,), np.float32)
        dstates[-1, :, :SPELL] = dout[at, :SPELL]
        dstates[0, :, SPELL:] = dout[at, SPELL:]
        dx = gru_back(w, "char", x, held, kept, dstates, g)
        for k in range(EMBED):
            g["letters"][:, k] += np.bincount(spelt.ravel(), dx[:, :, k].ravel(), 256)


def forward(w: dict[str, np.ndarray], x: np.ndarray, held: np.ndarray, keep: bool = False):
    """Logits of a batch of windows; with `keep`, also what the backward pass needs."""
    states, kept = gru(w, "word", x, held, keep)
    u = np.tanh(states @ w["att"])
    score = np.where(held > 0, u @ w["focus"], -1e9)
    e = np.exp(score - score.max(axis=0)) * np.maximum(held, 1e-9)
    a = e / e.sum(axis=0)
    pooled = (a[:, :, None] * states).sum(axis=0)
    logit = pooled @ w["out"] + w["const"][0]
    return (logit, (x, held, kept, states, u, a, pooled)) if keep else (logit, None)


def backward(w: dict[str, np.ndarray], saved, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weights and of the inputs for the given gradients of the logits."""
    x, held, kept, states, u, a, pooled = saved
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"], g["const"][0] = pooled.T @ dlogit, dlogit.sum()
    dpool = dlogit[:, None] * w["out"]
    dstates = a[:, :, None] * dpool
    da = (states * dpool).sum(axis=2)
    dscore = a * (da - (a * da).sum(axis=0))
    g["focus"] = np.tensordot(dscore, u, ((0, 1), (0, 1)))
    du = dscore[:, :, None] * w["focus"] * (1 - u * u)
    g["att"] = np.tensordot(states, du, ((0, 1), (0, 1)))
    dstates += du @ w["att"].T
    return g, gru_back(w, "word", x, held, kept, dstates, g)


def loss_gradients(w: dict[str, np.ndarray], evidence: np.ndarray, words: Words, begin: np.ndarray, size: np.ndarray, slope) -> dict[str, np.ndarray]:
    """Gradients of all weights over some windows, through words and their bytes; `slope` gives those of the logits."""
    at, held = places(begin, size, len(evidence))
    used, which = np.unique(words.which[at], return_inverse=True)
    spelt, kept = spell(w, words.letters[used], words.lengths[used], keep=True)
    which = which.reshape(at.shape)
    x = np.concatenate([evidence[at], spelt[which]], axis=2) * held[:, :, None]
    logit, saved = forward(w, x, held, keep=True)
    g, dx = backward(w, saved, slope(logit))
    dx = dx * held[:, :, None]
    dout = np.stack([np.bincount(which.ravel(), dx[:, :, _EVIDENCE + k].ravel(), len(used)) for k in range(2 * SPELL)], axis=1).astype(np.float32)
    spell_back(w, kept, dout, g)
    return g


def weights_at_first(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"att": draw(2 * HIDDEN, HIDDEN), "focus": draw(HIDDEN), "out": draw(2 * HIDDEN), "const": np.zeros(1, np.float32), "letters": draw(256, EMBED) * 16}
    for d in (0, 1):
        for layer, inputs, size in (("word", _INPUTS, HIDDEN), ("char", EMBED, SPELL)):
            w |= {f"{layer}in{d}": draw(inputs, 3 * size), f"{layer}rec{d}": draw(size, 3 * size), f"{layer}bias{d}": np.zeros(3 * size, np.float32)}
    return w


def evidence_tables(keys: np.ndarray, first: np.ndarray, y: np.ndarray, used: np.ndarray, least: int = 2) -> np.ndarray:
    """Log odds of the label for each key's slot, from the `used` documents that hold it; slots of fewer than `least` have none."""
    out = np.zeros((KEYS, SLOTS), np.float32)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    held = used[doc]
    toxic, clean = max(y[used].sum(), 1), max((1 - y[used]).sum(), 1)
    for k in range(KEYS):
        pairs = np.unique(doc[held].astype(np.int64) << 20 | keys[held, k])
        slot, label = pairs & (1 << 20) - 1, y[pairs >> 20]
        t, c = np.bincount(slot, label, SLOTS), np.bincount(slot, 1 - label, SLOTS)
        seen = t + c >= least
        out[k, seen] = np.clip(np.log((t[seen] + 0.5) / (toxic + 1)) - np.log((c[seen] + 0.5) / (clean + 1)), -4, 6)
    return out


def fit(texts: list[str], y: np.ndarray, prior: float | None = None, folds: int = 5, epochs: int = 5, rows: int = 128, rate: float = 0.01, seed: int = 7, most_windows: int = 24_000, least_steps: int = 600, most_epochs: int = 60, spelling: int = 300) -> Network:
    """Adam on the log loss of windows under their document's label, then Newton's method for how windows make a document.

    Both layers are trained in the first `spelling` steps, the layer of words in all.
    """
    if prior is None:
        prior = float(y.mean()) if len(y) else 0.0
    network = Network(np.zeros((KEYS, SLOTS), np.float32), weights_at_first(seed), np.zeros(4), prior)
    if len(y) == 0 or y.min() == y.max():
        network.joined[3] = np.log(np.clip(prior, 1e-3, 1 - 1e-3) / (1 - np.clip(prior, 1e-3, 1 - 1e-3)))
        return network
    parts, at = [], 0
    while at < len(texts):
        parts.append(words_of(texts[at : at + 200]))
        at += 200
    words = joined_words(parts)
    keys, size, first = words.keys, words.size, words.first
    # The network learns from evidence that other documents gave, as it will meet it in new texts.
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(y)) % folds
    x = np.empty((len(keys), _EVIDENCE), np.float32)
    for k in range(folds):
        network.evidence = evidence_tables(keys, first, y, fold != k)
        own = np.repeat(fold == k, np.diff(first))
        x[own] = network.evidence_of(keys[own], size[own])
    network.evidence = evidence_tables(keys, first, y, np.ones(len(y), bool))
    begin, length, doc = windows_of(first)
    usable = np.arange(len(begin))
    epochs = min(most_epochs, max(epochs, -(-least_steps * rows // min(len(begin), most_windows))))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.weights.items()}
    step, spelt = 0, None
    for epoch in range(epochs):
        if epoch:  # not every window of a toxic document is toxic: go on with the half that looks most so
            logits = network.window_logits(network.inputs(x, words) if spelt is None else spelt, begin, length)
            ranked = np.lexsort((-logits, doc))
            count = np.bincount(doc, minlength=len(y))
            rank = np.empty(len(doc))
            rank[ranked] = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            usable = np.flatnonzero((y[doc] == 0) | (rank < np.maximum(1, np.ceil(count[doc] / 2))))
        order = rng.permutation(usable)[:most_windows]
        for a in range(0, len(order), rows):
            pick = order[a : a + rows]
            slope = lambda logit, own=doc[pick]: ((_sigmoid(logit) - y[own]) / len(own)).astype(np.float32)
            if step < spelling:
                grads = loss_gradients(network.weights, x, words, begin[pick], length[pick], slope)
            else:  # the bytes are learnt: go on with the words alone
                spelt = network.inputs(x, words) if spelt is None else spelt
                logit, saved = forward(network.weights, *network.batch(spelt, begin[pick], length[pick]), keep=True)
                grads = {k: v for k, v in backward(network.weights, saved, slope(logit))[0].items() if not k.startswith(("char", "letters"))}
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            step += 1
            pace = rate * (1 - epoch / (epochs + 1))
            for k, v in grads.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-6))
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                network.weights[k] -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    f = network.document_features(network.window_logits(network.inputs(x, words), begin, length), doc, len(texts))
    beta = np.array([0.5, 0.5, 0.0, 0.0])
    share = float(y.mean())
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))  # the sample has more toxic rows than the corpus
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(f @ beta, -30, 30)))
        hess = (f * (weight * p * (1 - p))[:, None]).T @ f + np.diag([0.5, 0.5, 0.5, 1e-3])
        grad = f.T @ (weight * (p - y)) + np.array([0.5, 0.5, 0.5, 1e-3]) * beta
        move = np.linalg.solve(hess, grad)
        beta -= move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
    network.joined, network.learnt = beta, True
    return network


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, **how) -> Network:
    """Fits on at most `max_rows` labelled documents of each class, in one task: what comes to the driver is the network."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = rows.agg(F.avg("y")).first()[0]
    picked = None
    for y in (0, 1):
        own = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = own if picked is None else picked.union(own)
    sample = documents(docs).where(F.length("text") <= max_chars).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"doc_id": [], "y": [], "text": []}), *frames]).sort_values("doc_id", ignore_index=True)
        yield pd.DataFrame({"network": [pickle.dumps(fit(got["text"].tolist(), got["y"].to_numpy(float), share, **how))]})

    found = sample.select("doc_id", "y", "text").repartition(1).mapInPandas(learn, "network binary").first()
    return pickle.loads(found[0]) if found else fit([], np.zeros(0), share, **how)


def score_toxicity(docs: DataFrame, network: Network, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # tables of a fixed size

    def read(ids, texts):
        return ids, shared.value.score(texts).tolist()

    scored = map_rows(documents(docs), read, "doc_id bigint, score double", ["doc_id", "text"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, network: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score stays under the threshold, with their columns; all of them if the network hasn't learnt both classes."""
    if not network.learnt:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out, rows = [], ["" if t is None else t for t in texts]
        at = 0
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and (end == at or size + len(rows[end]) <= 1 << 19):
                size += len(rows[end])
                end += 1
            out.append(shared.value.score(rows[at:end]))
            at = end
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    scored = docs.select(F.struct("*").alias("row"), score.asNondeterministic()("text").alias("score"))
    return scored.where(F.col("score") < threshold).select("row.*")
