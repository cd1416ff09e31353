"""Benchmark decontamination: a generalised suffix automaton of the normalised test items reads the training tokens.

The automaton keeps, for each token of a document, the longest suffix that occurs in an item. Where that length reaches a window
(10 words, or a whole shorter item) the window's words are hit. Tokens are looked up by hash for whole slices of documents at once, and
only stretches whose word pairs all occur in some item, long enough for a window, are stepped through the automaton:
no match can leave such a stretch.
Test items are a stated query set: they are read in blocks of about `block_words` words. A benchmark of one block is one pass. With more, one pass
over all documents tells by a bit filter of all windows' hashes which may hold any; only these are read block by block, one automaton at a time, so
neither what is broadcast nor the passes over the documents grow with the benchmark.
Defined results: null texts and items without words have no windows; repeated items are one; a null item id is listed as empty text;
an empty benchmark leaves every document clean; rows with null or repeated ids are read like any other, equal texts get equal results; very long texts
are read whole; an empty table of documents gives no rows; other columns are never read, and kept where rows are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, checkpointed, documents, in_filter, map_rows, word_table

WINDOW, BLOCK_WORDS = 10, 100_000


class Automaton:
    """All substrings of the items' token sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        ends = [self._add(tokens) for _, tokens in items]
        n = len(self.length)
        #: The state of the last `window` tokens of a match that ends in a state; -1 where none is so long.
        self.cut = [-1] * n
        for v in sorted(range(n), key=self.length.__getitem__):
            if self.length[v] >= window:
                up = self.link[v]
                self.cut[v] = self.cut[up] if self.length[up] >= window else v
        self.found: dict[int, set[int]] = {}  # window state -> items
        self.short: dict[int, list[tuple[int, int]]] = {}  # state -> (length, item) of whole short items that end there
        names: dict[str, int] = {}
        for (name, tokens), end in zip(items, ends, strict=True):
            k = names.setdefault(name, len(names))
            if 0 < len(tokens) < window:
                self.short.setdefault(end, []).append((len(tokens), k))
            elif tokens:
                v = 0
                for i, t in enumerate(tokens):
                    v = self.next[v][t]
                    if i + 1 >= window:
                        self.found.setdefault(self.cut[v], set()).add(k)
        self.names = list(names)
        self.least = min([window, *(m for x in self.short.values() for m, _ in x)])

    def _add(self, tokens: list[int]) -> int:
        """Extend the automaton by one sequence; returns the state that the whole sequence reaches."""
        last = 0
        for t in tokens:
            after = self.next[last].get(t)
            if after is not None:
                last = after if self.length[after] == self.length[last] + 1 else self._split(last, t, after)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][t]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
            last = new
        return last

    def _state(self, length: int, link: int, after: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def read(self, tokens: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges (from, to) over the tokens and the items whose windows occur."""
        v = matched = 0
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        for i, t in enumerate(tokens, 1):
            while v and t not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            after = self.next[v].get(t)
            if after is None:
                continue
            v, matched = after, matched + 1
            size = 0
            if matched >= self.window and (own := self.found.get(self.cut[v])):
                items |= own
                size = self.window
            if self.short:
                up = v
                while up > 0:
                    for m, k in self.short.get(up, ()):
                        if m <= matched:
                            items.add(k)
                            size = max(size, m)
                    up = self.link[up]
            if size:
                if hits and i - size <= hits[-1][1]:
                    hits[-1] = (min(hits[-1][0], i - size), i)
                else:
                    hits.append((i - size, i))
        return hits, items


class Index:
    """An automaton with its vocabulary and word pairs as sorted arrays."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        _, _, _, words, first = word_table([text for _, text in items])
        self.vocabulary, tokens = np.unique(words, return_inverse=True)
        lists = [tokens[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        self.automaton = Automaton([(name, t) for (name, _), t in zip(items, lists, strict=True)], window)
        pairs = [np.array(t[:-1], np.int64) * len(self.vocabulary) + np.array(t[1:], np.int64) for t in lists if len(t) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def scan(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int, int, int]], set[str]]]:
        """Per text: words, hits as (first word, word after, first byte, byte after), and names of items."""
        _, begin, end, words, first = word_table(texts)
        starts = np.concatenate([[0], np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])])
        out = [(int(b - a), [], set()) for a, b in zip(first[:-1], first[1:], strict=True)]
        if len(words) == 0 or len(self.vocabulary) == 0:
            return out
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words
        joined = np.zeros(len(words), bool)  # with the word before
        if len(self.pairs):
            pair = at[:-1] * len(self.vocabulary) + at[1:]
            joined[1:] = known[:-1] & known[1:] & (self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair)
        joined[first[:-1][first[:-1] < len(words)]] = False
        run_start = np.flatnonzero(~joined)
        run_end = np.append(run_start[1:], len(words))
        long = (run_end - run_start >= self.automaton.least) & known[run_start]
        for a, b in zip(run_start[long].tolist(), run_end[long].tolist(), strict=True):
            hits, items = self.automaton.read(at[a:b].tolist())
            if hits:
                doc = int(np.searchsorted(first, a, side="right")) - 1
                w, s = int(first[doc]), int(starts[doc])
                out[doc][1].extend((a + x - w, a + y - w, int(begin[a + x]) - s, int(end[a + y - 1]) - s) for x, y in hits)
                out[doc][2].update(self.automaton.names[k] for k in items)
        return out


def indexes(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Broadcast]:
    """One broadcast index after the other per block of items; blocks are cut by running size, an item is never split."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    context = benchmark.sparkSession.sparkContext
    block, size = [], 0
    for row in items.orderBy("id", "text").toLocalIterator():  # one partition of the query set at a time
        block.append((row.id, row.text))
        size += len(row.text) // 2 + 1  # at most as many words
        if size >= block_words:
            yield context.broadcast(Index(block, window))
            block, size = [], 0
    if block:
        yield context.broadcast(Index(block, window))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan_all(blocks: list, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], list[tuple[int, int]], list[str]]]:
    """Over all blocks: words, merged word spans, merged byte spans, sorted item names of each text."""
    found = [b.value.scan(texts) for b in blocks] or [[(n, [], set()) for n in np.diff(word_table(texts)[4]).tolist()]]
    out = []
    for parts in zip(*found, strict=True):
        hits = [h for p in parts for h in p[1]]
        out.append((parts[0][0], _union([h[:2] for h in hits]), _union([h[2:] for h in hits]), sorted(set().union(*(p[2] for p in parts)))))
    return out


def _in_blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[list[Broadcast], Iterator[Broadcast]]:
    """The only index, or none if there are several: then they are to be taken one by one from the iterator."""
    blocks = indexes(benchmark, window, block_words)
    first = list(islice(blocks, 2))
    return (first, iter(())) if len(first) < 2 else ([], chain(first, blocks))


HITS = "array<struct<a:bigint,b:bigint>>"


def _window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where `size` words of one text stand from, and a hash of these."""
    n = max(len(words) - size + 1, 0)
    end = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + size <= end)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = (h + words[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return at, h + np.uint64(size)


def suspects(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, text) of the documents that may hold a window of any item: all that do, and few others."""

    def cut(texts):
        _, _, _, words, first = word_table(texts)
        size = np.minimum(np.diff(first), window)
        found = [(np.array([n] * len(h)), h.view(np.int64)) for n in np.unique(size[size > 0]).tolist() for h in [_of_items(words, first, size, n)]]
        return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1)]

    windows = checkpointed(map_rows(benchmark.select(F.coalesce("text", F.lit("")).alias("text")), cut, "size bigint, hash bigint", ["text"]))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `window` numbers
    known = docs.sparkSession.sparkContext.broadcast(bit_filter(windows.select("hash")))

    def read(ids, keys, texts):
        _, _, _, words, first = word_table(texts)
        hit = np.zeros(len(texts), bool)
        for n in sizes:
            at, h = _window_hashes(words, first, n)
            hit[np.searchsorted(first, at[in_filter(known.value, h.view(np.int64))], side="right") - 1] = True
        return [[c[k] for k in np.flatnonzero(hit).tolist()] for c in (ids, keys, texts)]

    keyed = documents(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return checkpointed(map_rows(keyed, read, "doc_id bigint, text_key bigint, text string", ["doc_id", "text_key", "text"]))


def _of_items(words: np.ndarray, first: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of those items whose windows have `n` words."""
    at, h = _window_hashes(words, first, n)
    return h[size[np.searchsorted(first, at, side="right") - 1] == n]


def _hits_by_block(docs: DataFrame, benchmark: DataFrame, window: int, blocks: Iterator[Broadcast]) -> DataFrame:
    """(doc_id, text_key, spans, items) of documents with hits: a pass over the suspects per block, its rows written before the next."""
    keyed = suspects(docs, benchmark, window)
    found = None
    for block in blocks:

        def read(ids, keys, texts, block=block):
            rows = [(i, k, [{"a": x, "b": y} for x, y, _, _ in hits], sorted(names)) for i, k, (_, hits, names) in zip(ids, keys, block.value.scan(texts), strict=True) if hits]
            return list(zip(*rows, strict=True)) if rows else [[]] * 4

        part = checkpointed(map_rows(keyed, read, f"doc_id bigint, text_key bigint, spans {HITS}, items array<string>", ["doc_id", "text_key", "text"]))
        block.unpersist()
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _report(ids: list, found: list[tuple[int, list[tuple[int, int]], list[str]]]) -> tuple:
    hit = [sum(b - a for a, b in spans) for _, spans, _ in found]
    return ids, [n for n, _, _ in found], hit, [len(names) for *_, names in found], [hashlib.sha256(",".join(names).encode()).hexdigest() for *_, names in found], [h > 0 for h in hit]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    one, several = _in_blocks(benchmark, window, block_words)
    first = next(several, None)
    if first is None:
        return map_rows(documents(docs), lambda ids, texts: _report(ids, [(n, spans, names) for n, spans, _, names in _scan_all(one, texts)]), REPORT, ["doc_id", "text"])
    found = _hits_by_block(docs, benchmark, window, chain([first], several)).alias("h")
    keyed = documents(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text").alias("d")
    rows = keyed.join(found, F.expr("d.doc_id <=> h.doc_id AND d.text_key = h.text_key"), "left").select("d.doc_id", "spans", "items", "text")

    def read(ids, spans, items, texts):
        counts = np.diff(word_table(texts)[4]).tolist()
        return _report(ids, [(n, _union([(x["a"], x["b"]) for x in s or ()]), sorted(names or ())) for n, s, names in zip(counts, spans, items, strict=True)])

    return map_rows(rows, read, REPORT, ["doc_id", "spans", "items", "text"])


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and what stands between the words of a span."""
    _, begin, end, _, _ = word_table([text])
    raw = text.encode("utf-8", "surrogatepass")
    for a, b in reversed(_union(spans)):
        raw = raw[: int(begin[a])] + raw[int(end[b - 1]) :]
    return raw.decode("utf-8", "surrogatepass")


def _covered(text: str, spans: list[tuple[int, int]], coverage: float) -> bool:
    return sum(b - a for a, b in _union(spans)) > coverage * int(np.diff(word_table([text])[4])[0])


def _cut(docs: DataFrame, block: list[Broadcast], coverage: float) -> DataFrame:
    """`docs` without the spans of one block, and without documents that it covers beyond `coverage`."""

    def clean_one(text: str, spans: list[tuple[int, int]]) -> str | None:
        if _covered(text, spans, coverage):
            return None
        while spans:
            text = _without(text, spans)
            spans = _scan_all(block, [text])[0][1]
        return text

    @F.pandas_udf("struct<keep:boolean,text:string>")
    def clean(texts: pd.Series) -> pd.DataFrame:
        out, rows = [], texts.tolist()
        for at in range(0, len(rows), 64):
            part = [t or "" for t in rows[at : at + 64]]
            for t, own, (_, spans, _, _) in zip(part, rows[at : at + 64], _scan_all(block, part), strict=True):
                done = clean_one(t, spans) if spans else own
                out.append((not spans or done is not None, done))
        return pd.DataFrame(out, columns=["keep", "text"])

    cleaned = docs.select(F.struct("*").alias("row"), clean.asNondeterministic()("text").alias("cleaned")).where("cleaned.keep")
    return cleaned.select(F.col("row").withField("text", F.col("cleaned.text")).alias("row")).select("row.*")


def _cut_round(docs: DataFrame, benchmark: DataFrame, window: int, blocks: Iterator[Broadcast], coverage: float) -> tuple[DataFrame, DataFrame]:
    """Rows without a hit in any block; and the others, cut at the hits of all blocks at once, but for those covered beyond `coverage`."""
    key = [F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")]
    found = _hits_by_block(docs, benchmark, window, blocks).select("doc_id", "text_key", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))
    rows = docs.select(F.struct("*").alias("row"), *key).alias("d")
    joined = checkpointed(rows.join(found.alias("h"), F.expr("d.id <=> h.doc_id AND d.key = h.text_key"), "left").select("row", "a", "b"))

    @F.pandas_udf("struct<keep:boolean,text:string>")
    def clean(texts: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, first, last, strict=True):
            spans = list(zip(map(int, a), map(int, b), strict=True))
            keep = not _covered(text, spans, coverage)
            out.append((keep, _without(text, spans) if keep else None))
        return pd.DataFrame(out, columns=["keep", "text"])

    hit = joined.where("a IS NOT NULL").select("row", clean.asNondeterministic()("row.text", "a", "b").alias("cleaned")).where("cleaned.keep")
    return joined.where("a IS NULL").select("row.*"), hit.select(F.col("row").withField("text", F.col("cleaned.text")).alias("row")).select("row.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of `docs`: spans of benchmark windows are cut out, and documents covered beyond `coverage` go.

    Cutting is repeated until no window is left, as what stood around a span may form a new one. Clean rows stay as they are.
    With several blocks, each round finds the hits of all blocks on the same text before it cuts, so the rows are those of one block.
    """
    one, several = _in_blocks(benchmark, window, block_words)
    first = next(several, None)
    if first is None:
        return _cut(docs, one, coverage)
    clean, left = _cut_round(docs, benchmark, window, chain([first], several), coverage)
    while not (left := checkpointed(left)).isEmpty():
        more, left = _cut_round(left, benchmark, window, indexes(benchmark, window, block_words), 1.0)
        clean = clean.union(more)
    return clean


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
m AS (SELECT g.doc_id, g.i, g.n, v.item_id FROM grams g JOIN windows v ON g.n = v.n AND g.win = v.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
