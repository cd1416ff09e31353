"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts anywhere else.

1. Anchors. In each string of `length` bytes the smallest hash of its GRAM-byte substrings is its anchor, so equal strings have
   equal anchors, and consecutive strings mostly share one. A string whose anchor occurs at no other place has no twin.
2. Pieces. Runs of strings with one anchor that occurs again are cut out with the bytes they span. Equal pieces are kept once; their strings
   are all repeated. Anchors that occur are told to the scan by a bit filter of fixed size; a false hit costs time, not truth.
3. Shards. Pieces are dealt by anchor, and shards of about SHARD bytes get a suffix array by induced sorting and its permuted common
   prefixes; a string is repeated if it shares `length` bytes with a neighbour in the suffix array. Anchors with more than `crowd`
   different pieces would make a shard too large: their strings are dealt by hash and counted instead.
4. Removal. Runs go back to all texts that hold the piece, by joins, and the union of the strings they start is removed.
Texts are told apart by 128 bits of hash. Rows with equal texts repeat each other whole.
Defined results: a null text is empty; a text shorter than `length` loses nothing; null and repeated ids are kept as they are; anchors of equal
hash are one anchor, which costs time, not truth; very long texts are read in blocks; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bit_filter, checkpointed, documents, in_filter, map_rows
from .suffix_array import repeated_starts

LENGTH, GRAM, SHARD, CROWD = 200, 32, 1_500_000, 4096
_MIX = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)
BLOCK = 1 << 20


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the `gram` bytes from each place (a power of two), by doubling."""
    h, width = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX[1]), 1
    while width < gram:
        h = h[:-width] * np.uint64(pow(_MIX[0], width, 2**64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(_MIX[2])
    return h ^ (h >> np.uint64(32))


def _least(values: np.ndarray, span: int, pick=np.minimum) -> np.ndarray:
    """The smallest (or, with np.maximum, largest) of each `span` consecutive values."""
    out, width = values, 1
    while 2 * width <= span:
        out = pick(out[:-width], out[width:])
        width *= 2
    n = len(values) - span + 1
    return pick(out[:n], out[span - width : span - width + n])


def _blocks(raw: bytes, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first start, gram hashes, anchor of each string) of blocks of a text, so that a long text needs no more memory."""
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(len(data) - length + 1, 0), BLOCK):
        hashes = _gram_hashes(data[at : at + BLOCK + length - 1], gram)
        yield at, hashes, _least(hashes, length - gram + 1)


def anchor_places(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, place) wherever a string of `length` bytes has its anchor."""
    anchors, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    span = length - gram + 1
    for at, hashes, least in _blocks(raw, length, gram):
        around = np.zeros(span - 1, np.uint64)
        held = np.flatnonzero(_least(np.concatenate((around, least, around)), span, np.maximum) == hashes)
        anchors.append(hashes[held])
        places.append(held + at)
    return np.concatenate(anchors), np.concatenate(places)


def anchor_runs(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, starts) of the runs of strings with one anchor, none longer than one place can serve."""
    anchors, begins, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    span = length - gram + 1
    for at, _, least in _blocks(raw, length, gram):
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        size = np.diff(np.append(first, len(least)))
        if (size > span).any():  # a value that comes again within reach: cut the run
            parts = -(-size // span)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.repeat(first, parts) + step * span
            size = np.diff(np.append(first, len(least)))
        anchors.append(least[first])
        begins.append(first + at)
        counts.append(size)
    return np.concatenate(anchors), np.concatenate(begins), np.concatenate(counts)


def _keyed(docs: DataFrame) -> DataFrame:
    return documents(docs).select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(LENGTH), "text").alias("k2"), "text")


def repeated_anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors that occur at more than one place of different texts, or at several of one."""

    def read(k1, k2, texts):
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        for a, b, t in zip(k1, k2, texts, strict=True):
            anchor, place = anchor_places(t.encode("utf-8", "surrogatepass"), length, gram)
            for column, value in zip(out, (anchor.view(np.int64), np.full(len(anchor), a), np.full(len(anchor), b), place), strict=True):
                column.append(value)
        return [np.concatenate(c) for c in out]

    places = map_rows(keyed, read, "anchor bigint, k1 bigint, k2 bigint, at bigint", ["k1", "k2", "text"])
    place = F.xxhash64("k1", "k2", "at").alias("place")
    return places.select("anchor", place).groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("anchor")


PIECES = "anchor bigint, c1 bigint, c2 bigint, k1 bigint, k2 bigint, first bigint, own int, piece binary"


def pieces(keyed: DataFrame, wanted, length: int, gram: int, bits: int) -> DataFrame:
    """The pieces of each text whose anchor the filter holds; of equal pieces in a slice of rows only the first has its bytes."""

    def read(k1, k2, texts):
        rows, seen = [], set()
        for a, b, t in zip(k1, k2, texts, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            anchor, first, own = anchor_runs(raw, length, gram)
            kept = np.flatnonzero(in_filter(wanted.value, anchor.view(np.int64), bits)) if len(anchor) else []
            for h, s, n in zip(anchor.view(np.int64)[kept].tolist(), first[kept].tolist(), own[kept].tolist(), strict=True):
                piece = raw[s : s + n + length - 1]
                key = xxhash.xxh3_128_intdigest(piece, h & 0xFFFFFFFF)
                rows.append((h, (key >> 64) - 2**63, (key & 2**64 - 1) - 2**63, a, b, s, n, None if key in seen else piece))
                seen.add(key)
        return list(zip(*rows, strict=True)) if rows else [[]] * 8

    return map_rows(keyed, read, PIECES, ["k1", "k2", "text"])


def folds(piece: bytes, own: int, gram: int) -> bool:
    """Whether one of the `own` strings of a piece may occur at another of its places.

    All of them share the bytes from place own - 1 on, so their first few would stand again less than `own` places later.
    An anchor with one piece that doesn't fold was a false hit, or all its pieces are equal: no shard need look at it.
    """
    probe = min(gram, 16)
    return piece.find(piece[own - 1 : own - 1 + probe], own, 2 * own + probe) >= 0


def _sorted_shards(batches: Iterator[pa.RecordBatch], length: int, gram: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, c1, c2, own, piece) sorted by anchor: whole anchors are gathered into shards of about `shard` bytes."""
    rows: list[tuple] = []
    size = 0

    def close(part: list[tuple]) -> pa.RecordBatch:
        keys = [(r[1], r[2]) for r in part]
        runs = repeated_starts([r[4] for r in part], [r[3] for r in part], length)
        found = [(c1, c2, a, b) for (c1, c2), own in zip(keys, runs, strict=True) for a, b in own]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()), (3, pa.int32()))], names=["c1", "c2", "a", "b"])

    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if group and row[0] != group[0][0]:
                if len(group) > 1 or folds(group[0][4], group[0][3], gram):
                    rows += group
                    size += sum(len(r[4]) for r in group)
                group = []
                if size >= shard:
                    yield close(rows)
                    rows, size = [], 0
            group.append(row)
    if group and (len(group) > 1 or folds(group[0][4], group[0][3], gram)):
        rows += group
    if rows:
        yield close(rows)


def repeated_runs(distinct: DataFrame, length: int, gram: int, shard: int, crowd: int) -> DataFrame:
    """(c1, c2, a, b): runs of repeated strings within different pieces, from shards or, for crowded anchors, by hash."""
    crowded = checkpointed(distinct.select("anchor", "c1", "c2").distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor"))
    usual = distinct.join(crowded, "anchor", "left_anti") if crowded.head(1) else distinct
    dealt = usual.select("anchor", "c1", "c2", "own", "piece").repartition("anchor").sortWithinPartitions("anchor", "c1", "c2")
    runs = dealt.mapInArrow(lambda b: _sorted_shards(b, length, gram, shard), "c1 bigint, c2 bigint, a int, b int")
    if not crowded.head(1):
        return runs

    def strings(c1, c2, own, blobs):
        out = [[], [], [], [], []]
        for a, b, n, p in zip(c1, c2, own, blobs, strict=True):
            keys = [xxhash.xxh3_128_intdigest(p[i : i + length]) for i in range(n)]
            for column, value in zip(out, ([a] * n, [b] * n, range(n), [(k >> 64) - 2**63 for k in keys], [(k & 2**64 - 1) - 2**63 for k in keys]), strict=True):
                column.extend(value)
        return out

    single = map_rows(distinct.join(crowded, "anchor", "left_semi"), strings, "c1 bigint, c2 bigint, at int, s1 bigint, s2 bigint", ["c1", "c2", "own", "piece"])
    twice = single.groupBy("s1", "s2").agg(F.count("*").alias("n")).where("n > 1").select("s1", "s2")
    return runs.union(single.join(twice, ["s1", "s2"]).select("c1", "c2", F.col("at").alias("a"), (F.col("at") + 1).alias("b")))


def cover(runs: list[tuple[int, int]], size: int, length: int) -> list[tuple[int, int]]:
    """Removed byte ranges: the union of the strings that start in the runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        a, b = a, min(b - 1 + length, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, crowd: int = CROWD, bits: int = FILTER_BITS) -> DataFrame:
    """(k1, k2, runs): for each different text, the runs of starts whose strings are repeated; texts without any are left out."""
    if gram & (gram - 1) or gram > length:
        raise ValueError("gram must be a power of two, at most length")
    keyed = _keyed(docs)
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated_anchors(keyed, length, gram), bits))
    cut = checkpointed(pieces(keyed, wanted, length, gram, bits))
    distinct = cut.where("piece IS NOT NULL").groupBy("anchor", "c1", "c2", "own").agg(F.first("piece").alias("piece"))
    places = cut.select("c1", "c2", "k1", "k2", "first", "own")
    place: Column = F.xxhash64("k1", "k2", "first")
    whole = places.groupBy("c1", "c2").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.first("own").alias("own")).where("p <> q").select("c1", "c2", F.lit(0).alias("a"), F.col("own").alias("b"))
    found = repeated_runs(distinct, length, gram, shard, crowd).union(whole).groupBy("c1", "c2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    # Written, so that the join below is one of two plain exchanges and Spark can split a piece that very many texts hold.
    runs = checkpointed(found)
    back = places.join(runs, ["c1", "c2"]).select("k1", "k2", F.transform("runs", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"]).alias("b"))).alias("runs"))
    copies = keyed.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where((F.col("n") > 1) & (F.col("size") >= length))
    copies = copies.select("k1", "k2", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), (F.col("size") - length + 1).cast("bigint").alias("b"))).alias("runs"))
    return back.union(copies).groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))


def _with_ranges(docs: DataFrame, length: int, **how) -> DataFrame:
    keyed = _keyed(docs).alias("d")
    found = repeated_ranges(docs, length, **how).alias("r")
    return keyed.join(found, F.expr("d.k1 = r.k1 AND d.k2 = r.k2"), "left").select("d.doc_id", "r.runs", "d.text")


def _removed(text: str, runs: list | None, length: int) -> tuple[bytes, list[tuple[int, int]], bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    gone = cover([(r["a"], r["b"]) for r in runs or ()], len(raw), length)
    kept, at = [], 0
    for a, b in gone:
        kept.append(raw[at:a])
        at = b
    return raw, gone, b"".join([*kept, raw[at:]])


def removal_report(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of `docs`."""

    def read(ids, runs, texts):
        done = [_removed(t, r, length) for t, r in zip(texts, runs, strict=True)]
        return ids, [len(raw) for raw, _, _ in done], [sum(b - a for a, b in gone) for _, gone, _ in done], [len(gone) for _, gone, _ in done], [hashlib.sha256(kept).hexdigest() for _, _, kept in done]

    return map_rows(_with_ranges(docs, length, **how), read, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", ["doc_id", "runs", "text"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id and the text without its repeated strings; bytes of characters cut in two are dropped."""

    def read(ids, runs, texts):
        return ids, [_removed(t, r, length)[2].decode("utf-8", "ignore") for t, r in zip(texts, runs, strict=True)]

    return map_rows(_with_ranges(docs, length, **how), read, "doc_id bigint, text string", ["doc_id", "runs", "text"])
