"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two fingerprints of 8 bytes that differ in at most `distance` bits agree in at least 8 - distance bytes. Postings are keyed by
that many positional bytes, so a pair meets in a posting only if its tally of shared positional bytes reaches the guaranteed
minimum; what meets is tallied and verified bit by bit. A crowded posting is cut once more by bands of the bits in which its rows vary, of which a linked pair
shares one. A pair that meets in several postings counts in the first alone, and within a
posting a search leaves a spanning forest of its links in place of all pairs, which keeps every class whole. Classes follow from star contraction over distinct fingerprints.
Defined results: null and empty texts have fingerprint 0 and are linked like any other; texts with fewer words than a shingle
are one shingle; rows with a null id get the class of their fingerprint, and a class of null ids alone has a null class id; repeated rows get equal
results; very long texts are hashed in parts; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, bit_filter, checkpointed, documents, in_filter, map_rows, packed, slices

SEED = 42


def shingle_hashes(text: str, width: int, seed: int = SEED, step: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles in order (A-Z lower-cased, space-joined), `step` at a time; fewer words than `width` are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    for at in range(0, max(len(words) - width + 1, min(len(words), 1)), step):
        part = words[at : at + step + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = np.concatenate(([0], ends[:-1])).tolist()
        last = (ends[width - 1 :] - 1).tolist() or [len(joined)]
        yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, last, strict=False)), np.uint64, len(last))


def majority(hashes: Iterator[np.ndarray]) -> int:
    """64 bits: each is 1 if set in over half of the hashes; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def fingerprint(text: str, shingle: int = 4, seed: int = SEED) -> int:
    """The majority bits of the text's shingles, repeats included."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = SEED) -> DataFrame:
    """doc_id and `fp`, the fingerprint's 64 bits as a bigint."""

    def read(ids, texts):
        return ids, np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)

    return map_rows(documents(docs), read, "doc_id bigint, fp bigint", ["doc_id", "text"])


def masks(agree: int) -> list[int]:
    """For each choice of `agree` byte positions, those bytes' bits, as signed 64-bit numbers."""
    out = [sum(0xFF << 8 * p for p in at) for at in combinations(range(8), agree)]
    return [m - 2**64 if m >= 2**63 else m for m in out]


def turns(agree: int) -> np.ndarray:
    """For each set of agreeing byte positions (as bits), the number of the posting whose turn the pair is: the first of `agree` of them.

    A pair with more agreeing bytes than that meets in several postings and counts in this one alone; -1 for too few.
    """
    number = {at: n for n, at in enumerate(combinations(range(8), agree))}
    first = [tuple(p for p in range(8) if s >> p & 1)[:agree] for s in range(256)]
    return np.array([number.get(at, -1) for at in first])


def _bits(diff: np.ndarray, turn: np.ndarray, slot: int) -> np.ndarray:
    """Differing bits of pairs whose turn is `slot`, from their tally of agreeing positional bytes; 99 for other pairs."""
    agreeing = np.packbits(diff.view(np.uint8).reshape(*diff.shape, 8) == 0, axis=-1, bitorder="little")[..., 0]
    return np.where(turn[agreeing] == slot, np.bitwise_count(diff), 99)


def _reach(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of the places 0 to n - 1, where `near(some, others)` tells which are linked.

    Each step compares the newly reached with those not reached yet, so a clique of n costs n comparisons, not n squared.
    """
    left, edges = np.arange(n), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[:64], front[64:]
            linked = near(at, left)
            hit = linked.any(0)
            edges += zip(at[linked.argmax(0)[hit]].tolist(), left[hit].tolist(), strict=True)
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return edges


def forest(fps: np.ndarray, distance: int, turn: np.ndarray, slot: int) -> list[tuple[int, int]]:
    """A spanning forest of the links whose turn is `slot`: pairs of positions."""
    return _reach(len(fps), lambda at, left: _bits(fps[at][:, None] ^ fps[left][None, :], turn, slot) <= distance)


#: Rows of a posting that are compared as they are, 2^distance at least; a larger one is cut by further bits.
CROWD = 2048


def bands(varying: int, distance: int) -> list[int]:
    """The bits of `varying` in distance + 1 masks: fingerprints that differ in these bits alone, and in `distance` of them at most, agree in one of the masks."""
    bits = [b for b in range(64) if varying >> b & 1]
    return [sum(1 << b for b in bits[k :: distance + 1]) for k in range(distance + 1)]


def _links(batches: Iterator[pa.RecordBatch], distance: int, turn: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (slot, path, key, fingerprint) sorted by the first three, a posting's key: links (a, b) between fingerprints within each posting, with slot -1.

    A spanning forest of each posting's own pairs keeps all classes whole, as every link is some posting's. The rows of postings with more than CROWD are
    passed on as they come (a is the fingerprint, b the key), so none is held whole.
    """
    rest, passing = np.zeros((4, 0), np.int64), None

    def links(rows: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((np.diff(rows[:3]) != 0).any(0)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [rows.shape[1]]])
        fps, node = rows[3].view(np.uint64), rows[3]
        slot = rows[0]
        two = begin[end - begin == 2]
        agreeing = np.packbits((fps[two] ^ fps[two + 1]).view(np.uint8).reshape(-1, 8) == 0, axis=-1, bitorder="little")[:, 0]
        two = two[(np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance) & (turn[agreeing] == slot[two])]
        a, b = [node[two]], [node[two + 1]]
        for s, e in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist(), strict=True):
            if (pairs := np.array(forest(fps[s:e], distance, turn, int(slot[s])), np.int64).reshape(-1, 2)).size:
                a.append(node[s + pairs[:, 0]])
                b.append(node[s + pairs[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        return _found(np.minimum(a, b), np.maximum(a, b), np.full(len(a), -1), np.zeros(len(a), np.int64))

    for batch in batches:
        rows = np.concatenate([rest, np.stack([np.asarray(c) for c in batch.columns])], axis=1)
        if rows.shape[1] == 0:
            continue
        begin = np.concatenate([[0], np.flatnonzero((np.diff(rows[:3]) != 0).any(0)) + 1])
        end = np.concatenate([begin[1:], [rows.shape[1]]])
        crowded = end - begin > CROWD
        if passing is not None and (rows[:3, 0] == passing).all():
            crowded[0] = True
        passing = rows[:3, -1].copy() if crowded[-1] else None
        closed = np.repeat(~crowded, end - begin)
        if passing is None:  # the last run may go on in the next batch
            closed[begin[-1] :] = False
        opened = np.repeat(crowded, end - begin)
        if closed.any():
            yield links(rows[:, closed])
        if opened.any():
            yield _found(rows[3, opened], rows[2, opened], rows[0, opened], rows[1, opened])
        rest = rows[:, :0] if passing is not None else rows[:, begin[-1] :]
    if rest.shape[1]:
        yield links(rest)


def _found(a: np.ndarray, b: np.ndarray, slot: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, slot, path)], names=["a", "b", "slot", "path"])


def _cut_up(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (slot, path, fingerprint, the bits that vary in its posting) of crowded postings as rows of the distance + 1 postings that each becomes."""
    for batch in batches:
        slot, path, fp, varying = (np.asarray(c) for c in batch.columns)
        for bits in np.unique(varying).tolist():
            own = varying == bits
            for n, band in enumerate(bands(bits & 2**64 - 1, distance)):
                key = fp[own] & np.uint64(band).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (slot[own], path[own] * 31 + n + 1, key, fp[own])], names=["slot", "path", "key", "fp"])


def near_links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Distinct links (a < b) between the distinct fingerprints of `fps`: enough of them to join each class.

    A crowded posting is dealt out once more by bands of the bits in which its rows vary, of which a linked pair shares one, and so on while one is crowded. `path` tells
    the postings apart that come from different ones; it is a hash, and two that shared it would only be compared together.
    """
    if not 0 < distance < 8:
        raise ValueError("the byte index serves distances from 1 to 7")
    agree = 8 - distance
    slots = F.array(*[F.struct(F.lit(n).cast("bigint").alias("slot"), F.lit(m).alias("mask")) for n, m in enumerate(masks(agree))])
    spread = fps.select("fp").distinct().select("fp", F.explode(slots).alias("c"))
    rows = spread.select("c.slot", F.lit(0).cast("bigint").alias("path"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("key"), "fp")
    turn, key, links = turns(agree), ["slot", "path", "key"], None
    while True:
        dealt = rows.repartition(*key).sortWithinPartitions(*key)
        found = packed(dealt.mapInArrow(lambda b: _links(b, distance, turn), "a bigint, b bigint, slot bigint, path bigint"))
        own = found.where("slot < 0").select("a", "b")
        links = own if links is None else links.union(own)
        crowded = found.where("slot >= 0").select("slot", "path", F.col("b").alias("key"), F.col("a").alias("fp"))
        if crowded.isEmpty():
            return links.distinct()
        varying = crowded.groupBy(*key).agg(F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying"))  # one row for each crowded posting
        rows = crowded.join(varying, key).select("slot", F.xxhash64("path", "key").alias("path"), "fp", "varying").mapInArrow(lambda b: _cut_up(b, distance), "slot bigint, path bigint, key bigint, fp bigint")


def _ends(edges: DataFrame, one: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Two rows (a, b) per row of `edges`: the columns named by `one`, and those named by `other`."""
    return edges.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (one, other)])).alias("e")).select("e.*")


def stars(edges: DataFrame) -> bool:
    """Whether `edges` (a > b) are stars around their smallest nodes: no node has two smaller neighbours, or a smaller and a larger one."""
    one = F.lit(1)
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), one.alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), one.alias("down")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down")).where("up + down > 1").isEmpty()


def classes(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, class) for each node of a link, the class being its smallest node: alternating large and small stars, until each class is one star."""
    edges = packed(links.where("a <> b").select("a", "b"))
    for _ in range(most):
        both = _ends(edges, ("a", "b"), ("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = packed(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = packed(_ends(down.join(least, "a"), ("b", "m"), ("a", "m")).where("a <> b").distinct())
        if stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("class")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())
    raise RuntimeError(f"no stars after {most} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable): one row per row of `docs`."""
    fps = checkpointed(fingerprints(docs, shingle))
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("own"))
    found = classes(near_links(fps, distance))
    joined = own.join(found, own.fp == found.node, "left").select("fp", "own", F.coalesce("class", "fp").alias("class"))
    # Classes of several fingerprints alone need a second aggregation, over fingerprints, not documents.
    named = joined.groupBy("class").agg(F.min("own").alias("component_id"))
    by_fp = joined.select("fp", "class").join(named, "class").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The similarity of the deduplicating operator: Jaccard of the sets of WIDTH-word shingles.
WIDTH, SIMILARITY = 5, 0.8
#: Buckets (as bits) in which shingles are counted for their order, the bits of a set's parity, and the rows of a posting compared in one group.
BUCKETS, PARITY, BLOCK = 22, 1024, 4096
#: Postings of a node that tell where a pair of nodes has its turn.
LEAD = 8


def _shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of all word shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes; 1 for two empty sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def rarity(keyed: DataFrame, least: int = 8, most: int = 1 << 16) -> np.ndarray:
    """For each of 2^BUCKETS buckets of shingle hashes, the binary logarithm of its count where that is large, else 0.

    It only puts shingles in an order; any order finds the same pairs, and this one keeps common shingles out of prefixes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(1 << BUCKETS, np.int64), [], 0
        for batch in batches:
            for part in slices(batch, 512, 1 << 20):
                for t in part.column(0).to_pylist():
                    held.append((_shingles(t) >> np.uint64(64 - BUCKETS)).astype(np.int64))
                    n += len(held[-1])
                if n >= 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total >= max(least, 4 * total.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = keyed.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "bucket").limit(most).toArrow()
    out = np.zeros(1 << BUCKETS, np.uint8)
    out[np.asarray(found["bucket"])] = np.log2(np.asarray(found["n"], float)).astype(np.uint8) if len(found) else 0
    return out


def prefix(hashes: np.ndarray, levels: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The first hashes of a set in the order of `levels`: sets with a similarity of `least` or more share one of them; 0 for an empty set."""
    if len(hashes) == 0:
        return np.zeros(1, np.uint64)
    size = len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1
    return hashes[np.lexsort((hashes, levels[hashes >> np.uint64(64 - BUCKETS)]))[:size]]


def parity(hashes: np.ndarray) -> np.ndarray:
    """Positional bits, each telling if the hashes of its own share are odd in number: sets differ in at least as many hashes as in bits.

    There are PARITY bits, or as many more, in powers of two, as a larger set has hashes; `folded` makes them comparable.
    """
    bits = max(PARITY, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else PARITY
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of positional bits (in any unit) with `size` of them: the bits of shares that fall together are added."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def prefix_rows(keyed: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """node, size, bits, keys, fp of each different text of `keyed` (node, other, text): its shingles' number, parity, prefix and fingerprint.

    `other` is a second hash of the text; of texts with one node that of the smallest is read.
    """
    levels = keyed.sparkSession.sparkContext.broadcast(rarity(keyed))

    def read(nodes, others, texts):
        sets = [_shingles(t) for t in texts]
        return nodes, others, [len(h) for h in sets], [parity(h).tobytes() for h in sets], [prefix(h, levels.value, least).view(np.int64) for h in sets], np.array([majority([h]) for h in sets], np.uint64).view(np.int64)

    rows = map_rows(keyed, read, "node bigint, other bigint, size bigint, bits binary, keys array<bigint>, fp bigint", ["node", "other", "text"])
    own = rows.groupBy("node").agg(F.min_by(F.struct("size", "bits", "keys", "fp"), "other").alias("r"))
    return packed(own.select("node", "r.*"))


def fingerprint_pairs(rows: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a < b) of nodes of `rows` (node, fp) that the byte-position index finds: the smallest nodes of linked fingerprints, and each node with the smallest of its own."""
    first = packed(rows.groupBy("fp").agg(F.min("node").alias("first")))
    equal = rows.select("node", "fp").join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    end = lambda e: first.select(F.col("fp").alias(e), F.col("first").alias(f"{e}_first"))
    linked = near_links(first, distance).join(end("a"), "a").join(end("b"), "b")
    return equal.union(linked.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b")))


def meetings(rows: DataFrame) -> DataFrame:
    """key, node, low, high of the postings with more than one node: low and high are the smallest and largest node there."""
    postings = rows.select("node", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    return packed(postings.join(shared, "key"))


def shingle_sets(keyed: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(node, held) with all shingle hashes of the texts of `nodes`; a bit filter tells the scan of the texts which to read, so no text is moved.

    The filter has some eight bits for each of `most` nodes, and FILTER_BITS at most; what it lets through beyond them is dropped after.
    """
    bits = min(FILTER_BITS, max(1 << 20, 1 << (8 * most).bit_length()))
    wanted = keyed.sparkSession.sparkContext.broadcast(bit_filter(nodes.select("node"), bits))

    def read(nodes, others, texts):
        at = np.flatnonzero(in_filter(wanted.value, np.array(nodes, np.int64), bits)).tolist() if nodes else []
        return [nodes[k] for k in at], [others[k] for k in at], [_shingles(texts[k]).tobytes() for k in at]

    sets = map_rows(keyed, read, "node bigint, other bigint, held binary", ["node", "other", "text"]).groupBy("node").agg(F.min_by("held", "other").alias("held"))
    return packed(sets.join(nodes, "node", "left_semi"), 1 << 11)


def plausible(pairs: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The distinct `pairs` (a, b) whose sizes and parities allow a similarity of `least`."""
    end = lambda e: rows.select(F.col("node").alias(e), F.col("size").alias(f"size_{e}"), F.col("bits").alias(f"bits_{e}"))
    both = pairs.distinct().join(end("a"), "a").join(end("b"), "b").where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * least - 1e-6)

    def tally(a, b, size_a, size_b, bits_a, bits_b):
        apart = np.zeros(len(a), np.int64)
        for k, (x, y) in enumerate(zip(bits_a, bits_b, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            least_bits = min(len(x), len(y))
            apart[k] = np.bitwise_count(folded(x, least_bits) ^ folded(y, least_bits)).sum(dtype=np.int64)
        at = _allowed(apart, np.array(size_a, np.int64) + np.array(size_b, np.int64), least)
        return [[c[k] for k in np.flatnonzero(at).tolist()] for c in (a, b)]

    return map_rows(both, tally, "a bigint, b bigint", ["a", "b", "size_a", "size_b", "bits_a", "bits_b"])


def _allowed(bits_apart: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Whether the tally of agreeing positional bits reaches the least that sets of a similarity of `least` and of `sizes` together guarantee."""
    return bits_apart <= sizes * (1 - least) / (1 + least) + 1e-9


def verified(pairs: DataFrame, keyed: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The distinct `pairs` (a, b) whose texts have a similarity of `least` or more, by all of their shingles."""
    pairs = packed(pairs)
    sets = shingle_sets(keyed, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * pairs.count())
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("sb")), "b")

    def verify(a, b, sa, sb):
        kept = [(x, y) for x, y, p, q in zip(a, b, sa, sb, strict=True) if similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= least]
        return [x for x, _ in kept], [y for _, y in kept]

    return packed(map_rows(both, verify, "a bigint, b bigint", ["a", "b", "sa", "sb"]))


def _open_pairs(size: np.ndarray, kind: np.ndarray, bits: list[bytes], part: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows of different classes whose sizes and parities allow a similarity of `least`.

    Rows of two parts are only paired across them.
    """
    order = np.argsort(size, kind="stable")
    size, kind, part = size[order], kind[order], part[order]
    rows = [np.frombuffer(bits[k], np.uint64) for k in order.tolist()]
    across = bool((part != part[:1]).any())
    end = np.searchsorted(size, size / least + 1e-9, side="right")
    level, held = 0, np.zeros((0, 0), np.uint64)
    for i, e in enumerate(end.tolist()):
        if len(rows[i]) != level:  # larger sets have more bits: all that rows of this level may be compared with, folded to it
            level, first = len(rows[i]), i
            last = int(np.searchsorted(size, max(s for s, r in zip(size[i:].tolist(), rows[i:], strict=True) if len(r) == level) / least + 1e-9, side="right"))
            held = np.stack([folded(r, level) for r in rows[i:last]])
        apart = kind[i + 1 : e] != kind[i]
        if across:
            apart &= part[i + 1 : e] != part[i]
        at = i + 1 + np.flatnonzero(apart)
        if len(at):
            bits_apart = np.bitwise_count(held[at - first] ^ held[i - first]).sum(1, dtype=np.int64)
            at = at[_allowed(bits_apart, size[at] + size[i], least)]
            yield np.full(len(at), order[i]), order[at]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first `keys` columns, one run of equal ones after the other."""
    rest: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rows.num_rows == 0:
            continue
        key = np.stack([rows.column(c).to_numpy() for c in range(keys)])
        cut = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), rows.num_rows]
        if rest and any(rest[-1].column(c)[0].as_py() != key[c, 0] for c in range(keys)):
            yield pa.concat_tables(rest)
            rest = []
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            rest.append(rows.slice(s, e - s))
            if e < rows.num_rows:
                yield pa.concat_tables(rest)
                rest = []
    if rest:
        yield pa.concat_tables(rest)


def _turns(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """For each pair of rows of leading postings the smallest one that both hold, or `key` without any."""
    shared = (a[:, :, None] == b[:, None, :]).any(2)
    return np.where(shared.any(1), np.where(shared, a, 2**63 - 1).min(1), key)


def open_pairs(met: DataFrame, known: DataFrame, rows: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Pairs (a < b) of nodes of different classes of `known` (node, class) that meet in a posting and that size and parity don't rule out.

    In postings of up to three nodes every pair has the smallest or the largest one, so these are left out.
    A posting of more than `block` rows is dealt into blocks, and each two of them are compared in a group of their own, so none grows with the posting.
    A pair that meets in several postings has its turn in one: the smallest that both have among their LEAD first, if there is such a one.
    """
    named = packed(met.join(known, "node", "left").select("key", "node", F.coalesce("class", "node").alias("class")))
    several = named.groupBy("key").agg(F.min("class").alias("c"), F.max("class").alias("d"), F.count("*").alias("n")).where("c <> d AND n > 3").select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = named.join(several, "key").select("key", "node", "class", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    group = ["key", "i", "j"]
    first = named.join(several, "key").groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("all"))
    lead = first.select("node", F.transform(F.sequence(F.lit(0), F.lit(LEAD - 1)), lambda k: F.get("all", F.least(k, F.size("all") - 1))).alias("lead"))
    known = rows.select("node", "size", "bits").join(lead, "node")
    held = dealt.join(known, "node").select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "class", "size", "bits", "lead")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, len(group)):
            part, node, kind, size = (run.column(c).to_numpy() for c in range(3, 7))
            if run.column(1)[0] != run.column(2)[0] and (part == part[0]).all():
                continue  # of two blocks one is empty
            key, lead = run.column(0)[0].as_py(), np.array(run.column(8).to_pylist(), np.int64)
            for x, y in _open_pairs(size, kind, run.column(7).to_pylist(), part, least):
                now = _turns(lead[x], lead[y], key) == key
                x, y = node[x[now]], node[y[now]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return held.repartition(*group).sortWithinPartitions(*group).mapInArrow(pairs, "a bigint, b bigint").distinct()


def similar_links(keyed: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (a < b) between nodes of `keyed` (node, other, text) whose texts have a similarity of `least` or more: enough of them to join each class.

    The byte-position index gives pairs of near fingerprints. A fingerprint can't promise a similarity, so an exact step follows: similar texts share a shingle of
    their prefixes, and in each such posting all nodes are paired with its smallest and its largest one. Both kinds of pairs are verified, which joins most
    classes by few of them; then every pair that meets between the classes that this leaves is verified.
    """
    rows = prefix_rows(keyed, least)
    met = meetings(rows)
    star = F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b"))))
    pairs = met.select(star.alias("p")).select("p.*").where("a <> b").union(fingerprint_pairs(rows))
    likely = verified(plausible(pairs, rows, least), keyed, least)
    return likely.union(verified(open_pairs(met, classes(likely), rows, least), keyed, least))


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` with one document of each class of near-duplicates: that of the smallest id, nulls last.

    Equal texts are one class; so are texts linked by `similar_links`. Of rows that agree in id and text the first in the order of all their
    columns stays. Null, empty and blank texts are one class. Texts are told apart by 128 bits of hash; nodes have the first 64, and a text
    that shares them with a different one is a class of its own. An empty table gives no rows; extra columns are kept and never read.
    """
    text = F.coalesce("text", F.lit(""))
    own = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text).alias("node"), F.xxhash64(F.lit(WIDTH), text).alias("other")]
    found = classes(similar_links(docs.select(*own[1:], text.alias("text")), least))
    texts = packed(docs.select(*own).groupBy("node", "other").agg(F.min("id").alias("id")))
    read = texts.groupBy("node").agg(F.min("other").alias("other"))
    named = texts.join(read.join(found, "node", "left").withColumn("class", F.coalesce("class", "node")), ["node", "other"], "left")
    alone = F.when(F.col("class").isNull(), F.struct("node", "other"))
    stay = named.groupBy("class", alone.alias("alone")).agg(F.min(F.struct("id", "node", "other")).alias("stay")).select("stay.*")
    key = ["id", "node", "other"]
    kept = docs.select(F.struct("*").alias("row"), *own).join(stay, key, "left_semi")
    turn = Window.partitionBy(*key).orderBy(F.to_json("row"))
    return kept.withColumn("turn", F.row_number().over(turn)).where("turn = 1").select("row.*")
