"""Hard negatives by whole inner products, with early discards in a rotated space.

An orthogonal rotation to the principal axes puts most of a product into its leading components. For a block of anchors against a tile of rows, products of
the leading components are accumulated group by group; what is left of a product is at most the product of the residual norms, so a pair is discarded
as soon as its partial product plus that bound and a slack for rounding lies under what the anchor already has, or outside the wanted range. Survivors are
verified by products of whole numbers, so results don't depend on the rotation, whose axes come from the second moments of all rows.
Anchors are taken in blocks of bounded size; each block meets all rows twice: for the positives, whose scores bound the range, and for the negatives. A task
keeps the best of each anchor only, and these are ranked in one window per anchor.
Defined results: rows with a null label, or a null, empty or non-finite vector take no part; null ids are no anchors and stand last among ties; rows of equal ids
are rows of their own, an anchor being other than its repetitions; vectors of another length than the first one or components beyond 2^28 after scaling are an
error; an anchor without positives, and a positive without negatives, give no rows; an empty table gives none; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import matrix, usable_rows

SCALE = 256
#: Bytes of a block of anchors, rows of a tile, pairs verified at once, and the share of survivors under which pairs are followed one by one.
BLOCK_BYTES, TILE, PAIRS, SPARSE = 1 << 21, 256, 1 << 16, 0.25
#: Relative slack for the rounding of rotated products.
SLACK = 1e-9
NO_ID = np.iinfo(np.int64).max


class Side(NamedTuple):
    """Whole vectors, the same rotated, the norm of what each group of components leaves, and the norm of all."""

    whole: np.ndarray
    rotated: np.ndarray
    left: np.ndarray
    norm: np.ndarray


def groups(dims: int) -> list[int]:
    """Where the groups of leading components end: an eighth, a quarter, half and all of them."""
    return sorted({max(1, dims // 8), max(1, dims // 4), max(1, dims // 2), dims})


def side(whole: np.ndarray, rotation: np.ndarray) -> Side:
    rotated = whole.astype(np.float64) @ rotation
    squares = rotated**2
    return Side(whole, rotated, np.stack([np.sqrt(squares[:, e:].sum(1)) for e in groups(whole.shape[1])]), np.sqrt(squares.sum(1)))


def principal_axes(moments: np.ndarray) -> np.ndarray:
    """Orthogonal columns, those of the largest second moments first."""
    return np.ascontiguousarray(np.linalg.eigh(moments)[1][:, ::-1])


def survivors(a: Side, x: Side, wanted, allowed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, whole product) of the `allowed` pairs that `wanted(anchor, least, most)` doesn't discard by the bounds of their products.

    `wanted` takes the bounds of all pairs of anchors and rows, or of single pairs with the anchor of each.
    """
    ends = groups(a.whole.shape[1])
    partial, alive, begin, every = np.zeros(allowed.shape), allowed, 0, None
    slack = SLACK * np.outer(a.norm, x.norm) + 1
    for g, end in enumerate(ends[:-1]):
        partial += a.rotated[:, begin:end] @ x.rotated[:, begin:end].T
        room = np.outer(a.left[g], x.left[g]) + slack
        alive = alive & wanted(every, partial - room, partial + room)
        begin = end
        if np.count_nonzero(alive) <= SPARSE * alive.size:
            break
    first, second = np.nonzero(alive)
    for at in range(0, len(first), PAIRS):
        i, j = first[at : at + PAIRS], second[at : at + PAIRS]
        known = partial[i, j]
        for h in range(g + 1, len(ends) - 1) if len(ends) > 1 else ():
            known = known + np.einsum("ij,ij->i", a.rotated[i, ends[h - 1] : ends[h]], x.rotated[j, ends[h - 1] : ends[h]])
            room = a.left[h][i] * x.left[h][j] + slack[i, j]
            keep = wanted(i, known - room, known + room)
            i, j, known = i[keep], j[keep], known[keep]
        yield i, j, np.einsum("ij,ij->i", a.whole[i], x.whole[j])


class Best:
    """The first `most` rows of each slot by score and id."""

    def __init__(self, slots: int, most: int, least: np.ndarray) -> None:
        self.most, self.least = most, least.astype(np.float64)  # the score that a further row must reach
        self.slot, self.score, self.id, self.uid = (np.zeros(0, np.int64) for _ in range(4))
        self.slots = slots

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        if len(slot) == 0:
            return
        cols = [np.concatenate(c) for c in ((self.slot, slot), (self.score, score), (self.id, ids), (self.uid, uid))]
        order = np.lexsort((cols[3], cols[2], -cols[1], cols[0]))
        cols = [c[order] for c in cols]
        begin = np.searchsorted(cols[0], cols[0])
        rank = np.arange(len(order)) - begin
        self.slot, self.score, self.id, self.uid = (c[rank < self.most] for c in cols)
        full = rank == self.most - 1
        self.least[cols[0][full]] = cols[1][full]


def second_moments(rows: DataFrame, dims: int, scale: int) -> np.ndarray:
    """The sum over all rows of the products of each two components."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0), scale, dims).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dims)), pa.array(list(total), pa.list_(pa.float64()))], names=["place", "total"])

    found = rows.select("vector").mapInArrow(partial, "place bigint, total array<double>").groupBy("place").agg(F.array(*[F.sum(F.get("total", F.lit(k))) for k in range(dims)]).alias("total"))
    out = np.zeros((dims, dims))
    for r in found.collect():  # `dims` rows
        out[r.place] = r.total
    return out


def _tiles(batches: Iterator[pa.RecordBatch], scale: int, rotation: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Side]]:
    """(uid, id, label, vectors) of the rows, a tile at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            uid, ids, label = (np.asarray(part.column(c).fill_null(NO_ID)) for c in range(3))
            yield uid, ids, label, side(matrix(part.column(3), scale, len(rotation)), rotation)


class Block(NamedTuple):
    """A block of anchors: their numbers as rows, ids, labels and vectors."""

    uid: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vectors: Side


def _anchor_block(found: pa.Table, scale: int, rotation: np.ndarray) -> Block:
    uid, ids, label = (found.column(c).to_numpy() for c in range(3))
    return Block(uid, ids, label, side(matrix(found.column(3).combine_chunks(), scale, len(rotation)), rotation))


def _positives(rows: DataFrame, block, rotation, scale: int, most: int) -> DataFrame:
    """(anchor, id, uid, score, rank): of each anchor (its place in the block) the best other rows of its label."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        found = Best(len(own.uid), most, np.full(len(own.uid), -np.inf))
        for uid, ids, label, x in _tiles(batches, scale, rotation.value):
            allowed = (own.label[:, None] == label[None, :]) & (own.uid[:, None] != uid[None, :])
            wanted = lambda i, least, most: most >= (found.least[:, None] if i is None else found.least[i])
            for i, j, score in survivors(own.vectors, x, wanted, allowed):
                found.add(i, score, ids[j], uid[j])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (found.slot, found.id, found.uid, found.score)], names=["anchor", "id", "uid", "score"])

    kept = rows.mapInArrow(best, "anchor bigint, id bigint, uid bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "uid"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most)


def _negatives(rows: DataFrame, block, ranges, rotation, scale: int, most: int) -> DataFrame:
    """(anchor, id, uid, score): of each anchor the rows of other labels that are among the best of any of its ranges within a task.

    `ranges` holds the least and the most score per anchor and positive; a range without scores has a least above its most.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (low, high) = block.value, ranges.value
        found = [Best(len(own.uid), most, low[:, q]) for q in range(low.shape[1])]
        for uid, ids, label, x in _tiles(batches, scale, rotation.value):

            def wanted(i, least, most):
                if i is None:
                    return np.logical_or.reduce([(most >= f.least[:, None]) & (least <= high[:, q, None]) for q, f in enumerate(found)])
                return np.logical_or.reduce([(most >= f.least[i]) & (least <= high[i, q]) for q, f in enumerate(found)])

            for i, j, score in survivors(own.vectors, x, wanted, own.label[:, None] != label[None, :]):
                for q, f in enumerate(found):
                    at = (score >= low[i, q]) & (score <= high[i, q])
                    f.add(i[at], score[at], ids[j[at]], uid[j[at]])
        every = np.unique(np.concatenate([np.stack([f.slot, f.id, f.uid, f.score]) for f in found], axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in every], names=["anchor", "id", "uid", "score"])

    return rows.mapInArrow(best, "anchor bigint, id bigint, uid bigint, score bigint")


def hard_negatives(embeddings: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors` tells anchors among the rows (vec_id, label, embedding). Each anchor's positives are its best other rows of its label; for each of them the first
    `negatives` rows of other labels whose score is from `low` to `high` hundredths of the positive's.
    """
    spark = embeddings.sparkSession
    usable = usable_rows(embeddings, F.col("label").cast("bigint").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor")).where("label IS NOT NULL")
    rows = checkpointed(usable.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "vector", F.col("anchor") & F.col("vec_id").isNotNull()).toDF("uid", "vec_id", "label", "vector", "anchor"))
    first = rows.select("vector").head()
    if first is None:
        return spark.createDataFrame([], RESULT)
    dims = len(first.vector)
    rotation = spark.sparkContext.broadcast(principal_axes(second_moments(rows, dims, scale)))
    chosen, read = rows.where("anchor").select("uid", "vec_id", "label", "vector"), rows.select("uid", "vec_id", "label", "vector")
    blocks = math.ceil(chosen.count() * dims * 8 / block_bytes)
    parts = []
    for b in range(blocks):
        own = _anchor_block(chosen.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).toArrow(), scale, rotation.value)
        block = spark.sparkContext.broadcast(own)
        met = _positives(read, block, rotation, scale, positives).toArrow()  # `positives` rows for each anchor of the block
        anchor, ids, _, score, rank = (met.column(c).to_numpy() for c in range(5))
        least, most = np.zeros((len(own.uid), positives), np.int64), np.full((len(own.uid), positives), -1, np.int64)
        least[anchor, rank - 1], most[anchor, rank - 1] = -(-low * score // 100), high * score // 100
        ranges = spark.sparkContext.broadcast((least, most))
        place = spark.createDataFrame(list(zip(anchor.tolist(), own.id[anchor].tolist(), [None if i == NO_ID else i for i in ids.tolist()], rank.tolist(), score.tolist(), least[anchor, rank - 1].tolist(), most[anchor, rank - 1].tolist(), strict=True)), "anchor bigint, anchor_id bigint, positive_id bigint, turn int, positive_score bigint, least bigint, most bigint")
        near = _negatives(read, block, ranges, rotation, scale, negatives).join(place, "anchor").where("score BETWEEN least AND most")
        order = F.row_number().over(Window.partitionBy("anchor", "turn").orderBy(F.desc("score"), "id", "uid"))
        found = near.withColumn("rank", order).where(F.col("rank") <= negatives)
        parts.append(found.select("anchor_id", "positive_id", "rank", F.nullif("id", F.lit(NO_ID)).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        if blocks > 1:
            parts[-1] = checkpointed(parts[-1])
    out = spark.createDataFrame([], RESULT)
    for p in parts:
        out = out.union(p)
    return out


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
#: The query over `embeddings`, with every product made.
SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
s AS MATERIALIZED (SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM k a JOIN k b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0),
p AS MATERIALIZED (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY anchor, p.uid ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor) WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
"""
