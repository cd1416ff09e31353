"""Vector codes: each part of a vector is stored as the number of the nearest entry of its part's codebook.

Codebooks come from rounds of assigning all parts and replacing entries by floors of means, in whole numbers throughout. The nearest entry is found in
a vantage-point tree over the entries of a part position: each node holds one entry, and beyond the median of their distances to it the others go to the
outer child. All rows of a batch go down the tree together. A child is visited unless its interval of distances, with radii rounded outwards,
lies beyond the best distance so far; ties are visited too (non-strict), and what is visited is compared by whole squared distances, of equal ones the
lower entry. Spark adds up sums and counts per part and entry, of which there are a fixed number.
Defined results: rows with a null vector, an empty one, or a null or non-finite component are dropped; null ids stand last when the first entries are chosen, and rows of
equal ids stand by their components; equal rows get equal codes; with fewer rows than entries there are as many entries as rows; null labels are one label;
vectors of another length than that of the first row, one that 8 doesn't divide, or components beyond 2^28 after scaling are an error; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import matrix, usable_rows

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that go down a tree together, and labels whose sums are copied to every task.
BATCH, LABELS = 4096, 1 << 16


class Node(NamedTuple):
    """A vantage entry, the radius that parts the others, and per child its tree and the least and greatest distance of its entries."""

    entry: int
    radius: float
    children: tuple[tuple["Node", float, float], ...]


def _down(x: np.ndarray | float):
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def _up(x: np.ndarray | float):
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def build_tree(entries: np.ndarray, members: list[int] | None = None) -> Node | None:
    """The tree of the numbered entries (whole numbers); equal entries have distance 0 and are leaves of their own."""
    members = list(range(len(entries))) if members is None else members
    if not members:
        return None
    vantage, rest = members[0], members[1:]
    if not rest:
        return Node(vantage, 0.0, ())
    distance = np.sqrt(((entries[rest] - entries[vantage]) ** 2).sum(1).astype(np.float64))
    order = np.argsort(distance, kind="stable")
    half = (len(rest) + 1) // 2
    children = []
    for at in (order[:half], order[half:]):
        if len(at):
            children.append((build_tree(entries, [rest[k] for k in at]), float(_down(distance[at].min())), float(_up(distance[at].max()))))
    return Node(vantage, float(distance[order[half - 1]]), tuple(children))


def nearest(tree: Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each point's nearest entry, the lower of equally near ones; and how many distances were computed."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    entry = np.zeros(len(points), np.int64)
    bound = np.full(len(points), np.inf)  # the best distance, rounded up
    looked = 0

    def visit(node: Node, at: np.ndarray) -> None:
        nonlocal looked
        looked += len(at)
        square = ((points[at] - entries[node.entry]) ** 2).sum(1)
        better = (square < best[at]) | ((square == best[at]) & (node.entry < entry[at]))
        won = at[better]
        best[won], entry[won] = square[better], node.entry
        distance = np.sqrt(square.astype(np.float64))
        bound[won] = _up(distance[better])
        low, high = _down(distance), _up(distance)
        inner = distance <= node.radius
        for first in (True, False):  # each point looks into its own side first
            for k, (child, least, most) in enumerate(node.children):
                mine = inner if (k == 0) == first else ~inner
                near = mine & (low - most <= bound[at]) & (least - high <= bound[at])
                if near.any():
                    visit(child, at[near])

    if len(points):
        visit(tree, np.arange(len(points)))
    return entry, best, looked


def assigned(codebooks: list[np.ndarray], trees: list[Node], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers and squared distances, rows by parts."""
    width = x.shape[1] // len(codebooks)
    code, error = np.zeros((len(x), len(codebooks)), np.int64), np.zeros((len(x), len(codebooks)), np.int64)
    for at in range(0, len(x), BATCH):
        for p, (book, tree) in enumerate(zip(codebooks, trees, strict=True)):
            code[at : at + BATCH, p], error[at : at + BATCH, p], _ = nearest(tree, book, x[at : at + BATCH, p * width : (p + 1) * width])
    return code, error


def _first_entries(rows: DataFrame, scale: int, parts: int, entries: int) -> list[np.ndarray]:
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.transform("vector", lambda x: F.floor(x.cast("double") * scale))).limit(entries).toArrow()
    vectors = first.column("vector").combine_chunks()
    dims = len(vectors[0]) if len(vectors) else parts
    if dims % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {dims} components")
    return list(matrix(vectors, scale, dims).reshape(-1, parts, dims // parts).transpose(1, 0, 2))


def fit_codebooks(rows: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part (entries by components) after all rounds over all `rows` (vec_id, vector)."""
    books = _first_entries(rows, scale, parts, entries)
    context, dims = rows.sparkSession.sparkContext, sum(b.shape[1] for b in books)
    for _ in range(rounds if len(books[0]) else 0):
        shared = context.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            trees, n = [build_tree(b) for b in now], len(now[0])
            total, count = np.zeros((parts, n, dims // parts), np.int64), np.zeros((parts, n), np.int64)
            for batch in batches:
                x = matrix(batch.column(0), scale, dims)
                code, _ = assigned(now, trees, x)
                for p in range(parts):
                    own = x[:, p * dims // parts : (p + 1) * dims // parts]
                    np.add.at(total[p], code[:, p], own)
                    count[p] += np.bincount(code[:, p], minlength=n)
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

        found = rows.select("vector").mapInArrow(sums, "part bigint, entry bigint, n bigint, total array<bigint>")
        added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(k))) for k in range(dims // parts)]).alias("total"))
        books = [b.copy() for b in books]
        for r in added.collect():  # parts x entries rows
            books[r.part][r.entry] = np.floor_divide(np.array(r.total, np.int64), r.n)
        shared.unpersist()
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """The digest of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def encode_vectors(rows: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """`rows` (vector and others) with `code` (an array of entry numbers) and `error` in place of the vector."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    others = [c for c in rows.columns if c != "vector"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        trees, dims = [build_tree(b) for b in now], sum(b.shape[1] for b in now)
        for batch in batches:
            code, error = assigned(now, trees, matrix(batch.column(len(others)), scale, dims))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(code.astype(np.int32)), pa.list_(pa.int32())), pa.array(error.sum(1))], names=[*others, "code", "error"])

    return rows.select(*others, "vector").mapInArrow(encode, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "code array<int>", "error bigint"]))


def decode_vectors(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """`coded` (with `code`) with `vector`, the components that its entries stand for, in place of the code."""
    entry = F.array(*[F.array(*[F.array(*[F.lit(v / scale) for v in e]) for e in b.tolist()]) for b in books])
    return coded.withColumn("vector", F.flatten(F.transform("code", lambda c, p: F.get(F.get(entry, p), c)))).drop("code")


def code_report(embeddings: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256: one row per kept row of `embeddings`."""
    rows = usable_rows(embeddings, "label")
    books = fit_codebooks(rows, scale, parts, entries, rounds)
    coded = checkpointed(encode_vectors(rows, books, scale))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    few = by_label.limit(LABELS + 1).count() <= LABELS
    joined = coded.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("of")))
    text = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return joined.select("vec_id", text.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql(scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The query over `embeddings`, every part compared with every entry; for rows of distinct ids."""
    usable = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {usable})",
        f"x AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) AS r(part))",
        f"b0 AS MATERIALIZED (SELECT part, entry, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for n in range(rounds + 1):
        square = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"a{n} AS MATERIALIZED (SELECT x.vec_id, x.label, x.part, any_value(x.v) AS v, min((s, entry)) AS best FROM (SELECT x.*, entry, {square} AS s FROM x JOIN b{n} b USING (part)) x GROUP BY ALL)".replace("any_value(x.v) AS v", "x.v AS v"))
        if n < rounds:
            steps += [
                f"m{n} AS MATERIALIZED (SELECT part, entry, list(floor_sum ORDER BY d) AS v FROM (SELECT part, best[2] AS entry, d, (sum(v[d]) - ((sum(v[d]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum FROM a{n}, range(1, (SELECT max(len(v)) FROM x) + 1) AS r(d) GROUP BY ALL) GROUP BY ALL)",
                f"b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v)::BIGINT[] AS v FROM b{n} b LEFT JOIN m{n} m ON b.part = m.part AND b.entry = m.entry)",
            ]
    steps += [
        f"c AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', best[2]::INT), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY ALL)",
        f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h"


SQL = _sql()
