"""Overlap of tiles with mask rasters, by summed columns in bit planes.

A mask is cut into blocks of BAND lines by SPAN pixels, whose lines are packed into words: a bit for each pixel that has the undesired value. Tiles of one row of
the grid lie between the same two lines, and CELL neighbours in neighbouring blocks: such a stretch of a row is joined to the blocks it touches on
(mask, band, block). Its lines are added up by plain sums, four columns side by side in one number, and the sums turned into bit planes (plane k has bit k of the sum of
each of a word's 64 columns); what the words before hold is carried along. So the sum over the area ahead of any corner is one carried number and a few counts of
bits, and a tile is counted by one such lookup at each of its two sides, however wide its slide and however many lines it spans (a region of 32,768 lines raises).
Pixels outside the mask are not counted; a region without any pixel has null fractions, and so has one whose mask has no line 0.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import Box
from tilewright.functions.overlap import share_score

WORD, BAND, SPAN = 64, 64, 512
#: Bits of a column's sum, and the lowest bits of the columns that are summed side by side in one number.
LANE, LANES = 16, 0x0001000100010001
#: Tiles of a stretch of a grid row, and how many tile pixels wide a stretch of tiles is that don't come from a grid.
CELL, CELL_WIDTH = 64, 4096


class Overlap(NamedTuple):
    """One score: its column, the column of mask paths, the region, and the undesired pixel value as text."""

    column: str
    path_column: str
    roi: Box
    value: str


def apart(column: str) -> Column:
    """The column as it is. The lambda function keeps what is selected beside it out of whole-stage code: in its one method long expressions aren't compiled by the JVM; apart they are cut into small ones."""
    return F.get(F.transform(F.array(column), lambda v: v), F.lit(0)).alias(column)


def packed_words(value: int) -> Column:
    """The words of a line `_row` of `_n` pixels that hold its pixels from `_at` on, SPAN of them at most: one bit per pixel that equals `value`, the first pixel in the lowest bit.

    Every bit is written out, as lambda functions aren't compiled and took ten times as long.
    """
    per_block = SPAN // WORD
    bit = lambda place, k: f"shiftleft(cast(get(_row, _at | {place}) <=> {value}S AS BIGINT), {k})"

    def tree(terms: list[str]) -> str:
        half = len(terms) // 2
        return f"({tree(terms[:half])} | {tree(terms[half:])})" if half else terms[0]

    words = [f"if(_n > (_at | {w * WORD}), {tree([bit(w * WORD + k, k) for k in range(WORD)])}, NULL)" for w in range(per_block)]
    return F.expr(f"slice(array({', '.join(words)}), 1, least(cast(ceil((_n - _at) / {WORD}) AS INT), {per_block}))")


def mask_blocks(masks: DataFrame, values: list[str]) -> DataFrame:
    """mask_path, band, block and its lines: number in the band, pixels of the whole line, and the words `v<value>` of each value."""
    n = F.size("row")
    cut = masks.where(n > 0).select(
        "mask_path", F.floor(F.col("y") / BAND).cast("int").alias("band"), F.pmod("y", F.lit(BAND)).cast("int").alias("line"), n.alias("_n"), F.col("row").cast("array<smallint>").alias("_row"),
        F.explode(F.sequence(F.lit(0), F.floor((n - 1) / SPAN).cast("int"))).alias("block"),
    ).withColumn("_at", F.col("block") * SPAN)
    packed = cut.select("mask_path", "band", "block", apart("line"), F.col("_n").alias("n"), *[packed_words(int(v)).alias(f"v{v}") for v in values])
    return packed.select("mask_path", "band", "block", F.struct("line", "n", *[f"v{v}" for v in values]).alias("l")).groupBy("mask_path", "band", "block").agg(F.collect_list("l").alias("lines"))


def _below(k: Column) -> Column:
    """The lowest `k` bits of a word."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), k))


def counted(planes: Column, within: Column) -> Column:
    """The sum of the columns in the word `within`."""
    return F.aggregate(planes, F.lit(0), lambda a, p: a + a + F.bit_count(p.bitwiseAND(within)))


def _pixels(axis: str, at: Column | int, resolution: Column, up: bool, tile: Column | None = None) -> Column:
    """A tile's edge in mask pixels, rounded outwards."""
    scaled = ((F.col(f"tile_{axis}") if tile is None else tile) + at) * F.col(f"mpp_{axis}") / resolution
    return (F.ceil(scaled) if up else F.floor(scaled)).cast("int")


def _kinds(overlaps: list[Overlap], *more: Callable[[int, Overlap], Column]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(int(o.value)).cast("smallint").alias("value"), F.col(o.path_column).alias("mask_path"), *[m(i, o) for m in more]) for i, o in enumerate(overlaps)])


def mask_strips(stretches: DataFrame, masks: DataFrame, overlaps: list[Overlap], key: list[str]) -> DataFrame:
    """One row per different `key` of `stretches` (path columns, tile_y, mpp_x, mpp_y, and x_from and x_to, its first and last tile_x) that has pixels:

    for overlap i the mask's mpp_x `m<i>`, its first word `f<i>`, the planes of each word's sums of columns `p<i>`, what stands ahead of each word `c<i>`, and the lengths of
    its lines `n<i>` with their numbers. Rasters grow from small tables, whose size the planner takes for theirs: joins with them are hinted, or they would be broadcast.
    """
    box = [lambda i, o, n=n: F.lit(getattr(o.roi, n)).alias(n) for n in ("x0", "y0", "x1", "y1")]
    carried = list(dict.fromkeys([*key, "tile_y", "mpp_x", "mpp_y", "x_from", "x_to"]))
    regions = stretches.select(*carried, F.explode(_kinds(overlaps, *box)).alias("k")).select(*carried, "k.*").where("mask_path <> ''").dropDuplicates([*key, "kind"])
    sizes = masks.where("y = 0").select("mask_path", F.col("mpp_x").alias("mask_mpp_x"), F.col("mpp_y").alias("mask_mpp_y")).hint("shuffle_hash")
    edge = lambda axis, at, up, tile=None: F.greatest(_pixels(axis, F.col(at), F.col(f"mask_mpp_{axis}"), up, tile), F.lit(0))
    scaled = regions.join(sizes, "mask_path").select(
        *key, "kind", "value", "mask_path", "mask_mpp_x",
        edge("y", "y0", False).alias("top"), edge("y", "y1", True).alias("end"), edge("x", "x0", False, F.col("x_from")).alias("left"), edge("x", "x1", True, F.col("x_to")).alias("right"),
    ).where("end > top AND right > left")
    touched = lambda a, b, size: F.explode(F.sequence(F.floor(F.col(a) / size).cast("int"), F.floor((F.col(b) - 1) / size).cast("int")))
    touching = scaled.withColumn("band", touched("top", "end", BAND)).withColumn("block", touched("left", "right", SPAN))
    values = sorted({o.value for o in overlaps})
    met = touching.join(mask_blocks(masks, values).hint("merge"), ["mask_path", "band", "block"])
    ahead = F.col("block") * (SPAN // WORD)
    first = F.greatest(F.floor(F.col("left") / WORD).cast("int"), ahead)
    n_words = F.least(F.floor((F.col("right") - 1) / WORD).cast("int") + 1, ahead + SPAN // WORD) - first
    words = F.coalesce(*[F.when(F.col("value") == int(v), F.col(f"v{v}")) for v in values])
    at = F.col("band") * BAND
    begins = F.col("block") == F.floor(F.col("left") / SPAN)
    lines = met.select(*key, "kind", "value", "mask_mpp_x", begins.alias("begins"), (F.col("top") - at).alias("top"), (F.col("end") - at).alias("end"), first.alias("first"), (first - ahead).alias("skip"), n_words.alias("words"), F.inline("lines"))
    held = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(words, F.col("skip") + 1, F.col("words")))
    spread = lines.where("line >= top AND line < end").select(*key, "kind", "mask_mpp_x", "begins", "first", "n", F.posexplode(held).alias("place", "word"))
    # The entry ahead of a line's words stands for its length, and is counted by it.
    slot = F.when(F.col("place") == 0, -1 - F.col("n")).otherwise(F.col("first") + F.col("place") - 1)
    lanes = [F.sum(F.shiftrightunsigned("word", k).bitwiseAND(F.lit(LANES))).alias(f"s{k}") for k in range(LANE)]
    counted_up = spread.where("place > 0 OR begins").groupBy(*key, "kind", "mask_mpp_x", slot.alias("slot")).agg(F.count(F.lit(1)).alias("lines"), *lanes)
    plane = lambda p: " | ".join(f"shiftleft(shiftrightunsigned(s{k}, {p}) & {LANES}L, {k})" for k in range(LANE))
    depth = f"length(bin(CASE WHEN lines < {1 << LANE - 1} THEN lines ELSE CAST(raise_error('a region has too many lines of its mask') AS BIGINT) END))"
    planes = F.expr(f"slice(array({', '.join(plane(p) for p in reversed(range(LANE - 1)))}), {LANE} - {depth}, {depth})")
    pieces = counted_up.select(*key, "kind", "mask_mpp_x", apart("slot"), "lines", planes.alias("planes"))
    found = pieces.groupBy(*key).agg(F.collect_list(F.struct("kind", "mask_mpp_x", "slot", "lines", "planes")).alias("all"))
    return _with_carries(found.select(*key, *[c for i in range(len(overlaps)) for c in _strip(i)]), len(overlaps))


def _strip(i: int) -> list[Column]:
    own = lambda test: F.filter("all", lambda p: (p["kind"] == i) & test(p["slot"]))
    words = F.sort_array(F.transform(own(lambda s: s >= 0), lambda p: F.struct(p["slot"].alias("slot"), p["planes"].alias("planes"))))
    lengths = own(lambda s: s < 0)
    return [F.get(lengths, F.lit(0))["mask_mpp_x"].alias(f"m{i}"), words.alias(f"w{i}"), F.transform(lengths, lambda p: F.struct((-1 - p["slot"]).alias("length"), p["lines"].alias("lines"))).alias(f"n{i}")]


def _with_carries(strips: DataFrame, n: int) -> DataFrame:
    """The words of each strip as its first one's number `f<i>` and planes `p<i>`, and what stands ahead of each, `c<i>`."""
    every = lambda a, p: F.array_append(a, F.element_at(a, -1) + counted(p, F.lit(-1).cast("bigint")))
    names = [c for c in strips.columns if c not in {f"w{i}" for i in range(n)}]
    parts = strips.select(*names, *[c for i in range(n) for c in (F.get(f"w{i}", F.lit(0))["slot"].alias(f"f{i}"), F.col(f"w{i}.planes").alias(f"p{i}"))])
    return parts.select(*[F.aggregate(f"p{i}", F.array(F.lit(0)), every).alias(f"c{i}") for i in range(n)], *parts.columns)


def with_scores(tiles: DataFrame, overlaps: dict[int, Overlap], mode: str) -> DataFrame:
    """`tiles` (tile_x, mpp_x and the columns of the strips) with the scores of some overlaps, by their numbers: the share of the undesired value among the pixels under a tile's region.

    Columns are added step by step, so that what is used several times is computed once, and outside of lambda functions, which aren't compiled.
    """
    edge = lambda i, at, up: F.greatest(_pixels("x", at, F.col(f"m{i}"), up), F.lit(0))
    ends = tiles.withColumns({f"_{n}{i}": edge(i, at, up) for i, o in overlaps.items() for n, at, up in (("b", o.roi.x0, False), ("e", o.roi.x1, True))})
    word = lambda i, n: F.least(F.shiftright(f"_{n}{i}", WORD.bit_length() - 1) - F.col(f"f{i}"), F.size(f"p{i}"))
    placed = ends.withColumns({f"_{n}w{i}": word(i, n) for i in overlaps for n in "be"} | {f"_{n}m{i}": _below(F.col(f"_{n}{i}") % WORD) for i in overlaps for n in "be"})

    def before(i: int, n: str) -> Column:
        at = F.col(f"_{n}w{i}")
        return F.get(f"c{i}", at) + F.coalesce(counted(F.get(f"p{i}", at), F.col(f"_{n}m{i}")), F.lit(0))

    reached = lambda i, n: n["lines"] * F.greatest(F.least(F.col(f"_e{i}"), n["length"]) - F.col(f"_b{i}"), F.lit(0))
    # Lines are mostly of one length.
    pixels = lambda i: F.when(F.size(f"n{i}") == 1, reached(i, F.get(f"n{i}", F.lit(0)))).otherwise(F.aggregate(f"n{i}", F.lit(0).cast("bigint"), lambda a, n: a + reached(i, n)))
    seen = placed.select(*[(before(i, "e") - before(i, "b")).alias(f"_s{i}") for i in overlaps], *[pixels(i).alias(f"_n{i}") for i in overlaps], *placed.columns)
    shares = seen.withColumns({f"_f{i}": F.when(F.col(f"_n{i}") > 0, F.col(f"_s{i}") / F.col(f"_n{i}")) for i in overlaps})
    scores = shares.withColumns({o.column: F.when(F.col(f"_n{i}") > 0, share_score(F.col(f"_f{i}"), mode)).otherwise(F.lit(0.0)) for i, o in overlaps.items()})
    return scores.drop(*[f"_{n}{i}" for i in overlaps for n in ("b", "e", "bw", "ew", "bm", "em", "n", "s", "f")])


def add_overlaps(tiles: DataFrame, masks: DataFrame, overlaps: list[Overlap], mode: str = "reference") -> DataFrame:
    """`tiles` (wherever they come from) with the scores of several mask kinds; disabled and missing masks score 0."""
    paths = list(dict.fromkeys(o.path_column for o in overlaps))
    key = [*paths, "tile_y", "mpp_x", "mpp_y", "_cell"]
    dealt = tiles.withColumn("_cell", F.floor(F.col("tile_x") / CELL_WIDTH))
    stretches = dealt.groupBy(*key).agg(F.min("tile_x").alias("x_from"), F.max("tile_x").alias("x_to"))
    strips = mask_strips(stretches, masks, overlaps, key)
    joined = dealt.alias("t").join(strips.hint("merge").alias("f"), [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in key], "left")
    both = joined.select("t.*", *[F.col(f"f.{n}{i}") for i in range(len(overlaps)) for n in "mfpcn"])
    return with_scores(both, dict(enumerate(overlaps)), mode).select(*tiles.columns, *[o.column for o in overlaps])
