"""Mixing sources to target weights: exact budgets per source by hash-random order and distributed prefix sums.

Every document gets a random key, the hash of its id; a source is read in the order of its keys. Keys are uniform, so their
leading bits are equal ranges: prefix sums come from sums per (source, range) and windows within one range, and a hot source is
spread over all ranges. A source whose target exceeds its words is read again from its first key.
Defined results: a null text has size 0; a null source is a source of its own, last in order; a null id's key is the hash of its text; rows of
equal keys stand by id and size, and those that agree in both are interchangeable; very long texts count like any other; an empty table gives no
rows; other columns are never read. Sources are few beside documents: one task orders their names and shares their targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Fixed values of the contract: weights by position, the size of the mix, and the most epochs of a source.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
RANGES = 1024


def word_count(text):
    """Words of `[^\\x20\\x09-\\x0D]+`: places where a word starts."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(flat, " +"), lambda w: w != "")).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source.

    Resharing the excess until no target is above its cap ends where every target is min(cap, level x weight);
    sorted by cap / weight, the level follows from running sums: it is that of the first source that stays under its cap,
    and the largest of those that do.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_level = Window.orderBy("full_at", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sizes.select("source", "source_size", weight.alias("weight"))
    df = df.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
    df = df.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"), F.sum("source_size").over(whole).alias("all_words"), F.sum("weight").over(whole).alias("all_weight"))
    df = df.withColumn("level", (F.col("all_words") * F.lit(share) - F.col("capped")) / (F.col("all_weight") - F.col("gone")))
    df = df.withColumn("level", F.max(F.when(F.col("level") < F.col("full_at"), F.col("level"))).over(whole))
    return df.select("source", "source_size", F.when(F.col("level") < F.col("full_at"), F.col("level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def mix(docs: DataFrame, ranges: int = RANGES, texts: bool = False, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, start (words of its source before it), taken.

    `taken` is the whole document for each epoch that reaches it; the document at the cut gives the words up to the budget. With `texts`, the text
    comes too.
    """
    kept = ["text"] if texts else []
    rows = docs.select(*kept, F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.coalesce(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))), F.lit("")).alias("key"))
    rows = rows.withColumn("range", (F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * ranges / 2**32).cast("int"))
    if not texts:  # the words are counted once, for the sums and for the windows
        rows = checkpointed(rows)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("offset"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), **how)
    inner = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    plan = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source")).select("o.source", "range", "offset", "source_size", "target")
    out = rows.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source AND r.range = p.range"))
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("bigint")
    start = F.col("within") + F.col("offset")
    reached = lambda epoch: F.greatest(F.lit(0), F.least(F.col("size"), budget - epoch * F.col("source_size") - start))
    return out.select(*kept, "doc_id", "r.source", "size", "source_size", "target", start.alias("start"), (reached(0) + reached(1)).cast("bigint").alias("taken"))


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, epoch, text: the mix itself, a row per document and epoch that takes words of it; the text at the cut ends there."""
    plan = mix(docs, texts=True, **how)
    words = lambda epoch: F.greatest(F.lit(0), F.least(F.col("size"), F.col("taken") - epoch * F.col("size"))).cast("int")
    each = plan.select("doc_id", "source", "size", "text", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), words(e).alias("words")) for e in (0, 1)])).alias("e")).where("e.words > 0")
    flat = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.when(F.col("e.words") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(flat, F.lit(1), F.col("e.words")), " "))
    return each.select("doc_id", "source", "e.epoch", part.alias("text"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS key FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS full_at FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0.0) AS capped, coalesce(sum(weight) OVER o, 0.0) AS gone, (sum(source_size) OVER ())::DOUBLE AS all_words, sum(weight) OVER () AS all_weight
      FROM l WINDOW o AS (ORDER BY full_at, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (all_words * 1.5::DOUBLE - capped) / (all_weight - gone) AS own FROM c),
m AS (SELECT *, max(CASE WHEN own < full_at THEN own END) OVER () AS level FROM v),
t AS (SELECT source, source_size, CASE WHEN level < full_at THEN level * weight ELSE cap END AS target FROM m),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target + 0.5::DOUBLE)::BIGINT AS budget,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""
MIX_SELECT = "SELECT doc_id, source, size, source_size, target, start, (greatest(0, least(size, budget - start)) + greatest(0, least(size, budget - source_size - start)))::BIGINT AS taken FROM r"
