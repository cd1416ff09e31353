"""What the pipeline's first stages do, and where."""

import random

import pyspark.sql
from pyspark.sql import functions as F

from tilewright.llm import simhash, toxicity
from tilewright.llm.common import packed


def test_the_network_is_fitted_in_a_task(spark, make, monkeypatch):
    """No text of the sample comes to the driver."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["vilex", "grumpo"] if i % 2 and k % 3 == 0 else ["calm", "plain", "kind"]) for k in range(8)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    docs = make(texts)
    monkeypatch.setattr(pyspark.sql.classic.dataframe.DataFrame, "toPandas", lambda self: 1 / 0)
    network = toxicity.fit_toxicity(docs, labels, least_steps=40, most_epochs=5, spelling=20)
    assert network.learnt and len(network.score(["vilex calm", "calm plain"])) == 2
    assert not toxicity.fit_toxicity(make([]), labels.limit(0)).learnt


def test_fingerprints_propose_pairs_in_the_pipeline(make, monkeypatch):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "changed"]) for b in base] + [" ".join(base[0])]
    docs = make(texts).select(F.xxhash64("text").alias("node"), F.xxhash64(F.lit(1), "text").alias("other"), "text")
    rows = simhash.prefix_rows(docs)
    nodes = [(r.node, r.fp % 2**64) for r in rows.select("node", "fp").collect()]
    assert len(nodes) == len(set(texts))
    got = {(r.a, r.b) for r in simhash.fingerprint_pairs(rows).collect()}
    near = {(min(a, b), max(a, b)) for a, x in nodes for b, y in nodes if a != b and (x ^ y).bit_count() <= 4}
    assert got and got <= near and all(a < b for a, b in got)
    used = []
    plain = simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda *a: used.append(1) or plain(*a))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(make(texts)).collect()) == list(range(6)) and used


def test_small_tables_in_many_partitions_cost_few_jobs_and_tasks(spark, make):
    """Near-duplicates take rounds over small tables: neither their filters nor their checkpoints cost a job or a task for each partition that a shuffle left."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(60)] for _ in range(6)]
    docs = make([" ".join([*b[: 60 - k], *["x"] * k]) for b in base for k in range(3)])
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in zip(held, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        small = packed(spark.range(20_000).repartition(64, "id"))
        assert small.rdd.getNumPartitions() == 4 and sorted(r.id for r in small.collect()) == list(range(20_000))
        spark.sparkContext.setJobGroup("near", "near")
        assert simhash.drop_near_duplicates(docs).count() == 6
        jobs = [tracker.getJobInfo(k) for k in tracker.getJobIdsForGroup("near")]
        tasks = sum(i.numCompletedTasks for j in jobs for s in j.stageIds if (i := tracker.getStageInfo(s)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert len(jobs) < 130 and tasks < 5_000, (len(jobs), tasks)
