"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from collections import Counter

import pytest

import corpus_pipeline
from tilewright.llm import decontaminate, licenses, media, mixing, pii, quality, repeats, secrets, simhash, toxicity

LABELS = "doc_id bigint, quality int, toxic int"
BENCH = "item_id bigint, text string, fp int"


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="session")
def operators(spark):
    bench = spark.createDataFrame([(1, "again and again", 0), (None, None, 0), (2, "", 0)], BENCH)
    no_labels = spark.createDataFrame([(None, 1, 1), (3, None, None)], LABELS)
    return {
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, no_labels)),
        "media": lambda d: media.read_back(media.store_texts(d)),
        "repeats": lambda d: repeats.removal_report(d),
        "secrets": lambda d: secrets.scan_secrets(d),
        "decontaminate": lambda d: decontaminate.contamination(d, bench),
        "licenses": lambda d: licenses.scan_licenses(d),
        "pii": lambda d: pii.find_personal_data(d),
        "quality": lambda d: quality.score_quality(d, quality.fit_quality(d, no_labels)),
        "simhash": lambda d: simhash.near_duplicates(d),
        "mixing": lambda d: mixing.mix(d),
    }


NAMES = ["toxicity", "media", "repeats", "secrets", "decontaminate", "licenses", "pii", "quality", "simhash", "mixing"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(operators, odd, name):
    assert ids(operators[name](odd)) == ids(odd)


@pytest.mark.parametrize("name", NAMES)
def test_equal_rows_get_equal_results(operators, odd, name):
    twins = [r.asDict() for r in operators[name](odd).where("doc_id = 3").collect()]
    for r in twins:
        r.pop("start", None), r.pop("taken", None)
    assert len(twins) == 2 and twins[0] == twins[1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, odd, none, name):
    out = operators[name](none)
    assert out.count() == 0 and out.columns == operators[name](odd).columns


def test_stages_keep_columns_and_survive(spark, odd, none, tmp_path):
    spark.createDataFrame([(3, 1, 0), (None, 1, 1)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of the kind", 0)], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        out = stage(spark, odd, str(tmp_path))
        if name != "mixing":
            assert out.columns == odd.columns
        if name == "near_duplicates":
            # Null, empty and blank texts are one class, and so are the twins and the two long texts.
            assert ids(out) == Counter([None, 1, 3, 5, 6, -8])
        else:
            assert ids(out) == ids(odd)


def test_run_over_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "again and again", 0)], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "start", "taken"]
    assert ids(out) == Counter([None, 1, 3, 5, 6, -8])


def test_registered_queries():
    import __spark_entry__ as entry

    found = entry.queries()
    assert entry.HAS_LLM and "pipeline" in found and set(entry.oracle_sql()) <= set(found)
    assert sorted(int(n[2:].split("_")[0]) for n in found if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
