import pytest

#: Columns that carry the names which the operators use inside.
CLASH = "k1 int, k2 string, fp bigint, node int, class string, range int, score string, _id int, _node int, text_key int, spans string, key string, words int, n int, y int, size int, terms int, media int, _cleaned int, _score int, _turn int"


def odd_rows(n_clash: int = 21):
    long = " ".join(f"word{i % 977} token" for i in range(30_000))
    texts = [(None, None, None), (None, "null id", "a"), (1, "", "a"), (2, None, "b"), (3, "the same text again and again", None), (3, "the same text again and again", None), (4, "  \n\t ", "b"), (5, "é ß 漢字 🎉 \u0000 end", "a"), (6, long, "a"), (7, long, "c"), (-8, "x", "c")]
    return [(i, t, "en", s, 0, *([None] * n_clash)) for i, t, s in texts]


@pytest.fixture(scope="session")
def schema():
    return f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"


@pytest.fixture(scope="session")
def odd(spark, schema):
    return spark.createDataFrame(odd_rows(), schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark, schema):
    return spark.createDataFrame([], schema)


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts, ids=None):
        return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return docs
