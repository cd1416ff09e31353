"""Operators 11 to 13 against the library, plain loops and DuckDB."""

import hashlib
import math
import random
from itertools import chain

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import codes, negatives, pieces, queries

sentencepiece = pytest.importorskip("sentencepiece")
PATH = queries.tokenizer_path("piece_bpe_32k.model")
ALPHABET = " \t\n\r▁  ab the  éß漢字🎉\x00①0123-=_//..#  　​﻿'²."


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.read_vocabulary(PATH))


def ids_of(encoder, text):
    return list(chain.from_iterable(encoder.blocks(text)))


def test_encoding_equals_the_library(encoder, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "▁", "x" * 5000, " " * 5000, "a1b2" * 2000, "漢字" * 2000, "aaab" * 1000, "\0", "é", "word " * 30_000, "mixed²text.² ³"]
    for text in texts:
        ids = ids_of(encoder, text)
        assert ids == library.encode(text), text[:60]
        assert b"".join(pieces.decoded(encoder, [ids])).decode() == library.decode(ids)


def test_decoding_of_any_ids_equals_the_library(encoder, library):
    rng = random.Random(6)
    for _ in range(20_000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(270), 259, 28705, rng.randrange(3, 259)]) for _ in range(rng.randint(0, 9))]
        cut = rng.randint(0, len(ids))
        assert b"".join(pieces.decoded(encoder, [ids[:cut], ids[cut:]])).decode() == library.decode(ids), ids


def test_each_prefix_has_the_last_token_of_its_merges(encoder):
    for chunk in ("▁tokenization", "▁▁▁▁▁▁▁word", "aaaaaaaaaa", "▁été漢"):
        for n, last in enumerate(encoder.last_tokens(chunk)[1:], 1):
            assert encoder.token(last) == encoder.merged(chunk[:n])[-1]


def test_small_tables_change_nothing(encoder, library, monkeypatch):
    for name, value in (("KEPT", 4), ("PAIRS", 8), ("BLOCK", 2), ("LONG", 3)):
        monkeypatch.setattr(pieces, name, value)
    fresh = pieces.Encoder(encoder.vocabulary)
    for text in ("one two one three two one four", "  spaces   and.stops, and\nlines\n\n"):
        assert ids_of(fresh, text) == library.encode(text)


def test_chunks_follow_the_borders_that_no_piece_crosses():
    assert pieces.chunk_pattern({("a", "▁")}) == "(?s:.+)"
    assert "²" in pieces.chunk_pattern({("²", "."), ("a", "b"), ("▁", "a")})


def test_token_report_of_odd_rows(spark, odd, none, library):
    vocabulary = pieces.read_vocabulary(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = []
    for r in rows:
        ids = library.encode(r.text)
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = [tuple(r) for r in pieces.token_report(odd, vocabulary).collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert pieces.token_report(none, vocabulary).count() == 0
    back = {(r.doc_id, r.text) for r in pieces.decode(pieces.encode(odd, vocabulary), vocabulary).collect()}
    assert back == {(r.doc_id, r.text) for r in rows}


CLASH = "uid int, anchor int, rank int, score int, vector int, code int, error int, label_error int"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 8) for r in rows], f"vec_id bigint, embedding array<float>, label int, {CLASH}")


def odd_vectors(n, dims, seed, spread=3):
    """Rows with ties, repeated rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.integers(-spread, spread + 1, dims) / 64], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * dims, 1), (n + 2, [float("inf")] * dims, 2), (n + 3, [None] * dims, 0), (n + 4, [], 0)]
    rows += [(n + 5, rows[0][1], None), (None, rows[1][1], 1), (None, None, None), rows[3], rows[3], rows[4]]
    return rows


def plain_negatives(rows, every):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    big = 2**63 - 1
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), big if j is None else j, m) for b, (j, w, m) in enumerate(kept) if b != a]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            near = sorted(s[:2] for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(i, None if j == big else j, n + 1, None if k == big else k, -p, -s) for n, (s, k) in enumerate(near)]
    return out


@pytest.mark.parametrize("block", [1 << 21, 400])
def test_hard_negatives_equal_plain_loops(spark, block):
    rows = odd_vectors(260, 8, 3)
    got = negatives.hard_negatives(table(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, block_bytes=block)
    key = lambda r: tuple(str(v) for v in r)
    want = plain_negatives(rows, 20)
    assert len(want) > 100
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_bounds_discard_and_keep(monkeypatch):
    rng = np.random.default_rng(8)
    axes, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    x = np.floor(256 * (rng.normal(size=(500, 64)) * (0.7 ** np.arange(64))) @ axes.T).astype(np.int64)
    rotation = negatives.principal_axes((x.T @ x).astype(float))
    a, b = negatives.side(x[:20], rotation), negatives.side(x, rotation)
    exact, limit = x[:20] @ x.T, 40_000
    for share in (0.0, 0.25, 1.0):  # never single pairs, then some, then all
        monkeypatch.setattr(negatives, "SPARSE", share)
        found = np.zeros(exact.shape, bool)
        looked = 0
        for i, j, score in negatives.survivors(a, b, lambda at, least, most: most >= limit, np.ones(exact.shape, bool)):
            assert (score == exact[i, j]).all()
            looked += len(i)
            found[i, j] = True
        assert found[exact >= limit].all()
        assert looked < exact.size / 2


def test_hard_negatives_of_no_rows(spark):
    assert negatives.hard_negatives(table(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    assert negatives.hard_negatives(table(spark, [(2, None, 1), (4, [1.0], None)]), F.col("vec_id") % 2 == 0).count() == 0
    assert negatives.hard_negatives(table(spark, [(1, [1.0], 1)]), F.col("vec_id") % 2 == 0).count() == 0
    assert negatives.hard_negatives(table(spark, [(2, [1.0], 1), (3, [0.5], 2)]), F.col("vec_id") % 2 == 0).count() == 0


def test_tree_finds_the_nearest_entry():
    rng = np.random.default_rng(4)
    for spread in (2, 50, 20_000):
        entries = rng.integers(-spread, spread + 1, (16, 8))
        entries[9] = entries[2]  # equal entries: the lower one
        points = rng.integers(-spread, spread + 1, (3000, 8))
        square = ((points[:, None] - entries[None]) ** 2).sum(2)
        entry, best, looked = codes.nearest(codes.build_tree(entries), entries, points)
        assert (entry == square.argmin(1)).all() and (best == square.min(1)).all()
        assert looked <= square.size
    clustered = entries[rng.integers(0, 16, 3000)] + rng.integers(-9, 10, (3000, 8))
    assert codes.nearest(codes.build_tree(entries), entries, clustered)[2] < 0.8 * clustered.shape[0] * 16  # most children are passed over


def plain_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    kept = sorted(((i is None, i or 0, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[:3])
    width = len(kept[0][2]) // parts
    cut = [[r[2][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]
    near = lambda v, book: min((sum((x - y) ** 2 for x, y in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = [near(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                if own := [c[p] for c, m in zip(cut, mine) if m == e]:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out, by_label = [], {}
    for (no_id, i, _, label), c in zip(kept, cut):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((None if no_id else i, "".join(f"{e:02x}" for _, e in best), sum(s for s, _ in best), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, code, error, by_label[label], digest) for i, code, error, label in out]


@pytest.mark.parametrize(("n", "few"), [(200, True), (200, False), (3, True)])
def test_codes_equal_plain_loops(spark, monkeypatch, n, few):
    if not few:
        monkeypatch.setattr(codes, "LABELS", 0)
    rows = odd_vectors(n if n > 5 else 5, 16, 9)[: None if n > 5 else n]
    got = codes.code_report(table(spark, rows).repartition(4))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_codes(rows), key=key)


def test_codes_of_no_rows_and_back(spark):
    assert codes.code_report(table(spark, [])).count() == 0
    assert codes.code_report(table(spark, [(1, None, 1)])).count() == 0
    rows = [(i, [float(i % 2)] * 8, 0) for i in range(40)]
    books = codes.fit_codebooks(codes.usable_rows(table(spark, rows)))
    back = codes.decode_vectors(codes.encode_vectors(codes.usable_rows(table(spark, rows)), books), books).collect()
    assert all(r.vector == [float(r.vec_id % 2)] * 8 and r.error == 0 for r in back)


def test_new_queries_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    for name in ("op12_hard_negatives", "op13_vector_codes"):
        got = queries.QUERIES[name](spark, sf).toPandas()
        want = con.execute(queries.ORACLE_SQL[name]).fetchdf()[list(got.columns)]
        assert len(got) and sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))
