"""The two classifiers: gradients, traversal and held-out accuracy."""

import random

import numpy as np
import pytest

from tilewright.llm import quality, toxicity
from tilewright.llm.common import crc


def synthetic(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "kltmr" for b in "aeiou" for c in "nrst"]
    texts, toxic, good = [], [], []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 260))]
        bad, junk = rng.random() < 0.3, rng.random() < 0.25
        if bad:
            for _ in range(1 + len(w) // 40):
                w[rng.randrange(len(w))] = rng.choice(["vilex", "grumpo", "snarlu", "vileshk", "vilebor"])
        if junk:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [w[0]] * len(w)
        texts.append(" ".join(w))
        toxic.append(int(bad))
        good.append(int(not junk))
    return texts, np.array(toxic, float), np.array(good, float)


def test_gradients():
    """Of words and of their bytes, against differences."""
    rng = np.random.default_rng(3)
    w = toxicity.weights_at_first(3)
    words = toxicity.words_of(["some words of a text", "and others of a text, a longer one with some words"])
    evidence = rng.standard_normal((len(words.keys), toxicity._EVIDENCE)).astype(np.float32)
    begin, size = np.array([0, 5, 7]), np.array([5, 3, 4])
    grads = toxicity.loss_gradients(w, evidence, words, begin, size, np.ones_like)

    def total():
        x = np.concatenate([evidence, toxicity.spell(w, words.letters, words.lengths)[0][words.which]], axis=1)
        at, held = toxicity.places(begin, size, len(x))
        return toxicity.forward(w, x[at] * held[:, :, None], held)[0].sum(dtype=np.float64)

    for k in w:
        flat = w[k].reshape(-1)
        picked = rng.choice(len(flat), min(4, len(flat)), replace=False) if k != "letters" else [6 * ord(c) + i for i, c in enumerate("some")]
        for i in picked:
            old, step = flat[i], np.float32(1e-2)
            ends = []
            for d in (step, -step):
                flat[i] = old + d
                ends.append(total())
            flat[i] = old
            assert grads[k].reshape(-1)[i] == pytest.approx((ends[0] - ends[1]) / 0.02, abs=2e-2)


def test_long_words_are_read_whole():
    texts = ["a " + "x" * 31 + "yz " + "q" * 100 + " b", "", "q" * 100, "x" * 32]
    words = toxicity.words_of(texts)
    assert np.diff(words.first).tolist() == [1 + 2 + 4 + 1, 0, 4, 1] and words.size.tolist() == [1, 32, 1, 32, 32, 32, 4, 1, 32, 32, 32, 4, 32]
    assert words.which[3:7].tolist() == words.which[8:12].tolist() and words.lengths[words.which].tolist() == words.size.tolist()
    assert bytes(words.letters[words.which[1]]) == b"x" * 31 + b"y" and bytes(words.letters[words.which[6]][:5]) == b"qqqq\0"


def test_toxicity_reads_inside_words():
    """Words that differ in all that the evidence sees: their label shows in the middle alone."""
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(n))

    def texts(n):
        y = np.array([float(rng.random() < 0.5) for _ in range(n)])
        return [" ".join(draw(6) + ("zqz" if t and k % 3 == 0 else draw(3)) + draw(5) for k in range(12)) for t in y], y

    network = toxicity.fit(*texts(500), least_steps=400)
    more, y = texts(200)
    assert ((network.score(more) >= 0.5) == y).mean() > 0.9


def test_windows_cover_whole_texts():
    first = np.array([0, 0, 10, 74, 200, 5200])
    begin, size, doc = toxicity.windows_of(first)
    for d in range(5):
        own = [(b, b + s) for b, s, k in zip(begin, size, doc) if k == d]
        assert own[0][0] == first[d] and own[-1][1] == first[d + 1]
        assert all(b <= a2 + toxicity.WINDOW and a2 < b for (_, b), (a2, _) in zip(own, own[1:]))


def test_toxicity_learns_and_batches_agree():
    texts, toxic, _ = synthetic(500, 1)
    network = toxicity.fit(texts, toxic, epochs=3, least_steps=150)
    more, y, _ = synthetic(200, 2)
    scores = network.score(more)
    assert ((scores >= 0.5) == y).mean() > 0.95
    assert np.allclose(scores, np.concatenate([network.score([t]) for t in more]), atol=1e-5)
    assert network.score(["", "..."]).tolist() == [network.prior] * 2


def test_toxicity_without_classes():
    assert 0 <= toxicity.fit([], np.zeros(0)).score(["a b"])[0] < 0.01
    assert 0 <= toxicity.fit(["a", "b"], np.zeros(2)).score(["a b"])[0] < 0.01


@pytest.mark.parametrize("label", [0, 1, None])
def test_nothing_goes_without_both_classes(spark, label):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(20)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 0, label) for i in range(20)], "doc_id bigint, quality int, toxic int")
    assert toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, labels)).count() == 20


def test_forest_against_walking_by_hand():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, len(quality.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    forest = quality.fit(x, y, trees=25)
    margin = []
    for row in x[:50]:
        total = forest.start
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        margin.append(1 / (1 + np.exp(-total)))
    assert np.allclose(forest.score(x[:50]), margin)
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.95
    assert quality.fit(np.zeros((0, 0)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]


def test_statistics_are_finite():
    for t in ("", " ", "\n", "a", "é" * 10, "!!! ###", "x" * 100_000):
        s = quality.statistics(t)
        assert len(s) == len(quality.FEATURES) and np.isfinite(s).all()


def test_statistics_by_counting():
    text = 'The cat, the cat | sat!\n\nOn "THE" mat...\nß été 12 AA # aa\n\nOn'
    raw, w = text.encode(), text.encode().split()
    got = dict(zip(quality.FEATURES, quality.statistics(text), strict=True))
    share = lambda chars: sum(raw.count(c.encode()) for c in chars) / len(raw)
    pairs = [(a, b) for a, b in zip(w, w[1:])]
    lines = [x for x in raw.split(b"\n") if x]
    want = {
        "log_bytes": np.log(len(raw) + 1), "log_words": np.log(len(w) + 1), "word_len": np.mean([len(x) for x in w]), "word_len_sd": np.std([len(x) for x in w]), "unique_words": len(set(w)) / len(w),
        "top_word": max(map(w.count, w)) / len(w), "top_pair": max(map(pairs.count, pairs)) / len(w), "repeats_next": sum(a == b for a, b in pairs) / len(w),
        "letters": sum(chr(c).isascii() and chr(c).isalpha() for c in raw) / len(raw), "upper": sum(65 <= c <= 90 for c in raw) / len(raw), "digits": share("12"), "spaces": share(" \n"), "wide": sum(c > 127 for c in raw) / len(raw),
        "marks": share(',|!".#'), "bars": share("|"), "stops": share("."), "commas": share(","), "breaks": share("\n"), "quotes": share('"'), "lines": np.log(len(lines) + 1), "line_len": np.log(1 + len(raw) / len(lines)),
        "unique_lines": len(set(lines)) / len(lines), "upper_words": sum(x.isupper() for x in w) / len(w), "marked_words": sum(x[-1:] in (b",", b"|", b"!", b'"', b".", b"#") for x in w) / len(w),
        "short_words": sum(len(x) < 3 for x in w) / len(w), "long_words": 0.0, "byte_entropy": -sum(raw.count(c) / len(raw) * np.log2(raw.count(c) / len(raw)) for c in set(raw)), "exclaims": share("!"), "hashes": share("#"),
    }
    assert set(want) == set(got) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_both_in_spark(spark, make):
    texts, toxic, good = synthetic(400, 4)
    docs = make(texts)
    labels = spark.createDataFrame([(i, int(q), int(t)) for i, (q, t) in enumerate(zip(good, toxic))], "doc_id bigint, quality int, toxic int")
    for got, y in ((quality.score_quality(docs, quality.fit_quality(docs, labels)), good), (toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, epochs=3, least_steps=150)), toxic)):
        rows = got.collect()
        assert got.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(texts)
        held = [r for r in rows if r.held_out]
        assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
        assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.9
    network = toxicity.fit(texts, toxic, epochs=2, least_steps=100)
    left = {r.doc_id for r in toxicity.without_toxic(docs, network).collect()}
    assert left == {i for i, s in enumerate(network.score(texts)) if s < 0.5}
