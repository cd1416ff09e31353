"""The whole pipeline against plain Python on a small table."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tilewright.llm import secrets, toxicity
from tilewright.llm.common import crc

from .test_exact import naive_classes, naive_contamination, naive_mix, words_of


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def cut(text, items):
    """Without the benchmark's words, for texts whose words are separated by single spaces."""
    while True:
        w, gone = text.split(" "), set()
        for item in items:
            v = words_of(item)
            for k in range(len(v) - 9):
                gone |= {i + j for i in range(len(w) - 9) if w[i : i + 10] == v[k : k + 10] for j in range(10)}
        if not gone:
            return text
        text = " ".join(x for i, x in enumerate(w) if i not in gone)


def test_run(spark, tmp_path):
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "klmnprst" for b in "aeiou" for c in "dfglx"]
    items = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(3)]
    texts, labels = [], []
    for i in range(90):
        w = [rng.choice(words) for _ in range(rng.randrange(60, 140))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["vilex", "grumpo"])
        if i % 9 == 1:
            w[20:20] = items[i % 3].split()
        if i % 10 == 3:
            w[5] = "token=abcdef0123456789abcdef01"
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    for i in (1, 2, 5, 6, 7):
        texts.append(texts[i])
        w = texts[i].split()
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += [items[0], None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    learnt = [(i, y) for i, _, y in labels if crc(i) % 5]
    network = toxicity.fit([texts[i] for i, _ in learnt], np.array([y for _, y in learnt], float), float(np.mean([y for _, y in learnt])))
    scores = network.score([t or "" for t in texts])
    kept = [i for i in range(len(texts)) if scores[i] < 0.5]
    sets = {i: shingles(texts[i] or "") for i in kept}
    first = naive_classes(kept, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = [i for i in kept if first[i] == i]
    found = dict(zip(kept, naive_contamination([texts[i] for i in kept], list(enumerate(items)))))
    kept = [i for i in kept if found[i][1] <= 0.5 * found[i][0]]
    last = {i: secrets.redact(cut(texts[i], items)) if texts[i] else texts[i] for i in kept}
    assert set(got) == set(kept)
    size, total, target = naive_mix([(i, last[i], f"s{i % 4}") for i in kept])
    for i in kept:
        assert (got[i].size, got[i].source_size) == (size[i], total[f"s{i % 4}"]) and got[i].target == pytest.approx(target[f"s{i % 4}"])
    assert abs(sum(r.taken for r in got.values()) - 1.5 * sum(size.values())) <= 4
    folder = str(tmp_path / "out")
    corpus_pipeline.write_corpus(spark, str(tmp_path), folder)
    held = {}
    for r in spark.read.parquet(f"{folder}/corpus").collect():
        assert r.text.split() == last[r.doc_id].split()[: len(r.text.split())]
        held[r.doc_id] = held.get(r.doc_id, 0) + len(r.text.split())
    assert held == {i: r.taken for i, r in got.items() if r.taken} and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["corpus", "secrets"]
    # It did something at every stage.
    assert sum(scores >= 0.5) >= 15 and len(kept) < sum(scores < 0.5) and any(v[1] for v in found.values()) and any("[REDACTED]" in (t or "") for t in last.values())
