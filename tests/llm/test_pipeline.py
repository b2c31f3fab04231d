"""The pipeline stage by stage, on a small fixture."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from adjudica.llm import mixing


def test_stages(spark, frame, prose, tmp_path):
    rng, rows = random.Random(4), []
    for i in range(60):
        words = prose(i, rng.randint(5, 200))
        rows.append((i, " ".join(words), "aa" if i % 2 else "bb", f"s{i % 4}" if i % 3 else "hot"))
        if i % 5 == 0:
            rows.append((1000 + i, rows[-1][1].upper(), "aa", "s1"))
        if i % 6 == 0 and len(words) > 60:
            words[3] = "changed"
            rows.append((2000 + i, " ".join(words), None, "s2"))
    rows += [(5000, None, "aa", "s1"), (5001, "", "aa", None), (5002, "12 34 !!", "aa", "s1"), (5003, "word " * 3000, "bb", None), (7, rows[8][1], "aa", "s3"), (None, "a b c", "aa", "s1")]
    docs, before = frame(rows), None
    columns = docs.columns
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, "").write.parquet(path)
        docs = outputs[name] = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns

    texts = {n: [r for r in d.collect()] for n, d in outputs.items()}
    assert Counter(r.doc_id for r in texts["language"]) == Counter(r[0] for r in rows if r[0] not in (5000, 5001, 5002))
    last = defaultdict(lambda: -1)
    for r in texts["language"]:
        last[r.text.lower()] = max(last[r.text.lower()], -1 if r.doc_id is None else r.doc_id)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in texts["exact_dedup"]) == sorted(last.values())

    shingles = lambda t: frozenset(zip(*[t.lower().split()[k:] for k in range(5)]))
    kept = texts["near_dedup"]
    sets = [shingles(r.text) for r in kept]
    for i, a in enumerate(sets):
        assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for b in sets[:i])
    ids = {r.doc_id for r in kept}
    for r in texts["exact_dedup"]:
        if r.doc_id not in ids:
            a = shingles(r.text)
            assert any(len(a & b) >= 0.8 * len(a | b) for b in sets)

    copies = {r.doc_id: r.copies for r in mixing.sample(outputs["near_dedup"]).collect()}
    assert Counter(r.doc_id for r in texts["mixing"]) == Counter({k: v for k, v in copies.items() if v})

    words = Counter()
    for r in texts["mixing"]:
        words[r.doc_id] += len(r.text.split())
    packed, fill = Counter(), Counter()
    for r in texts["packing"]:
        packed[r.doc_id] += r.n_words
        fill[r.bin_id] += r.n_words
    assert packed == words and max(fill.values()) <= 2048


def test_empty(spark, frame):
    docs = frame([])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns
