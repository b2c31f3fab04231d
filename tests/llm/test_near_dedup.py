import random
from collections import defaultdict

import numpy as np

from adjudica.llm import near_dedup as nd, shingles
from adjudica.llm.components import components


def plain_shingles(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def plain_classes(rows):
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    return [(d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g]


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def corpus(prose):
    rng, rows = random.Random(5), []
    for base in range(12):
        words = prose(base, 300)
        rows.append(" ".join(words))
        rows += [" ".join(edited(words, rng, n)) for n in (0, 1, 2, 4, 6, 8, 12, 20, 40)]
    chain = prose(77, 250)  # neighbours are alike, the ends are not
    for _ in range(14):
        chain = edited(chain, rng, 3)
        rows.append(" ".join(chain))
    shared = prose(99, 120)  # a passage that many share
    rows += [" ".join(shared + prose(500 + i, 90)) for i in range(25)]
    rows += [rows[0].upper(), rows[0].replace(" ", ", "), "one two", "One, two!", "three", None, "", "?!", "a b c d e", "a b c d e f"]
    rows += ["yes " * 30, "yes " * 60, "yes no " * 40]
    return [(i, t) for i, t in enumerate(rows)] + [(None, rows[1]), (3, rows[3]), (3, rows[3]), (None, None)]


def test_classes_match_brute_force(frame, prose):
    rows = corpus(prose)
    got = nd.near_classes(frame(rows)).collect()
    want = plain_classes(rows)
    assert sorted(map(repr, ((r.doc_id, r.class_id, r.class_size) for r in got))) == sorted(map(repr, want))
    groups = defaultdict(int)
    for r in got:
        groups[(r.class_id, r.class_size)] += r.kept
    assert all(r.doc_id == r.class_id for r in got if r.kept)
    wordless = sum(not plain_shingles(t) for _, t in rows)
    assert sum(r.kept for r in got) == len({(c, n) for _, c, n in want if n > 1}) + sum(n == 1 for *_, n in want)
    assert wordless == 4


def test_large_group_and_many_strays(frame, prose):
    """Coarse bands put unlike texts into one bucket: classes stay those of brute force."""
    rng = random.Random(3)
    base = prose(1, 60)
    rows = [(i, " ".join(edited(base, rng, rng.choice((1, 2, 6))))) for i in range(160)]
    got = nd.near_classes(frame(rows), bands=40, rows=1).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == sorted(plain_classes(rows))


def test_one_text_repeats_a_passage(frame, prose):
    """Counts do not keep texts apart whose sets are similar."""
    rows = []
    for pair in range(8):
        words = prose(700 + pair, 104)
        rows.append((2 * pair, " ".join(words)))
        rows.append((2 * pair + 1, " ".join(words + words[:34] * 1000 + prose(800 + pair, 10))))
    rows.append((99, rows[1][1] + " " + rows[1][1]))  # another count variant
    got = nd.near_classes(frame(rows)).collect()
    want = plain_classes(rows)
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == sorted(want)
    assert all(n > 1 for *_, n in want)


def test_drop_near(frame, prose):
    words = prose(4, 200)
    text, other = " ".join(words), " ".join(prose(5, 200))
    docs = frame([(5, text), (2, text.upper()), (9, other), (9, other), (None, text), (7, None), (8, "")])
    left = nd.drop_near(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 7, 8, 9]
    assert nd.drop_near(frame([])).count() == 0 and nd.near_classes(frame([])).count() == 0


def test_sketches_estimate_probability_jaccard():
    ids = np.arange(1, 401, dtype=np.uint64)
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 6, 400).astype(float), rng.integers(1, 6, 400).astype(float)
    a[:40], b[40:80] = 0, 0
    owner = np.repeat([0, 1], [360, 360])
    s = shingles.prob_min_hash(2, owner, np.concatenate([ids[a > 0], ids[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 6000)
    want = sum(
        1 / np.maximum(a / a[d], b / b[d]).sum() for d in range(400) if a[d] > 0 and b[d] > 0
    )
    assert abs((s[0] == s[1]).mean() - want) < 0.025


def test_shingles_match_plain(prose):
    texts = [" ".join(prose(i, n)) for i, n in enumerate((0, 1, 4, 5, 6, 50))] + ["A, b c! D e f é_x", "a " * 3000]
    owner, ids, counts = shingles.distinct_shingles(texts)
    for i, text in enumerate(texts):
        assert (owner == i).sum() == len(plain_shingles(text))
        words = len("".join(c if c.isalnum() else " " for c in text).split())
        assert counts[owner == i].sum() == (max(words - 4, 1) if words else 0)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(139, 200), (300, 300), (301, 302), (302, 301)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [*range(100, 140), 200]}, 301: 301, 302: 301}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
