from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from adjudica.llm import packing


def plain_best_fit(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [
            (b["left"], i) for i, b in enumerate(bins)
            if b["left"] >= n and b["sources"][s] < per_source and (c < 0 or c not in b["clusters"])
        ]
        if not fits:
            bins.append({"left": capacity, "sources": Counter(), "clusters": set()})
            fits = [(capacity, len(bins) - 1)]
        i = min(fits)[1]
        bins[i]["left"] -= n
        bins[i]["sources"][s] += 1
        bins[i]["clusters"].add(c)
        out.append((i, min(fits)[0]))
    return out


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 20), st.integers(0, 70), st.integers(-1, 80)), max_size=150),
    st.integers(1, 3),
)
def test_each_item_goes_to_a_tightest_compatible_bin(items, per_source):
    items.sort(reverse=True)
    sizes, sources, clusters = (np.array([x[k] for x in items], dtype=np.int64) for k in range(3))
    got = packing.best_fit(sizes, sources, clusters, 20, per_source)
    # Which of equally tight bins is taken is open: follow the choices and check each.
    left, of_source, of_cluster = defaultdict(lambda: 20), Counter(), set()
    for (n, s, c), b in zip(items, got, strict=True):
        opened = set(left)
        allowed = [x for x in opened if left[x] >= n and of_source[x, s] < per_source and (c < 0 or (x, c) not in of_cluster)]
        if allowed:
            assert b in allowed and left[b] == min(left[x] for x in allowed)
        else:
            assert b not in opened
        left[b] -= n
        of_source[b, s] += 1
        of_cluster.add((b, c))


def test_pack(frame, prose):
    rows = [(i, " ".join(prose(i, 1 + i * 13 % 90)), "xx", f"s{i % 7}" if i % 3 else "hot") for i in range(400)]
    rows += [(1000 + i, rows[5][1].upper(), "xx", "hot") for i in range(30)]
    rows += [(2000, "w " * 1234, "xx", None), (2001, None, "xx", None), (2002, "", None, None), (None, "a b", "xx", "s1"), (7, rows[7][1]), (7, rows[7][1])]
    got = packing.pack(frame(rows), capacity=100, per_source=2, shard_rows=120).collect()
    words = Counter()
    for i, text, *_ in rows:
        words[i] += len((text or "").split())
    packed, pieces = Counter(), defaultdict(list)
    fill, sources = Counter(), defaultdict(Counter)
    for r in got:
        packed[r.doc_id] += r.n_words
        pieces[r.doc_id].append((r.first_word, r.n_words))
        fill[r.bin_id] += r.n_words
        sources[r.bin_id][r.source] += 1
    assert packed == words and {r.doc_id for r in got} == {r[0] for r in rows}
    assert sorted(pieces[2000]) == [(100 * k, 100) for k in range(12)] + [(1200, 34)]
    assert max(fill.values()) <= 100 and all(max(c.values()) <= 2 for c in sources.values())
    copies = [r.bin_id for r in got if r.doc_id == 5 or 1000 <= (r.doc_id or 0) < 1030]
    assert len(set(copies)) == 31


def test_given_clusters_and_empty(frame):
    from pyspark.sql import functions as F

    docs = frame([(i, "a b c", "xx", f"s{i}") for i in range(6)])
    one = docs.withColumn("class", F.lit(1))
    assert len({r.bin_id for r in packing.pack(one, cluster="class").collect()}) == 6
    none = docs.withColumn("class", F.lit(None).cast("int"))
    assert len({r.bin_id for r in packing.pack(none, cluster="class").collect()}) == 1
    assert packing.pack(frame([])).count() == 0
