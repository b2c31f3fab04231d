"""Linked classes against comparing all pairs of texts."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adjudica.llm import metric_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    sets = [shingles(text) for _, text in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def found(spark, rows, partitions=3, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    frame = frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["node", "n", "homes", "id", "home", "ids"])])
    out = metric_join.linked_classes(frame, **options)
    return sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("seed,leaf", [(1, 64), (2, 2), (3, 4)])
def test_equals_all_pairs(spark, prose, seed, leaf):
    draw, words = random.Random(seed), prose(seed, 400)
    passage = prose(seed + 50, 60)
    rows = []
    for _ in range(12):  # chains of edits, so that ends are far apart
        text = [draw.choice(words) for _ in range(draw.randint(3, 90))]
        for _ in range(draw.randint(1, 9)):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(draw.randint(0, 3)):
                at = draw.randrange(len(text) + 1)
                text[at : at + draw.randint(0, 2)] = [draw.choice(words) for _ in range(draw.randint(0, 2))]
            text = text or ["again"]
    for _ in range(25):  # a common passage with few or many words of its own
        own = [draw.choice(words) for _ in range(draw.choice([0, 2, 5, 8, 11, 15, 60]))]
        rows.append(" ".join([*own, *passage]) if draw.random() < 0.5 else "  ".join([*passage, *own]))
    for _ in range(30):  # near copies of one text
        text = list(passage[::-1])
        text[draw.randrange(60)] = draw.choice(words)
        rows.append("\t".join(text).upper())
    rows = [(i, t) for i, t in enumerate(rows)]
    draw.shuffle(rows)
    assert found(spark, rows, leaf=leaf, frequent=3) == brute(rows)


def test_edges_of_words_nulls_repeats(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [
        (5, None), (6, ""), (7, " \n\t"), (8, "one"), (9, "ONE"), (9, "ONE"), (10, "one two three four"), (11, "one two three four five"),
        (12, "ÉÉ a b c d"), (13, "éé a b c d"), (14, "a b"), (15, "A B\v"), (None, text), (20, text), (None, "x y"), (21, "long " * 60_000), (22, "long " * 9),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(1, "a")]) == [(1, 1, 1)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert metric_join.linked_classes(none).count() == 0


@pytest.mark.parametrize("extra,linked", [(10, True), (11, False)])
def test_the_bound_is_met_exactly(spark, extra, linked):
    """40 shingles against the same and 10 or 11 more: 40/50 is linked, 40/51 is not."""
    text = [f"w{i}" for i in range(44)]
    rows = [(1, " ".join(text)), (2, " ".join([*text, *(f"x{i}" for i in range(extra))]))]
    assert {c for _, _, c in found(spark, rows)} == ({1} if linked else {1, 2})


def test_pairs_of_many_full_regions_are_held_some_at_a_time(monkeypatch):
    """op11_jaccard_join: a task's memory does not grow with the pairs of all of its regions."""
    monkeypatch.setattr(metric_join, "HELD_PAIRS", 5000, raising=False)
    rng = np.random.default_rng(3)
    members = [rng.choice(200, metric_join.LEAF, replace=False) for _ in range(100)]
    home = np.repeat(np.arange(100), metric_join.LEAF)
    node = np.concatenate(members)
    again = rng.permutation(np.concatenate((np.arange(len(home)), np.arange(50))))  # some visits come twice
    home, node = home[again], node[again]
    n, rank = np.full(len(home), 100), np.ones(len(home), np.int32)
    columns = [home, node, n, rank, node + 1000, np.zeros(len(home), np.int32)]
    halves = [[c[:3000].tobytes() for c in columns], [c[3000:].tobytes() for c in columns]]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *[pa.array([c]) for c in half]], names=["part", *[f"c{i}" for i in range(6)]])
        for half in halves
    ]
    common, largest = Counter(), 0
    for out in metric_join._small_pairs(iter(batches)):
        largest = max(largest, out.num_rows)
        for row in out.to_pylist():
            assert row["x_last"] == row["a"] + 1000 and row["y_last"] == row["b"] + 1000 and row["meets"] == 1
            common[tuple(sorted((row["a"], row["b"])))] += row["common"]
    expected = Counter(pair for nodes in members for pair in combinations(sorted(nodes.tolist()), 2))
    assert common == expected
    assert largest <= 5000 + metric_join.LEAF**2 // 2


def test_texts_are_not_shuffled_and_wide_visits_are_joined_once(spark, prose, monkeypatch, tmp_path):
    """op11_jaccard_join: whole texts go to no shuffle, and the join of wide visits is not made twice."""
    plans, materialise = {}, metric_join.materialise

    def kept(df, label, *rest):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, label, *rest)

    monkeypatch.setattr(metric_join, "materialise", kept)
    words, passage = prose(5, 400), prose(6, 60)
    draw = random.Random(5)
    rows = [(i, " ".join([*passage, *(draw.choice(words) for _ in range(20 + i % 7))])) for i in range(30)]
    rows += [(100 + i, " ".join([*words[:90], "end", str(i)])) for i in range(30)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    out = metric_join.linked_classes(spark.read.parquet(path), leaf=4, frequent=3)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)
    assert len(plans["join-sets"]) == 2
    for plan in plans["join-sets"]:
        dealt = re.findall(r"Exchange (?:hash|range)partitioning\(.*", plan)
        assert all("_groupingexpression" in x for x in dealt), dealt  # the bitmap of wanted rows
    for plan in plans["join-wide"]:
        assert not re.search(r"Join \[home#\d+L?, size#\d+L?\]", plan)
    assert "numbered" not in plans


def test_sketches_drop_no_link_and_most_other_pairs():
    """op11_jaccard_join: pairs are told apart before their sets are read, at the bound exactly."""
    rng = np.random.default_rng(9)
    sets, pairs, linked = [], [], []
    for n in [1, 2, 5, 9, 63, 64, 65, 100, 128, 129, 700, 1000, 1025, 5000]:
        for extra in [0, n // 4, n // 4 + 1, n // 2, n]:
            for shared in (n, n // 2):
                ids = rng.integers(0, 1 << 56, 2 * n + extra - shared, dtype=np.int64)
                x, y = np.sort(ids[:n]), np.sort(np.concatenate((ids[:shared], ids[n:])))
                pairs.append((len(sets), len(sets) + 1))
                linked.append(100 * shared >= 80 * len(ids))
                sets += [x, y]
    n = np.array([len(s) for s in sets])
    sketches = metric_join._sketches(n, np.repeat(np.arange(len(sets)), n), np.concatenate(sets))
    assert all(64 <= 8 * len(s) < max(2 * k, 65) for s, k in zip(sketches, n, strict=True))
    a, b = np.array(pairs).T
    batch = pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(n[a] + n[b]), pa.array([sketches[i] for i in a]), pa.array([sketches[i] for i in b])],
        names=["a", "b", "__n", "__x", "__y"],
    )
    (out,) = metric_join._sketches_fit(iter([batch]))
    kept = set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
    assert all(pair in kept for pair, is_link in zip(pairs, linked, strict=True) if is_link)
    far = [p for p in pairs if 60 <= n[p[0]] and len(np.intersect1d(sets[p[0]], sets[p[1]])) <= n[p[0]] // 2]
    assert far and not kept.intersection(far)
    assert metric_join._sketches(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) == []


def _visiting(sets, of=metric_join._visits):
    """A batch of nodes and the first shingles of their sets."""
    n = np.array([len(s) for s in sets])
    homes = [np.sort(s)[:k] for s, k in zip(sets, of(n), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(sets)) * 7 + 1), pa.array(n), pa.array([h.tolist() for h in homes], pa.list_(pa.int64()))], names=["node", "n", "homes"]
    ), homes


def _near_copies(rng, n, copies, edits):
    ids = rng.integers(0, 1 << 56, n, dtype=np.int64)
    out = []
    for _ in range(copies):
        mine = ids.copy()
        at = rng.choice(n, edits, replace=False)
        mine[at] = rng.integers(0, 1 << 56, edits, dtype=np.int64)
        out.append(mine)
    return out


@pytest.mark.parametrize("parts", [7, 500])
def test_pairs_come_where_runs_begin_and_end(parts):
    """op11_jaccard_join: rows of a pair do not grow with the parts that its regions lie in, and count the same."""
    rng = np.random.default_rng(11)
    sets = _near_copies(rng, 900, 20, 4) + _near_copies(rng, 300, 3, 90) + _near_copies(rng, 6, 2, 1)
    batch, homes = _visiting(sets)
    every, none = np.full(1 << 22, 255, np.uint8), np.zeros(1 << 22, np.uint8)
    (blobs,) = metric_join._narrow(iter([batch, batch.slice(0, 0)]), every, none, parts, 1.0)
    common, rows, rank, meets = Counter(), Counter(), Counter(), set()
    for i in range(blobs.num_rows):
        for out in metric_join._small_pairs(iter([blobs.slice(i, 1)]), runs=True):
            for row in out.to_pylist():
                pair = (row["a"] - 1) // 7, (row["b"] - 1) // 7
                rows[pair] += 1
                common[pair] += row["common"]
                rank[pair] = max(rank[pair], row["x_rank"])
                meets |= {pair} if row["meets"] else set()
    expected = {}
    for i, j in combinations(range(len(sets)), 2):
        shared = np.intersect1d(homes[i], homes[j])
        if len(shared) and 100 * min(len(sets[i]), len(sets[j])) >= 80 * max(len(sets[i]), len(sets[j])):
            expected[i, j] = shared
    assert common == {pair: len(shared) for pair, shared in expected.items()}
    assert rank == {(i, j): np.searchsorted(homes[i], shared[-1]) + 1 for (i, j), shared in expected.items()}
    linked = {(i, j) for i, j in expected if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked and linked <= meets
    # 20 copies differ in up to 8 shingles each, few of them among the first 210.
    assert sum(rows[pair] for pair in combinations(range(20), 2)) < 20 * 190


def test_nodes_without_enough_company_have_no_link():
    """op11_jaccard_join: a node that shares too few regions to be linked visits none; linked ones all stay."""
    rng = np.random.default_rng(12)
    sets = []
    for n in (1, 2, 3, 5, 8, 21, 64, 100, 333, 1200):
        for share in (1.0, 0.9, 0.8):  # a subset at the bound exactly, its missing shingles first or last
            ids = np.sort(rng.integers(0, 1 << 56, n, dtype=np.int64))
            keep = -(-int(round(share * 100)) * n // 100)
            sets += [ids, ids[:keep]] + [ids, ids[n - keep :]]
    unrelated = [rng.integers(0, 1 << 56, 500, dtype=np.int64) for _ in range(50)]
    for i, s in enumerate(unrelated[1:]):
        s[:9] = unrelated[i][-9:]  # some common shingles
    batch, homes = _visiting(sets + unrelated)
    n = batch.column("n").to_numpy()
    flat, owner = np.concatenate(homes), np.repeat(np.arange(len(homes)), [len(h) for h in homes])
    seen = Counter()
    for i in range(len(homes)):
        partner = i ^ 1
        for key in homes[i] if i >= len(sets) else np.intersect1d(homes[i], homes[partner]):
            seen[i, int(key)] += 1
    others = Counter(int(k) for h in homes[len(sets) :] for k in h)
    several = np.array([seen[o, int(k)] > 0 if o < len(sets) else others[int(k)] > 1 for o, k in zip(owner, flat, strict=True)])
    stays = metric_join._linkable(n, owner, several, 1.0)
    assert stays[: len(sets)].all()
    assert not stays[len(sets) :].any()
    plain = np.flatnonzero(n == 500)
    assert metric_join._linkable(n, owner, several, 0.0)[plain].sum() <= len(plain)


@pytest.mark.parametrize("log,parts", [(25, 12), (27, 53)])
def test_counted_regions_are_those_of_several_nodes(log, parts):
    """op11_jaccard_join: few bytes a visit, any size of the bitmap, parts that begin inside a byte."""
    rng = np.random.default_rng(13)
    sets = _near_copies(rng, 400, 9, 3) + [rng.integers(0, 1 << 56, 700, dtype=np.int64) for _ in range(200)]
    batch, homes = _visiting(sets)
    halves = [out for part in (batch.slice(0, 4), batch.slice(4)) for out in metric_join._tallied(iter([part]), parts)]
    table = pa.Table.from_batches(halves)
    assert table.nbytes < 40 * sum(map(len, homes))
    several, wide = np.zeros(1 << log, bool), np.zeros(1 << 25, bool)
    for part in set(table.column("part").to_pylist()):
        mine = table.filter(pa.compute.equal(table.column("part"), part))
        (row,) = metric_join._tally_bits(mine, parts, 4, log).to_pylist()
        for bits, name, more in ((several, "several", log - 25), (wide, "wide", 0)):
            on = np.unpackbits(np.frombuffer(row[name], np.uint8), bitorder="little")[: row["n"] << more]
            bits[row["lo"] << more : (row["lo"] + row["n"]) << more] = on
    keys, counts = np.unique(np.concatenate(homes), return_counts=True)
    for bits, least in ((several, 2), (wide, 5)):
        packed = np.packbits(bits, bitorder="little")
        assert metric_join._on(packed, keys[counts >= least]).all()
        assert metric_join._on(packed, keys[counts < least]).mean() < 0.01


def test_one_row_of_equal_sets_visits(spark):
    """op11_jaccard_join: of rows with equal sets in any files one goes to the regions."""
    rows = [(i % 40, f"{i % 50}") for i in range(2000)]
    described = spark.createDataFrame([(i, n, i // 100, [n, n + 1]) for i, (n, _) in enumerate(rows)], "index long, node long, file long, homes array<long>")
    kept = metric_join._one_row_each(described).groupBy("node").count().collect()
    assert len(kept) == 40 and sum(r["count"] for r in kept) <= 42


def test_last_pairs_are_told_apart_before_they_are_listed(spark):
    """op11_jaccard_join: nodes of a mixed cell give the pairs that their sketches allow, all links among them."""
    rng = np.random.default_rng(14)
    sets = _near_copies(rng, 150, 60, 24)  # alike, but not linked
    for k in range(0, 40, 2):  # these differ in up to 30 shingles of 300, as many as a link allows at most in 33
        sets[k + 1] = np.concatenate((sets[k][: 150 - 16 + k % 4], rng.integers(0, 1 << 56, 16 - k % 4, dtype=np.int64)))
    sets += [np.arange(3), np.arange(4), np.concatenate((sets[0], rng.integers(0, 1 << 56, 37, dtype=np.int64)))]
    cells = [(9, i, len(s), 0.3, False, i, 0) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(cells, "home long, node long, n long, distance double, visitor boolean, component long, main long")
    held = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate([*sets, sets[0]])], "node long, ids array<long>")
    held = held.replace(len(sets), 0, ["node"])  # a node may come twice
    found = [tuple(r) for r in metric_join._last_pairs(frame, held).collect()]
    linked = {
        (i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    }
    assert len(linked) >= 20 and linked <= set(found) and len(found) == len(set(found)) <= 2 * len(linked)
