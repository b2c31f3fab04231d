import re
from collections import Counter, defaultdict

from adjudica.llm import mixing


def plain_targets(sizes):
    """Deal by weight; sources above their ceiling are set to it and the rest is dealt anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values()) * 1.5
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        level = left / max(sum(weights[s] for s in order if s not in full), 1)
        over = {s for s in order if s not in full and level * weights[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weights[s] for s in order}
        full |= over


def documents(prose):
    rows, n = [], 0
    for source, count in ((None, 30), ("a", 400), ("b", 40), ("B", 8), ("é", 3), ("", 60), ("none", 0)):
        for _ in range(count):
            n += 1
            rows.append((n, " ".join(prose(n, 1 + n * 7 % 50)), "xx", source))
    return rows + [(9001, None, "xx", "a"), (9002, " \t\n\x0b", "xx", "b"), (9003, "a b", "xx", "c"), (None, "x y", "xx", "c"), (9004, None, "xx", "hollow")]


def test_targets_and_counts(frame, prose):
    rows = documents(prose)
    got = mixing.sample(frame(rows)).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    want = plain_targets(dict(sizes))
    taken, longest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= -(-rate // 1) and r.taken == r.copies * r.size <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        longest[source[r.doc_id]] = max(longest[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - want[s]) <= 2 * longest[s] for s in want)


def test_reruns_and_partitions_agree(frame, prose):
    rows = documents(prose)
    one = sorted(map(repr, mixing.sample(frame(rows)).collect()))
    assert one == sorted(map(repr, mixing.sample(frame(rows[::-1]).repartition(7)).collect()))


def test_mix_emits_the_copies(frame, prose):
    docs = frame(documents(prose) + [(1, "twice the same row", "xx", "a")] * 2)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = Counter()
    for r in mixing.sample(docs).collect():
        times[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in times.items() if v})


def test_empty(frame):
    assert mixing.sample(frame([])).count() == 0
    assert mixing.mix(frame([])).count() == 0
    only = mixing.sample(frame([(1, None, None, None)])).first()
    assert (only.size, only.target, only.taken) == (0, 0.0, 0)
    assert mixing.mix(frame([(1, "", None, "s")])).count() == 0
