import random

from adjudica.llm import line_dedup

MIN = 6


def plain(rows):
    """Lines that lie in a run of enough words which occurs before, by ids and lines."""
    docs, first, out = [], {}, []
    for number, (doc_id, text) in enumerate(rows):
        lines = [(k, " ".join(x.lower().split())) for k, x in enumerate((text or "").split("\n")) if x.strip()]
        runs = []
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for _, x in lines[a : b + 1]) >= MIN:
                    runs.append((a, b))
        docs.append(((doc_id is None, doc_id or 0, number), lines, runs))
    for place, lines, runs in sorted(docs):
        for a, b in runs:
            first.setdefault(tuple(x for _, x in lines[a : b + 1]), (place, a))
    for (doc_id, text), (place, lines, runs) in zip(rows, docs, strict=True):
        gone = set()
        for a, b in runs:
            if first[tuple(x for _, x in lines[a : b + 1])] != (place, a):
                gone |= set(range(lines[a][0], lines[b][0] + 1))
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        out.append((doc_id, kept, len(gone)))
    return out


def test_brute_force(frame):
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.choice((1, 1, 2, 3, 7)))) for _ in range(25)]
    rows = []
    for i in range(80):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 9))]
        if i % 5 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "  ")
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.1 else x for x in lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "one two three four five six"), (None, "One two  three four five six"), (204, "x")]
    rows += [(300, "\n".join(["same line of six words here"] * 60))]
    got = line_dedup.dedup_lines(frame(rows), min_words=MIN).collect()
    assert sorted(repr((r.doc_id, r.clean_text, r.removed_lines)) for r in got) == sorted(map(repr, plain(rows)))
    assert {r.doc_id: r.clean_text for r in got}[None] == ""
    for r in got:
        assert sum(r.removed_lines > 0 for _ in (0,)) == (len(r.runs) > 0)


def test_runs_and_repeats(frame):
    a = "alpha beta gamma delta epsilon zeta\neta theta\niota"
    docs = frame([(1, a), (2, "before it all\n" + a + "\nafter"), (2, "x"), (3, a), (3, a)])
    got = line_dedup.dedup_lines(docs, min_words=MIN).collect()
    runs = {(r.doc_id, tuple(map(tuple, r.runs)), r.clean_text) for r in got}
    assert (2, ((1, 3, 1, 0),), "before it all\nafter") in runs
    assert [r.clean_text for r in got if r.doc_id == 3] == ["", ""]
    assert line_dedup.dedup_lines(frame([]), min_words=MIN).count() == 0
