from collections import defaultdict

from adjudica.llm import exact_dedup as ed

LONG = "Long Text " * 30_000


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


ROWS = [
    (1, "Same text"), (5, "sAME TEXT"), (3, "same text"), (4, "same texT."), (6, None), (7, ""), (None, ""),
    (8, "École"), (9, "école"), (10, LONG), (11, LONG + "x"), (12, LONG.upper()), (13, "a"), (13, "a"), (None, "z"),
    (None, "z"), (14, " same text"),
]


def test_groups_match_brute_force(frame):
    got = ed.exact_groups(frame(ROWS)).collect()
    groups = defaultdict(list)
    for doc_id, text in ROWS:
        groups[lowered(text)].append(doc_id)
    want = [(d, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g]
    assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size) for r in got))) == sorted(map(repr, want))
    # Exactly one row of each group stays, and it has the largest id.
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_copies_keeps_all_columns(frame):
    docs = frame(ROWS)
    left = ed.drop_copies(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert sorted(lowered(r.text) for r in rows) == sorted({lowered(t) for _, t in ROWS})
    assert {r.doc_id for r in rows if lowered(r.text) == "same text"} == {5}


def test_empty_and_carried(frame):
    assert ed.exact_groups(frame([])).count() == 0
    assert ed.drop_copies(frame([])).count() == 0
    from pyspark.sql import functions as F

    out = ed.exact_groups(frame([(1, "a"), (2, None)]), carry={"kind": F.upper("text")})
    assert {(r.doc_id, r.kind) for r in out.collect()} == {(1, "A"), (2, None)}
