import math
import random

import pytest

import verify
from adjudica.llm import cosine, queries


def plain(rows, k):
    def unit(e):
        e = [x if x is not None and math.isfinite(x) else 0.0 for x in [*e, *[None] * (40 - len(e))]]
        n = math.sqrt(math.fsum(x * x for x in e))
        return tuple(x / n if n else 0.0 for x in e), tuple(e)

    all_rows = sorted({(i, *unit(e)) for i, e in rows if i is not None and e is not None})
    out = []
    for q in all_rows:
        if q[0] % 100 == 0:
            near = sorted((-round(math.fsum(a * b for a, b in zip(q[1], c[1])), 9), c[0]) for c in all_rows if c != q)
            out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(near[:k])]
    return sorted(out)


def search(spark, rows, k, block=cosine.BLOCK):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vectors = cosine.dense(df, "vec_id", "embedding").cache()
    got = cosine.nearest(vectors, vectors.where("id % 100 = 0"), k, block).collect()
    return sorted((r.query_id, r.rank, r.neighbor_id, r.similarity) for r in got)


@pytest.mark.parametrize("block", [cosine.BLOCK, 4])
def test_brute_force(spark, block):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-9, 9)) for _ in range(40)]) for i in range(900)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)]  # copies of a query, a query among them
    rows += [(7, rows[7][1]), (7, rows[8][1]), (2500, None), (None, rows[3][1]), (2501, []), (2502, [1.0]), (2503, [None] * 40)]
    rows += [(2600, [0.0] * 40), (2601, [math.nan, math.inf, 3.0]), (2700, rows[8][1])]
    got, want = search(spark, rows, 3, block), plain(rows, 3)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_few_rows(spark):
    rows = [(0, [1.0] * 32), (1, [1.0] * 31 + [-1.0])]
    assert [r[:3] for r in search(spark, rows, 5)] == [(0, 1, 1)]
    assert search(spark, rows[:1], 5) == [] and search(spark, rows[1:], 5) == [] and search(spark, [], 5) == []


def test_recall_against_cosine(spark, sf_dir):
    """The vectors' search finds every neighbour; the folded codes find few, as the README says."""
    con = verify.warehouse(sf_dir)
    want = {r[:2] for r in con.execute(
        "select q.vec_id, c.vec_id from embeddings q, embeddings c where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id "
        "qualify row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding, c.embedding) desc, c.vec_id) <= 10"
    ).fetchall()}

    def recall(name):
        return len(want & {(r.query_id, r.neighbor_id) for r in queries.QUERIES[name](spark, sf_dir).collect()}) / len(want)

    assert recall("op6_topk_vectors") == 1
    assert recall("op6_topk_search") < 0.3
