import random

import pytest

from adjudica.llm import hamming


def plain(rows, k, bits):
    def code(e):
        return tuple(sum(e[j::bits][i] or 0 for i in range(len(e[j::bits]))) > 0 for j in range(bits))

    codes = sorted({(i, code(e)) for i, e in rows if i is not None and e is not None})
    out = []
    for q in codes:
        if q[0] % 100 == 0:
            far = sorted((sum(a != b for a, b in zip(q[1], c[1])), c[0], c[1]) for c in codes if c != q)
            out += [(q[0], n + 1, i, d) for n, (d, i, _) in enumerate(far[:k])]
    return out


def search(spark, rows, k, bits):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, code int")
    codes = hamming.binary_codes(df, "vec_id", "embedding", bits).cache()
    return [tuple(r) for r in hamming.nearest(codes, codes.where("id % 100 = 0"), k, bits).collect()]


@pytest.mark.parametrize("bits,k", [(32, 3)])
def test_brute_force(spark, bits, k):
    rng = random.Random(bits)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)]) for i in range(900)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)]  # copies of a query, a query among them
    rows += [(7, rows[7][1]), (7, rows[8][1]), (2500, None), (None, rows[3][1]), (2501, []), (2502, [1.0]), (2503, [None] * 40)]
    got = search(spark, [(*r, 0, 0) for r in rows], k, bits)
    assert sorted(got) == sorted(plain(rows, k, bits))


def test_few_rows(spark):
    rows = [(0, [1.0] * 32, 0, 0), (1, [1.0] * 31 + [-1.0], 0, 0)]
    assert search(spark, rows, 5, 32) == [(0, 1, 1, 1)]
    assert search(spark, rows[:1], 5, 32) == []
    assert search(spark, rows[1:], 5, 32) == [] and search(spark, [], 5, 32) == []


def test_codes_of_64_bits(spark):
    """The first bit is the sign of the long: it overflows nothing and counts as others."""
    rows = [(0, [1.0] * 64, 0, 0), (1, [-1.0] + [1.0] * 63, 0, 0), (2, [1.0] * 63 + [-1.0], 0, 0)]
    assert sorted(search(spark, rows, 5, 64)) == sorted(plain([r[:2] for r in rows], 5, 64)) == [(0, 1, 1, 1), (0, 2, 2, 1)]
    with pytest.raises(ValueError, match="64 bits"):
        search(spark, rows, 5, 128)
