import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use for their own results or internals.
CLASH = (
    "row", "id", "size", "score", "kept", "keep_id", "group_size", "class_id", "bin_id", "digest", "length",
    "prefix", "key", "node", "band", "bands", "piece", "copies", "doc", "stats", "label", "word count",
)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with further columns of clashing names."""
    from pyspark.sql import functions as F

    def make(rows, clash=True):
        full = [(*r, *(None,) * (4 - len(r)), 0)[:5] for r in rows]
        df = spark.createDataFrame(full, SCHEMA).coalesce(2)
        return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]) if clash else df

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded prose: words of random syllables, as many as asked for."""
    import random

    def make(seed, n):
        rng = random.Random(seed)
        return [
            "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)
        ]

    return make
