from pyspark.sql import functions as F

from adjudica.llm import membership
from adjudica.sources.scratch import materialise


def test_joins_match_plain_joins_also_when_the_bitmap_is_full(spark, monkeypatch):
    df = materialise(spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "test")
    keys = materialise(spark.range(0, 6000, 7).select(F.col("id").alias("k")), "test")
    for bits in (membership.FILTER_BITS, 64):
        monkeypatch.setattr(membership, "FILTER_BITS", bits)
        on = membership.semi_join(df, "k", keys).count()
        assert on == df.join(keys, "k", "left_semi").count()
        assert membership.anti_join(df, "k", keys).count() == 3000 - on
    none = keys.limit(0)
    assert membership.semi_join(df, "k", none).count() == 0
    assert membership.anti_join(df, "k", none).count() == 3000
