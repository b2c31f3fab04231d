from pyspark.sql import functions as F

from adjudica.llm import rows


def test_keys_are_unique_and_the_same_in_every_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("__row text")).repartition(5).write.parquet(path)
    docs = spark.read.parquet(path).where("doc_id >= 100")
    twice = docs.unionByName(docs)
    multiplied = docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    joined = docs.join(spark.range(2).select(F.col("id").alias("n")), F.lit(True))
    for df, stored in ((docs, False), (twice, True), (multiplied, True), (joined, True), (spark.range(400), True)):
        key = rows.keyed(df)
        first, second = (sorted(map(repr, key.collect())) for _ in range(2))
        assert first == second
        assert key.select(rows.ROW).distinct().count() == df.count() == len(first)
        assert rows._is_plain_read(df) != stored
        assert key.select(f"{rows.DOC}.*").columns == df.columns
