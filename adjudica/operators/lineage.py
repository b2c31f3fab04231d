"""Labels through derived columns: what a column is made of decides how it is protected."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from adjudica.operators.analytics import merge_labels
from adjudica.sources.scratch import materialise, new_path


def inherited_labels(labels: DataFrame, lineage: DataFrame) -> DataFrame:
    """One label per column, its own and those of all columns it is derived from, at any distance.

    ``labels`` has ``field``, ``category`` and ``regimes`` (as :func:`analytics.merge_labels` takes them),
    ``lineage`` has ``source`` and ``target`` columns; it may branch, meet again and hold cycles. The
    most protective category and all regimes win. Columns that no label reaches have no row.

    A label is a set of tags, and tags only add up. Each round follows the edges from the tags that were
    new in the round before, and keeps what is new to its column, so every (column, tag) is handed on
    once. The number of rounds is the longest way a tag travels, not the number of columns.
    Edges with a NULL end lead nowhere, labels of a NULL field stay with it.
    """
    tags = F.concat(
        F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("tag"))),
        F.transform(F.coalesce("regimes", F.array().cast("array<string>")), lambda r: F.struct(F.lit("regime").alias("kind"), r.alias("tag"))),
    )
    edges = materialise(lineage.select("source", "target").where("source <> target").distinct(), "lineage")
    # Each round is one folder more of one table, which is read in one scan.
    spark, path = labels.sparkSession, new_path(labels.sparkSession, "tags")
    fresh = labels.select("field", F.explode(tags).alias("t")).select("field", "t.*").distinct()
    schema = fresh.schema
    for number in count():
        folder = f"{path}/round={number}"
        fresh.write.parquet(folder)
        new, known = (spark.read.schema(schema).parquet(p) for p in (folder, path))
        if new.isEmpty():
            break
        # A category of NULL says nothing and is not handed on.
        step = (
            new.where(F.col("tag").isNotNull())
            .join(edges, F.col("field") == F.col("source"))
            .select(F.col("target").alias("field"), "kind", "tag")
            .distinct()
        )
        fresh = step.join(known, ["field", "kind", "tag"], "left_anti")
    one = known.select(
        "field",
        F.when(F.col("kind") == "category", F.col("tag")).alias("category"),
        F.when((F.col("kind") == "regime") & F.col("tag").isNotNull(), F.array("tag"))
        .otherwise(F.array().cast("array<string>"))
        .alias("regimes"),
    )
    return merge_labels(one)
