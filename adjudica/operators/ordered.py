"""Ordered computations that never put one key's whole history into one task.

A window partitioned by key sends all rows of a key to one task, and a window without a key sends
all rows to one. Here rows are range-partitioned by (key, order) instead, so a hot key spreads over
many segments. Each segment is reduced to one small row; prefixes over those rows (at most one per
segment and key) are then joined back to the segments.

The segment number comes from sampled range bounds, so the split is written once and read back;
computing it twice could give two different splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.sources.scratch import materialise

SEGMENT = "__segment"
KEY = "__key"


def default_segments(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segments: int | None = None,
    label: str = "segments",
) -> DataFrame:
    """Rows with the number of their range segment; ``order`` should tell rows apart."""
    ranged = df.repartitionByRange(segments or default_segments(df), *keys, *order)
    return materialise(ranged.withColumn(SEGMENT, F.spark_partition_id()), label)


def _keyed(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with the key as one struct, and the columns that group by key.

    A struct is never NULL and equals another with NULLs in the same fields. So plain equality
    joins NULL keys too, and the window over a segment and the join to it share one shuffle.
    """
    if not keys:
        return rows, []
    return rows.withColumn(KEY, F.struct(*keys)), [KEY]


def _inside(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by, SEGMENT).orderBy(*order)


def _across(by: Sequence[str]):
    # Without a key this window holds one row per segment.
    return Window.partitionBy(*by).orderBy(SEGMENT)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    segments: int | None = None,
) -> DataFrame:
    """Add inclusive running sums per key, in order."""
    inputs = {name: f"__value_{i}" for i, name in enumerate(values)}
    prepared = df.select("*", *[values[n].alias(c) for n, c in inputs.items()])
    rows, by = _keyed(split(prepared, keys, order, segments, "running"), keys)
    totals = rows.groupBy(*by, SEGMENT).agg(*[F.sum(c).alias(c) for c in inputs.values()])
    before = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, SEGMENT, *[F.sum(c).over(before).alias(f"{c}_before") for c in inputs.values()]
    )
    within = _inside(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *[F.sum(c).over(within).alias(f"{c}_here") for c in inputs.values()])

    def total(c: str) -> Column:
        """NULL only where no value has been seen yet, as for a sum over one window."""
        here, earlier = F.col(f"{c}_here"), F.col(f"{c}_before")
        return F.coalesce(here + earlier, here, earlier)

    return local.join(offsets, [*by, SEGMENT]).select(
        *df.columns, *[total(c).alias(n) for n, c in inputs.items()]
    )


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    segments: int | None = None,
) -> DataFrame:
    """Add the preceding row's values per key: ``columns`` maps new names to existing ones."""
    rows, by = _keyed(split(df, keys, order, segments, "previous"), keys)
    carried = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    last = rows.groupBy(*by, SEGMENT).agg(
        F.max_by(carried, F.struct(*order)).alias("__last")
    )
    handed = last.select(
        *by, SEGMENT, F.lag("__last").over(_across(by)).alias("__handed_over")
    )
    local = rows.select("*", F.lag(carried).over(_inside(by, order)).alias("__local"))
    joined = local.join(handed, [*by, SEGMENT]).withColumn(
        "__prior", F.coalesce("__local", "__handed_over")
    )
    return joined.select(*df.columns, *[F.col(f"__prior.{n}").alias(n) for n in columns])
