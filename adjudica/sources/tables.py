"""Reading and writing tables: Parquet folders or catalog tables, always by column name."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def is_path(name: str) -> bool:
    return "/" in name


def table_exists(spark: SparkSession, name: str) -> bool:
    if not is_path(name):
        return spark.catalog.tableExists(name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(path))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(name) if is_path(name) else spark.table(name)


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """Reorder ``df`` to ``schema`` by name; refuse missing, extra or differently typed columns."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in schema.fields}
    missing = sorted(want.keys() - have.keys())
    extra = sorted(have.keys() - want.keys())
    retyped = sorted(
        f"{n}: {have[n].simpleString()} is not {want[n].simpleString()}"
        for n in want.keys() & have.keys()
        if have[n].simpleString() != want[n].simpleString()
    )
    if missing or extra or retyped:
        raise ValueError(f"append mismatch: missing {missing}, extra {extra}, types {retyped}")
    return df.select(*schema.names)


def write_table(
    df: DataFrame, name: str, mode: str = "overwrite", partition_by: list[str] | None = None
) -> None:
    """Replace a table, or append to it by column name."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown write mode {mode!r}")
    spark = df.sparkSession
    if mode == "append" and table_exists(spark, name):
        df = align(df, read_table(spark, name).schema)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if is_path(name):
        writer.parquet(name)
    else:
        writer.format("parquet").saveAsTable(name)


def ensure_table(spark: SparkSession, name: str, schema: StructType) -> bool:
    """Create an empty table when it is absent. True when this call created it."""
    if table_exists(spark, name):
        return False
    empty = spark.createDataFrame([], schema)
    try:
        if is_path(name):
            empty.write.mode("ignore").parquet(name)
        else:
            empty.write.format("parquet").mode("ignore").saveAsTable(name)
    except AnalysisException:
        # Another writer created it between the test and the write.
        if not table_exists(spark, name):
            raise
        return False
    return True


def replace_folder(spark: SparkSession, staged: str, path: str) -> None:
    """Put a staged folder in the place of ``path``: two renames, then the old copy goes."""
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, old = new_path(path), new_path(f"{path}.replaced-{uuid.uuid4().hex}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had_old = system.exists(target)
    if had_old and not system.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not system.rename(new_path(staged), target):
        if had_old:
            system.rename(old, target)
        raise OSError(f"cannot move {staged} to {path}")
    if had_old:
        system.delete(old, True)
    spark.catalog.refreshByPath(path)


def write_contracts(
    contracts: DataFrame, path: str, payload: str = "payload", mode: str = "overwrite"
) -> bool:
    """Parquet sink: proposal columns flattened next to the typed payload column.

    Nothing is written when there are no contracts. The emptiness test reads one row at most.
    """
    if contracts.isEmpty():
        return False
    rest = [F.col(c) for c in contracts.columns if c != payload]
    contracts.select(*rest, F.col(payload)).write.mode(mode).parquet(path)
    return True
