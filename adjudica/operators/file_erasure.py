"""Erasure that touches only the files that hold a subject.

The index of a :class:`~adjudica.sources.file_table.FileTable` names the files that may hold one of
the requested values. Only these are read; those that really have a match are written anew and take
the old ones' place in the next version. All other files stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from adjudica.operators import erasure
from adjudica.sources.file_table import FileTable
from adjudica.sources.scratch import materialise
from adjudica.sources.tables import write_table

PATH = "__path"


class FileErasure(NamedTuple):
    """Outcome of a batch, not yet visible: what :func:`publish` needs, and which files it took.

    ``candidates`` were read, ``hit`` are the ones among them that hold a subject, ``added`` their
    new copies.
    """

    erasure: erasure.Erasure
    version: int
    candidates: list[str]
    hit: list[str]
    added: DataFrame | None


def _paths(frame: DataFrame) -> list[str]:
    return sorted(r["path"] for r in frame.select("path").distinct().collect())


def _wanted(table: FileTable, requests: DataFrame) -> DataFrame:
    """column, value: the requested values as the index holds them, read as the column's type."""
    value = F.lit(None).cast("string")
    for f in table.schema.fields:
        typed = F.col("where_value").try_cast(f.dataType).cast("string")
        value = F.when(F.col("where_column") == f.name, typed).otherwise(value)
    return requests.select(F.col("where_column").alias("column"), value.alias("value")).distinct()


def erase(
    table: FileTable, requests: DataFrame, audit: DataFrame, schema: StructType, table_name: str, **options
) -> FileErasure:
    """Carry out a batch of requests, with the results of :func:`erasure.erase` on the whole table.

    A subject of the audit is left alone and makes no file a candidate. New files are written here
    and become part of the table by :func:`publish`.
    """
    version = table.version()
    erasure.check_columns(requests, table.schema)
    done = erasure.prior_erasures(audit, table_name)
    fresh = requests.select(*erasure.KEY).distinct().join(done, erasure.KEY, "left_anti")
    candidates = _paths(table.candidates(_wanted(table, fresh), version))
    rows = table.read(candidates)
    if candidates:
        rows = rows.select("*", F.col("_metadata.file_path").alias(PATH))
    else:
        rows = rows.withColumn(PATH, F.lit(None).cast("string"))
    result = erasure.erase(rows, requests, audit, schema, table_name, **options)
    hit = _paths(result.matched.select(F.col(PATH).alias("path")))
    added = None
    if hit:
        # The same erasure over the files with a match; the others of the candidates are left alone.
        added = table.write_files(result.table.where(F.col(PATH).isin(*hit)).repartition(len(hit), PATH).drop(PATH))
    return FileErasure(result, version, candidates, hit, added)


def publish(table: FileTable, result: FileErasure, audit_path: str) -> int:
    """Append the audit, then commit the new version, so that no row is erased without a record."""
    write_table(materialise(result.erasure.audit, "erasure-audit"), audit_path, mode="append")
    if not result.hit:
        return result.version
    return table.commit(result.version, result.hit, result.added)


def sweep(table: FileTable, tombstones: DataFrame, key: str, schema: StructType) -> list[str]:
    """Null the PII of tombstoned keys in a derived table; returns the files that were written anew."""
    version = table.version()
    gone = tombstones.select(key).where(F.col(key).isNotNull()).distinct()
    wanted = gone.select(F.lit(key).alias("column"), F.col(key).cast(table.schema[key].dataType).cast("string").alias("value"))
    candidates = _paths(table.candidates(wanted, version))
    if not candidates:
        return []
    rows = table.read(candidates).select("*", F.col("_metadata.file_path").alias(PATH))
    hit = _paths(rows.join(gone, key, "left_semi").select(F.col(PATH).alias("path")))
    if hit:
        swept = erasure.sweep(rows.where(F.col(PATH).isin(*hit)), gone, [key], schema)
        added = table.write_files(swept.repartition(len(hit), PATH).drop(PATH))
        table.commit(version, hit, added)
    return hit


def untouched(before: Sequence[str], result: FileErasure) -> list[str]:
    """The files that stay as they are."""
    return sorted(set(before) - set(result.hit))
