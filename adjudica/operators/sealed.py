"""Retention of audit snapshots by keys: what expires is a key, not a file of the audit.

Snapshots are stored encrypted under a data key of their subject and day of expiry; data keys are
stored encrypted under a master key. Keys of one month of expiry are one folder. A key that is
gone makes its snapshots unreadable, and the audit, however large, is never written again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adjudica.sources.scratch import materialise, new_path
from adjudica.sources.tables import replace_folder

KEYS = "key_id string, expires_on date, wrapped binary, month string"
SNAPSHOT, SEALED = "pre_erasure_snapshot", "sealed_snapshot"


@dataclass(frozen=True)
class KeyStore:
    """Data keys below ``path``. ``master`` is a Column of 16, 24 or 32 bytes (as a literal it is part of
    the plan), ``subject`` the audit's columns that name a subject. One writer at a time."""

    spark: SparkSession
    path: str
    master: Column
    subject: Sequence[str]
    years: int = 7

    def _folder(self, month: str | None = None):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/month={month}" if month else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keys(self) -> DataFrame:
        path, system = self._folder()
        if not system.exists(path):
            return self.spark.createDataFrame([], KEYS)
        return self.spark.read.schema(KEYS).parquet(self.path)

    def _placed(self, audit: DataFrame) -> DataFrame:
        """The audit with the name of each row's key. Names are keyed hashes: the store holds no identifier."""
        named = F.to_json(F.struct(*self.subject), {"ignoreNullFields": "false"})
        expires = F.add_months(F.col("erased_at").cast("date"), 12 * self.years)
        return audit.withColumns(
            {"__key_id": F.sha2(F.concat(self.master, named.cast("binary")), 256), "__expires_on": expires}
        )

    def _fresh_key(self) -> Column:
        """32 random bytes: each encryption draws 12 from the system's secure source as its start."""
        starts = [
            F.substring(F.aes_encrypt(F.concat(F.lit(part), F.col("key_id")).cast("binary"), self.master, F.lit("GCM")), 1, 12)
            for part in "abc"
        ]
        return F.unhex(F.sha2(F.concat(*starts), 256))

    def add(self, audit: DataFrame, as_of: Column) -> None:
        """Draw the keys the audit's rows lack. Rows past their horizon, or without a time, get none."""
        wanted = (
            self._placed(audit)
            .where(F.col("__expires_on") >= as_of.cast("date"))
            .select(F.col("__key_id").alias("key_id"), F.col("__expires_on").alias("expires_on"))
            .distinct()
        )
        missing = wanted.join(self.keys().select("key_id", "expires_on"), ["key_id", "expires_on"], "left_anti")
        wrapped = F.aes_encrypt(self._fresh_key(), self.master, F.lit("GCM"), aad=F.col("key_id"))
        fresh = missing.select(
            "key_id", "expires_on", wrapped.alias("wrapped"), F.date_format("expires_on", "yyyy-MM").alias("month")
        )
        # Written before the store is touched: the append reads what it extends.
        drawn = materialise(fresh, "data-keys")
        drawn.repartition("month").write.mode("append").partitionBy("month").parquet(self.path)

    def _with_key(self, audit: DataFrame) -> DataFrame:
        stored = self.keys().select(
            F.col("key_id").alias("__key_id"), F.col("expires_on").alias("__expires_on"), F.col("wrapped").alias("__wrapped")
        )
        key = F.aes_decrypt("__wrapped", self.master, F.lit("GCM"), aad=F.col("__key_id"))
        joined = self._placed(audit).join(stored, ["__key_id", "__expires_on"], "left")
        return joined.withColumn("__data_key", F.when(F.col("__wrapped").isNotNull(), key))

    def seal(self, audit: DataFrame) -> DataFrame:
        """The audit with ``sealed_snapshot`` in the place of its snapshot; NULL where there is no key."""
        sealed = F.aes_encrypt(F.col(SNAPSHOT).cast("binary"), F.col("__data_key"), F.lit("GCM"), aad=F.col("__key_id"))
        others = [c for c in audit.columns if c != SNAPSHOT]
        return self._with_key(audit).select(*others, sealed.alias(SEALED))

    def open(self, sealed: DataFrame) -> DataFrame:
        """The sealed audit with its snapshots readable again; NULL where the key is gone."""
        text = F.aes_decrypt(SEALED, F.col("__data_key"), F.lit("GCM"), aad=F.col("__key_id")).cast("string")
        others = [c for c in sealed.columns if c != SEALED]
        return self._with_key(sealed).select(*others, text.alias(SNAPSHOT))

    def _drop(self, gone: Column) -> int:
        """Delete keys. A month of which none is left is a folder less; of others a new copy is
        written. One row a month comes to the driver: at most twelve a year of retention."""
        months = self.keys().groupBy("month").agg(F.bool_and(gone).alias("whole"), F.bool_or(gone).alias("some"))
        touched = months.where("some").select("month", "whole").collect()
        partial = [month for month, whole in touched if not whole]
        staged = new_path(self.spark, "data-keys")
        if partial:
            rest = self.keys().where(F.col("month").isin(partial) & ~gone)
            rest.repartition("month").write.partitionBy("month").parquet(staged)
        for month, whole in touched:
            path, system = self._folder(month)
            if whole:
                system.delete(path, True)
            else:
                replace_folder(self.spark, f"{staged}/month={month}", path.toString())
        return len(touched)

    def expire(self, as_of: Column) -> int:
        """Delete the keys whose day has passed; returns the number of folders changed."""
        return self._drop(F.col("expires_on") < as_of.cast("date"))

    def forget(self, subject: dict[str, object]) -> int:
        """Delete all keys of one subject before their day."""
        row = F.struct(*[F.lit(subject[c]).alias(c) for c in self.subject])
        named = F.to_json(row, {"ignoreNullFields": "false"})
        return self._drop(F.col("key_id") == F.sha2(F.concat(self.master, named.cast("binary")), 256))
