"""Tables whose data files are named by a manifest, with a filter of identifiers for each file.

A version of the table is a list of files, stored as one small Parquet table. A change writes new
files beside the old ones and then a new list; files it does not touch stay as they are and are in
both lists. The index holds for each file and indexed column a Bloom filter in buckets of 32,768
bits: a value belongs to one bucket, in which it sets a few bits. So a question about a value reads
one bucket of each file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from adjudica.sources.tables import table_exists

BUCKET_BITS = 1 << 15
#: Bits a value sets in its bucket, and bits of the filter for each row of a file.
PROBES = 4
BITS_PER_ROW = 12

FILES = "path string, n_rows bigint"
INDEX = "column string, buckets int, bucket int, path string, bits binary"


class ConcurrentChange(RuntimeError):
    """Another writer has committed since this version was read."""


def _hash(value: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), value)


def _bucket(value: Column, buckets: Column) -> Column:
    return F.pmod(_hash(value, 0), buckets).cast("int")


def _positions(value: Column) -> list[Column]:
    return [F.pmod(_hash(value, probe), F.lit(BUCKET_BITS)) for probe in range(1, PROBES + 1)]


@dataclass(frozen=True)
class FileTable:
    """A table below the folder ``root``, with an index over some of its columns."""

    spark: SparkSession
    root: str
    schema: StructType
    indexed: tuple[str, ...]

    # Versions -------------------------------------------------------------------------------

    def _folder(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:09d}"

    def version(self) -> int:
        """The newest version; 0 before the first."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder = path(f"{self.root}/manifest")
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        return max((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()), default=0)

    def files(self, version: int | None = None) -> DataFrame:
        """path, n_rows of a version's files."""
        return self.spark.read.schema(FILES).parquet(self._folder(version or self.version()))

    def paths(self, version: int | None = None) -> list[str]:
        """The files of a version by name; a scan holds this list in any case."""
        return sorted(r["path"] for r in self.files(version).select("path").collect())

    def read(self, paths: Iterable[str] | None = None) -> DataFrame:
        """The table, or the rows of some of its files."""
        chosen = list(self.paths() if paths is None else paths)
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*chosen)

    # Changes --------------------------------------------------------------------------------

    def write_files(self, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """Store rows as new data files, and index them; they are in no version yet. path, n_rows of each."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        columns = [c for c in df.columns if c in self.schema.names or c in partition_by]
        writer = df.select(*columns).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(folder)
        path = F.col("_metadata.file_path").alias("path")
        added = f"{self.root}/added/{uuid.uuid4().hex}"
        rows.select(path).groupBy("path").agg(F.count("*").alias("n_rows")).write.parquet(added)
        files = self.spark.read.schema(FILES).parquet(added)
        self._index(rows, files)
        return files

    def _index(self, rows: DataFrame, files: DataFrame) -> None:
        if not self.indexed:
            return
        most = files.agg(F.max("n_rows")).first()[0] or 0
        buckets = 1
        while buckets * BUCKET_BITS < most * BITS_PER_ROW:
            buckets *= 2
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in self.indexed])
        values = rows.select(F.col("_metadata.file_path").alias("path"), F.explode(pairs).alias("x"))
        value = F.col("x.value")
        bits = (
            values.where(value.isNotNull())
            .select("path", "x.column", _bucket(value, F.lit(buckets)).alias("bucket"), F.explode(F.array(*_positions(value))).alias("place"))
            .groupBy("path", "column", "bucket")
            .agg(F.bitmap_construct_agg("place").alias("bits"))
        )
        bits = bits.select("column", F.lit(buckets).alias("buckets"), "bucket", "path", "bits")
        bits.write.mode("append").partitionBy("column", "buckets").parquet(f"{self.root}/index")

    def commit(self, read_version: int, removed: Iterable[str], added: DataFrame | None) -> int:
        """Make a new version of the one that was read; :class:`ConcurrentChange` if that is not the newest."""
        gone = list(removed)
        files = self.spark.createDataFrame([], FILES) if read_version == 0 else self.files(read_version)
        if gone:
            files = files.join(self.spark.createDataFrame([(p,) for p in gone], "path string"), "path", "left_anti")
        if added is not None:
            files = files.unionByName(added)
        staged = f"{self.root}/manifest/_staged-{uuid.uuid4().hex}"
        files.coalesce(1).write.parquet(staged)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        target = path(self._folder(read_version + 1))
        system = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if self.version() != read_version or system.exists(target) or not system.rename(path(staged), target):
            system.delete(path(staged), True)
            raise ConcurrentChange(f"{self.root}: version {read_version} is no longer the newest")
        return read_version + 1

    # Questions ------------------------------------------------------------------------------

    def candidates(self, wanted: DataFrame, version: int | None = None) -> DataFrame:
        """path of the files that may hold one of the values (column, value): none that does is missing.

        A column without an index makes every file a candidate.
        """
        files = self.files(version)
        indexed = wanted.where(F.col("column").isin(*self.indexed) & F.col("value").isNotNull())
        unindexed = wanted.where(~F.col("column").isin(*self.indexed))
        everywhere = files if unindexed.head(1) else files.limit(0)
        if not self.indexed or not table_exists(self.spark, f"{self.root}/index"):
            return everywhere.select("path")
        index = self.spark.read.schema(INDEX).parquet(f"{self.root}/index")
        sizes = [r["buckets"] for r in index.select("buckets").distinct().collect()]  # powers of 2
        asked = indexed.select("column", "value", F.explode(F.array(*map(F.lit, sizes))).alias("buckets")).select(
            "column", "buckets", _bucket(F.col("value"), F.col("buckets")).alias("bucket"), F.array(*_positions(F.col("value"))).alias("places")
        )

        def on(place: Column) -> Column:
            byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (place % 8).cast("int")) == 1

        met = index.join(asked, ["column", "buckets", "bucket"]).where(F.forall("places", on))
        return met.select("path").unionByName(everywhere.select("path")).distinct().join(files, "path", "left_semi")


def create(
    df: DataFrame, root: str, indexed: Sequence[str], schema: StructType | None = None, partition_by: Sequence[str] = ()
) -> FileTable:
    """Store ``df`` as the first version of a table."""
    kept = StructType([f for f in df.schema.fields if f.name not in partition_by])
    table = FileTable(df.sparkSession, root.rstrip("/"), schema or kept, tuple(indexed))
    table.commit(0, [], table.write_files(df, partition_by))
    return table
