"""The stored observation log, and an index that answers for any instant without replaying it.

Observations are appended in batches, each under an id of its own; a batch that is already there is
not added again. The index holds, for each learner and time bucket, how many observations came
before the bucket and their sum. A question about an instant reads one bucket of the index, the same
bucket of the log, and those batches that the index does not cover yet.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from adjudica import schemas
from adjudica.operators import ordered
from adjudica.operators.learners import _posterior
from adjudica.sources.scratch import materialise
from adjudica.sources.tables import align

DAY = 86_400
PRIOR = ("mu0", "kappa0", "sigma2")

_PREFIX = "learner_id string, n bigint, total double, bucket bigint"
_HEADS = "learner_id string, head struct<ts: timestamp_ntz, mu0: double, kappa0: double, sigma2: double>"


@dataclass(frozen=True)
class ObservationLog:
    """A log below the folder ``root``; ``bucket_seconds`` is fixed for its life."""

    spark: SparkSession
    root: str
    bucket_seconds: int = DAY

    # Files ----------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _system(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, system = self._path(folder), self._system()
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def _move(self, staged: str, target: str) -> bool:
        """Put a staged folder in its place; False where the place is taken."""
        system = self._system()
        system.mkdirs(self._path(target).getParent())
        if not system.exists(self._path(target)) and system.rename(self._path(staged), self._path(target)):
            return True
        system.delete(self._path(staged), True)
        return False

    def bucket(self, ts: Column) -> Column:
        """The number of an instant's bucket, whatever the session's time zone."""
        seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
        return F.floor((F.unix_date(F.to_date(ts)).cast("bigint") * DAY + seconds) / self.bucket_seconds)

    # The log --------------------------------------------------------------------------------

    def batches(self) -> list[str]:
        return [n.removeprefix("batch=") for n in self._names("log") if n.startswith("batch=")]

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Add a batch by column name; False, and nothing is written, where a batch of this id is there.

        The files are written aside and moved in place at once, so a batch is there whole or not at all.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"{batch!r} is no batch id")
        if batch in self.batches():
            return False
        staged = f"_staged/{uuid.uuid4().hex}"
        aligned = align(rows, schemas.OBSERVATIONS).withColumn("bucket", self.bucket(F.col("ts")))
        aligned.write.partitionBy("bucket").parquet(f"{self.root}/{staged}")
        return self._move(staged, f"log/batch={batch}")

    def read(self) -> DataFrame:
        """All rows of the log, with their batch and bucket."""
        own = [StructField("batch", StringType()), StructField("bucket", LongType())]
        schema = StructType([*schemas.OBSERVATIONS.fields, *own])
        if not self.batches():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/log")

    # The index ------------------------------------------------------------------------------

    def _newest(self) -> str | None:
        return max((n for n in self._names("index") if re.fullmatch(r"v\d{9}", n)), default=None)

    def covered(self) -> set[str]:
        """The batches that the index has taken in."""
        newest = self._newest()
        if newest is None:
            return set()
        found = self.spark.read.schema("batch string").parquet(f"{self.root}/index/{newest}/batches")
        return {r["batch"] for r in found.collect()}

    def _parts(self) -> tuple[DataFrame, DataFrame]:
        newest = self._newest()
        if newest is None:
            return self.spark.createDataFrame([], _PREFIX), self.spark.createDataFrame([], _HEADS)
        folder = f"{self.root}/index/{newest}"
        return self.spark.read.schema(_PREFIX).parquet(f"{folder}/prefix"), self.spark.read.schema(_HEADS).parquet(f"{folder}/heads")

    def refresh(self) -> int:
        """Take the batches the index does not cover into it; returns their number.

        Only these batches are read. Sums before a bucket grow by what the new rows add before it,
        so rows that come late are counted in all later buckets.
        """
        covered = self.covered()
        fresh = [b for b in self.batches() if b not in covered]
        if not fresh:
            return 0
        prefix, heads = self._parts()
        rows = self.read().where(F.col("batch").isin(*fresh))
        head = F.struct("ts", *PRIOR)
        added = rows.groupBy("learner_id", "bucket").agg(F.count("*").alias("n"), F.sum("observation").alias("total"))
        added = materialise(added.where(F.col("bucket").isNotNull()), "index-added")
        new_heads = rows.groupBy("learner_id").agg(F.min(head).alias("head"))
        heads = heads.unionByName(new_heads).groupBy("learner_id").agg(F.min("head").alias("head"))
        # What each bucket itself adds: differences of the old sums, and the new rows.
        by_learner = Window.partitionBy("learner_id").orderBy("bucket")  # at most one row a bucket
        old = prefix.select(
            "learner_id",
            (F.col("bucket") - 1).alias("bucket"),
            (F.col("n") - F.coalesce(F.lag("n").over(by_learner), F.lit(0))).alias("n"),
            (F.coalesce("total", F.lit(0.0)) - F.coalesce(F.lag("total").over(by_learner), F.lit(0.0))).alias("total"),
        ).where("n > 0")
        each = old.unionByName(added).groupBy("learner_id", "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        upto = by_learner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = each.agg(F.max("bucket")).first()[0]
        summed = each.select(
            "learner_id", "bucket", F.sum("n").over(upto).alias("n"), F.sum("total").over(upto).alias("total"),
            F.lead("bucket").over(by_learner).alias("next"),
        )
        # A learner has a row in every bucket after its first observation, so one bucket answers for all.
        spread = F.explode(F.sequence(F.col("bucket") + 1, F.coalesce("next", F.lit(last + 1 if last is not None else None))))
        grown = summed.select("learner_id", "n", "total", spread.alias("bucket"))
        staged = f"_staged/{uuid.uuid4().hex}"
        grown.write.partitionBy("bucket").parquet(f"{self.root}/{staged}/prefix")
        heads.write.parquet(f"{self.root}/{staged}/heads")
        names = self.spark.createDataFrame([(b,) for b in sorted(covered | set(fresh))], "batch string")
        names.coalesce(1).write.parquet(f"{self.root}/{staged}/batches")
        number = int((self._newest() or "v0")[1:]) + 1
        if not self._move(staged, f"index/v{number:09d}"):
            raise RuntimeError(f"{self.root}: another refresh has finished first")
        return len(fresh)

    # Questions ------------------------------------------------------------------------------

    def state_as_of(
        self, questions: DataFrame, question_id: str, default_prior: tuple[float, float, float] | None = None
    ) -> DataFrame:
        """The results of :func:`learners.credibility_as_of` over the log, from the index.

        Reads the questions' buckets alone, of the index and of the covered log, and the batches that
        are not covered. A question after the last bucket is answered by the sums over all.
        """
        covered, (prefix, heads) = sorted(self.covered()), self._parts()
        log = self.read()
        old, new = log.where(F.col("batch").isin(*covered)), log.where(~F.col("batch").isin(*covered))
        last = prefix.agg(F.max("bucket")).first()[0] if covered else None
        asked = questions.select(question_id, "learner_id", "ts", self.bucket(F.col("ts")).alias("at"))
        capped = F.least("at", F.lit(last)) if last is not None else F.col("at")
        asked = materialise(asked.withColumn("bucket", capped), "questions")
        # As many numbers as there are buckets, at most.
        buckets = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect() if r["bucket"] is not None)
        none = F.lit(None).cast(asked.schema[question_id].dataType).alias(question_id)
        empty_ts = F.lit(None).cast("timestamp_ntz").alias("ts")

        def counted(rows: DataFrame, ts: Column, n: Column, total: Column) -> DataFrame:
            return rows.select("learner_id", "bucket", ts, F.lit(0).alias("after"), total.alias("x"), n.cast("bigint").alias("one"), none)

        before = counted(prefix.where(F.col("bucket").isin(*buckets)), empty_ts, F.col("n"), F.col("total"))
        same = counted(old.where(F.col("bucket").isin(*buckets)), F.col("ts"), F.lit(1), F.col("observation"))
        later = F.explode(F.filter(F.array(*[F.lit(b).cast("bigint") for b in buckets]), lambda b: b >= F.least("bucket", F.lit(buckets[-1] if buckets else 0))))
        uncovered = counted(
            new.where("bucket is not null").withColumn("own", F.col("bucket")).withColumn("bucket", later),
            F.when(F.col("bucket") <= F.col("own"), F.col("ts")).alias("ts"), F.lit(1), F.col("observation"),
        )
        ends = asked.select(
            "learner_id", "bucket", "ts", F.lit(1).alias("after"), F.lit(0.0).alias("x"), F.lit(0).cast("bigint").alias("one"), question_id
        )
        summed = ordered.running_sums(
            before.unionByName(same).unionByName(uncovered).unionByName(ends),
            ["learner_id", "bucket"],
            ["ts", "after", question_id, "x"],
            {"n": F.col("one"), "total": F.col("x")},
        ).where("after = 1")
        fresh_heads = new.groupBy("learner_id").agg(F.min(F.struct("ts", *PRIOR)).alias("head"))
        heads = heads.unionByName(fresh_heads).groupBy(F.struct("learner_id").alias("__key")).agg(F.min("head").alias("head"))
        known = summed.withColumn("__key", F.struct("learner_id")).join(heads, "__key", "left")
        filled = [
            F.coalesce(F.col(f"head.{c}"), F.lit(float(v))) if default_prior else F.col(f"head.{c}")
            for c, v in zip(PRIOR, default_prior or PRIOR, strict=True)
        ]
        precision, mean = _posterior(*filled, F.col("n"), F.col("total"))
        return known.select(question_id, "learner_id", "ts", "n", mean.alias("mean"), precision.alias("precision"))
