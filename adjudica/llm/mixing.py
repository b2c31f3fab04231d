"""Mixing sources to target weights by systematic sampling.

Each source gets a target (words). A document is expected target / source size times; within its
source, documents stand in order of size, their expected copies are summed up from the start, one
offset between 0 and 1 is added, and a document is emitted once for every whole number that the sum
crosses at it. So each gets the floor or the ceiling of its expectation, and as neighbours in the
order have like sizes, the words taken miss the target by about one document.

No task sees a source whole: the sum before a document is the one before its (source, size, slot)
group plus its place in the group. Slots cut the documents of one size by a hash of their id. Groups
are counted with partial sums; the windows over them hold one row per slot of a size, or per size
of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.llm import rows
from adjudica.sources.scratch import materialise

#: What counts as a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2
SEED = "mix-1"


def words(text: str = "text") -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING
) -> DataFrame:
    """source, source_size, target: ``share`` of all words, dealt by weight up to a ceiling.

    Sources in order of code points, NULL last, take the weights in turn. No target is above
    ``ceiling`` times its source's size; what a source can't take is dealt to the others by weight
    until none is above. In closed form: sources in order of ceiling per weight are full up to some
    place, and from there on all get the same amount per unit of weight. The windows hold one row
    per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    in_turn = everything.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    place = ((F.row_number().over(in_turn) - 1) % len(weights) + 1).cast("int")
    dealt = totals.withColumn("__weight", F.element_at(turn, place)).withColumn(
        "__cap", F.col("source_size") * ceiling
    )
    by_need = everything.orderBy(F.col("__cap") / F.col("__weight"), F.col("source").asc_nulls_last())
    full_before = F.coalesce(
        F.sum("__cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    weight_left = F.sum("__weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * F.lit(share)
    level = (budget - full_before) / weight_left
    dealt = dealt.withColumn("__level", level).withColumn(
        "__open", F.col("__level") * F.col("__weight") <= F.col("__cap")
    )
    # The first source that isn't full sets the level; after it the levels only fall.
    common = F.max(F.when(F.col("__open"), F.col("__level"))).over(everything)
    target = F.when(F.col("__open"), common * F.col("__weight")).otherwise(F.col("__cap")).cast("double")
    return dealt.select("source", "source_size", target.alias("target"))


def _offset(seed: str) -> Column:
    """A number from 0 up to 1 for each source, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit("\x00null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def sample(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None,
    seed: str = SEED, **targets,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken (and ``row``).

    A NULL text has size 0; NULL is a source like others. A document of a source without words is
    expected 0 times. Of rows that repeat an id within a source and size, which one gets a further
    copy is open, but the rows returned are the same in every run. An empty table gives an empty
    result. Other columns are not read.
    """
    kept = [F.col(row).alias("__row")] if row else []
    sized = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
            words(text).alias("size"), *kept,
        ),
        "mix-sizes",
    )
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    slotted = sized.withColumn("__order", order).withColumn(
        "__group", F.struct("source", "size", F.substring("__order", 1, 2).alias("slot"))
    )
    groups = slotted.groupBy("__group").agg(F.count("*").alias("n")).select("__group", "__group.*", "n")
    within_size = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    within_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sizes = groups.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = sizes.select(
        F.struct("source", "size").alias("__size"),
        F.coalesce(F.sum("n").over(within_source), none).alias("__smaller"),
    )
    plan = source_targets(sized, **targets).select(
        F.struct("source").alias("__source"), "source_size", "target", _offset(seed).alias("__offset")
    )
    starts = (
        groups.select(
            "__group",
            F.struct("source", "size").alias("__size"),
            F.struct("source").alias("__source"),
            F.coalesce(F.sum("n").over(within_size), none).alias("__slots_before"),
        )
        .join(sizes, "__size")
        .join(plan, "__source")
        .select(
            "__group", (F.col("__slots_before") + F.col("__smaller")).alias("__before"),
            "source_size", "target", "__offset",
        )
    )
    place = F.row_number().over(Window.partitionBy("__group").orderBy("__order", "doc_id"))
    numbered = slotted.withColumn("__place", place).join(starts, "__group")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def crossed(rank: Column) -> Column:
        return F.floor(rate * rank + F.col("__offset"))

    rank = F.col("__before") + F.col("__place")
    out = numbered.withColumn("copies", crossed(rank) - crossed(rank - 1))
    back = [F.col("__row").alias(row)] if row else []
    return out.select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *back
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as ``sample`` takes it."""
    numbered = rows.keyed(docs)
    fields = numbered.select(
        rows.ROW,
        F.col(f"{rows.DOC}.{doc_id}").alias("__id"),
        F.col(f"{rows.DOC}.{text}").alias("__text"),
        F.col(f"{rows.DOC}.{source}").alias("__source"),
    )
    taken = sample(fields, "__id", "__text", "__source", row=rows.ROW, **options).where("copies > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    mixed = numbered.join(taken.select(rows.ROW, "copies"), rows.ROW).select(rows.DOC, times.alias("__n"))
    return mixed.select(f"{rows.DOC}.*")
