"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each refinement splits only the groups that the one before left with more than one row:

1. rows are counted by length and prefix hash, with partial counts before the shuffle;
2. keys of groups with several rows set bits of a bitmap of fixed size (``membership``). A row whose
   bit is off has no equal; a row whose bit is on survives (also the few that share a bit by
   chance), so the bitmap saves work and decides nothing;
3. only surviving rows get the hash of their full content, in the same scan that tests the bit.

Texts are never shuffled: what is written and grouped is a row number, the id and the hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.llm import membership, rows
from adjudica.sources.scratch import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX_CHARS = 48


def normalised(text: str = "text") -> Column:
    """NULL as empty; A-Z in lower case, all else as it is."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower())


def _length(text: str) -> Column:
    return F.octet_length(F.coalesce(F.col(text), F.lit("")))


def _prefix(text: str) -> Column:
    start = F.substring(F.coalesce(F.col(text), F.lit("")), 1, PREFIX_CHARS)
    return F.xxhash64(F.translate(start, UPPER, UPPER.lower()))


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, and the ``carry`` columns.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty. The row with the
    largest id stays; a NULL id is smaller than any other. Of rows that repeat both text and id
    exactly one has ``kept``. Further columns of ``docs`` are not read unless ``carry`` names
    expressions over them. An empty table gives an empty result.
    """
    carry = dict(carry or {})
    counts = materialise(
        docs.groupBy(_length(text).alias("length"), _prefix(text).alias("prefix")).agg(
            F.count("*").alias("rows")
        ),
        "exact-counts",
    )
    lengths = counts.groupBy("length").agg(F.sum("rows").alias("n")).where("n > 1")
    several = counts.join(lengths, "length", "left_semi").where("rows > 1")
    bitmap = membership.bitmap_of(several, F.struct("length", "prefix"))

    # The key goes first and alone, so that no column of docs can clash with it.
    keyed = docs.select(
        F.struct(_length(text).alias("length"), _prefix(text).alias("prefix")).alias("__key"),
        F.col(doc_id).alias("__id"),
        normalised(text).alias("__text"),
        F.struct(F.lit(0).alias("__none"), *[c.alias(n) for n, c in carry.items()]).alias("__carry"),
    )
    tested = membership.flagged(keyed, F.col("__key"), bitmap, "__survives")
    read = materialise(
        tested.select(
            F.monotonically_increasing_id().alias("__row"),
            F.col("__id").alias("doc_id"),
            F.when(F.col("__survives"), F.unhex(F.sha2("__text", 256))).alias("__full"),
            *[F.col(f"__carry.{n}").alias(n) for n in carry],
        ),
        "exact-rows",
    )
    alone = read.where("__full is null").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        *carry,
    )
    survivors = read.where("__full is not null")
    # The largest struct: ids that are NULL come first in its order, so they lose to any other.
    groups = survivors.groupBy("__full").agg(
        F.max(F.struct("doc_id", "__row")).alias("__last"), F.count("*").alias("group_size")
    )
    grouped = survivors.join(groups, "__full").select(
        "doc_id",
        F.col("__last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("__row") == F.col("__last.__row")).alias("kept"),
        *carry,
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, by the rules of ``exact_groups``."""
    numbered = rows.keyed(docs)
    texts = numbered.select(
        rows.ROW, F.col(f"{rows.DOC}.{doc_id}").alias("__id"), F.col(f"{rows.DOC}.{text}").alias("__text")
    )
    groups = exact_groups(texts, "__id", "__text", {"row": F.col(rows.ROW)})
    dropped = groups.where("not kept").select(F.col("row").alias(rows.ROW))
    return membership.anti_join(numbered, rows.ROW, dropped).select(f"{rows.DOC}.*")
