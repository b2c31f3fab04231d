"""Near-duplicate classes: ProbMinHash sketches, banding, exact verification, components.

1. Every text gives a sketch of its set of five-word shingles, and keys of its bands; a text that
   repeats a shingle gives those of a second sketch too, weighted by 1 + ln(count). Texts with the
   same set of shingles become one node, which has the bands of all of them.
2. Nodes that share a band key are candidates. No bucket is expanded to all its pairs: each node is
   first paired with its bucket's smallest node.
3. Candidate pairs are verified by the exact Jaccard similarity of their sets of shingles. Only
   texts of candidates are read again; a bitmap of fixed size spares the others the shuffle.
4. Verified pairs give components. Buckets that still hold several components are taken up again:
   each node outside a bucket's largest component is compared with the nodes of its other components
   by odd sketches, and only pairs that pass are emitted and verified. Odd sketches lose nothing:
   their distance is never above the number of shingles in which two sets differ. Pairs inside a
   component need no test, as they change nothing. So the classes are the same as if all pairs of
   all buckets had been verified.

Two texts whose sets have similarity s share a band of the first sketch with probability
1 - (1 - s^rows)^bands, 0.99995 at 0.8, however often either repeats its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from adjudica.llm import membership, rows as row_keys, shingles, textbatch
from adjudica.llm.components import components
from adjudica.sources.scratch import materialise

SIMILARITY = 0.8
BANDS = 25
ROWS = 5
#: Bits of an odd sketch. It tells sets apart that differ in fewer shingles than that.
ODD_BITS = 4096


def _text_key(text: str) -> Column:
    """128 bits of a text's content, the same wherever the text is read."""
    content = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(content).alias("k1"), F.xxhash64(F.lit(1), content).alias("k2"))


def _sketched(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, keys, more, n_more = [], [], [], [], []
        for _, texts in textbatch.slices(batch.column("text")):
            owner, ids, counts = shingles.distinct_shingles(texts)
            sketches = shingles.prob_min_hash(len(texts), owner, ids, np.ones(len(ids)), bands * rows)
            repeats = np.bincount(owner, counts > 1, len(texts)) > 0
            some, number = repeats[owner], np.cumsum(repeats) - 1
            weighted = shingles.prob_min_hash(
                int(repeats.sum()), number[owner[some]], ids[some], 1 + np.log(counts[some]), bands * rows
            )
            more.append(shingles.band_keys(weighted, bands))
            n_more.append(repeats * bands)
            sizes.append(np.bincount(owner, minlength=len(texts)))
            digests.append(shingles.set_digests(len(texts), owner, ids))
            keys.append(shingles.band_keys(sketches, bands))
        if not sizes:
            continue
        digest, flat = np.concatenate(digests), np.concatenate(keys)
        offsets = pa.array(np.arange(len(flat) + 1) * bands, pa.int32())
        more_offsets = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(n_more)))), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                batch.column("id"),
                batch.column("k1"),
                batch.column("k2"),
                pa.array(np.concatenate(sizes), pa.int64()),
                pa.array(digest[:, 0]),
                pa.array(digest[:, 1]),
                pa.ListArray.from_arrays(offsets, pa.array(flat.reshape(-1))),
                pa.ListArray.from_arrays(more_offsets, pa.array(np.concatenate(more).reshape(-1), pa.int64())),
            ],
            names=["row", "id", "k1", "k2", "n", "s1", "s2", "bands", "more"],
        )


def sketches(texts: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, id, text key, n (distinct shingles), set digest, band keys of the set (bands) and, where a
    shingle repeats, of the counts (more); from row, id, text."""
    keyed = texts.select("row", "id", "text", _text_key("text").alias("k")).select("row", "id", "text", "k.*")
    schema = StructType([f for f in keyed.schema if f.name != "text"])
    for name in ("n", "s1", "s2"):
        schema = schema.add(name, LongType())
    schema = schema.add("bands", ArrayType(LongType())).add("more", ArrayType(LongType()))
    return keyed.mapInArrow(lambda batches: _sketched(batches, bands, rows), schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in textbatch.slices(batch.column("text")):
            owner, ids, _ = shingles.distinct_shingles(texts)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
            odd = shingles.odd_sketches(len(texts), owner, ids, ODD_BITS)
            odd_offsets = np.arange(len(texts) + 1) * odd.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").slice(start, len(texts)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int64))),
                    pa.ListArray.from_arrays(pa.array(odd_offsets, pa.int32()), pa.array(odd.reshape(-1))),
                ],
                names=["node", "ids", "odd"],
            )


def shingle_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, ids, odd: sets and odd sketches of the wanted nodes (node, k1, k2), each text taken once."""
    wanted = wanted.select("node", F.struct("k1", "k2").alias("__key"))
    keyed = texts.select(_text_key("text").alias("__key"), "text")
    bitmap = membership.bitmap_of(wanted, F.col("__key"))
    near = membership.flagged(keyed, F.col("__key"), bitmap, "__on").where("__on")
    # Equal texts meet once: one of them leaves each task.
    single = near.groupBy("__key").agg(F.first("text").alias("text"))
    return single.join(wanted, "__key").select("node", "text").mapInArrow(
        _sets, "node bigint, ids array<bigint>, odd array<bigint>"
    )


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have at least the Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("ids").alias("__a"))
    right = sets.select(F.col("node").alias("b"), F.col("ids").alias("__b"))
    common = F.size(F.array_intersect("__a", "__b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(common >= similarity * (F.size("__a") + F.size("__b") - common)).select("a", "b")


def _fits(n: Column, m: Column, similarity: float) -> Column:
    """Sets of these sizes can reach the similarity at all."""
    return F.least(n, m) >= F.lit(similarity) * F.greatest(n, m)


def _differ_little(similarity: float) -> Column:
    """The odd sketches allow that two sets of n and m shingles reach the similarity."""
    bits = F.lit(0)
    for place in range(ODD_BITS // 64):
        bits = bits + F.bit_count(F.col("odd")[place].bitwiseXOR(F.col("__odd")[place]))
    # J >= s means that at most (1 - s) / (1 + s) of both sizes differ; the rest is for rounding.
    return bits <= (F.col("n") + F.col("__n")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)


def _star_pairs(banded: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each node with the smallest node of each of its buckets, where sizes fit."""
    centres = (
        banded.groupBy("band")
        .agg(F.min(F.struct("node", "n")).alias("__centre"), F.count("*").alias("__size"))
        .where("__size > 1")
    )
    joined = banded.join(centres, "band").where(F.col("node") != F.col("__centre.node"))
    return (
        joined.where(_fits(F.col("n"), F.col("__centre.n"), similarity))
        .select(F.col("__centre.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )


def _mixed_buckets(banded: DataFrame, labels: DataFrame) -> DataFrame:
    """band, node, n, component: the rows of buckets that hold several components."""
    several = banded.groupBy("band").agg(F.count("*").alias("__size")).where("__size > 1").select("band")
    rows = banded.join(several, "band").join(labels, "node", "left").select(
        "band", "node", "n", F.coalesce("component", "node").alias("component")
    )
    mixed = rows.groupBy("band").agg(F.min("component").alias("__lo"), F.max("component").alias("__hi"))
    return rows.join(mixed.where("__lo <> __hi").select("band"), "band", "left_semi")


def _stray_pairs(mixed: DataFrame, sets: DataFrame, tested: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of one bucket in different components that may be similar, not yet tested."""
    rows = mixed.join(sets.select("node", "odd"), "node")
    main = (
        mixed.groupBy("band", "component").agg(F.count("*").alias("__count"))
        .groupBy("band").agg(F.max(F.struct("__count", "component"))["component"].alias("__main"))
    )
    strays = (
        rows.join(main, "band")
        .where("component <> __main")
        .select(
            "band", "__main", F.col("node").alias("__x"), F.col("n").alias("__n"),
            F.col("component").alias("__own"), F.col("odd").alias("__odd"),
        )
    )
    pairs = rows.join(strays, "band").where(
        (F.col("component") != F.col("__own"))
        & ((F.col("component") == F.col("__main")) | (F.col("node") < F.col("__x")))
        & _fits(F.col("n"), F.col("__n"), similarity)
        & _differ_little(similarity)
    )
    ordered = pairs.select(F.least("node", "__x").alias("a"), F.greatest("node", "__x").alias("b")).distinct()
    return ordered.join(tested, ["a", "b"], "left_anti")


def near_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None, similarity: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept (and ``row``).

    ``class_id`` is the smallest id of the class; the row that has it stays, and of several such
    rows exactly one. NULL ids are larger than others, so they stay only in a class of their own
    kind. A text without words (also NULL) is like no other: it is a class of its own. Texts of
    fewer than five words have one shingle of all their words. Repeated rows are near-duplicates of
    each other. ``docs`` is read twice and must give the same texts both times. Other columns are
    not read. An empty table gives an empty result.
    """
    texts = docs.select(F.col(text).alias("text"))
    carried = F.struct(F.col(doc_id).alias("id"), (F.col(row) if row else F.lit(None).cast("int")).alias("key"))
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), carried.alias("id"), F.col(text).alias("text")
    )
    stored = materialise(sketches(source, bands, rows), "near-sketches")
    digest = F.struct("s1", "s2", "n").alias("__set")

    nodes = materialise(
        stored.where("n > 0")
        .groupBy(digest)
        .agg(F.min(F.struct(F.col("row").alias("node"), "k1", "k2", "bands")).alias("__node"))
        .select("__set", "__node.*", F.col("__set.n").alias("n")),
        "near-nodes",
    )
    counted = stored.select(digest, F.explode("more").alias("band")).distinct()
    counted = materialise(counted.join(nodes.select("__set", "node", "n"), "__set").select("node", "n", "band"), "near-bands")
    banded = nodes.select("node", "n", F.explode("bands").alias("band")).unionByName(counted)
    first = materialise(_star_pairs(banded, similarity), "near-pairs")
    ends = first.select(F.explode(F.array("a", "b")).alias("node"))
    links = materialise(verified(first, _stored_sets(texts, nodes, ends), similarity), "near-links")
    labels = materialise(components(links), "near-labels")
    mixed = materialise(_mixed_buckets(banded, labels), "near-mixed")
    sets = _stored_sets(texts, nodes, mixed.select("node"))
    more = materialise(verified(_stray_pairs(mixed, sets, first, similarity), sets, similarity), "near-links")
    labels = materialise(components(links.unionByName(more)), "near-labels")

    member = (
        stored.select("row", "id.id", "id.key", "n", digest)
        .join(nodes.select("__set", "node"), "__set", "left")
        .join(labels, "node", "left")
        .select("row", "id", "key", F.coalesce("component", "node", "row").alias("__class"))
    )
    member = materialise(member, "near-members")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    classes = member.groupBy("__class").agg(F.min(order).alias("__first"), F.count("*").alias("class_size"))
    back = [F.col("key").alias(row)] if row else []
    return member.join(classes, "__class").select(
        F.col("id").alias("doc_id"),
        F.col("__first.id").alias("class_id"),
        "class_size",
        (F.col("row") == F.col("__first.row")).alias("kept"),
        *back,
    )


def _stored_sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    wanted = materialise(nodes.select("node", "k1", "k2").join(wanted.distinct(), "node"), "near-wanted")
    return materialise(shingle_sets(texts, wanted), "near-sets")


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    numbered = row_keys.keyed(docs)
    fields = numbered.select(
        row_keys.ROW, F.col(f"{row_keys.DOC}.{doc_id}").alias("__id"), F.col(f"{row_keys.DOC}.{text}").alias("__text")
    )
    classes = near_classes(fields, "__id", "__text", row=row_keys.ROW, **options)
    dropped = classes.where("not kept").select(row_keys.ROW)
    return membership.anti_join(numbered, row_keys.ROW, dropped).select(f"{row_keys.DOC}.*")
