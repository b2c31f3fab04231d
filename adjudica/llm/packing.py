"""Packing documents into training windows by conflict-constrained best fit.

A bin holds a bounded number of documents of one source and one document of a duplicate cluster. A
bin's bitmaps say which sources and clusters it has. Bins are kept in order of what is left in them;
a document looks up the first bin that it fits into (its successor) and goes on from there to the
first bin whose bitmaps allow it, which is the tightest compatible one. Without any it opens a bin.

Documents are dealt to shards by a hash, so that a source or cluster of any size is spread evenly.
A shard holds about ``shard_rows`` rows at any size of the table and is packed on its own, largest
documents first. Only ids and sizes move, never texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adjudica.llm.mixing import words
from adjudica.sources.scratch import materialise

CAPACITY = 2048
SHARD_ROWS = 4096
PER_SOURCE = 2
BLOCK = 64


def best_fit(
    sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, per_source: int
) -> np.ndarray:
    """The bin of each item, in the order given. ``sources`` and ``clusters`` are numbers from 0; a
    cluster of -1 conflicts with none."""
    n = len(sizes)
    source_words = int(sources.max(initial=0)) // 64 + 1
    cluster_words = int(clusters.max(initial=0)) // 64 + 1
    # One bitmap per allowed document of a source: level k has the sources of which k + 1 are in.
    source_bits = np.zeros((per_source, source_words, n), np.uint64)
    cluster_bits = np.zeros((cluster_words, n), np.uint64)
    left = np.zeros(n, np.int64)  # ascending
    bin_at = np.zeros(n, np.int64)  # the bin at each place of that order
    opened, out = 0, np.zeros(n, np.int64)
    one = np.uint64(1)
    for item in range(n):
        size, s, c = sizes[item], int(sources[item]), int(clusters[item])
        s_bit, c_bit = one << np.uint64(s % 64), (one << np.uint64(c % 64)) if c >= 0 else np.uint64(0)
        full = source_bits[per_source - 1, s // 64]
        place, found = int(np.searchsorted(left[:opened], size)), -1
        while place < opened:
            block = bin_at[place : min(place + BLOCK, opened)]
            clash = (full[block] & s_bit) | (cluster_bits[c // 64 if c >= 0 else 0][block] & c_bit)
            free = np.flatnonzero(clash == 0)
            if len(free):
                place += int(free[0])
                found = int(bin_at[place])
                break
            place += len(block)
        if found < 0:
            found, place, rest = opened, opened, capacity - size
            opened += 1
        else:
            rest = left[place] - size
        # The bin moves to its new place in the order: those between make room.
        to = int(np.searchsorted(left[:place], rest))
        left[to + 1 : place + 1], bin_at[to + 1 : place + 1] = left[to:place].copy(), bin_at[to:place].copy()
        left[to], bin_at[to] = rest, found
        for level in source_bits:
            if not level[s // 64, found] & s_bit:
                level[s // 64, found] |= s_bit
                break
        if c >= 0:
            cluster_bits[c // 64, found] |= c_bit
        out[item] = found
    return out


def _numbered(values: list) -> np.ndarray:
    places: dict = {}
    return np.array([places.setdefault(v, len(places)) for v in values], dtype=np.int64)


def _conflicting(clusters: np.ndarray) -> np.ndarray:
    """Numbers of the clusters that occur more than once; -1 for the others."""
    kinds, which, counts = np.unique(clusters, return_inverse=True, return_counts=True)
    numbers = np.full(len(kinds), -1)
    numbers[counts > 1] = np.arange(int((counts > 1).sum()))
    return numbers[which]


def _packed(table: pa.Table, capacity: int, per_source: int) -> pa.Table:
    table = table.sort_by([("size", "descending"), ("row", "ascending"), ("piece", "ascending")])
    bins = best_fit(
        table["size"].to_numpy(),
        _numbered(table["source"].to_pylist()),
        _conflicting(table["cluster"].to_numpy()),
        capacity,
        per_source,
    )
    bin_id = table["shard"].to_numpy() * (1 << 32) + bins
    return table.select(["row", "piece", "size"]).append_column("bin_id", pa.array(bin_id, pa.int64()))


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None,
    capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per piece: doc_id, source, piece, first_word, n_words, bin_id.

    Sizes are words. A document of more than ``capacity`` words is cut into pieces of ``capacity``
    and a rest; pieces count as documents of one cluster. NULL and texts without words are pieces of 0
    words, so every input row is in a bin. ``cluster`` names a column with duplicate clusters (NULL:
    the row conflicts with none by cluster); by default texts that are equal but for case are a
    cluster. A NULL source is a source. Repeated rows are documents of their own. An empty table
    gives an empty result. Other columns are not read.
    """
    content = F.xxhash64(F.lower(F.coalesce(F.col(text), F.lit(""))))
    rows = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            words(text).alias("words"),
            (F.xxhash64(cluster) if cluster else content).alias("cluster"),
            (F.col(cluster).isNull() if cluster else F.lit(False)).alias("alone"),
        ),
        "pack-sizes",
    )
    last = F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    size = F.least(F.col("words") - F.col("piece") * capacity, F.lit(capacity)).cast("long")
    shards = max(1, -(-pieces.count() // shard_rows))
    own = F.when(F.col("alone"), F.xxhash64("row", F.lit("alone"))).otherwise(F.col("cluster"))
    dealt = pieces.select(
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"),
        "row", "piece", size.alias("size"), "source", own.alias("cluster"),
    )
    packed = dealt.groupBy("shard").applyInArrow(
        lambda table: _packed(table, capacity, per_source), "row bigint, piece bigint, size bigint, bin_id bigint"
    )
    return packed.join(rows.select("row", "doc_id", "source"), "row").select(
        "doc_id",
        "source",
        "piece",
        (F.col("piece") * capacity).alias("first_word"),
        F.col("size").alias("n_words"),
        "bin_id",
    )
