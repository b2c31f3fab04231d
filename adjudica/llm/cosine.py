"""Exact k nearest vectors by cosine similarity, by blocks of queries against all vectors.

Codes cannot tell which vectors are nearest (see ``hamming`` for what they keep), so every query meets
every vector, as a product of matrices. Queries are taken in blocks of fixed size; for each block
every task reads its share of the vectors once and keeps the best k + 1 of each query. Work grows with
queries times vectors; the shuffle gets k + 1 rows a query and task.

Equal vectors are one entry with their k + 1 smallest ids, and equal queries are one search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adjudica.operators.ordered import default_segments
from adjudica.sources.scratch import materialise

K = 10
#: Queries of a block, and of a product of matrices.
BLOCK = 8192
SLICE = 256
#: A product of matrices rounds differently by shape: what is this near to the k-th is computed again.
ROUNDING = 1e-9


def dense(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, e: vectors of one length. Missing, NULL, NaN and infinite components count as 0.

    Rows without an id or an embedding are left out. Rows that agree in id and vector are one.
    """
    named = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    named = named.where("id is not null and e is not null")
    longest = max(named.agg(F.max(F.size("e"))).first()[0] or 0, 1)

    def component(place):
        value = F.get(F.col("e"), place)
        return F.when(F.abs(value) < float("inf"), value).otherwise(0.0)

    return named.select("id", F.transform(F.sequence(F.lit(0), F.lit(longest - 1)), component).alias("e")).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay, so their similarity to any is 0."""
    largest = np.abs(rows).max(axis=1, keepdims=True, initial=0)
    rows = rows / np.where(largest > 0, largest, 1)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def _best(batches: Iterator[pa.RecordBatch], numbers: np.ndarray, asked: np.ndarray, keep: int) -> Iterator[pa.RecordBatch]:
    """query, similarity, same, ids: the ``keep`` best entries of a task for each query."""
    wanted, best = _units(asked), None
    floor = np.full(len(asked), -np.inf)  # the keep-th best so far
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = _matrix(batch.column("e"))
        units = _units(raw)
        parts = []
        for start in range(0, len(asked), SLICE):
            near = wanted[start : start + SLICE] @ units.T
            least = floor[start : start + SLICE]
            if near.shape[1] > keep:
                least = np.maximum(least, np.partition(near, -keep, axis=1)[:, -keep])
            query, entry = np.nonzero(near >= least[:, None] - ROUNDING)
            query += start
            # A bounded number of pairs at a time is computed again.
            for at in range(0, len(query), 1 << 16):
                q, v = query[at : at + (1 << 16)], entry[at : at + (1 << 16)]
                parts.append((q, v, (wanted[q] * units[v]).sum(axis=1), (asked[q] == raw[v]).all(axis=1)))
        query, entry, similarity, same = (np.concatenate(p) for p in zip(*parts, strict=True))
        ids = batch.column("ids").take(pa.array(entry))
        smallest = ids.flatten().take(pa.array(ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()))
        found = pa.table(
            {"at": query, "similarity": similarity, "same": pa.array(same), "ids": ids, "smallest": smallest}
        )
        both = found if best is None else pa.concat_tables([best, found])
        both = both.sort_by([("at", "ascending"), ("similarity", "descending"), ("smallest", "ascending")])
        at = both["at"].to_numpy()
        place = np.arange(len(at)) - np.searchsorted(at, at)
        best = both.filter(pa.array(place < keep)).combine_chunks()
        at, place = at[place < keep], place[place < keep]
        last = place == keep - 1
        floor[at[last]] = best["similarity"].to_numpy()[last]
    if best is not None:
        at = best["at"].to_numpy()
        out = best.drop_columns(["at", "smallest"]).add_column(0, "query", pa.array(numbers[at], pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, neighbor_id, similarity: the k nearest rows of each query, itself left out.

    ``vectors`` and ``queries`` have id and e as made by ``dense``; queries are rows of ``vectors``.
    Ties go to the smaller id. A vector of zeros has similarity 0 to all. With fewer than k other
    rows, all of them are returned. Without queries the result is empty.
    """
    few = F.row_number().over(Window.partitionBy("e").orderBy("id"))
    entries = materialise(
        vectors.withColumn("__n", few).where(F.col("__n") <= k + 1)
        .groupBy("e").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .repartition(default_segments(vectors)),
        "cosine-entries",
    )
    asked = materialise(
        queries.select("e").distinct().select(F.monotonically_increasing_id().alias("query"), "e"), "cosine-queries"
    )
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"query bigint, similarity double, same boolean, ids array<{kind}>"
    blocks, found = -(-asked.count() // block), []
    for number in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        numbers, rows = part["query"].to_numpy(), _matrix(part["e"].chunk(0))
        best = entries.select("e", "ids").mapInArrow(
            lambda batches, numbers=numbers, rows=rows: _best(batches, numbers, rows, k + 1), schema
        )
        found.append(materialise(best, "cosine-best"))
    empty = vectors.sparkSession.createDataFrame([], schema)
    every = reduce(DataFrame.unionByName, found, empty).select("query", "similarity", "same", F.explode("ids").alias("id"))
    first = Window.partitionBy("query").orderBy(F.desc("similarity"), "id", F.desc("same"))
    # A row of the query's own is among the first k + 1 of its vector's, or k others come before it.
    best = every.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1).drop("__n")
    pairs = queries.select(F.col("id").alias("query_id"), "e").join(asked, "e").drop("e").join(best, "query")
    others = pairs.where((F.col("id") != F.col("query_id")) | ~F.col("same"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("similarity"), "id"))
    return (
        others.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("neighbor_id"), "similarity")
    )
