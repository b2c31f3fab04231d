"""Exact k nearest neighbours of binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits, each of which is an index of its own. Search grows segment by
segment: at step (radius, segment) the codes are fetched whose segment differs from the query's in
exactly ``radius`` bits, and their whole distance is computed. After segment s of radius r, any code
not seen differs in more than r bits in segments up to s and in r or more in the others: its distance
is above r * segments + s. A query is finished when its k-th distance is not.

Equal codes are one entry with their k + 1 smallest ids, and equal queries are one search, so a code
that many rows share costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.sources.scratch import materialise

SEGMENT_BITS = 16
CODE_BITS = 32
K = 10


def binary_codes(vectors: DataFrame, vec_id: str, embedding: str, bits: int = CODE_BITS) -> DataFrame:
    """id, code: bit j is the sign of the sum of the components j, j + bits, j + 2 * bits, ...

    Missing and NULL components count as 0; a bit is on when the sum is above 0. Rows without an id
    or an embedding are left out. Rows that agree in id and code are one. A code is one long, so it
    has 64 bits at most.
    """
    if bits > 64:
        raise ValueError("a code has 64 bits at most")
    named = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    named = named.where("id is not null and e is not null")
    longest = named.agg(F.max(F.size("e"))).first()[0] or 0
    folds = max(1, -(-longest // bits))

    def bit(place: Column) -> Column:
        parts = [F.coalesce(F.get(F.col("e"), place + fold * bits), F.lit(0.0)) for fold in range(folds)]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return F.when(total > 0, 1).otherwise(0).cast("long")

    places = F.sequence(F.lit(0), F.lit(bits - 1))
    code = F.aggregate(places, F.lit(0).cast("long"), lambda acc, j: F.shiftleft(acc, 1).bitwiseOR(bit(j)))
    return named.select("id", code.alias("code")).distinct()


def _segment(code: str, number: int) -> Column:
    return F.shiftrightunsigned(F.col(code), SEGMENT_BITS * number).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _apart(number: int) -> Column:
    return F.bit_count(_segment("query", number).bitwiseXOR(_segment("code", number)))


def _ring(radius: int) -> Column:
    """All segment values with ``radius`` bits on."""
    every = F.sequence(F.lit(0), F.lit((1 << SEGMENT_BITS) - 1))
    return F.filter(every, lambda value: F.bit_count(value) == radius)


def nearest(codes: DataFrame, queries: DataFrame, k: int = K, bits: int = CODE_BITS) -> DataFrame:
    """query_id, rank, neighbor_id, distance: the k nearest rows of each query, itself left out.

    ``codes`` and ``queries`` have id and code; queries are rows of ``codes``. Ties go to the smaller
    id. With fewer than k other rows, all of them are returned. Without queries the result is empty.
    """
    spark, segments = codes.sparkSession, bits // SEGMENT_BITS
    few = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    index = materialise(
        codes.withColumn("__n", few).where(F.col("__n") <= k + 1)
        .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")),
        "hamming-index",
    )
    total = codes.count()
    need = min(k + 1, total)
    kind = codes.schema["id"].dataType.simpleString()
    open_codes = materialise(queries.select(F.col("code").alias("query")).distinct(), "hamming-open")
    best = spark.createDataFrame([], f"query bigint, distance int, id {kind}, code bigint")
    nearest_first = Window.partitionBy("query").orderBy("distance", "id", "code")
    steps = [(r, s) for r in range(SEGMENT_BITS + 1) for s in range(segments)]
    for radius, segment in steps:
        if open_codes.isEmpty():
            break
        probes = open_codes.select("query", F.explode(_ring(radius)).alias("__mask")).select(
            "query", _segment("query", segment).bitwiseXOR(F.col("__mask").cast("long")).alias("__value")
        )
        found = index.withColumn("__value", _segment("code", segment)).join(probes, "__value")
        for other in range(segments):  # what an earlier step has fetched is not taken again
            if other != segment:
                found = found.where(_apart(other) > (radius if other < segment else radius - 1))
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance")
        fresh = found.select("query", distance, F.explode("ids").alias("id"), "code")
        # Both sides are cut to k + 1 rows a query before they are shuffled.
        both = best.unionByName(fresh).withColumn("__n", F.row_number().over(nearest_first))
        best = materialise(both.where(F.col("__n") <= k + 1).drop("__n"), "hamming-best")
        covered = radius * segments + segment
        state = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        done = state.where((F.col("n") == need) & ((F.col("far") <= covered) | F.lit(need == total)))
        open_codes = materialise(open_codes.join(done, "query", "left_anti"), "hamming-open")
    pairs = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(best, "query")
    others = pairs.where((F.col("id") != F.col("query_id")) | (F.col("code") != F.col("query")))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "id", "code"))
    return (
        others.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("neighbor_id"), "distance")
    )
