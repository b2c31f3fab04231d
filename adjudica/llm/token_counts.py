"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer digest, tokens). Texts are reduced to distinct
digests with partial aggregation before the shuffle, joined with the stored digests of the same
tokenizer version, and only the misses are encoded; their counts are appended to the cache, from
which all rows then take theirs. A new vocabulary file has another digest, so old counts are never
used for it. Two jobs that append the same digest do no harm: the cache is read by distinct digest.

Only NULL is normalised (to the empty text): any other change of a text could change its count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adjudica.llm import textbatch
from adjudica.sources.scratch import materialise

CACHE_SCHEMA = "digest binary, tokenizer binary, n_tokens bigint"


@lru_cache(maxsize=4)
def _encoder(path: str):
    """A function from texts to numbers of tokens, by the library of the file's kind."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(path)
        words.no_truncation()
        words.no_padding()
        return lambda texts: [len(e) for e in words.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    raise ValueError(f"no tokenizer library is known for {path}")


def tokenizer_digest(path: str) -> bytes:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).digest()


def _counts(batches: Iterator[pa.RecordBatch], path: str, version: bytes) -> Iterator[pa.RecordBatch]:
    count = _encoder(path)
    for batch in batches:
        counts: list[int] = []
        for _, texts in textbatch.slices(batch.column("text")):
            counts += count(texts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("digest"),
                pa.array([version] * len(counts), pa.binary()),
                pa.array(counts, pa.int64()),
            ],
            names=["digest", "tokenizer", "n_tokens"],
        )


def stored(spark: SparkSession, cache: str, version: bytes) -> DataFrame:
    """digest, n_tokens of one tokenizer version, each digest once. The folder must exist."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == F.lit(version))
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def new_cache(spark: SparkSession, cache: str) -> None:
    """Make an empty cache table at ``cache``, or leave one that is there."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)


def misses(docs: DataFrame, cache: str, version: bytes, text: str = "text") -> DataFrame:
    """digest, text: one row for each distinct text whose count is not stored."""
    digest, content = _digest(text), _content(text)
    distinct = docs.groupBy(digest.alias("digest")).agg(F.first(content).alias("text"))
    return distinct.join(stored(docs.sparkSession, cache, version).select("digest"), "digest", "left_anti")


def _content(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(_content(text), 256))


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, limit: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is a vocabulary file that every executor has at that path; ``cache`` a folder
    made by ``new_cache`` in storage that all share. NULL counts as the empty text, which has as
    many tokens as the library says (0). Repeated rows each get their row; other columns are not
    read. An empty table gives an empty result.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    rows = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.octet_length(_content(text)).cast("long").alias("n_bytes"),
            _digest(text).alias("digest"),
        ),
        "token-digests",
    )
    misses(docs, cache, version, text).mapInArrow(
        lambda batches: _counts(batches, tokenizer, version), CACHE_SCHEMA
    ).write.mode("append").parquet(cache)
    return rows.join(stored(spark, cache, version), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
