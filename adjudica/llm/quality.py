"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Every text becomes a vector of statistics (sizes, shares of character classes, repetition of words
and lines), transformed so that each is roughly symmetric. Each class has its mean and a covariance
that is shrunk twice: towards the covariance of all classes and towards a diagonal. A score compares
the two classes' log densities: Mahalanobis distances through Cholesky factors that are made once.

Statistics are computed in one pass over the texts; what is stored and joined with labels is the
vector, not the text. Means and covariances are sums, so all labelled rows take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adjudica.llm import textbatch

STATISTICS = (
    "words", "word_length", "word_spread", "upper", "digits", "marks", "symbols", "distinct_words",
    "top_word", "adjacent_repeats", "lines", "line_length", "repeated_lines", "stops", "capitalised",
    "not_ascii", "short_words", "runs_of_marks",
)
#: Weight of the covariance of all classes, and of the diagonal.
POOLED = 0.5
DIAGONAL = 0.2


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of a share, one count added on both sides: finite also for empty texts."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics per text."""
    points, owner = textbatch.code_points(texts)
    n = len(texts)
    space = textbatch.table_of("isspace")[points]
    alpha = textbatch.table_of("isalpha")[points]
    upper = textbatch.table_of("isupper")[points]
    digit = textbatch.table_of("isdigit")[points]
    plain_mark = np.isin(points, np.frombuffer(".,;:!?'\"()-".encode("utf-32-le"), dtype=np.uint32))
    symbol = ~(space | alpha | digit | plain_mark)
    mark = plain_mark | symbol

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=n).astype(float)

    chars = per_text(~space)
    starts, ends = textbatch.runs_of(~space)
    of_word = owner[starts]
    words = np.bincount(of_word, minlength=n).astype(float)
    lengths = (ends - starts).astype(float)
    mean = np.bincount(of_word, lengths, n) / np.maximum(words, 1)
    spread = np.sqrt(np.bincount(of_word, (lengths - mean[of_word]) ** 2, n) / np.maximum(words, 1))

    hashes = textbatch.run_hashes(points, starts, ends)
    order = np.lexsort((hashes, of_word))
    by_text, by_hash = of_word[order], hashes[order]
    new = np.concatenate(([True], (by_text[1:] != by_text[:-1]) | (by_hash[1:] != by_hash[:-1])))[: len(order)]
    distinct = np.bincount(by_text[new], minlength=n).astype(float)
    top = np.zeros(n)
    if len(order):
        at = np.flatnonzero(new)
        np.maximum.at(top, by_text[at], np.diff(np.append(at, len(order))).astype(float))
    same = (of_word[1:] == of_word[:-1]) & (hashes[1:] == hashes[:-1])
    repeats = np.bincount(of_word[1:][same], minlength=n).astype(float)

    line_starts, line_ends = textbatch.runs_of(points != textbatch.NEWLINE)
    of_line = owner[line_starts]
    lines = np.bincount(of_line, minlength=n).astype(float)
    line_keys = np.stack([of_line.astype(np.uint64), textbatch.run_hashes(points, line_starts, line_ends)], axis=1)
    kinds = np.unique(line_keys, axis=0) if len(line_keys) else line_keys
    distinct_lines = np.bincount(kinds[:, 0].astype(np.int64), minlength=n).astype(float)

    stops = per_text(np.isin(points, np.frombuffer(".!?".encode("utf-32-le"), dtype=np.uint32)))
    mark_run = mark & np.concatenate(([False], mark[:-1]))
    capital = np.bincount(of_word[upper[starts]], minlength=n).astype(float)
    short = np.bincount(of_word[lengths <= 2], minlength=n).astype(float)
    return np.stack(
        [
            np.log1p(words),
            np.log1p(mean),
            np.log1p(spread),
            _share(per_text(upper), chars),
            _share(per_text(digit), chars),
            _share(per_text(mark), chars),
            _share(per_text(symbol), chars),
            _share(distinct, words),
            _share(top, words),
            _share(repeats, words),
            np.log1p(lines),
            np.log1p(words / np.maximum(lines, 1)),
            _share(lines - distinct_lines, lines),
            np.log((stops + 0.5) / (words + 1)),
            _share(capital, words),
            _share(per_text(alpha & (points > 127)), chars),
            _share(short, words),
            np.log((per_text(mark_run) + 0.5) / (words + 1)),
        ],
        axis=1,
    )


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(texts) for _, texts in textbatch.slices(batch.column("text"))]
        table = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
        flat = pa.array(table.reshape(-1), pa.float64())
        offsets = pa.array(np.arange(len(table) + 1) * len(STATISTICS), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.ListArray.from_arrays(offsets, flat)], names=["id", "stats"]
        )


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, stats: the transformed statistics of every row's whole text; NULL counts as empty."""
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, stats array<double>"
    return narrow.mapInArrow(_described, schema).withColumnRenamed("id", "doc_id")


@dataclass(frozen=True)
class Discriminant:
    """Two classes: log priors, means, and inverse Cholesky factors with half log determinants."""

    log_prior: np.ndarray
    means: np.ndarray
    inverse_factors: np.ndarray
    half_log_det: np.ndarray
    scale: float

    def log_odds(self, stats: np.ndarray) -> np.ndarray:
        densities = []
        for k in (0, 1):
            z = (stats - self.means[k]) @ self.inverse_factors[k].T
            densities.append(self.log_prior[k] - 0.5 * np.einsum("ij,ij->i", z, z) - self.half_log_det[k])
        return self.scale * (densities[1] - densities[0])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of 1, x and the products of x, by class, of one task's rows."""
    size = len(STATISTICS) + 1
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        stats = np.array(batch.column("stats").to_pylist(), dtype=float)
        ones = np.concatenate([np.ones((len(stats), 1)), stats], axis=1)
        labels = np.array(batch.column("label").to_pylist())
        for label in np.unique(labels):
            own = ones[labels == label]
            sums[int(label)] = sums.get(int(label), np.zeros((size, size))) + own.T @ own
    for label, products in sums.items():
        yield pa.record_batch(
            [
                pa.array([label] * size * size, pa.int32()),
                pa.array(np.arange(size * size), pa.int32()),
                pa.array(products.reshape(-1), pa.float64()),
            ],
            names=["label", "place", "value"],
        )


def learn(labelled: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant | None:
    """Fit on the columns stats and label (0 or 1); None where a class has no row.

    Only sums of fixed size reach the driver. Log odds are scaled by 1 / sqrt(number of statistics):
    statistics that depend on one another would otherwise make nearly every score 0 or 1.
    """
    size = len(STATISTICS) + 1
    sums = (
        labelled.where("label in (0, 1) and stats is not null")
        .select("stats", F.col("label").cast("int").alias("label"))
        .mapInArrow(_moments, "label int, place int, value double")
        .groupBy("label", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    products = np.zeros((2, size * size))
    for row in sums:
        products[row["label"], row["place"]] = row["value"]
    products = products.reshape(2, size, size)
    counts = products[:, 0, 0]
    if counts.min() == 0:
        return None
    means = products[:, 0, 1:] / counts[:, None]
    scatter = [products[k, 1:, 1:] - counts[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    common = (scatter[0] + scatter[1]) / counts.sum()
    factors, half_log_det = [], []
    for k in (0, 1):
        own = (1 - pooled) * scatter[k] / counts[k] + pooled * common
        level = np.maximum(np.diag(own), 1e-6)
        own = (1 - diagonal) * own + diagonal * np.diag(level) + 1e-6 * np.eye(size - 1)
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        half_log_det.append(np.log(np.diag(lower)).sum())
    return Discriminant(
        np.log(counts / counts.sum()),
        means,
        np.stack(factors),
        np.array(half_log_det),
        1 / np.sqrt(size - 1),
    )


def _scored(batches: Iterator[pa.RecordBatch], model: Discriminant | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = np.array(batch.column("stats").to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
        odds = np.clip(model.log_odds(stats), -50, 50) if model else np.zeros(len(stats))
        scores = 1 / (1 + np.exp(-odds))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])


def score(described: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id, score (0 to 1: the probability of label 1). Without a model every score is 0.5."""
    narrow = described.select(F.col("doc_id").alias("id"), "stats")
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, score double"
    return narrow.mapInArrow(lambda batches: _scored(batches, model), schema).withColumnRenamed("id", "doc_id")
