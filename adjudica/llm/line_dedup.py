"""Removal of repeated runs of lines, by winnowed fingerprints.

Lines that are blank are left out of account. A window is the shortest run of lines from a line on
(or up to a line) that has ``min_words`` words. Its fingerprint is its smallest line hash: any two
equal runs with that many words contain equal windows, so they share fingerprints for certain.

1. Every text gives its windows: fingerprint, window hash and position.
2. Fingerprints are counted; windows whose fingerprint occurs once in the whole table are dropped.
3. Windows of equal fingerprint and hash are joined with the first of their positions (order: id,
   then line). No group is expanded to pairs, and counts and minima are made before the shuffle.
4. Windows that follow one another on the same first text are one match, extended in both ways: a run
   is covered to its last line, since windows run forwards from each line and backwards from each.
5. The later runs are deleted, the first occurrence stays.

So a line goes if and only if it lies in a run of lines, of ``min_words`` words at least, that
occurs before in the order of ids and lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adjudica.llm import membership, textbatch
from adjudica.llm.textbatch import mixed
from adjudica.sources.scratch import materialise

MIN_WORDS = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def line_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, line number, hash, words) of every line that is not blank.

    Lines are what newlines separate. Space around words and case do not count.
    """
    points, owner = textbatch.code_points([t.lower() for t in texts])
    newline = points == textbatch.NEWLINE
    line_of = np.cumsum(newline) - newline  # number of the line each code point is on
    space = textbatch.table_of("isspace")[points]
    starts, ends = textbatch.runs_of(~space)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    hashes, word_line = textbatch.run_hashes(points, starts, ends), line_of[starts]
    at = np.flatnonzero(np.concatenate(([True], word_line[1:] != word_line[:-1])))
    counts = np.diff(np.append(at, len(word_line)))
    place = np.arange(len(word_line)) - np.repeat(at, counts)
    with np.errstate(over="ignore"):
        parts = mixed(hashes + _STEP * (place.astype(np.uint64) + np.uint64(1)))
        lines = mixed(np.add.reduceat(parts, at))
    text_of = owner[starts[at]]
    lines_before = np.zeros(len(texts), np.int64)  # line numbers start anew in each text
    first_point = np.searchsorted(owner, np.arange(len(texts)))
    lines_before[:] = line_of[first_point]
    return text_of, word_line[at] - lines_before[text_of], lines, counts


def windows(hashes: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line (by place) of each window of one text, without repeats."""
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(words)
    forward_end = np.searchsorted(total, total[:-1] + min_words) - 1
    back_start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    lines = np.arange(n)
    ahead = forward_end < n
    behind = total[1:] >= min_words
    first = np.concatenate((lines[ahead], back_start[behind]))
    last = np.concatenate((forward_end[ahead], lines[behind]))
    both = np.unique(first * n + last) if n else first
    return (both // n, both % n) if n else (first, last)


def _fingerprints(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest line hash of each window, and the hash of all its lines in order."""
    lengths = last - first + 1
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    lines = hashes[np.repeat(first, lengths) + place]
    with np.errstate(over="ignore"):
        parts = mixed(lines + _STEP * (place.astype(np.uint64) + np.uint64(1)))
        whole = mixed(np.add.reduceat(parts, at) + lengths.astype(np.uint64))
    return np.minimum.reduceat(lines, at), whole


def _windowed(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("row")
        for start, texts in textbatch.slices(batch.column("text")):
            text_of, line, hashes, words = line_hashes(texts)
            cuts = np.searchsorted(text_of, np.arange(len(texts) + 1))
            parts = []
            for number in range(len(texts)):
                own = slice(cuts[number], cuts[number + 1])
                first, last = windows(hashes[own], words[own], min_words)
                if len(first):
                    prints, wholes = _fingerprints(hashes[own], first, last)
                    parts.append((np.full(len(first), number), prints, wholes, line[own][first], line[own][last]))
            if not parts:
                continue
            number, prints, wholes, first, last = (np.concatenate(p) for p in zip(*parts, strict=True))
            owners = pa.array(number + start)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.take(owners),
                    batch.column("id").take(owners),
                    pa.array(prints.view(np.int64)),
                    pa.array(wholes.view(np.int64)),
                    pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()),
                ],
                names=["row", "id", "print", "window", "first", "last"],
            )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row, first, last, origin_id, origin_line: runs of lines that occur before. From row, id, text.

    Lines are numbered from 0 and include blank ones. Runs of one text may overlap where their
    first occurrences differ.
    """
    kind = docs.schema["id"].dataType.simpleString()
    found = materialise(
        docs.select("row", "id", "text").mapInArrow(
            lambda batches: _windowed(batches, min_words),
            f"row bigint, id {kind}, print bigint, window bigint, first bigint, last bigint",
        ),
        "line-windows",
    )
    several = found.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    near = membership.semi_join(found, "print", several)
    position = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), "row", "first", "last")
    origins = (
        near.groupBy("print", "window").agg(F.min(position).alias("origin"), F.count("*").alias("n")).where("n > 1")
    )
    later = near.join(origins, ["print", "window"]).where(
        (F.col("row") != F.col("origin.row")) | (F.col("first") != F.col("origin.first"))
    )
    # Windows on one diagonal (same first text, same distance) that touch are one run.
    diagonal = Window.partitionBy("row", "origin.row", F.col("first") - F.col("origin.first")).orderBy("first", "last")
    reach = F.max("last").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(F.col("first") > reach + 1, 1).when(reach.isNull(), 1).otherwise(0)
    numbered = later.withColumn("__opened", opened).withColumn("__run", F.sum("__opened").over(diagonal))
    return numbered.groupBy(
        "row", F.col("origin.row").alias("__from"), (F.col("first") - F.col("origin.first")).alias("__shift"), "__run"
    ).agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.first("origin.id").alias("origin_id"),
        F.min("origin.first").alias("origin_line"),
    ).select("row", "first", "last", "origin_id", "origin_line")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed = [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            if not runs:
                texts.append(text)
                removed.append(0)
                continue
            lines = text.split("\n")
            keep = np.ones(len(lines), bool)
            for run in runs:
                keep[run["first"] : run["last"] + 1] = False
            texts.append("\n".join(line for line, kept in zip(lines, keep, strict=True) if kept))
            removed.append(int((~keep).sum()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(texts, pa.string()),
                batch.column("n_lines"),
                pa.array(removed, pa.int64()),
                batch.column("runs"),
            ],
            names=["id", "clean_text", "n_lines", "removed_lines", "runs"],
        )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, clean_text, n_lines, removed_lines, runs.

    ``runs`` are the (first, last, origin_id, origin_line) that were deleted; blank lines inside a run
    go with it. A NULL text stays NULL and has no lines. Texts of NULL ids come after all others.
    Repeated rows are texts of their own: the later one loses what it repeats. An empty table gives an
    empty result. Other columns are not read.
    """
    texts = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text")
        ),
        "line-texts",
    )
    runs = repeated_runs(texts, min_words)
    by_row = materialise(
        runs.groupBy("row").agg(
            F.sort_array(F.collect_list(F.struct("first", "last", "origin_id", "origin_line"))).alias("runs")
        ),
        "line-runs",
    )
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    bitmap = materialise(membership.bitmap_of(by_row, F.col("row")), "line-bitmap")
    seen = membership.flagged(texts, F.col("row"), bitmap, "__on")
    untouched = seen.where("not __on").select(
        F.col("id").alias("doc_id"), F.col("text").alias("clean_text"), n_lines.alias("n_lines"),
        F.lit(0).cast("long").alias("removed_lines"),
        F.array().cast(by_row.schema["runs"].dataType).alias("runs"),
    )
    kind, listed = texts.schema["id"].dataType.simpleString(), by_row.schema["runs"].dataType
    hit = seen.where("__on").join(by_row, "row", "left")
    cleaned = hit.select(
        "id", "text", n_lines.alias("n_lines"), F.coalesce("runs", F.array().cast(listed)).alias("runs")
    ).mapInArrow(
        _cleaned,
        f"id {kind}, clean_text string, n_lines bigint, removed_lines bigint, runs {listed.simpleString()}",
    )
    return untouched.unionByName(cleaned.withColumnRenamed("id", "doc_id"))
