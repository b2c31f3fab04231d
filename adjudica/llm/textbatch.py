"""Texts of an Arrow batch as numpy arrays, in slices of bounded size.

A slice joins several texts into one array of code points, so that the work on characters, words
and lines is array work. Memory grows with the slice bound and with the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_CHARS = 400_000
SLICE_TEXTS = 256
NEWLINE = 10


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with NULL as empty; a slice holds one text at least."""
    start, held, chars = 0, [], 0
    for row, text in enumerate(column):
        value = text.as_py() or ""
        if held and (chars + len(value) > SLICE_CHARS or len(held) == SLICE_TEXTS):
            yield start, held
            start, held, chars = row, [], 0
        held.append(value)
        chars += len(value)
    if held:
        yield start, held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a newline, and the text each belongs to."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return points, np.repeat(np.arange(len(texts)), lengths)


@lru_cache(maxsize=None)
def table_of(test: str) -> np.ndarray:
    """Which code points pass a ``str`` test, for example isalpha."""
    passes = getattr(str, test)
    return np.fromiter((passes(chr(c)) for c in range(0x110000)), dtype=bool, count=0x110000)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix: every input bit changes about half of the output bits."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run [start, end) of code points, by content; runs do not overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    inside = np.repeat(np.arange(len(starts)), lengths)
    offset = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(starts, lengths) + offset
    with np.errstate(over="ignore"):
        # A sum of mixed (character, place) pairs: order counts, and one reduce gives all runs.
        parts = mixed(points[at].astype(np.uint64) + (offset.astype(np.uint64) << np.uint64(21)) + np.uint64(1))
        first = np.cumsum(lengths) - lengths
        sums = np.zeros(len(starts), dtype=np.uint64)
        filled = lengths > 0
        sums[filled] = np.add.reduceat(parts, first[filled])
        return mixed(sums + lengths.astype(np.uint64))


def runs_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edges = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
