"""Tokens that never collide: a keyed permutation of all strings of the same shape.

A string's shape is the class of each character: capital, small letter or digit, and the letters of
Latin-1 in stretches of their own. Characters of no class, those of other scripts among them, stay as
they are and stay readable: the token of ``tokens`` is for such names. Rounds take turns between the characters at odd and at even places: those of one
kind are moved on within their class by amounts that a keyed hash draws from all the others. As a
round leaves what it hashes unchanged, it can be undone, so different strings get different tokens and the
key gives the string back; no map is kept. A string of one character is moved by a constant.

A batch's strings are turned together: their characters are one array, and only the hash is taken
string by string.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

ROUNDS = 8
#: First character and number of characters of each class.
CLASSES = (("A", 26), ("a", 26), ("0", 10), ("À", 23), ("Ø", 7), ("à", 23), ("ø", 8))


#: Characters turned at a time, unless one string has more: bounds memory.
SLICE_CHARS = 400_000

# First character and number of characters of each code point's class; 0 where it has none.
_FIRST, _COUNT = np.zeros(256, np.int64), np.zeros(256, np.int64)
for _first, _count in CLASSES:
    _FIRST[ord(_first) : ord(_first) + _count] = ord(_first)
    _COUNT[ord(_first) : ord(_first) + _count] = _count


def _turned(texts: list[str], keys: list[str | None], numbers: Sequence[int], sign: int) -> list[bytes]:
    """Each text after the rounds of these numbers."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    spans = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(owner)) - (ends - lengths)[owner]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    known = np.where(points < len(_FIRST), points, 0)
    first, count = _FIRST[known], np.maximum(_COUNT[known], 1)

    def strings(of: np.ndarray) -> list[bytes]:
        joined = of.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [joined[a:b].encode("utf-8", "surrogateescape") for a, b in spans]

    for number in numbers:
        turn = (_COUNT[known] > 0) & ((place + number) % 2 == 0)
        # As concat_ws does, a NULL key is left out.
        secrets = [(f"{number}|" if k is None else f"{k}|{number}|").encode("utf-8", "surrogateescape") for k in keys]
        masked = strings(np.where(turn, first, points))
        digests = b"".join(sha256(k + m).digest() for k, m in zip(secrets, masked, strict=True))
        drawn = np.frombuffer(digests, ">u2").reshape(-1, 16)[owner, place % 16].astype(np.int64)
        points = np.where(turn, first + (points - first + sign * drawn) % count, points)
    return strings(points)


def _slices(texts: list[str | None]) -> Iterator[slice]:
    start, chars = 0, 0
    for row, text in enumerate(texts):
        size = len(text or "")
        if chars and chars + size > SLICE_CHARS:
            yield slice(start, row)
            start, chars = row, 0
        chars += size
    yield slice(start, len(texts))


def _strings(column: pa.Array) -> list[str | None]:
    """Bytes that are no UTF-8 stay what they are."""
    return [v if v is None else v.decode("utf-8", "surrogateescape") for v in column.cast(pa.binary()).to_pylist()]


def _all_turned(texts: pa.Array, keys: pa.Array, numbers: list[int], sign: int) -> pa.Array:
    values, secrets = _strings(texts), _strings(keys)
    out: list[bytes | None] = []
    for part in _slices(values):
        done = _turned([v or "" for v in values[part]], secrets[part], numbers, sign)
        out += [None if v is None else d for v, d in zip(values[part], done, strict=True)]
    return pa.array(out, pa.binary()).view(pa.string())


def _all_rounds(text: Column, key: str | Column, numbers: list[int], sign: int) -> Column:
    @F.arrow_udf("string")
    def turned(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return _all_turned(texts, keys, numbers, sign)

    return turned(text, F.lit(key) if isinstance(key, str) else key)


def _rounds_of_rows(df: DataFrame, columns: Mapping[str, str], key: str | Column, numbers: list[int], sign: int) -> DataFrame:
    """The rows with each of these columns turned from the one it names. Rows go through Python whole."""
    before = df.columns
    names = [*before, *[c for c in columns if c not in before]]
    held = {f.name: f for f in df.schema.fields}
    schema = StructType([StructField(c, StringType()) if c in columns else held[c] for c in names])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = {c: _all_turned(batch.column(before.index(text)), batch.column(len(before)), numbers, sign) for c, text in columns.items()}
            yield pa.RecordBatch.from_arrays([done[c] if c in done else batch.column(before.index(c)) for c in names], names=names)

    secret = F.lit(key) if isinstance(key, str) else key
    free = "__secret" + "_" * max(map(len, before))  # no column of df has this name
    return df.select("*", secret.alias(free)).mapInArrow(turned, schema)


def permute(text: Column, key: str | Column, rounds: int = ROUNDS) -> Column:
    """The token of a text under a key; NULL stays NULL."""
    return _all_rounds(text, key, list(range(rounds)), 1)


def restore(token: Column, key: str | Column, rounds: int = ROUNDS) -> Column:
    """The text of a token made by :func:`permute` with the same key and rounds."""
    return _all_rounds(token, key, list(range(rounds))[::-1], -1)


def permute_rows(df: DataFrame, columns: Mapping[str, str], key: str | Column, rounds: int = ROUNDS) -> DataFrame:
    """The rows with the token of a text column in each new or replaced column: {column: text column}."""
    return _rounds_of_rows(df, columns, key, list(range(rounds)), 1)


def restore_rows(df: DataFrame, columns: Mapping[str, str], key: str | Column, rounds: int = ROUNDS) -> DataFrame:
    """Undo :func:`permute_rows`."""
    return _rounds_of_rows(df, columns, key, list(range(rounds))[::-1], -1)
