"""Format-preserving tokens.

Character ``i`` of the plaintext is replaced according to byte ``i mod 32`` of
``SHA-256(transformation::plaintext)``: capitals by capitals, small letters by small letters,
digits by digits; anything else stays. Built from native expressions, so it runs in the JVM.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, functions as F

from adjudica.functions.common import let

# Digits that are not decimal digits (superscripts, circled digits, ...), by rule.
_OTHER_DIGITS = "".join(
    c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit() and not c.isdecimal()
)
_UPPER = r"^\p{IsUppercase}$"
_LOWER = r"^\p{IsLowercase}$"
_DIGIT = rf"^[\p{{Nd}}{_OTHER_DIGITS}]$"
_ASCII = "^[\\x00-\\x7f]*$"


def _byte(digest: Column, position: Column) -> Column:
    pair = F.substring(digest, (position % 32) * 2 + 1, F.lit(2))
    return F.conv(pair, 16, 10).cast("int")


def _shift(base: str, b: Column) -> Column:
    return F.char(F.lit(ord(base)) + b % 26)


def _letters(plaintext: Column, digest: Column, upper, lower, digit) -> Column:
    def replace(ch: Column, position: Column) -> Column:
        b = _byte(digest, position)
        return (
            F.when(upper(ch), _shift("A", b))
            .when(lower(ch), _shift("a", b))
            .when(digit(ch), (b % 10).cast("string"))
            .otherwise(ch)
        )

    return F.array_join(F.transform(F.split(plaintext, ""), replace), "")


def token(plaintext: Column, transformation: str = "default") -> Column:
    """Deterministic token of the same length and per-position character class."""
    digest = F.sha2(F.concat(F.lit(f"{transformation}::"), plaintext), 256)

    # Most identifiers are ASCII: range tests there, Unicode properties only where needed.
    def plain(d: Column) -> Column:
        return _letters(
            plaintext,
            d,
            lambda c: c.between("A", "Z"),
            lambda c: c.between("a", "z"),
            lambda c: c.between("0", "9"),
        )

    def wide(d: Column) -> Column:
        return _letters(
            plaintext,
            d,
            lambda c: c.rlike(_UPPER),
            lambda c: c.rlike(_LOWER),
            lambda c: c.rlike(_DIGIT),
        )

    # Bound once: inside the per-character function it would be hashed anew for each character.
    return let(digest, lambda d: F.when(plaintext.rlike(_ASCII), plain(d)).otherwise(wide(d)))
