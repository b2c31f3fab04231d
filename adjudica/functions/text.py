"""Field extraction from free text with anchored patterns.

The patterns follow Unicode semantics: any decimal digit counts as a digit, any Unicode blank as a
blank, and word edges look at letters and numbers of every script.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, functions as F

from adjudica.functions.common import let

_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]*"
# Besides their capitals, i and s also match dotted/dotless i and long s.
_I, _S = r"[iİı]", r"[sſ]"
_SEPARATOR = rf"{_BLANK}(?:{_I}{_S}|:){_BLANK}"
_LETTER = r"A-Za-zİıſK"
_NAME = rf"(?id)holder{_SEPARATOR}([{_LETTER}][{_LETTER}\- ]*?)(?:[.,;]|$)"
_WORD = r"[\p{L}\p{N}_]"

# The extraction vocabulary. ``holder`` is an older alias of ``holder_name``.
# Word edges are tested after the first characters have matched: a look-behind in front would be
# tried at every position of the text.
PATTERNS = {
    "holder_name": _NAME,
    "holder": _NAME,
    "premium": rf"(?i)prem{_I}um{_SEPARATOR}\$?(-?\p{{Nd}}+(?:\.\p{{Nd}}+)?)",
    "zip_code": rf"(\p{{Nd}}(?<!{_WORD}\p{{Nd}})\p{{Nd}}{{4}})(?!{_WORD})",
    "age": rf"(?i)age(?<!{_WORD}age){_SEPARATOR}(\p{{Nd}}{{1,3}})(?!{_WORD})",
}

_NUMERIC = {"premium": "double", "age": "int"}


def _foreign_digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit, and the ASCII digit of equal value at the same place."""
    digits = [
        chr(cp)
        for cp in range(128, sys.maxunicode + 1)
        if unicodedata.category(chr(cp)) == "Nd"
    ]
    return "".join(digits), "".join(str(unicodedata.decimal(d)) for d in digits)


_FOREIGN, _ASCII = _foreign_digits()


def extract_field(text: Column, name: str) -> Column:
    """First match of the field's pattern, trimmed and typed; NULL when absent or unknown."""
    if name not in PATTERNS:
        return F.lit(None).cast("string")
    found = F.trim(F.regexp_extract(text, PATTERNS[name], 1))
    if name not in _NUMERIC:
        return let(found, lambda v: F.when(v != "", v))
    return let(found, lambda v: _number(v, _NUMERIC[name]))


def _number(digits: Column, dtype: str) -> Column:
    """Number written in any script's digits; NULL for no digits at all."""
    plain = F.when(digits.rlike(r"^[\x00-\x7f]*$"), digits).otherwise(
        F.translate(digits, _FOREIGN, _ASCII)
    )
    return plain.try_cast(dtype)
