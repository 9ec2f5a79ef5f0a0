"""Code points: names that follow from them, and columns of characters and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.format import HEX_NAMED, LEADING, TANGUT_COMPONENTS, TRAILING, VOWELS

_hangul: dict[str, str] = {}


def hangul(name: str) -> str | None:
    """The syllable of a romanised name in capitals."""
    if not _hangul:
        for i, a in enumerate(LEADING):
            for j, b in enumerate(VOWELS):
                for k, c in enumerate(TRAILING):
                    _hangul.setdefault(a + b + c, chr(0xAC00 + (i * len(VOWELS) + j) * len(TRAILING) + k))
    return _hangul.get(name)


def algorithmic(name: str) -> str | None:
    """The character whose Unicode name follows from its code point, in any case, hyphens as spaces."""
    kind, _, last = name.translate({i: i - 32 for i in range(97, 123)}).replace("-", " ").rpartition(" ")
    if kind == "HANGUL SYLLABLE":
        return hangul(last)
    if kind == "TANGUT COMPONENT" and last.isascii() and last.isdigit():
        cp = TANGUT_COMPONENTS[0] + int(last) - 1
        return chr(cp) if TANGUT_COMPONENTS[0] <= cp <= TANGUT_COMPONENTS[1] else None
    if kind in HEX_NAMED and 4 <= len(last) <= 8 and all(c in "0123456789ABCDEF" for c in last):
        cp = int(last, 16)
        return chr(cp) if any(a <= cp <= b for a, b in HEX_NAMED[kind]) else None
    return None


def char(cp: Column) -> Column:
    """The character of a code point; null for surrogates and numbers beyond the last."""
    valid = (cp >= 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, cp).otherwise(32)), 8, "0")), "UTF-32"))


def chars(text: Column) -> Column:
    """Array of the characters of a text; empty for an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def code_point_value(token: Column) -> Column:
    """The number of a code point token (U+, u+, 0x, 0X, U, u and 1 to 8 hex digits, or 4 to 8 bare ones); null for another."""
    prefixed = F.regexp_extract(token, r"^(?:[Uu]\+|0[xX]|[Uu])([0-9A-Fa-f]{1,8})$", 1)
    bare = F.regexp_extract(token, r"^([0-9A-Fa-f]{4,8})$", 1)
    return F.conv(F.when(prefixed != "", prefixed).when(bare != "", bare), 16, 10).cast("long")


def escape_name(cp: Column) -> Column:
    """U+ and at least four hex digits."""
    return F.concat(F.lit("U+"), F.when(cp < 0x1000, F.lpad(F.hex(cp), 4, "0")).otherwise(F.hex(cp)))
