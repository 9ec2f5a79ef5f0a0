"""Text operators that need no grammar: native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.format import CANCEL, FILLERS, SCRIPTS, TAG_BASE
from .codepoints import char, chars, escape_name

#: Markers in a text, and how they are written so that they stay text.
ESCAPES = (("<:", "<<::>"), (r"\\:", r"\\<::>"), (r"\\U(?=[0-9A-Fa-f]{4,8}(?![A-Za-z0-9_-]))", r"\\<:U>"))


def joined(items: Column) -> Column:
    return F.array_join(items, "")


def escape_markers(text: Column) -> Column:
    """A text in which no marker is read."""
    for marker, written in ESCAPES:
        text = F.regexp_replace(text, marker, written)
    return text


def escape_ascii(text: Column) -> Column:
    """A text without markers with every character beyond ASCII as a code point, in the form that what stands around it needs."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x00-\x7F]+|[^\x00-\x7F])"), F.lit(1))
    nothing = F.array(F.lit(""))
    around = F.arrays_zip(F.concat(nothing, pieces).alias("before"), pieces.alias("piece"), F.concat(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), nothing).alias("after"))

    def one(x: Column) -> Column:
        code = escape_name(F.ascii(x["piece"]))
        closed = x["after"].rlike("^[A-Za-z0-9_-]") | x["before"].endswith("\\")
        return F.when(x["piece"].isNull(), "").when(F.ascii(x["piece"]) < 128, x["piece"]).when(closed, F.concat(F.lit("<:"), code, F.lit("/>"))).otherwise(F.concat(F.lit("\\:"), code))

    return F.when(text.rlike(r"[^\x00-\x7F]"), joined(F.transform(around, one))).otherwise(text)


def unescape_codes(markup: Column) -> Column:
    """Text of markup that holds no tags but escapes and code points: the native path of to_unicode."""
    parts = F.regexp_extract_all(markup, F.lit(r"(?s)(<:[^>]*>|\\:(?:[Uu]\+)?[A-Za-z0-9_-]+|[^<\\]+|.)"), F.lit(1))

    def one(t: Column) -> Column:
        code = F.regexp_extract(t, r"^(?:<:|\\:)U\+([0-9A-Fa-f]{1,8})(?:/?>)?$", 1)
        value = F.conv(F.when(code != "", code), 16, 10).cast("long")
        return F.coalesce(char(value), F.when(t.rlike("^<:.>$"), F.substring(t, 3, 1)), t)

    return joined(F.transform(parts, one))


def tag_encode(text: Column) -> Column:
    """ASCII text as TAG characters, ended by the cancelling one."""
    return F.concat(joined(F.transform(chars(text), lambda c: char(F.ascii(c) + TAG_BASE))), F.lit(CANCEL))


def tag_decode(tags: Column) -> Column:
    """The ASCII text of TAG characters; the cancelling one is dropped."""
    return joined(F.transform(chars(F.replace(tags, F.lit(CANCEL), F.lit(""))), lambda c: char(F.ascii(c) - TAG_BASE)))


def html_escape(text: Column) -> Column:
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def script_of(c: Column) -> Column:
    """The script whose characters have controls of their own, or an empty text."""
    cp, out = F.ascii(c), F.lit("")
    for script, a, b in SCRIPTS:
        out = F.when(cp.between(a, b), script).otherwise(out)
    return out


def styled(text: Column, forms: dict[str, str]) -> Column:
    """Single characters in a style; the forms' keys and values are one character each."""
    single = {k: v for k, v in forms.items() if len(k) == len(v) == 1}
    return F.translate(text, "".join(single), "".join(single.values()))


def hash31(text: Column, multiplier: int = 31) -> Column:
    """h * multiplier + byte modulo 2**32 over the UTF-8 bytes."""
    octets = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.aggregate(octets, F.lit(0).cast("long"), lambda h, b: (h * multiplier + F.conv(b, 16, 10).cast("long")) % (1 << 32))


def bloom_positions(key: Column, bits: Column, hashes: int = 7) -> Column:
    """Places of a key in a Bloom filter, by double hashing."""
    first, step = hash31(key), hash31(key, 131).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: ((first + i.cast("long") * step) % (1 << 32)) % bits)


def endings(name: Column) -> Column:
    """What follows each hyphen of a name."""
    parts = F.split(name, "-")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))


def filled_names(name: Column, fillers: tuple[str, ...] = FILLERS) -> Column:
    """The names with one filler word put after one of the hyphens, in reading order."""
    parts = F.split(name, "-")
    words = F.array(*map(F.lit, fillers))
    at = lambda i: F.transform(words, lambda w: F.concat_ws("-", F.slice(parts, 1, i), F.array(w), F.slice(parts, i + 1, F.size(parts))))
    return F.when(F.size(parts) > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), at))).otherwise(F.array().cast("array<string>"))


def combined_key(style: Column) -> Column:
    """A style's parts in one order, so that bold-italic and italic-bold are the same."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(style, "[ -]+"))), "-")
