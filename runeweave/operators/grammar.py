"""Patterns of the markup and of meta sequences, and what fails to be read."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..plans.format import CANCEL, DRAWING, EXTENDING, TAG_BASE

# First characters of meta sequences.
SIGIL_OPEN, SIGIL_ATTACH, SIGIL_CLOSE = "<", ":", "</"
# Characters of names, of meta keys and of meta values.
NAME, KEY, VALUE = "A-Za-z0-9_-", ("a-z", "a-z0-9-"), "A-Za-z0-9#.%+\\-_,()/"
HEX = "[0-9A-Fa-f]"
#: A token: an escaped marker, a character by number, a short tag, a tag, a tag without an end. What is between tokens is text.
TOKEN = re.compile(
    rf"(?P<escaped>\\\\(?::|U(?={HEX}{{4,8}}(?![{NAME}]))))"
    rf"|(?P<number>\\U{HEX}{{4,8}}(?![{NAME}]))"
    rf"|(?P<short>\\:(?:[Uu]\+)?[{NAME}]*)"
    r"|(?P<tag><:[^>]*>)"
    r"|(?P<unclosed><:[^>]*\Z)"
)
CODE = re.compile(rf"(?:[Uu]\+|0[xX]|[Uu])({HEX}{{1,8}})\Z|({HEX}{{4,8}})\Z")
OPERAND_CODE = re.compile(rf"(?:[Uu]\+|0[xX])({HEX}{{1,8}})\Z")
META_VALUE = re.compile(f"[{VALUE}]+\\Z")
TAG = re.compile(r"<:([^>]*)>")
#: Unicode White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f"[^{SPACE}]+")
#: One break or blank, which block tags take with them.
PADDING = re.compile(r"\r\n|[ \t\r\n]")
TAIL = re.compile(r"(?:\r\n|[ \t\r\n])\Z")


def spread(ranges) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


#: A character with those that belong to it.
CLUSTER = re.compile(f"(?s:.)(?:(?<=[{spread(DRAWING)}])(?s:.)|[{spread(EXTENDING)}])*")


def mirrored(characters: str) -> str:
    """A class of ASCII characters as one of TAG characters; - stands for a range, \\ keeps what follows."""
    return re.sub(r"\\(.)|(?<=.)-(?=.)|([^\\])", lambda m: chr(TAG_BASE + ord(m[1] or m[2])) if m[1] or m[2] else "-", characters)


def tags(text: str) -> str:
    """ASCII text as a sequence of TAG characters."""
    return "".join(chr(TAG_BASE + ord(c)) for c in text) + CANCEL


def untagged(text: str) -> str:
    return "".join(chr(ord(c) - TAG_BASE) for c in text)


_KEY = f"[{mirrored(KEY[0])}][{mirrored(KEY[1])}]*"
_PAIR = f"({_KEY}){chr(TAG_BASE + 32)}([{mirrored(VALUE)}]+){CANCEL}"
#: A meta sequence: its sigil is group 1 (opened or attached) with key 2 and value 3, or it closes key 4.
META = re.compile(f"([{tags(SIGIL_OPEN + SIGIL_ATTACH)[:-1]}]){_PAIR}|{tags(SIGIL_CLOSE)[:-1]}({_KEY}){CANCEL}")
ANY_TAGS = re.compile(f"[{chr(TAG_BASE + 0x20)}-{chr(TAG_BASE + 0x7E)}]+{CANCEL}")


class Warning_(NamedTuple):
    message: str
    at: int


class MarkupError(Exception):
    """What a text cannot be read for. kind: UnknownEntity, Unclosed, InvalidMeta or Unsupported (a warning in strict mode); warnings: those before it."""

    # Messages.
    MESSAGES = {"UnknownEntity": "unknown entity: {}", "Unclosed": "unclosed <: at {}", "InvalidMeta": "invalid meta value in <:{}>", "Unsupported": "{}"}

    def __init__(self, kind: str, detail: str, at: int, warnings: tuple = ()):
        super().__init__(self.MESSAGES[kind].format(detail))
        self.kind, self.detail, self.at, self.warnings = kind, detail, at, list(warnings)


def size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def scalar(digits: str) -> str | None:
    """The character of a hexadecimal number, None where there is none."""
    value = int(digits, 16)
    return None if value > 0x10FFFF or 0xD800 <= value <= 0xDFFF else chr(value)
