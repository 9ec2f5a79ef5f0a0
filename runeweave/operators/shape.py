"""How tags are written: forms of an inline tag that cannot be taken for an opener, and markup in ASCII."""

from __future__ import annotations

import re

from .compiled import Tables
from .grammar import NAME, TAG, WORD

PLAIN = re.compile("[A-Za-z0-9_ -]*")
AFTER = re.compile(f"[{NAME}]")


def looks_open(t: Tables, content: str) -> bool:
    """Whether an inline tag looks as if it opened something: neither closed, nor an operator's, nor pairs of meta keys and values."""
    if len(content) < 2 and content < "\x80" or content[:1] == "/" or content[-1:] == "/" or content in t.operators:
        return False
    words = WORD.findall(content)
    return len(words) % 2 == 1 or not words or not all(w in t.meta for w in words[::2])


def short_form(t: Tables, content: str, before: str, after: str) -> str | None:
    """The short tag of a content, where it has one that what stands around does not change."""
    spaced = " " in content
    if (spaced and ("-" in content or content.split(" ", 1)[0] in t.meta)) or not PLAIN.fullmatch(content):
        return None
    return None if before == "\\" or AFTER.match(after) else "\\:" + content.replace(" ", "-")


def block_form(t: Tables, content: str) -> str | None:
    """The content as a block around its one operand."""
    word, found, operand = content.partition(" ")
    if not found or word not in t.operators or " " in operand or operand in t.operators:
        return None
    return f"<:{word}> {operand} <:/{word}>"


def explicit(t: Tables, source: str, memo: dict | None = None) -> str:
    """A source whose inline tags cannot be taken for openers."""
    memo = {} if memo is None else memo
    header = t.header.match(source)
    begin = header.end() if header else 0
    end, last = begin, source[begin - 1 : begin]

    def one(m: re.Match) -> str:
        nonlocal end, last
        before = source[m.start() - 1] if m.start() > end else last
        key = (m[1], before == "\\", AFTER.match(source, m.end()) is not None)
        form = memo.get(key)
        if form is None:
            form = m[0]
            if looks_open(t, m[1]):
                form = short_form(t, m[1], before, source[m.end() : m.end() + 1]) or f"<:{m[1]}/>"
            if len(memo) < 1 << 16:
                memo[key] = form
        end, last = m.end(), form[-1:]
        return form

    out, here = [source[:begin]], begin
    for m in TAG.finditer(source, begin):
        out += [source[here : m.start()], one(m)]
        here = m.end()
    return "".join(out) + source[here:]


BEYOND = re.compile(rf"(\\?)([^\x00-\x7F])(?=([{NAME}]?))|<:|>")


def ascii_only(markup: str) -> str:
    """Characters beyond ASCII as code points: bare in a tag, self-closed before a name character or after a backslash, else short."""
    inside = False

    def one(m: re.Match) -> str:
        nonlocal inside
        if not m[2]:
            inside = m[0] == "<:"
            return m[0]
        code = f"U+{ord(m[2]):04X}"
        if inside:
            return m[1] + code
        return f"{m[1]}<:{code}/>" if m[1] or m[3] else f"\\:{code}"

    return BEYOND.sub(one, markup)
