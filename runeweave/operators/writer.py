"""Text to markup: one pattern, made of the dictionary, finds what must be written in another way; everything between stays."""

from __future__ import annotations

import re

from .compiled import JOINER, Tables
from .grammar import ANY_TAGS, CANCEL, HEX, NAME, SIGIL_ATTACH, SIGIL_CLOSE, SIGIL_OPEN, TAG_BASE, VALUE, mirrored, tags, untagged
from .shape import ascii_only, explicit

#: Spellings that are remembered.
MEMO = 1 << 16


class Writer:
    """Writes texts with the tables of one lexicon."""

    def __init__(self, tables: Tables):
        self.t = tables
        self._memo: dict[str, str] = {}
        self._forms: dict = {}
        bare = lambda text: tags(text)[:-1]
        keys = "|".join(sorted(map(bare, tables.meta), key=len, reverse=True)) or "(?!)"
        pair = f"(?:{keys}){bare(' ')}[{mirrored(VALUE)}]+{CANCEL}"
        joined = sorted((t for t in tables.spelled if JOINER in t), key=len, reverse=True)
        known = f"(?=(?s:.{{0,3}}){JOINER})(?:{'|'.join(map(re.escape, joined)) or '(?!)'})(?!️)"
        suffix = "[" + "".join(re.escape(c) for c in tables.suffixes if len(c) == 1) + "]" if tables.suffixes else "(?!)"
        follows = f"(?:{suffix}|{ANY_TAGS.pattern})"
        self._attached = re.compile(f"{bare(SIGIL_ATTACH)}({pair})")
        self._found = re.compile(
            f"(?P<span>{bare(SIGIL_OPEN)}{pair}|{bare(SIGIL_CLOSE)}(?:{keys}){CANCEL})"
            f"|(?P<joined>{known})"
            rf"|(?P<marker><:|\\:)"
            rf"|(?P<number>\\U(?={HEX}{{4,8}}(?:(?![{NAME}])|[{NAME}]{follows})))"
            rf"|(?P<flag>{self.SPECIAL}[{mirrored('A-Za-z0-9')}]+{CANCEL})"
            rf"|(?P<character>{self.SPECIAL})(?P<suffixes>{suffix}*)(?P<metas>(?:{self._attached.pattern})*)",
            re.S,
        )

    #: A character that may not stand as it is: a marker's first, one beyond ASCII, one that something follows.
    SPECIAL = r"(?:[<\\]|[^\x00-\x7F]|[\x00-\x7F](?=[̀-\U0010FFFF]))"

    def write(self, text: str) -> str:
        """Markup that reads as the text, without tags that could be taken for openers."""
        return explicit(self.t, self._found.sub(self._spelling, text), self._forms)

    def write_ascii(self, text: str) -> str:
        return ascii_only(self.write(text))

    def _spelling(self, m: re.Match) -> str:
        if (known := self._memo.get(m[0])) is not None:
            return known
        out = self._spelled(m)
        if len(self._memo) < MEMO:
            self._memo[m[0]] = out
        return out

    def _spelled(self, m: re.Match) -> str:
        spelled = self.t.spelled
        if m["span"]:
            content = untagged(m[0][:-1])
            return f"<:/{content[2:]}>" if content.startswith(SIGIL_CLOSE) else f"<:{content[1:]}>"
        if m["joined"]:
            return f"<:{spelled[m[0]]}>"
        if m["marker"]:
            return m[0][0] + "<::>"
        if m["number"]:
            return "\\<:U>"
        if m["flag"]:
            c = m[0][0]
            return (f"<:{spelled[c]}>" if c in spelled else c) + m[0][1:]
        c = m["character"]
        blocks = [self.t.suffixes[s] for s in m["suffixes"]]
        metas = [untagged(a[1][:-1]) for a in self._attached.finditer(m["metas"])]
        if not (blocks or metas or c in spelled):
            return c
        # The first suffix is the innermost word, which stands last.
        return f"<:{' '.join([*metas, *blocks[1:], *blocks[:1], spelled.get(c, c)])}>"
