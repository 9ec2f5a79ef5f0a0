"""Markup to text.

`TOKEN` cuts a source into tokens and the text between them.  A reader goes through them with a
handler for each kind; a tag's content is resolved by the first of a list of readings that knows
it.  Places are noted in characters and turned to bytes only where a warning needs one.  What a tag
or an operand gives without a warning is remembered.
"""

from __future__ import annotations

import re

from ..functions.codepoints import algorithmic
from ..plans.dictionary import lower, script_of
from .compiled import JOINER, Operator, Tables
from .grammar import (
    CLUSTER,
    CODE,
    META_VALUE,
    NAME,
    OPERAND_CODE,
    PADDING,
    SIGIL_ATTACH,
    SIGIL_CLOSE,
    SIGIL_OPEN,
    TAIL,
    TOKEN,
    WORD,
    MarkupError,
    Warning_,
    scalar,
    size,
    tags,
)
from .shape import block_form, looks_open, short_form

#: Results that are remembered.
MEMO = 1 << 16
LETTER = re.compile(r"[A-Za-z]|[^\x00-\x7f]")


class Unknown(Exception):
    """A content that no reading knows. args: kind, detail."""


class Reader:
    """Reads sources with the tables of one lexicon; not for several threads at once."""

    def __init__(self, tables: Tables):
        self.t = tables
        self._known: dict = {}
        self._notes: list[str] = []
        self._readings = (self._named, self._literal, self._numbered, algorithmic, self._meta, self._operated, self._loosely_named)

    # Sources

    def read(self, source: str, mode: str = "lenient") -> tuple[str, list[Warning_]]:
        """Text and warnings. mode: lenient keeps what cannot be read, warn raises for it, error raises for the first warning too."""
        out: list[str] = []
        warned: list[tuple[int, str]] = []
        scope: Operator | None = None
        here = 0
        self._notes.clear()

        def placed() -> list[Warning_]:
            found, at, last = [], 0, 0
            for where, message in sorted(warned, key=lambda w: w[0]):
                at, last = at + size(source[last:where]), where
                found.append(Warning_(message, at))
            return found

        def noted(where: int) -> None:
            warned.extend((where, n) for n in self._notes)
            self._notes.clear()

        def failed(kind: str, detail: str, where: int, written: str) -> str:
            if mode != "lenient":
                raise MarkupError(kind, detail, size(source[:where]), tuple(placed()))
            warned.append((where, MarkupError.MESSAGES[kind].format(detail)))
            return written

        def stretch(end: int, closes: bool = False) -> None:
            text = source[here:end]
            if scope is not None:
                text = self._scoped(scope, TAIL.sub("", text) if closes else text)
                noted(here)
            out.append(text)

        if m := self.t.header.match(source):
            here = m.end()
            if (version := version_of(m)) and not self.t.version.match(version):
                warned.append((0, f"unsupported {self.t.lexicon.format.header_word} version {version}"))
        for m in TOKEN.finditer(source, here):
            kind, written, begun = m.lastgroup, m[0], m.start()
            content = written[2:-1] if kind == "tag" else written[2:]
            closes = kind == "tag" and (not content or (content[0] == "/" and content[1:] not in self.t.meta))
            if begun > here or scope is not None:
                stretch(begun, closes)
            here = m.end()
            if kind == "escaped":
                out.append(written[1:])
            elif kind == "unclosed":
                out.append(failed("Unclosed", written, begun, written))
            elif closes:
                scope = None
            elif kind == "tag" and content[0] == "/":
                out.append(tags(SIGIL_CLOSE + content[1:]))
            elif kind == "tag" and content in self.t.operators:
                scope = self.t.operators[content]
                if p := PADDING.match(source, here):
                    here = p.end()
            else:
                try:
                    out.append(self._known.get(written) or self._token(kind, content, written, source[here : here + 1]))
                    noted(begun)
                except Unknown as e:
                    noted(begun)
                    out.append(failed(*e.args, begun, written))
        if here < len(source):
            stretch(len(source))
        warnings = placed()
        if mode == "error" and warnings:
            raise MarkupError("Unsupported", warnings[0].message, warnings[0].at, tuple(warnings))
        return "".join(out), warnings

    def _token(self, kind: str, content: str, written: str, after: str) -> str:
        """The text of a short tag, a number or a tag."""
        if kind == "number":
            text = self._character(content, written)
        elif kind == "short":
            text = self._short(content, written)
        else:
            inner = content[:-1] if content.endswith("/") and len(content) > 1 else content
            text = self._resolved(inner)
            if inner is content and not self._notes and looks_open(self.t, content):
                ways = [w for w in (short_form(self.t, content, "", after), block_form(self.t, content), f"<:{content}/>") if w]
                listed = f"{', '.join(ways[:-1])} or {ways[-1]}" if len(ways) > 1 else ways[0]
                self._notes.append(f"<:{content}> looks like an opening tag: write {listed}")
        return self._remember(written, text)

    def _remember(self, key, text: str) -> str:
        if not self._notes and len(self._known) < MEMO:
            self._known[key] = text
        return text

    # Contents

    def _short(self, name: str, written: str) -> str:
        if (text := self.t.names.get(name)) is None and (text := self._number(name, written)) is None:
            try:
                text = self._resolved(name.replace("-", " "))
            except Unknown:
                raise Unknown("UnknownEntity", name) from None
        return text

    def _resolved(self, content: str) -> str:
        """What the first reading that knows a content makes of it."""
        for reading in self._readings:
            if (text := reading(content)) is not None:
                return text
        raise Unknown("UnknownEntity", content)

    def _named(self, content: str) -> str | None:
        return self.t.names.get(content.replace(" ", "-"))

    def _literal(self, content: str) -> str | None:
        return content if len(content) == 1 and content < "\x80" else None

    def _numbered(self, content: str) -> str | None:
        return self._number(content, f"<:{content}>")

    def _number(self, token: str, written: str) -> str | None:
        m = CODE.match(token)
        return self._character(m[1] or m[2], written) if m else None

    def _character(self, digits: str, written: str) -> str:
        text = scalar(digits)
        if text is None:
            self._notes.append(f"invalid code point U+{int(digits, 16):04X}")
        return written if text is None else text

    def _loosely_named(self, content: str) -> str | None:
        name, x = lower(content).replace(" ", "-"), self.t.lexicon
        found = (x.names.get(name), x.filled(name), x.endings.get(name))
        return next((text for text in found if text is not None), None)

    def _meta(self, content: str) -> str | None:
        """Meta that opens, or is attached to each character of what follows it."""
        words, i = content.split(" "), 0
        pairs: list[str] = []

        def blanks(i: int) -> int:
            while i < len(words) and not words[i]:
                i += 1
            return i

        i = blanks(0)
        while i + 1 < len(words) and words[i] in self.t.meta:
            key, i = words[i], blanks(i + 1)
            value = words[i] if i < len(words) else ""
            if not META_VALUE.match(value):
                raise Unknown("InvalidMeta", content)
            if key == "font" and value not in self.t.lexicon.fonts:
                self._notes.append(f"{value} is no font style of the entities, used as a font family")
            pairs.append(f"{key} {value}")
            i = blanks(i + 1)
        if not pairs:
            return None
        rest = " ".join(words[i:])
        if not rest:
            return "".join(tags(SIGIL_OPEN + p) for p in pairs)
        attached = "".join(tags(SIGIL_ATTACH + p) for p in pairs)
        try:
            text = self._resolved(rest)
        except Unknown:
            text = "".join(self._resolved(w) if re.fullmatch(f"[{NAME}]{{2,}}", w) else w for w in rest.split(" "))
        return CLUSTER.sub(lambda m: m[0] + attached, text) or attached

    # Operators

    def _operated(self, content: str) -> str | None:
        """Operator words, styles and effects before the last one, and operands."""
        t = self.t
        words = content.split(" ") if " " in content else content.split("-", 1)
        if len(words) < 2 or words[0] not in t.operators:
            return None
        n = 1
        while n < len(words) - 1 and words[n] in t.operators:
            last = t.operators[words[n - 1]]
            begins = last.operands(WORD.findall(" ".join(words[n:])))
            if begins and begins[0] in last.block.forms:
                break
            n += 1
        stack, rest = [t.operators[w] for w in words[:n]], WORD.findall(" ".join(words[n:]))
        group = next((o for o in stack if o.block.group), None)
        if group is not None:
            stack.remove(group)
            named = [o for o in stack if not o.block.effect]
            return self._grouped(group, named[-1] if named else None, rest)
        *outer, last = stack
        effects = [o for o in outer if o.block.effect]
        styles = [o for o in outer if not o.block.effect]
        if not styles:
            return "".join(self._operand(last, w, effects) for w in last.operands(rest))
        plain = "".join(self._operand(last, w, []) for w in last.operands(rest))
        return "".join(self._styled(styles, c) + self._controls(effects, c) for c in plain)

    def _scoped(self, scope: Operator, text: str) -> str:
        """Text in a block: each word is an operand, blanks stay."""
        if scope.block.group:
            return self._grouped(scope, None, WORD.findall(text))
        known = self._known

        def one(m: re.Match) -> str:
            key = (scope.word, m[0])
            return known[key] if key in known else self._fresh(key, scope)

        return WORD.sub(one, text)

    def _fresh(self, key: tuple[str, str], scope: Operator) -> str:
        before, self._notes = self._notes, []
        text = self._remember(key, self._operand(scope, key[1], []))
        self._notes = before + self._notes
        return text

    def _controls(self, effects: list[Operator], character: str) -> str:
        """What effects put after a character: controls, then meta for those that have none for it."""
        controls, attached = [], []
        for o in effects:
            control, meta = o.block.control(character), o.block.meta
            if control:
                controls.append(control)
            elif meta:
                self._notes.append(f"{o.word} on {character} kept as {meta[0]} meta")
                attached.append(tags(f"{SIGIL_ATTACH}{meta[0]} {meta[1]}"))
            else:
                self._notes.append(f"{o.word} does not apply to {character}")
        return "".join(controls + attached)

    def _operand(self, o: Operator, token: str, effects: list[Operator]) -> str:
        """An operand as a whole, by its number, by readings, or letter by letter."""
        forms, block = o.block.forms, o.block
        if token in forms:
            return self._whole(forms[token], effects)
        if (m := OPERAND_CODE.match(token)) and (character := scalar(m[1])):
            return self._letter(o, character, effects)
        if block.readings:
            pieces = split_readings(token, forms)
            if pieces is None:
                self._notes.append(f"no {o.word} form of {token}")
                return token
            return "".join(self._whole(forms[p], effects) for p in pieces)
        letters = self.t.names.get(token, token) if size(token) > 1 else token
        out, i = [], 0
        while i < len(letters):
            n = 2 if len(letters) > i + 1 and letters[i : i + 2] in forms else 1
            form = forms.get(letters[i : i + n])
            if form in block.finals and form is not None and i and LETTER.match(letters[i - 1]) and not LETTER.match(letters, i + n):
                out.append(block.finals[form] + self._controls(effects, letters[i]))
            elif n == 2:
                out.append(form + self._controls(effects, letters[i]))
            else:
                out.append(self._letter(o, letters[i], effects))
            i += n
        return "".join(out)

    def _whole(self, form: str, effects: list[Operator]) -> str:
        """A form with the effects' controls behind its first part."""
        if not effects:
            return form
        head, joiner, tail = form.partition(JOINER)
        return head + self._controls(effects, form[:1] or " ") + joiner + tail

    def _letter(self, o: Operator, character: str, effects: list[Operator]) -> str:
        if character in o.block.forms:
            return o.block.forms[character] + self._controls(effects, character)
        if o.block.control(character) is not None:
            return character + self._controls([o, *effects], character)
        self._notes.append(f"no {o.word} form of {character}")
        return character + self._controls(effects, character)

    def _styled(self, styles: list[Operator], character: str) -> str:
        """A character in all the styles: the form of their union with its own, or one style after the other, the nearest first."""
        own, base = self.t.layer.get(character, (None, self.t.spelled.get(character)))
        if base is not None:
            union = self.t.mask(own.word) if own else 0
            for o in styles:
                union |= self.t.mask(o.word)
            both = self.t.combined.get(union)
            if both is not None and base in both.block.forms:
                return both.block.forms[base]
        for o in reversed(styles):
            if len(character) == 1:
                put = self._put(o, character)
                if put is None:
                    self._notes.append(f"no {o.word} form of {character}")
                else:
                    character = put
        return character

    def _put(self, o: Operator, character: str) -> str | None:
        """A style put below the layers of a character, on the first of them that has a form."""
        above, x = [], character
        while x not in o.by_character:
            if x not in self.t.layer:
                return None
            layer, x = self.t.layer[x]
            if len(x) != 1:
                return None
            above.append(layer)
        form = o.by_character[x]
        if above and form == x:
            return character
        for layer in reversed(above):
            form = layer.block.forms.get(form)
        return form

    def _grouped(self, group: Operator, naming: Operator | None, words: list[str]) -> str:
        """Operands joined by a group's controls; a later group word begins a group inside."""
        if naming is not None:
            words = naming.operands(words)
        groups: list[tuple[Operator, list[str]]] = [(group, [])]
        for w in words:
            own = groups[-1][1]
            if own and w in self.t.operators and self.t.operators[w].block.group:
                groups.append((self.t.operators[w], []))
            elif naming is not None and w in naming.block.forms:
                own.append(naming.block.forms[w])
            else:
                own.append(self.t.names.get(w, w) if size(w) > 1 else w)
        text, inside, notes = "", False, []
        for o, parts in reversed(groups):
            if parts:
                script = script_of(parts[0][0]) if parts[0] else ""
                prefix, infix, begin, end = (o.block.affixes.get((k, script)) for k in ("*prefix", "*infix", "*open", "*close"))
                if prefix is None and infix is None:
                    notes.insert(0, f"no {o.word} group of {parts[0]}")
                joined = [*parts, (begin or "") + text + (end or "")] if inside else parts
                text = (prefix or "") + (infix or "").join(joined)
            inside = True
        self._notes += notes
        return text


def version_of(header: re.Match) -> str:
    """The version that a header names, empty without one."""
    found = re.search('version="([^"]*)', header[1])
    return found[1] if found else ""


def split_readings(word: str, forms: dict[str, str]) -> list[str] | None:
    """The fewest pieces with forms that make up the word, the longest first piece of those."""
    steps: list[int | None] = [None] * len(word) + [0]  # pieces from here to the end
    longest = max(map(len, forms), default=0)
    for i in reversed(range(len(word))):
        after = [steps[j] for j in range(i + 1, min(len(word), i + longest) + 1) if word[i:j] in forms and steps[j] is not None]
        steps[i] = min(after) + 1 if after else None
    if steps[0] is None:
        return None
    pieces, i = [], 0
    while i < len(word):
        j = next(j for j in range(len(word), i, -1) if steps[j] == steps[i] - 1 and word[i:j] in forms)
        pieces.append(word[i:j])
        i = j
    return pieces
