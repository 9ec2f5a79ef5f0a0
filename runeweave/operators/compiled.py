"""What reading and writing look up, compiled once from a lexicon."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from ..plans.dictionary import Block, Lexicon
from ..plans.format import OPERAND_WORDS

JOINER = "\u200d"


@dataclass(eq=False)
class Operator:
    """A block with what its operands need: forms also by character, and how many words an operand that begins with a word may have."""

    word: str
    block: Block
    by_character: dict[str, str] = field(default_factory=dict)
    reach: dict[str, int] = field(default_factory=dict)

    def operands(self, words: list[str]) -> list[str]:
        """Words in operands: from each place the longest run that is one."""
        out, i, forms = [], 0, self.block.forms
        while i < len(words):
            n = min(self.reach.get(words[i], 1), len(words) - i)
            while n > 1 and "-".join(words[i : i + n]) not in forms:
                n -= 1
            out.append("-".join(words[i : i + n]))
            i += n
        return out


class Tables:
    """Lookup tables of a lexicon.

    Style words are bits: the parts of block names are numbered, a block is the set of its parts'
    bits, and a combination of styles is looked up by the union.  `layer` says what a styled
    character is made of: the operator that was put on it and the character below.
    """

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.names, self.spelled, self.suffixes, self.meta = lexicon.names, lexicon.spelled, lexicon.suffixes, lexicon.meta
        self.operators = {word: self._operator(word, block) for word, block in lexicon.blocks.items()}
        self.header = re.compile(rf"<:{lexicon.format.header_word}(?=[ >])([^>]*)>(?:\r\n|\n)?")
        self.version = re.compile(re.escape(lexicon.format.version_prefix) + r"[0-9]+\Z")

    def _operator(self, word: str, block: Block) -> Operator:
        out = Operator(word, block, dict(block.forms))
        for operand, form in block.forms.items():
            text = self.names.get(operand, "")
            if len(text) == 1 and self.spelled.get(text) == operand:
                out.by_character.setdefault(text, form)
            count = operand.count("-") + 1
            if 1 < count <= OPERAND_WORDS:
                first = operand.split("-", 1)[0]
                out.reach[first] = max(out.reach.get(first, 1), count)
        return out

    @cached_property
    def bits(self) -> dict[str, int]:
        parts = sorted({p for word in self.operators for p in word.split("-") if p})
        return {p: 1 << i for i, p in enumerate(parts)}

    def mask(self, word: str) -> int:
        out = 0
        for p in word.split("-"):
            out |= self.bits.get(p, 0)
        return out

    @cached_property
    def combined(self) -> dict[int, Operator]:
        """The operator of each set of parts; of several words for a set, the first in order."""
        out: dict[int, Operator] = {}
        for word in sorted(self.operators, key=lambda w: w.split("-"), reverse=True):
            if len(set(word.split("-"))) == word.count("-") + 1:
                out[self.mask(word)] = self.operators[word]
        return out

    @cached_property
    def layer(self) -> dict[str, tuple[Operator, str]]:
        """Styled character → the operator on it and what it is put on."""
        out = {}
        for text, content in self.spelled.items():
            word, found, operand = content.partition(" ")
            if found and word in self.operators:
                out[text] = self.operators[word], self.names.get(operand, operand) if len(operand) > 1 else operand
        return out
