"""Fixed values of the markup format.

The header's word and the address of its versions belong to the texts at hand and are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Format:
    """header_word: the word after <: in a header; version_prefix: what precedes the number in the versions that are read."""

    header_word: str = "markup"
    version_prefix: str = "https://example.org/v"


# Section precedence, words that a Unicode name may drop, padding of block tags.
SECTIONS = ("own", "names", "latex", "html", "descriptions")
FILLERS = ("disc-sign", "vowel-sign", "numeric-sign", "letter", "sign", "syllable", "symbol", "digit", "hieroglyph", "ideogram", "logogram", "character")
#: Bytes of the shortest ending that names an entity; words of the longest operand.
LEAST_ENDING = 3
OPERAND_WORDS = 8
#: TAG characters: the plane that mirrors ASCII, and the one that ends a sequence.
TAG_BASE = 0xE0000
CANCEL = "\U000E007F"

# Scripts with controls of their own, as ranges of code points.
SCRIPTS = (("egyptian", 0x13000, 0x13FFF), ("cjk", 0x2E80, 0x2FFF), ("cjk", 0x3000, 0x9FFF), ("cjk", 0x20000, 0x33FFF))

# Characters that belong to the one before them.
EXTENDING = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x200D, 0x200D), (0x20D0, 0x20FF), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F), (0x13430, 0x1345F), (0x1F3FB, 0x1F3FF), (0xE0000, 0xE007F), (0xE0100, 0xE01EF))
#: Characters that draw the next one to themselves.
DRAWING = ((0x200D, 0x200D), (0x13430, 0x13436))

# Names derived from code points (Unicode 16.0 rules NR1 and NR2).
HEX_NAMED = {
    "CJK UNIFIED IDEOGRAPH": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x2EBF0, 0x2EE5F), (0x30000, 0x3134F), (0x31350, 0x323AF)),
    "CJK COMPATIBILITY IDEOGRAPH": ((0xF900, 0xFAFF), (0x2F800, 0x2FA1F)),
    "TANGUT IDEOGRAPH": ((0x17000, 0x187FF), (0x18D00, 0x18D7F)),
    "KHITAN SMALL SCRIPT CHARACTER": ((0x18B00, 0x18CFF),),
    "NUSHU CHARACTER": ((0x1B170, 0x1B2FF),),
    "EGYPTIAN HIEROGLYPH": ((0x13460, 0x143FF),),
}
TANGUT_COMPONENTS = (0x18800, 0x18AFF)
LEADING = ("G", "GG", "N", "D", "DD", "R", "M", "B", "BB", "S", "SS", "", "J", "JJ", "C", "K", "T", "P", "H")
VOWELS = ("A", "AE", "YA", "YAE", "EO", "E", "YEO", "YE", "O", "WA", "WAE", "OE", "YO", "U", "WEO", "WE", "WI", "YU", "EU", "YI", "I")
TRAILING = ("", "G", "GG", "GS", "N", "NJ", "NH", "D", "L", "LG", "LM", "LB", "LS", "LT", "LP", "LH", "M", "B", "BS", "S", "SS", "NG", "J", "C", "K", "T", "P", "H")
