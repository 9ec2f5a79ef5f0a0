"""Dictionary sections derived by rule from public character data in the standard library."""

from __future__ import annotations

import html.entities
import re
import unicodedata
from functools import cache

# Greek by Latin letters, Greek letter names.
GREEK = dict(zip("abgdeziklmnxoprstufABGDEZIKLMNXOPRSTUF", "αβγδεζικλμνξοπρστυφΑΒΓΔΕΖΙΚΛΜΝΞΟΠΡΣΤΥΦ")) | {"th": "θ", "Th": "Θ", "TH": "Θ", "ch": "χ", "Ch": "Χ", "CH": "Χ", "ps": "ψ", "Ps": "Ψ", "PS": "Ψ", "c": "ς", "final-sigma": "ς", "*final σ": "ς"}
GREEK_NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
# Controls that follow a character, by effect and script.
NOT_SIGNS = {"*suffix egyptian": "", "*suffix cjk": ""}
EFFECTS = {
    "mirror": {"*suffix": "\U000E004D", "*suffix egyptian": "\U00013440"},
    "flip": {"*suffix": "\U000E0046", **NOT_SIGNS},
    "turn": {"*suffix": "\U000E0054", **NOT_SIGNS},
    "left": {"*suffix": "\U000E004C", **NOT_SIGNS},
    "right": {"*suffix": "\U000E0052", **NOT_SIGNS},
    "iconic": {"*suffix": "\uFE0F"},
    "plain": {"*suffix": "\uFE0E"},
    "light-skinned": {"*suffix": "\U0001F3FB"},
    "medium-light-skinned": {"*suffix": "\U0001F3FC"},
    "medium-skinned": {"*suffix": "\U0001F3FD"},
    "medium-dark-skinned": {"*suffix": "\U0001F3FE"},
    "dark-skinned": {"*suffix": "\U0001F3FF"},
}
# TAG letters of the colours.
COLOURS = {"red": "r", "green": "g", "blue": "b", "brown": "n", "pink": "p", "purple": "v", "orange": "o", "yellow": "y", "black": "k", "white": "w", "gray": "a"}
# Prefixes and infixes of groups.
GROUPS = {
    "above": {"*group": "", "*prefix cjk": "⿱", "*infix egyptian": "\U00013430", "*open egyptian": "\U00013437", "*close egyptian": "\U00013438"},
    "beside": {"*group": "", "*prefix cjk": "⿰", "*infix egyptian": "\U00013431", "*open egyptian": "\U00013437", "*close egyptian": "\U00013438"},
}
# People, and the hair that joins them.
HAIR = {"red-haired": "🦰", "curly-haired": "🦱", "white-haired": "🦳", "bald": "🦲"}
PEOPLE = {"woman": "👩", "man": "👨", "adult": "🧑", "person": "🧑"}
BLOND = {"person": "👱", "woman": "👱\u200d♀\ufe0f", "man": "👱\u200d♂\ufe0f"}
# Other names of blocks.
ALIASES = {
    "fraktur": "fracture", "double-struck": "double", "superscript": "upper", "subscript": "lower", "reverseInPlace": "reversed", "reverse": "mirror", "mirrored": "mirror", "flipped": "flip", "grey": "gray", "blonde-haired": "blond-haired",
    "light-skin": "light-skinned", "medium-light-skin": "medium-light-skinned", "medium-skin": "medium-skinned", "medium-dark-skin": "medium-dark-skinned", "dark-skin": "dark-skinned", "fair-skinned": "light-skinned", "pale-skinned": "light-skinned",
    "light-brown-skinned": "medium-light-skinned", "olive-skinned": "medium-skinned", "tan-skinned": "medium-skinned", "brown-skinned": "medium-dark-skinned", "dark-brown-skinned": "dark-skinned", "emoji": "iconic", "text": "plain",
    "gr": "greek", "hieroglyph": "egyptian anatolian", "eg": "egyptian", "gardiner": "egyptian",
}
# Own names, which win over all others.
OWN = {
    "less": "<", "colon": ":", "greater": ">", "empty": "∅", "i": "ⅈ", "norm": "‖", "mars": "♂", "venus": "♀", "world": "🌍", "idea": "💡", "attention": "⚠️", "alarm": "🚨", "flash": "⚡️",
    "red-hair": "\u200d🦰", "curly-hair": "\u200d🦱", "white-hair": "\u200d🦳", "light-skin-tone": "\U0001F3FB", "medium-light-skin-tone": "\U0001F3FC", "medium-skin-tone": "\U0001F3FD", "medium-dark-skin-tone": "\U0001F3FE", "dark-skin-tone": "\U0001F3FF",
}
DESCRIPTIONS = {"tilde-tilde": "≈", "double-tilde": "≈", "arrow-above-tilde": "⥴", "greek-capital-reversed-dotted-lunate-sigma-symbol": "Ͽ"}
# Font styles and meta keys with their CSS.
FONTS = {
    "cuneiform-ur3": {"lang": "sux-Xsux-x-ur3", "families": "CuneiformComposite, Noto Sans Cuneiform"},
    "cuneiform-old-babylonian": {"lang": "akk-Xsux-x-oldbab", "families": "Santakku, CuneiformOB, Noto Sans Cuneiform"},
    "cuneiform-old-babylonian-monumental": {"lang": "akk-Xsux-x-oldbabm", "families": "SantakkuM, Santakku, Noto Sans Cuneiform"},
    "cuneiform-neo-assyrian": {"lang": "akk-Xsux-x-neoassyr", "families": "Assurbanipal, CuneiformNAOutline, Assyrian, Noto Sans Cuneiform"},
    "cuneiform-hittite": {"lang": "hit-Xsux", "families": "UllikummiA, UllikummiB, UllikummiC, Noto Sans Cuneiform"},
    "cuneiform-archaic": {"lang": "sux-Xsux-x-archaic", "families": "Akkadian, Noto Sans Cuneiform"},
    "han-japanese": {"lang": "ja", "families": "Noto Sans CJK JP, Hiragino Sans"},
    "han-simplified": {"lang": "zh-Hans", "families": "Noto Sans CJK SC, PingFang SC"},
    "han-traditional": {"lang": "zh-Hant", "families": "Noto Sans CJK TC, PingFang TC"},
    "han-hong-kong": {"lang": "zh-HK", "families": "Noto Sans CJK HK, PingFang HK"},
    "han-korean": {"lang": "ko", "families": "Noto Sans CJK KR, Apple SD Gothic Neo"},
    "han-jis78": {"lang": "ja", "families": "Noto Sans CJK JP, Hiragino Sans", "features": "jp78"},
}
META = {
    "font": "font-family: {}", "lang": "", "color": "color: {}", "background": "background-color: {}", "angle": "display: inline-block; transform: rotate({}deg)",
    "size": "font-size: {}", "weight": "font-weight: {}", "style": "font-style: {}", "features": "font-feature-settings: '{}'",
}
# Words of a mathematical letter's Unicode name, and the style word of each.
STYLE_WORDS = {"BOLD": "bold", "ITALIC": "italic", "SCRIPT": "script", "FRAKTUR": "fracture", "BLACK-LETTER": "fracture", "DOUBLE-STRUCK": "double", "SANS-SERIF": "sans", "MONOSPACE": "monospace"}
STYLE_ORDER = ("sans", "bold", "italic", "script", "fracture", "double", "monospace")
# Blocks of other compatibility decompositions.
DECOMPOSED = {"<super>": "upper", "<sub>": "lower", "<circle>": "circled", "<wide>": "fullwidth", "<square>": "squared"}


def _each():
    for cp in range(0x110000):
        if not 0xD800 <= cp <= 0xDFFF and (name := unicodedata.name(chr(cp), "")):
            yield chr(cp), name


@cache
def names() -> dict[str, str]:
    """Unicode names in lower case with hyphens; names that follow from the code point are left to the algorithm."""
    out = {}
    for c, name in _each():
        if not re.match(r"CJK (UNIFIED|COMPATIBILITY) IDEOGRAPH-|HANGUL SYLLABLE |TANGUT IDEOGRAPH-|TANGUT COMPONENT-|KHITAN SMALL|NUSHU CHARACTER-", name):
            out.setdefault(name.lower().replace(" ", "-"), c)
    return out


@cache
def html_names() -> dict[str, str]:
    return {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}


def style_of(name: str) -> str | None:
    """The style block that a mathematical letter's name tells: MATHEMATICAL BOLD ITALIC SMALL A is bold-italic."""
    words = name.split(" ")
    if words[0] not in ("MATHEMATICAL", "BLACK-LETTER", "DOUBLE-STRUCK", "SCRIPT"):
        return None
    styles = {STYLE_WORDS[w] for w in words if w in STYLE_WORDS}
    return "-".join(s for s in STYLE_ORDER if s in styles) or None


@cache
def blocks() -> dict[str, dict[str, str]]:
    """Style blocks from decompositions, effects, colours with the things named by them, groups, people, Greek."""
    out: dict[str, dict[str, str]] = {}
    for c, name in _each():
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if kind.startswith("<"):
            base = "".join(chr(int(x, 16)) for x in rest.split())
            block = style_of(name) if kind == "<font>" else DECOMPOSED.get(kind)
            if block and not re.search(r"(ISOLATED|INITIAL|MEDIAL|FINAL) FORM|HALFWIDTH|ARABIC|HEBREW|ORDINAL INDICATOR", name):
                forms, letter = out.setdefault(block, {}), unicodedata.normalize("NFKC", base)
                if letter not in forms or name.startswith("MATHEMATICAL "):  # letterlike symbols fill the holes of the mathematical ones
                    forms[letter] = c
        if m := re.match(r"LATIN (?:SMALL|CAPITAL) LETTER (TURNED|REVERSED) (.)$", name):
            out.setdefault(m[1].lower(), {}).setdefault(m[2].lower() if "SMALL" in name else m[2], c)
        if m := re.match(r"EGYPTIAN HIEROGLYPH ([A-Z]+)0*(\d+)([A-Z]?)$", name):
            out.setdefault("egyptian", {}).setdefault(("Aa" if m[1] == "AA" else m[1]) + m[2] + m[3].lower(), c)
        if m := re.match(r"ANATOLIAN HIEROGLYPH A0*(\d+)([A-Z]?)$", name):
            out.setdefault("anatolian", {}).setdefault(m[1] + m[2].lower(), c)
        if m := re.match(r"(?:LARGE |HEAVY )?(RED|GREEN|BLUE|BROWN|PINK|PURPLE|ORANGE|YELLOW|BLACK|WHITE) ([A-Z -]+)$", name):
            out.setdefault(m[1].lower(), {}).setdefault(m[2].lower().replace(" ", "-"), c)
    for colour, letter in COLOURS.items():
        out.setdefault(colour, {}).update({"*suffix": chr(0xE0000 + ord(letter)), "*meta": f"color {colour}", **NOT_SIGNS})
    out["italic"]["h"] = "\u210e"  # named after Planck
    out.setdefault("fullwidth", {}).update({chr(c): chr(c + 0xFEE0) for c in range(0x21, 0x7F)})
    out["greek"] = GREEK | {n: unicodedata.lookup(f"GREEK SMALL LETTER {n.upper()}") for n in GREEK_NAMES.split()} | {n.capitalize(): unicodedata.lookup(f"GREEK CAPITAL LETTER {n.upper()}") for n in GREEK_NAMES.split()} | {"lambda": "λ", "Lambda": "Λ"}
    out |= EFFECTS | GROUPS
    for word, hair in HAIR.items():
        out[word] = {who: f"{base}\u200d{hair}" for who, base in PEOPLE.items()}
    out["blond-haired"] = dict(BLOND)
    out["ligature"] = {"ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "ij": "ĳ", "IJ": "Ĳ", "dz": "ǳ", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ", "st": "ﬆ"}
    return out


def sections() -> dict[str, dict]:
    """All sections: own, names, html, descriptions, blocks, block-aliases, fonts, meta."""
    return {"own": dict(OWN), "names": names(), "latex": {}, "html": html_names(), "descriptions": dict(DESCRIPTIONS), "blocks": blocks(), "block-aliases": dict(ALIASES), "fonts": FONTS, "meta": dict(META)}
