"""Meta sequences in text: the runs that they cover, and HTML.

One pattern finds the sequences; plain stretches are copied whole.  A sweep keeps the open spans in
the order in which they were opened: a close takes its span out, and every later one is cut there
and goes on as a new run, so that runs always nest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass
from typing import NamedTuple

from .compiled import Tables
from .grammar import CLUSTER, META, SIGIL_OPEN, TAG_BASE, Warning_, size, untagged


class Run(NamedTuple):
    key: str
    value: str
    start: int
    end: int
    at: int


@dataclass
class Styled:
    text: str
    runs: list[Run]


def last_cluster(text: str) -> str:
    """The last character of a text with what belongs to it."""
    back = 32
    while back < len(text) and (found := CLUSTER.findall(text[-back:])) and len(found) < 3:
        back *= 2
    found = CLUSTER.findall(text[-back:])
    return found[-1] if found else ""


def meta_runs(t: Tables, tagged: str) -> tuple[Styled, list[Warning_]]:
    """Plain text and the runs that meta sequences cover, in bytes of it."""
    plain: list[str] = []
    runs: list[Run] = []
    warnings: list[Warning_] = []
    live: list[int] = []  # open spans by their number
    by_key: dict[str, list[int]] = defaultdict(list)
    spans: dict[int, tuple[str, str, int, int]] = {}  # key, value, start, place
    here = at = read = 0

    def cut(number: int) -> None:
        key, value, start, place = spans[number]
        if start < here:
            runs.append(Run(key, value, start, here, place))

    for number, m in enumerate(META.finditer(tagged)):
        stretch = tagged[read : m.start()]
        plain.append(stretch)
        here, at, read = here + size(stretch), at + size(stretch), m.end()
        if m[4]:
            key = untagged(m[4])
            if not by_key[key]:
                warnings.append(Warning_(f"</{key} closes no open {key}", at))
            else:
                closed = by_key[key].pop()
                place = bisect_left(live, closed)
                cut(live.pop(place))
                for later in live[place:]:
                    cut(later)
                    spans[later] = (*spans[later][:2], here, at)
        else:
            key, value = untagged(m[2]), untagged(m[3])
            if m[1] == chr(TAG_BASE + ord(SIGIL_OPEN)):
                spans[number] = (key, value, here, at)
                live.append(number)
                by_key[key].append(number)
            elif here:
                length = size(last_cluster(stretch if len(stretch) > 64 else "".join(plain[-64:])))
                runs.append(Run(key, value, here - length, here, at))
        at += size(m[0])
    plain.append(tagged[read:])
    here += size(plain[-1])
    for number in live:
        cut(number)
    runs.sort(key=lambda r: (r.start, -r.end, r.at))
    warnings += [Warning_(f"unknown meta key {r.key}", r.at) for r in runs if r.key not in t.meta]
    return Styled("".join(plain), runs), sorted(warnings, key=lambda w: w.at)


ENTITIES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})


def escaped(text: str) -> str:
    return text.translate(ENTITIES) if any(c in text for c in '&<>"') else text


def html(t: Tables, styled: Styled) -> str:
    """Runs as nested span elements: the tags that stand at each place, between the pieces of the text."""
    raw = styled.text.encode("utf-8", "surrogatepass")
    ends, begins, around = Counter(), defaultdict(list), []
    for r in styled.runs:
        while around and around[-1][0] <= r.start:
            ends[around.pop()[0]] += 1
        for outer in reversed(around):  # what is around a run ends with it at the earliest
            if outer[0] >= r.end:
                break
            outer[0] = r.end
        around.append([r.end])
        begins[r.start].append(span(t, r))
    for outer in around:
        ends[outer[0]] += 1
    out, here = [], 0
    for place in sorted({*ends, *begins}):
        out += [escaped(raw[here:place].decode("utf-8", "surrogatepass")), "</span>" * ends[place], *begins[place]]
        here = place
    return "".join(out) + escaped(raw[here:].decode("utf-8", "surrogatepass"))


def listed(text: str) -> list[str]:
    return [x for x in map(str.strip, text.split(",")) if x]


def quoted(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


def span(t: Tables, run: Run) -> str:
    """The opening tag of a run: fonts by their families and language, other keys by their template, unknown ones as data."""
    font, template = t.lexicon.fonts.get(run.value), t.meta.get(run.key)
    known: dict[str, str] = {}
    if run.key == "font" and font is not None:
        known["lang"] = font.get("lang", "")
        features = listed(font.get("features", ""))
        known["style"] = f"font-family: {quoted(listed(font.get('families', '')))}" + (f"; font-feature-settings: {quoted(features)}" if features else "")
    elif run.key == "lang":
        known["lang"] = run.value
    elif template is None:
        known[f"data-{run.key}"] = run.value
    else:
        known["style"] = template.replace("{}", quoted([run.value]) if run.key == "font" else run.value)
    return "<span" + "".join(f' {k}="{escaped(v)}"' for k, v in known.items()) + ">"
