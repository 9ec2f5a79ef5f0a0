"""Readable dictionary sources: nested `name { key: value }` files, parsed whole, as a long DataFrame.

Keys and values may be quoted; in quotes a backslash keeps the next character, and \\u{hex} is a
code point.  Lines that begin with // or #, and lines from /* to */, are comments, as is what
follows a value in such a form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^\s:"]+))\s*:\s*(?:"((?:[^"\\]|\\.)*)"|(\S+))\s*(.*)$')
OPEN = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^\s{"]+))\s*\{\s*(.*)$')
COMMENT = re.compile(r"\s*(?://|#)")
ESCAPE = re.compile(r"\\(?:u\{?([0-9A-Fa-f]+)\}|(.))")
SCHEMA = "path string, line int, section string, table string, key string, value string"


class EntityError(ValueError):
    """A line that is neither entry, table, end nor comment."""


def unescaped(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else m[2], text)


def parse(source: str) -> Iterator[tuple[int, tuple[str, ...], str, str]]:
    """(line, names of the enclosing tables, key, value) of each entry; an empty table gives an entry with key ''. """
    stack: list[str] = []
    inside = False
    for number, line in enumerate(source.split("\n"), 1):
        bare = line.strip()
        if inside or bare.startswith("/*"):
            inside = not bare.endswith("*/")
            continue
        if not bare or COMMENT.match(bare):
            continue
        if bare == "}":
            if not stack:
                raise EntityError(f"line {number}: nothing to close")
            stack.pop()
        elif (m := OPEN.match(line)) and (not m[3] or COMMENT.match(m[3])):
            stack.append(unescaped(m[1]) if m[1] is not None else m[2])
            yield number, tuple(stack), "", ""
        elif (m := ENTRY.match(line)) and (not m[5] or COMMENT.match(m[5])):
            yield number, tuple(stack), unescaped(m[1]) if m[1] is not None else m[2], unescaped(m[3]) if m[3] is not None else m[4]
        else:
            raise EntityError(f"line {number}: {bare}")
    if stack:
        raise EntityError(f"{stack[-1]} is not closed")


def scan(spark: SparkSession, path: str, pattern: str = "*.wasp") -> DataFrame:
    """(path, line, section, table, key, value) of all entity files below path; entries outside sections are in section `own`."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, line, at[0] if at else "own", at[1] if len(at) > 1 else None, key, value) for p, text in zip(batch["path"], batch["value"]) for line, at, key, value in parse(text)]
            yield pd.DataFrame(rows, columns=["path", "line", "section", "table", "key", "value"])

    return files.mapInPandas(run, SCHEMA)


def sections(entries: DataFrame) -> dict[str, dict]:
    """The merged sections of a scan, first entry of a key first, in the order of paths and lines.  A dictionary is a small dimension, so it is gathered."""
    out: dict[str, dict] = {}
    for r in entries.orderBy("path", "line").collect():
        section = out.setdefault(r["section"], {})
        if r["table"] is not None:
            section = section.setdefault(r["table"], {})
        if r["key"]:
            section.setdefault(r["key"], r["value"])
    return out
