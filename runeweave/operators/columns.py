"""The converter as functions of columns, in Arrow batches, and as SQL functions.

The dictionary travels once to each Python worker as a broadcast.  Functions are lenient: a text
that cannot be read keeps its source and tells why in `warnings`; null stays null.

Only texts that need the grammar go to Python: for the others (no marker to read, nothing beyond
ASCII to write, no TAG character) the function gets null, and the text itself is the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..functions.text import html_escape
from ..plans.dictionary import Lexicon, default, load
from ..plans.format import CANCEL
from .converter import Converter, MarkupError

WARNING = "array<struct<message:string,at:int>>"
CONVERTED = f"text string, warnings {WARNING}, error struct<kind:string,detail:string,at:int>"
RUNS = f"text string, runs array<struct<key:string,value:string,start:int,end:int,at:int>>, warnings {WARNING}"
#: What a text that is not its own markup has: a marker's first character, or one beyond ASCII.
UNUSUAL = r"[<\\]|[^\x00-\x7F]"


def marked(markup: Column) -> Column:
    """Whether markup holds what the grammar reads."""
    return markup.contains("<:") | markup.contains("\\")



class Engine:
    """Column functions over one dictionary: a lexicon, or the path of a stored one, or the default."""

    def __init__(self, spark: SparkSession, lexicon: Lexicon | str | None = None):
        self.spark, self.lexicon = spark, load(spark, lexicon) if isinstance(lexicon, str) else lexicon or default()
        sent = spark.sparkContext.broadcast(self.lexicon)
        made: list[Converter] = []

        def converter() -> Converter:
            if not made:
                made.append(Converter(sent.value))
            return made[0]

        def mapped(f: Callable[[Converter, str], object], kind: str):
            """A text function, over the distinct texts of a batch."""

            def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                c = converter()
                for texts in batches:
                    known = {None: None}
                    for t in texts:
                        if t not in known:
                            known[t] = f(c, t)
                    yield pd.Series([known[t] for t in texts], dtype=object)

            return pandas_udf(run, kind)

        def structs(f: Callable[[Converter, str], dict], kind: str, names: list[str]):
            def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
                c = converter()
                for texts in batches:
                    rows = [f(c, t) if t is not None else dict.fromkeys(names) for t in texts]
                    yield pd.DataFrame(rows, columns=names, dtype=object)

            return pandas_udf(run, kind)

        def converted(mode: str):
            def one(c: Converter, text: str) -> dict:
                try:
                    out, warnings = c.convert(text, mode)
                    return {"text": out, "warnings": [w._asdict() for w in warnings], "error": None}
                except MarkupError as e:
                    return {"text": None, "warnings": [w._asdict() for w in e.warnings], "error": {"kind": e.kind, "detail": e.detail, "at": e.at}}

            return structs(one, CONVERTED, ["text", "warnings", "error"])

        def runs(c: Converter, text: str) -> dict:
            styled, warnings = c.meta_runs(text)
            return {"text": styled.text, "runs": [r._asdict() for r in styled.runs], "warnings": [w._asdict() for w in warnings]}

        self._converted = {mode: converted(mode) for mode in ("lenient", "warn", "error")}
        self._markup = mapped(lambda c, t: c.to_markup(t), "string")
        self._ascii = mapped(lambda c, t: c.to_ascii_markup(t), "string")
        self._explicit = mapped(lambda c, t: c.explicit(t), "string")
        self._html = mapped(lambda c, t: c.html(c.meta_runs(t)[0]), "string")
        self._text = mapped(lambda c, t: c.convert(t)[0], "string")
        self._runs = structs(runs, RUNS, ["text", "runs", "warnings"])

    def _where(self, needs: Column, text: Column, f, otherwise: Column) -> Column:
        """f of the texts that need it, `otherwise` for the rest."""
        return F.when(needs, f(F.when(needs, text))).otherwise(otherwise)

    def convert(self, markup: Column, mode: str = "lenient") -> Column:
        """struct(text, warnings, error) of markup."""
        plain = F.struct(markup.alias("text"), F.array().cast(WARNING).alias("warnings"), F.lit(None).cast("struct<kind:string,detail:string,at:int>").alias("error"))
        plain = F.when(markup.isNotNull(), plain).otherwise(F.struct(markup.alias("text"), F.lit(None).cast(WARNING).alias("warnings"), F.lit(None).cast("struct<kind:string,detail:string,at:int>").alias("error")))
        return self._where(marked(markup), markup, self._converted[mode], plain)

    def to_unicode(self, markup: Column) -> Column:
        """The text of markup."""
        return self._where(marked(markup), markup, self._text, markup)

    def to_markup(self, text: Column) -> Column:
        """Markup of text: to_unicode gives the text back."""
        return self._where(text.rlike(UNUSUAL), text, self._markup, text)

    def to_ascii_markup(self, text: Column) -> Column:
        """Markup of text in ASCII only."""
        return self._where(text.rlike(UNUSUAL), text, self._ascii, text)

    def explicit(self, markup: Column) -> Column:
        """Markup whose inline tags cannot be taken for openers."""
        return self._where(markup.contains("<:"), markup, self._explicit, markup)

    def meta_runs(self, tagged: Column) -> Column:
        """struct(text, runs, warnings) of text with meta sequences."""
        none = lambda kind: F.when(tagged.isNotNull(), F.array().cast(kind))
        plain = F.struct(tagged.alias("text"), none(RUNS.split(", ")[1].split(" ", 1)[1]).alias("runs"), none(WARNING).alias("warnings"))
        return self._where(tagged.contains(CANCEL), tagged, self._runs, plain)

    def to_html(self, tagged: Column) -> Column:
        """HTML of text with meta sequences."""
        return self._where(tagged.contains(CANCEL), tagged, self._html, html_escape(tagged))

    def header(self, markup: Column) -> Column:
        """struct(version, length in bytes) of a header at the start, null without one."""
        pattern = rf"^<:{self.lexicon.format.header_word}(?=[ >])[^>]*>(?:\r\n|\n)?"
        whole = F.regexp_extract(markup, pattern, 0)
        version = F.regexp_extract(F.regexp_extract(whole, "^[^>]*>", 0), r'version="([^">]*)', 1)
        return F.when(whole != "", F.struct(version.alias("version"), F.octet_length(whole).alias("length")))

    def warnings(self, df: DataFrame, markup: str, *keep: str) -> DataFrame:
        """A row for each warning of a column's texts: the kept columns, message, at."""
        # An inner explode would have the optimizer test the array, and so convert each text, twice.
        return df.select(*keep, F.explode_outer(self.convert(F.col(markup))["warnings"]).alias("w")).where("w is not null").select(*keep, "w.message", "w.at")

    def runs(self, df: DataFrame, tagged: str, *keep: str) -> DataFrame:
        """A row for each run of a column's texts: the kept columns, text, key, value, start, end, at."""
        x = df.select(*keep, self.meta_runs(F.col(tagged)).alias("m")).select(*keep, "m.text", F.explode_outer("m.runs").alias("r"))
        return x.where("r is not null").select(*keep, "text", "r.key", "r.value", "r.start", "r.end", "r.at")

    def register(self) -> None:
        """SQL functions to_unicode, to_markup, to_ascii_markup, explicit_markup, markup_html, convert_markup, meta_runs."""
        for name, f in {"to_unicode": self._text, "to_markup": self._markup, "to_ascii_markup": self._ascii, "explicit_markup": self._explicit, "markup_html": self._html, "convert_markup": self._converted["lenient"], "meta_runs": self._runs}.items():
            self.spark.udf.register(name, f)
