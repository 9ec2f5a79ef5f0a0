"""Dictionary ETL: entries of sections to the tables of a dictionary, as ranked unions, joins and windows.

An entry is (section, table, key, value, n): n is its place in reading order, table the block or
font it is in.  Wherever several entries claim a key or a text, each claim is a row with its rank
and the least rank wins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import filled_names, hash31
from .format import FILLERS, SECTIONS

ENTRIES = "section string, table string, key string, value string, n long"
#: Schemas of the tables, which a stored dictionary must have.
TABLES = {
    "names": "name string, text string, n long",
    "blocks": "block string, n long",
    "block_entries": "block string, key string, text string, n long",
    "chars": "text string, form string",
    "suffixes": "control string, block string",
    "fonts": "name string, key string, value string, n long",
    "meta": "key string, template string, n long",
    "fillers": "filler string, n long",
}
#: Keys by which a table is sorted when stored.
SORTED_BY = {"names": ("name",), "blocks": ("block",), "block_entries": ("block", "key"), "chars": ("text",), "suffixes": ("control",), "fonts": ("name", "key"), "meta": ("key",), "fillers": ("filler",)}
#: Fixed pattern: a cased letter's name.
CASED = "^(.+?)-(capital|small)-letter-(.+)$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def entries_of(spark: SparkSession, sections: dict[str, dict]) -> DataFrame:
    """Sections as entries; a table without entries has one with an empty key."""
    rows = []
    for section, items in sections.items():
        for key, value in items.items():
            if isinstance(value, dict):
                rows += [(section, key, "", "")] + [(section, key, k, v) for k, v in value.items()]
            else:
                rows.append((section, None, key, value))
    columns = [pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 4
    return spark.createDataFrame(pa.table([*columns, pa.array(range(len(rows)), pa.int64())], names=["section", "table", "key", "value", "n"]))


def small_session(spark: SparkSession) -> SparkSession:
    """A session for a dictionary, which is a few hundred thousand rows at most: one partition a shuffle."""
    out = spark.newSession()
    for key, value in (("shuffle.partitions", "1"), ("adaptive.enabled", "false"), ("execution.arrow.localRelationThreshold", "0")):
        out.conf.set(f"spark.sql.{key}", value)
    return out


def layered(*layers: DataFrame) -> DataFrame:
    """Entries of several sources, the first source's before the next one's."""
    out = None
    for i, layer in enumerate(layers):
        x = layer.withColumn("n", F.col("n") + F.lit(i << 40))
        out = x if out is None else out.unionByName(x)
    return out


def least(claims: DataFrame, key: list[str], order: list, values: list[str]) -> DataFrame:
    """The values of each key's first claim, with `first`: its place."""
    best = claims.groupBy(*key).agg(F.min(F.struct(F.struct(*order).alias("first"), *values)).alias("m"))
    return best.select(*key, "m.first", *[f"m.{v}" for v in values])


def short_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """(name, short) of cased letters: the letter where no other script has it or where it is Latin, else script and letter; words taken give none. names: (name), taken: (word)."""
    part = lambda i: F.regexp_extract("name", CASED, i)
    x = names.select("name", part(1).alias("script"), part(2).alias("case"), part(3).alias("letter")).where("script <> ''")
    x = x.withColumn("letter", F.when(F.col("case") == "capital", F.concat(F.upper(F.substring("letter", 1, 1)), F.expr("substring(letter, 2)"))).otherwise(F.col("letter")))
    x = x.withColumn("scripted", F.concat_ws("-", "script", "letter"))
    same = Window.partitionBy("letter")
    latin = F.col("script") == "latin"
    x = x.withColumn("holders", F.count("*").over(same)).withColumn("latins", F.count_if(latin).over(same)).withColumn("twice", F.count("*").over(Window.partitionBy("scripted")))
    known = taken.distinct()
    x = x.join(known.select(F.col("word").alias("letter"), F.lit(True).alias("letter_taken")), "letter", "left").join(known.select(F.col("word").alias("scripted"), F.lit(True).alias("scripted_taken")), "scripted", "left")
    bare = (F.length("letter") > 1) & F.col("letter_taken").isNull() & ((F.col("holders") == 1) | (latin & (F.col("latins") == 1)))
    full = ~latin & (F.col("twice") == 1) & F.col("scripted_taken").isNull()
    return x.select("name", F.when(bare, F.col("letter")).when(full, F.col("scripted")).alias("short")).where("short is not null")


def blocks_of(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, block entries): own blocks, aliases of one or several, and names in which an alias stands for a part."""
    raw = entries.where("section = 'blocks' and table is not null")
    own = raw.groupBy(F.col("table").alias("block")).agg(F.min("n").alias("n"))
    alias = entries.where("section = 'block-aliases' and table is null").select(F.col("key").alias("block"), "value", "n").join(own.select("block"), "block", "left_anti")
    parts = own.select(F.col("block").alias("source"), F.col("n").alias("bn"), F.split("block", "-").alias("p")).where(F.size("p") > 1).select("source", "bn", "p", F.posexplode("p").alias("i", "part"))
    derived = parts.join(alias.select(F.col("block").alias("alias"), F.col("value").alias("part"), F.col("n").alias("an")), "part")
    named = F.transform("p", lambda w, i: F.when(i == F.col("i"), F.col("alias")).otherwise(w))
    derived = derived.select(F.array_join(named, "-").alias("block"), "source", "bn", "i", "an")
    known = own.select("block").unionByName(alias.select("block"))
    derived = least(derived, ["block"], ["bn", "i", "an"], ["source"]).join(known, "block", "left_anti").select("block", "source", F.lit(0).alias("place"))
    sources = own.select("block", F.col("block").alias("source"), F.lit(0).alias("place"))
    sources = sources.unionByName(alias.select("block", F.posexplode(F.split("value", " ")).alias("place", "source")).select("block", "source", "place")).unionByName(derived)
    claims = sources.join(raw.where("key <> ''").select(F.col("table").alias("source"), "key", "value", "n"), "source")
    found = least(claims, ["block", "key"], ["place", "n"], ["value"])
    order = own.select("block", "n").unionByName(alias.select("block", "n")).unionByName(derived.select("block", F.lit(1 << 60).alias("n")))
    return order, found.select("block", "key", F.col("value").alias("text"), (F.col("first.place") * F.lit(1 << 50) + F.col("first.n")).alias("n"))


def missing_targets(entries: DataFrame) -> DataFrame:
    """(alias, target): the blocks that aliases name and that there are not."""
    targets = entries.where("section = 'block-aliases' and table is null").select(F.col("key").alias("alias"), F.explode(F.split("value", " +")).alias("target")).where("target <> ''").distinct()
    return targets.join(entries.where("section = 'blocks' and table is not null").select(F.col("table").alias("target")).distinct(), "target", "left_anti").select("alias", "target")


def compiled(entries: DataFrame) -> dict[str, DataFrame]:
    """The tables of a dictionary.  Of the texts of a name the first in the order of SECTIONS wins, then short names, then names in lower case."""
    entries = _once(least(entries, ["section", "table", "key"], ["n"], ["value"]).select("section", "table", "key", "value", F.col("first.n").alias("n")))
    plain = entries.where("table is null and key <> ''")
    given = plain.where("section = 'own' and key = '*fillers'").select(F.posexplode(F.split("value", " +")).alias("n", "filler")).select("filler", F.col("n").cast("long").alias("n")).where("filler <> ''")
    listed = entries.sparkSession.createDataFrame([(f, i) for i, f in enumerate(FILLERS)], TABLES["fillers"])
    fillers = given if given.head(1) else listed
    rank = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    words = plain.where(F.col("section").isin(*SECTIONS) & ~((F.col("section") == "own") & F.col("key").startswith("*"))).select("section", F.col("key").alias("name"), F.col("value").alias("text"), rank.alias("rank"), "n")
    operands = entries.where("section = 'blocks' and table is not null and key <> ''")
    shorts = _once(short_names(words.where("section = 'names'").select("name"), words.select(F.col("name").alias("word")).unionByName(operands.select(F.col("key").alias("word")))))
    short = words.where("section = 'names'").join(shorts, "name").select(F.col("short").alias("name"), "text", F.lit(10).alias("rank"), "n")
    own = least(words.select("name", "text", "rank", "n").unionByName(short), ["name"], ["rank", "n"], ["text"])
    low = F.translate("name", UPPER, LOWER)
    twins = own.where(low != F.col("name")).select(low.alias("name"), "text", F.lit(20).alias("a"), F.col("first.rank").cast("long").alias("b"), F.col("first.n").alias("c"))
    claims = own.select("name", "text", F.col("first.rank").cast("int").alias("a"), F.lit(0).cast("long").alias("b"), F.col("first.n").alias("c")).unionByName(twins)
    names = least(claims, ["name"], ["a", "b", "c"], ["text"])
    names = _once(names.select("name", "text", (F.col("first.a") * F.lit(1 << 55) + F.col("first.b") * F.lit(1 << 50) + F.col("first.c")).alias("n")))
    order, block_entries = blocks_of(entries)
    controls = operands.where("(key = '*suffix' or key like '*suffix %') and value <> ''")
    suffixes = least(controls.select(F.col("value").alias("control"), "n", F.col("table").alias("block")), ["control"], ["n"], ["block"]).select("control", "block")
    meta = plain.where("section = 'meta'").select("key", F.col("value").alias("template"), "n")
    return {
        "names": names,
        "blocks": order,
        "block_entries": block_entries,
        "chars": spellings(words, operands, shorts, names, order, meta, fillers),
        "suffixes": suffixes,
        "fonts": entries.where("section = 'fonts' and table is not null").select(F.col("table").alias("name"), "key", "value", "n"),
        "meta": meta,
        "fillers": fillers,
    }


def spellings(words: DataFrame, operands: DataFrame, shorts: DataFrame, names: DataFrame, blocks: DataFrame, meta: DataFrame, fillers: DataFrame) -> DataFrame:
    """(text, form): the content of the preferred tag of each text beyond ASCII.

    Claims by rank: own names; names that both the LaTeX and the HTML list give; HTML names that are
    the last word of the Unicode name; block forms; Unicode names, by their short name where there is one.
    """
    of = lambda section: words.where(F.col("section") == section).select("name", "text", "n")
    claim = lambda df, rank, form: df.select("text", F.lit(rank).alias("rank"), "n", form.alias("form"), F.lit("").alias("block"), F.lit("").alias("operand"))
    single, name = F.length("text") == 1, F.col("name")
    read = names.select("name", "text")
    html = of("html").where(single).join(read, ["name", "text"], "left_semi")
    latex = of("latex").where(single).join(html.select("name", "text"), ["name", "text"], "left_semi")
    last = of("names").groupBy("text").agg(F.max_by("name", "n").alias("unicode"))
    agreed = html.join(last, "text").where(F.element_at(F.split("unicode", "-"), -1) == F.lower("name"))
    one_way = operands.where("key = '*one-way'").select("table").distinct()
    glyph = (F.length("value") == 1) | F.col("value").contains("‍")
    forms = operands.where(~F.col("key").startswith("*") & glyph).join(one_way, "table", "left_anti").join(blocks.select(F.col("block").alias("table"), F.col("n").alias("bn")), "table")
    place = F.row_number().over(Window.partitionBy("value").orderBy("bn", "n"))
    forms = forms.withColumn("place", place).where("place = 1").select(F.col("value").alias("text"), F.lit(3).alias("rank"), F.lit(0).cast("long").alias("n"), F.concat_ws(" ", "table", "key").alias("form"), F.col("table").alias("block"), F.col("key").alias("operand"))
    unicode = of("names").join(shorts, "name", "left").withColumn("spelled", F.coalesce("short", "name"))
    claims = claim(of("own"), 0, name).unionByName(claim(latex, 1, name)).unionByName(claim(agreed, 2, name)).unionByName(forms).unionByName(claim(unicode, 4, F.col("spelled")))
    chosen = _once(least(claims, ["text"], ["rank", "n"], ["form", "block", "operand"]).withColumn("rank", F.col("first.rank")).drop("first"))
    inner = chosen.where("rank <> 3 and not contains(form, ' ')").select(F.col("text").alias("operand"), F.col("form").alias("inner"))
    chosen = chosen.join(inner, "operand", "left")
    named = F.when((F.col("rank") == 3) & F.col("inner").isNotNull() & F.col("operand").rlike(r"[^\x00-\x7F]"), F.concat_ws(" ", "block", "inner")).otherwise(F.col("form"))
    chosen = _once(chosen.select("text", named.alias("form")).where(F.col("text").rlike(r"[^\x00-\x7F]")))
    whole = of("names").join(chosen, "text").where("name = form").select("text", "name")
    shorter = without_filler(whole, names.select("name", "text"), blocks.select(F.col("block").alias("word")).unionByName(meta.select(F.col("key").alias("word"))), fillers)
    return chosen.join(shorter, "text", "left").select("text", F.coalesce("short", "form").alias("form"))


def without_filler(whole: DataFrame, names: DataFrame, words: DataFrame, fillers: DataFrame) -> DataFrame:
    """(text, short): a name without one filler word, the shortest that still reads as the text: as a name, or with a filler put back unless its first word is an operator or a meta key."""
    listed = [r[0] for r in fillers.orderBy("n").collect()]
    drops = F.flatten(F.array(*[_dropped(F.col("name"), f, i) for i, f in enumerate(listed)])) if listed else F.array().cast("array<struct<short:string,f:int,i:int>>")
    x = whole.select("text", F.explode(drops).alias("d")).select("text", "d.short", F.length("d.short").alias("size"), "d.f", "d.i")
    x = x.join(names.select(F.col("name").alias("short"), F.col("text").alias("direct")), "short", "left")
    barred = words.distinct().select(F.col("word").alias("first"), F.lit(True).alias("barred"))
    x = _once(x.withColumn("first", F.substring_index("short", "-", 1)).join(F.broadcast(barred), "first", "left"))
    open_ = x.where("direct is null and barred is null").select("short").distinct()
    filled = open_.select("short", F.posexplode(filled_names(F.col("short"), tuple(listed))).alias("at", "name")).join(names, "name")
    back = least(filled, ["short"], ["at"], ["text"]).select("short", F.col("text").alias("filled"))
    x = x.join(back, "short", "left").where(F.coalesce("direct", F.when(F.col("barred").isNull(), F.col("filled"))) == F.col("text"))
    return least(x, ["text"], ["size", "f", "i"], ["short"]).select("text", "short")


def _dropped(name: Column, filler: str, number: int) -> Column:
    """The names that one occurrence of a filler less makes."""
    pieces, between = F.split(name, f"-{filler}-"), f"-{filler}-"
    at = lambda i: F.struct(F.concat(F.array_join(F.slice(pieces, 1, i), between), F.lit("-"), F.array_join(F.slice(pieces, i + 1, F.size(pieces)), between)).alias("short"), F.lit(number).alias("f"), i.alias("i"))
    return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), at)).otherwise(F.array().cast("array<struct<short:string,f:int,i:int>>"))


def _once(df: DataFrame) -> DataFrame:
    """A dimension that several tables are made of, as local rows: a dictionary is gathered whole anyway, and plans stay short."""
    return df.sparkSession.createDataFrame(df.toArrow())


def store(tables: dict[str, DataFrame], path: str) -> None:
    """Write tables as Parquet below a path, sorted by the hash of their key and the key."""
    for name, df in tables.items():
        keys = SORTED_BY[name]
        df.coalesce(1).sortWithinPartitions(hash31(F.concat_ws(" ", *keys)), *keys).write.mode("overwrite").parquet(f"{path}/{name}")


def stored(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a stored dictionary; raises where one has not the columns it should."""
    out = {}
    for name, schema in TABLES.items():
        df = spark.read.parquet(f"{path}/{name}")
        want = [tuple(c.split(" ")) for c in schema.replace("long", "bigint").split(", ")]
        if sorted(df.dtypes) != sorted(want):
            raise ValueError(f"{path}/{name} is no table of a dictionary: {df.dtypes}")
        out[name] = df
    return out


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of a dictionary."""
    out = None
    for name, df in tables.items():
        x = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = x if out is None else out.unionByName(x)
    return out
