"""Queries over a data folder, one for each operator, and independent SQL for the same rows."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.codepoints import char, chars, code_point_value
from .operators import packing, search
from .operators.columns import Engine
from .operators.converter import SIGIL_ATTACH, SIGIL_CLOSE, SIGIL_OPEN, tags
from .plans import etl
from .plans.dictionary import compile_entries, default, differences, store
from .plans.format import LEADING, TRAILING, VOWELS
from .sources import tables
from .sources.unicode_seed import html_names

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table that is smaller than a usual split, over all cores: its file may be one row group, which one task reads. A larger one as it is."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < 64 << 20 else df


def latin_letter(name: str) -> str:
    """LATIN SMALL LETTER E WITH ACUTE as e-with-acute."""
    _, case, _, *rest = name.split(" ")
    letter = "-".join(rest).lower()
    return letter[0].upper() + letter[1:] if case == "CAPITAL" else letter


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else "NULL" if x is None else str(x) for x in r) + ")" for r in rows)


# Characters and escapes


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, c AS ch, unicode(c) AS cp FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> '')")
def code_points(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.posexplode(chars(F.col("text"))).alias("pos", "ch")).select("doc_id", "pos", "ch", F.ascii("ch").alias("cp"))


@query("""
WITH t AS (SELECT 'documents' AS src, text AS x FROM documents UNION ALL SELECT 'pages', html FROM pages), c AS (SELECT src, unnest(string_split(x, '')) AS ch FROM t)
SELECT src, ch, unicode(ch) AS cp, count(*) AS n FROM c WHERE unicode(ch) > 127 GROUP BY ALL""")
def non_ascii_inventory(spark, sf_dir):
    x = read(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("text").alias("x")).unionByName(read(spark, sf_dir, "pages").select(F.lit("pages").alias("src"), F.col("html").alias("x")))
    beyond = F.regexp_extract_all("x", F.lit(r"([^\x00-\x7F])"), F.lit(1))
    return x.select("src", F.explode(beyond).alias("ch")).groupBy("src", "ch").agg(F.count("*").alias("n")).select("src", "ch", F.ascii("ch").alias("cp"), "n")


@query(r"""
WITH c AS (SELECT doc_id, string_split(text, '') AS c FROM documents)
SELECT doc_id, array_to_string(list_transform(c, lambda x, i: CASE WHEN unicode(x) < 128 THEN x
  WHEN regexp_full_match(coalesce(c[i + 1], ''), '[A-Za-z0-9_-]') OR coalesce(c[i - 1], '') = '\' THEN '<:U+' || printf('%04X', unicode(x)) || '/>' ELSE '\:U+' || printf('%04X', unicode(x)) END), '') AS markup FROM c""")
def ascii_escape(spark, sf_dir):
    return dealt(read(spark, sf_dir, "documents")).select("doc_id", T.escape_ascii(F.col("text")).alias("markup"))


@query("SELECT doc_id, text FROM documents")
def roundtrip_ascii(spark, sf_dir):
    x = dealt(read(spark, sf_dir, "documents")).withColumn("markup", T.escape_ascii(T.escape_markers(F.col("text"))))
    return x.select("doc_id", T.unescape_codes(F.col("markup")).alias("text"))


@query("SELECT 'documents' AS src, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id || '/' || turn, text FROM conversations UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), text FROM benchmark")
def roundtrip_unicode(spark, sf_dir):
    """Texts to markup and back, through the whole grammar."""
    e = Engine(spark)
    rows = [dealt(read(spark, sf_dir, "documents")).select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("id"), "text")]
    rows += [read(spark, sf_dir, "conversations").select(F.lit("conversations").alias("src"), F.concat_ws("/", "conv_id", "turn").alias("id"), "text")]
    rows += [read(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("src"), F.col("item_id").cast("string").alias("id"), "text")]
    x = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return x.withColumn("markup", e.to_markup(F.col("text"))).select("src", "id", e.to_unicode(F.col("markup")).alias("text"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS beyond_ascii FROM documents")
def ascii_only_check(spark, sf_dir):
    x = dealt(read(spark, sf_dir, "documents")).select(Engine(spark).to_ascii_markup(F.col("text")).alias("m"))
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("m").rlike(r"[^\x00-\x7F]")).cast("long").alias("beyond_ascii"))


# Spellings of the letters of Latin-1 that are not their Unicode names' last part.
LATIN = {"Æ": "ligature AE", "×": "multiplication-sign", "ß": "sharp-s", "æ": "ligature ae", "÷": "division-sign", "Ð": "ETH", "Þ": "THORN"}
LATIN |= {chr(c): latin_letter(unicodedata.name(chr(c))) for c in range(0xC0, 0x100) if chr(c) not in LATIN}


@query(f"""
WITH d(ch, form) AS (VALUES {values(LATIN.items())}), m AS (SELECT map(list(ch), list(form)) AS m FROM d), c AS (SELECT doc_id, string_split(regexp_replace(text, '[^\\x00-\\x7FÀ-ÿ]', '', 'g'), '') AS c FROM documents)
SELECT doc_id, array_to_string(list_transform(c, lambda x, i: CASE WHEN m[x] IS NULL THEN x
  WHEN regexp_full_match(coalesce(c[i + 1], ''), '[A-Za-z0-9_-]') OR coalesce(c[i - 1], '') = '\\' THEN '<:' || m[x] || '/>' ELSE '\\:' || replace(m[x], ' ', '-') END), '') AS markup FROM c, m""".replace("\\\\", "\\"))
def spell_back_latin1(spark, sf_dir):
    """The characters up to Latin-1's letters of each text as names, in explicit form."""
    plain = F.regexp_replace("text", "[^\\x00-\\x7FÀ-ÿ]", "")
    return read(spark, sf_dir, "documents").select("doc_id", Engine(spark).to_markup(plain).alias("markup"))


# Styles and blocks

SPACED = "regexp_replace(regexp_replace(text, '[^A-Za-z]', '', 'g'), '(.)', '\\1 ', 'g')"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Code points of A and a in each style, and the letters that stand elsewhere.
STYLES = {
    "bold": (0x1D400, 0x1D41A, {}),
    "italic": (0x1D434, 0x1D44E, {"h": "ℎ"}),
    "bold-italic": (0x1D468, 0x1D482, {}),
    "script": (0x1D49C, 0x1D4B6, {"B": "ℬ", "E": "ℰ", "F": "ℱ", "H": "ℋ", "I": "ℐ", "L": "ℒ", "M": "ℳ", "R": "ℛ", "e": "ℯ", "g": "ℊ", "o": "ℴ"}),
    "bold-script": (0x1D4D0, 0x1D4EA, {}),
    "fracture": (0x1D504, 0x1D51E, {"C": "ℭ", "H": "ℌ", "I": "ℑ", "R": "ℜ", "Z": "ℨ"}),
    "bold-fracture": (0x1D56C, 0x1D586, {}),
    "double": (0x1D538, 0x1D552, {"C": "ℂ", "H": "ℍ", "N": "ℕ", "P": "ℙ", "Q": "ℚ", "R": "ℝ", "Z": "ℤ"}),
    "sans": (0x1D5A0, 0x1D5BA, {}),
    "sans-bold": (0x1D5D4, 0x1D5EE, {}),
    "sans-italic": (0x1D608, 0x1D622, {}),
    "sans-bold-italic": (0x1D63C, 0x1D656, {}),
    "monospace": (0x1D670, 0x1D68A, {}),
}


def style_letters(style: str) -> str:
    """LETTERS in a style, by Unicode's chart."""
    capital, small, elsewhere = STYLES[style]
    return "".join(elsewhere.get(c, chr((capital if c < "a" else small) + i % 26)) for i, c in enumerate(LETTERS))


def spaced(text) -> F.Column:
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z]", ""), "(.)", "$1 ")


def style_query(block: str):
    def run(spark, sf_dir):
        markup = F.concat(F.lit(f"<:{block}> "), spaced(F.col("text")), F.lit(f" <:/{block}>"))
        return dealt(read(spark, sf_dir, "documents")).select("doc_id", Engine(spark).to_unicode(markup).alias("styled"))

    run.__name__ = f"{block.replace('-', '_')}_block"
    query(f"SELECT doc_id, translate({SPACED}, {quoted(LETTERS)}, {quoted(style_letters(block))}) AS styled FROM documents")(run)


for _block in STYLES:
    style_query(_block)


@query(f"SELECT doc_id, translate({SPACED}, {quoted(LETTERS)}, {quoted(style_letters('fracture'))}) AS styled FROM documents")
def fracture_native(spark, sf_dir):
    """The same style without Python, by the dictionary's forms."""
    return dealt(read(spark, sf_dir, "documents")).select("doc_id", T.styled(spaced(F.col("text")), {k: v for k, v in default().blocks["fracture"].forms.items() if k.isascii()}).alias("styled"))


@query("SELECT p_partkey, length(regexp_replace(p_name, '[ abgdeziklmnxoprstufcABGDEZIKLMNXOPRSTUF]', '', 'g')) AS n_warnings, CASE WHEN regexp_matches(p_name, '[^ abgdeziklmnxoprstufcABGDEZIKLMNXOPRSTUF]') THEN 9 END AS first_at FROM part")
def style_warnings(spark, sf_dir):
    """Characters without a Greek form, and the byte at which their block's text begins."""
    letters = F.regexp_replace(F.regexp_replace("p_name", " ", ""), "(.)", "$1 ")
    x = read(spark, sf_dir, "part").select("p_partkey", Engine(spark).convert(F.concat(F.lit("<:greek> "), letters, F.lit("<:>")))["warnings"].alias("w"))
    return x.select("p_partkey", F.size("w").cast("long").alias("n_warnings"), F.get("w", F.lit(0))["at"].alias("first_at"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: CASE WHEN c = ' ' THEN '  ' ELSE chr(unicode(c) + 65248) || ' ' END), '') AS wide FROM part")
def fullwidth_block(spark, sf_dir):
    letters = T.joined(F.transform(chars(F.col("p_name")), lambda c: F.when(c == " ", "  ").otherwise(F.concat(c, F.lit(" ")))))
    return read(spark, sf_dir, "part").select("p_partkey", Engine(spark).to_unicode(F.concat(F.lit("<:fullwidth> "), letters, F.lit(" <:>"))).alias("wide"))


@query("SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS raised, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS lowered FROM orders")
def raised_digits(spark, sf_dir):
    e, spread = Engine(spark), F.regexp_replace(F.col("o_orderkey").cast("string"), "(.)", "$1 ")
    return read(spark, sf_dir, "orders").select("o_orderkey", e.to_unicode(F.concat(F.lit("<:upper "), spread, F.lit("/>"))).alias("raised"), e.to_unicode(F.concat(F.lit("<:lower "), spread, F.lit("/>"))).alias("lowered"))


GREEK_PAIRS = {"th": "θ", "ch": "χ", "ps": "ψ"}
_g = "word"
for _a, _b in GREEK_PAIRS.items():
    _g = f"replace({_g}, '{_a}', '{_b}')"


@query(f"""
WITH g AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) || 'oks' AS word FROM part)
SELECT p_partkey, word, regexp_replace(translate({_g}, 'abgdeziklmnxoprstufc', 'αβγδεζικλμνξοπρστυφς'), 'σ$', 'ς') AS greek FROM g""")
def greek_translit(spark, sf_dir):
    """Words, made no names by an ending, in Greek letters: pairs first, final sigma last."""
    words = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).select("p_partkey", F.concat("w", F.lit("oks")).alias("word"))
    return words.select("p_partkey", "word", Engine(spark).to_unicode(F.concat(F.lit("<:greek "), "word", F.lit("/>"))).alias("greek"))


@query(r"""
WITH c AS (SELECT event_id, (event_id * 7919) % 1200000 AS cp FROM events)
SELECT event_id, CASE WHEN cp > 1114111 OR cp BETWEEN 55296 AND 57343 THEN '\:U+' || printf('%X', cp) ELSE chr(CAST(CASE WHEN cp BETWEEN 55296 AND 57343 OR cp > 1114111 THEN 65 ELSE cp END AS INTEGER)) END AS text,
  cp > 1114111 OR cp BETWEEN 55296 AND 57343 AS invalid FROM c WHERE cp > 0""")
def code_point_forms(spark, sf_dir):
    x = read(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 7919) % 1200000).alias("cp")).where("cp > 0")
    return x.select("event_id", Engine(spark).convert(F.concat(F.lit("\\:U+"), F.hex("cp"))).alias("c")).select("event_id", "c.text", (F.size("c.warnings") > 0).alias("invalid"))


@query("SELECT event_id, (event_id * 7919) % 1114112 AS value FROM events")
def code_point_values(spark, sf_dir):
    """Numbers of tokens in all prefixed forms, natively."""
    x = read(spark, sf_dir, "events").select("event_id", F.hex((F.col("event_id") * 7919) % 1114112).alias("h"))
    form = F.element_at(F.array(*[F.concat(F.lit(p), "h") for p in ("U+", "u+", "0x", "0X", "U", "u")]), (F.col("event_id") % 6 + 1).cast("int"))
    return x.select("event_id", code_point_value(form).alias("value"))


@query("SELECT n_nationkey, 'https://example.org/v1' AS version, CAST(47 AS INTEGER) AS length, n_name AS text FROM nation")
def header_skip(spark, sf_dir):
    e = Engine(spark)
    source = F.concat(F.lit('<:markup version="https://example.org/v1">\n'), "n_name")
    return read(spark, sf_dir, "nation").select("n_nationkey", e.header(source)["version"].alias("version"), e.header(source)["length"].alias("length"), e.to_unicode(source).alias("text"))


ORACLES["header_skip"] = ORACLES["header_skip"].replace("47", str(len('<:markup version="https://example.org/v1">\n')))


@query(r"SELECT n_nationkey, '<<::>' || n_name || '\<::>' || n_name AS markup, '<:' || n_name || '\:' || n_name AS text FROM nation")
def escape_markers(spark, sf_dir):
    e, text = Engine(spark), F.concat(F.lit("<:"), "n_name", F.lit("\\:"), "n_name")
    return read(spark, sf_dir, "nation").select("n_nationkey", T.escape_markers(text).alias("markup"), e.to_unicode(e.to_markup(text)).alias("text"))


@query("""
SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN role WHEN turn % 5 = 4 THEN '' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS scope FROM conversations""")
def block_scope(spark, sf_dir):
    """The opener that holds at each token of a conversation: openers do not nest, any closer ends them."""
    event = F.when(F.col("role") == "user", F.col("role")).when(F.col("turn") % 5 == 4, "")
    return search.scopes(read(spark, sf_dir, "conversations"), "conv_id", "turn", event).select("conv_id", "turn", "scope")


@query("SELECT p_partkey, 'A' || chr(917618) || chr(917581) || substr(p_brand, 7) AS text FROM part")
def effect_suffix(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", Engine(spark).to_unicode(F.concat(F.lit("<:mirror red A/>"), F.substring("p_brand", 7, 9))).alias("text"))


# Meta, spans, HTML


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ''), lambda c: chr(917504 + unicode(c))), '') || chr(917631) AS tagged, n_name AS back FROM nation")
def tag_encode(spark, sf_dir):
    x = read(spark, sf_dir, "nation").withColumn("tagged", T.tag_encode(F.col("n_name")))
    return x.select("n_nationkey", "tagged", T.tag_decode(F.col("tagged")).alias("back"))


@query("SELECT doc_id, text, 'color' AS key, 'red' AS value, CAST(0 AS INTEGER) AS \"start\", CAST(strlen(text) AS INTEGER) AS \"end\" FROM documents WHERE text <> ''")
def meta_runs_simple(spark, sf_dir):
    tagged = F.concat(F.lit(tags(SIGIL_OPEN + "color red")), "text", F.lit(tags(SIGIL_CLOSE + "color")))
    x = dealt(read(spark, sf_dir, "documents")).where("text <> ''").select("doc_id", tagged.alias("tagged"))
    return Engine(spark).runs(x, "tagged", "doc_id").drop("at")


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query("SELECT doc_id, '<span style=\"color: red\">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</span>' AS html FROM documents WHERE text <> ''")
def html_span(spark, sf_dir):
    tagged = F.concat(F.lit(tags(SIGIL_OPEN + "color red")), "text", F.lit(tags(SIGIL_CLOSE + "color")))
    return dealt(read(spark, sf_dir, "documents")).where("text <> ''").select("doc_id", Engine(spark).to_html(tagged).alias("html"))


# HTML's names of the characters that pages are full of.
CENSUS = {"amp": "&", "copy": "©", "middot": "·", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\xa0", "hellip": "…", "mdash": "—", "ndash": "–", "eacute": "é", "Eacute": "É", "frac12": "½"}


@query(f"""
WITH d(name, text) AS (VALUES {values(CENSUS.items())}), r AS (SELECT unnest(regexp_extract_all(html, '&([A-Za-z][A-Za-z0-9]*);', 1)) AS name FROM pages)
SELECT name, d.text, count(*) AS n FROM r LEFT JOIN d USING (name) GROUP BY ALL""")
def html_entity_census(spark, sf_dir):
    """References by name, with what the HTML list has for them."""
    return search.reference_counts(read(spark, sf_dir, "pages"), "html", spark.createDataFrame(list(html_names().items()), "name string, text string"))


CROSSING = [(1, "<:color red>a<:size 2em>b<:/color>c<:/size>", '<span style="color: red">a<span style="font-size: 2em">b</span></span><span style="font-size: 2em">c</span>'), (2, "<:lang ja>直", '<span lang="ja">直</span>'), (3, "<:color blue B/>", '<span style="color: blue">B</span>')]
STACKED = [(1, "<:bold italic alpha/>", "𝜶"), (2, "<:bold fracture A/>", "𝕬"), (3, "<:greek bold a/>", "𝛂"), (4, "<:sans bold italic alpha/>", "𝞪"), (5, "<:mirror bold italic A/>", "𝑨\U000E004D"), (6, "<:dark-skinned red-haired woman/>", "👩🏿‍🦰"), (7, "<:double bold A/>", "𝐀")]
GROUPED = [(1, "<:beside 木 木/>", "⿰木木"), (2, "<:above 宀 beside 电 电/>", "⿱宀⿰电电"), (3, "<:egyptian beside A1 A2/>", "𓀀\U00013431𓀁"), (4, "<:beside a b/>", "ab")]


def literal_query(name: str, cases: list, html: bool = False) -> None:
    def run(spark, sf_dir):
        e = Engine(spark)
        text = e.to_unicode(F.col("markup"))
        return spark.createDataFrame([c[:2] for c in cases], "id int, markup string").select("id", (e.to_html(text) if html else text).alias("result"))

    run.__name__ = name
    query(f"SELECT CAST(id AS INTEGER) AS id, result FROM (VALUES {values((c[0], c[2]) for c in cases)}) AS v(id, result)")(run)


literal_query("crossing_spans", CROSSING, html=True)
literal_query("stacked_styles", STACKED)
literal_query("groups_ids", GROUPED)


@query("SELECT n_nationkey, 'x' || chr(917562) || array_to_string(list_transform(string_split('color red', ''), lambda c: chr(917504 + unicode(c))), '') || chr(917631) AS tagged FROM nation")
def attach_meta(spark, sf_dir):
    """Meta attached to a character."""
    return read(spark, sf_dir, "nation").select("n_nationkey", Engine(spark).to_unicode(F.concat(F.lit("<:color red x/>"))).alias("tagged"))


# Hashes, filters, numbering


@query("SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h FROM part")
def text_hash(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.hash31(F.col("p_name")).alias("h"))


@query("""
WITH k AS (SELECT p_partkey, p_name, p_partkey % 2 = 0 AS stored, list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS b FROM part),
h AS (SELECT *, list_reduce(b, lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h1, list_reduce(b, lambda h, c: (h * 131 + c) % 4294967296, CAST(0 AS BIGINT)) | 1 AS h2 FROM k),
m AS (SELECT 10 * count(*) AS bits FROM k WHERE stored), p AS (SELECT *, list_transform(range(7), lambda i: ((h1 + i * h2) % 4294967296) % bits) AS p FROM h, m),
f AS (SELECT DISTINCT unnest(p) AS bit FROM p WHERE stored)
SELECT p_partkey, (SELECT count(*) = 0 FROM unnest(p.p) AS u(b) WHERE b NOT IN (SELECT bit FROM f)) AS maybe FROM p""")
def bloom_membership(spark, sf_dir):
    """Which names a filter of every other name holds, ten bits a name, false positives included."""
    names = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    stored = F.col("p_partkey") % 2 == 0
    bits = names.where(stored).agg((10 * F.count("*")).alias("bits"))
    x = names.crossJoin(F.broadcast(bits)).select("p_partkey", F.explode(F.array_distinct(T.bloom_positions(F.col("p_name"), F.col("bits")))).alias("bit"))
    found = x.where(stored).select("bit").distinct().withColumn("set", F.lit(True))
    return x.join(found, "bit", "left").groupBy("p_partkey").agg(F.every(F.coalesce("set", F.lit(False))).alias("maybe"))


@query("""
WITH k AS (SELECT p_name, list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h, strlen(p_name) + strlen(p_brand) + 20 AS size FROM part)
SELECT h // 268435456 AS chunk, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM k GROUP BY ALL""")
def chunk_order_group(spark, sf_dir):
    """Entries and bytes by range of the key's hash."""
    x = read(spark, sf_dir, "part").select(T.hash31(F.col("p_name")).alias("h"), (F.octet_length("p_name") + F.octet_length("p_brand") + 20).alias("size"))
    return packing.by_hash_range(x, "h", F.col("size"), 268435456)


@query("SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_wins(spark, sf_dir):
    return search.first_wins(read(spark, sf_dir, "events"), "event_type", "event_id").select("event_type", "event_id", "user_id")


@query("SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark, sf_dir):
    return search.last_wins(read(spark, sf_dir, "events"), "event_type", "event_id").select("event_type", "event_id", "user_id")


@query("SELECT p_brand, p_name AS shortest, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY strlen(p_name), unicode(p_name), p_name, p_partkey) AS r FROM part) WHERE r = 1")
def shortest_name(spark, sf_dir):
    return packing.shortest(read(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey").withColumnRenamed("p_name", "shortest")


@query("""
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS script, split_part(p_name, ' ', 2) AS letter FROM part), n AS (SELECT letter, count(*) AS n FROM w GROUP BY letter)
SELECT script, letter, CASE WHEN n = 1 THEN letter ELSE script || '-' || letter END AS short FROM w JOIN n USING (letter)""")
def unique_short_names(spark, sf_dir):
    """The last word of a name alone where no other name ends so, else both words."""
    w = read(spark, sf_dir, "part").select(F.split("p_name", " ").alias("w")).select(F.get("w", F.lit(0)).alias("script"), F.get("w", F.lit(1)).alias("letter")).distinct()
    n = w.groupBy("letter").agg(F.count("*").alias("n"))
    return w.join(n, "letter").select("script", "letter", F.when(F.col("n") == 1, F.col("letter")).otherwise(F.concat_ws("-", "script", "letter")).alias("short"))


@query("""
WITH n AS (SELECT DISTINCT replace(p_name, ' ', '-') AS name FROM part), e AS (SELECT DISTINCT regexp_extract(name, '-(.*)$', 1) AS ending FROM n)
SELECT ending, name FROM (SELECT ending, name, row_number() OVER (PARTITION BY ending ORDER BY strlen(name), unicode(name), name) AS r FROM e JOIN n ON n.name LIKE concat('%-', ending) WHERE strlen(ending) >= 3) WHERE r = 1""")
def name_endings(spark, sf_dir):
    """The shortest name for each ending, by an equi-join on exploded endings."""
    n = read(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")).distinct()
    x = n.select("name", F.explode(T.endings(F.col("name"))).alias("ending")).where(F.octet_length("ending") >= 3)
    return x.groupBy("ending").agg(F.min_by("name", F.struct(F.octet_length("name"), F.ascii("name"), F.col("name"))).alias("name"))


@query("""
WITH f AS (SELECT unnest(string_split('disc-sign vowel-sign numeric-sign letter sign syllable symbol digit hieroglyph ideogram logogram character', ' ')) AS filler), n AS (SELECT DISTINCT replace(p_name, ' ', '-') AS name FROM part)
SELECT name, split_part(name, '-', 1) || '-' || filler || '-' || split_part(name, '-', 2) AS filled FROM n, f""")
def filler_insert(spark, sf_dir):
    n = read(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")).distinct()
    return n.select("name", F.explode(T.filled_names(F.col("name"))).alias("filled"))


@query("""
WITH a AS (SELECT n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN n_name || 'x' ELSE n_name END AS value FROM nation WHERE n_nationkey >= 5)
SELECT key, a.value AS ours, b.value AS theirs FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value""")
def dictionary_check(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    other = n.where("key >= 5").withColumn("value", F.when(F.col("key") % 3 == 0, F.concat("value", F.lit("x"))).otherwise(F.col("value")))
    return differences(n.where("key < 20"), other, "key", "value")


def syllable(i: int) -> str:
    return unicodedata.name(chr(0xAC00 + i)).removeprefix("HANGUL SYLLABLE ")


# Parts of names of Hangul syllables, read off the standard library's names of those with a silent or short other part.
@query(f"""
WITH l(i, a) AS (VALUES {values((i, syllable(i * 588)[:-1]) for i in range(19))}), v(j, b) AS (VALUES {values((j, syllable((11 * 21 + j) * 28)) for j in range(21))}), t(k, c) AS (VALUES {values((k, syllable(11 * 588 + k)[1:]) for k in range(28))})
SELECT a || b || c AS name, chr(44032 + (i * 21 + j) * 28 + k) AS syllable FROM l, v, t""")
def hangul_names(spark, sf_dir):
    part = lambda items, n: spark.createDataFrame(list(enumerate(items)), f"{n} int, {n}_name string")
    x = F.broadcast(part(LEADING, "i")).crossJoin(F.broadcast(part(VOWELS, "j"))).crossJoin(F.broadcast(part(TRAILING, "k")))
    return x.select(F.concat("i_name", "j_name", "k_name").alias("name"), char((F.col("i") * 21 + F.col("j")) * 28 + F.col("k") + 44032).alias("syllable"))


@query("SELECT 'CJK UNIFIED IDEOGRAPH-' || printf('%04X', 19968 + event_id % 20992) AS name, chr(CAST(19968 + event_id % 20992 AS INTEGER)) AS text FROM events")
def cjk_algorithmic(spark, sf_dir):
    name = F.concat(F.lit("CJK UNIFIED IDEOGRAPH-"), F.hex(F.col("event_id") % 20992 + 19968))
    x = read(spark, sf_dir, "events").select(name.alias("name"))
    return x.select("name", Engine(spark).to_unicode(F.concat(F.lit("<:"), "name", F.lit("/>"))).alias("text"))


# Unicode blocks that texts in alphabetic scripts use.
BLOCKS = """0000..007F; Basic Latin
0080..00FF; Latin-1 Supplement
0100..017F; Latin Extended-A
0180..024F; Latin Extended-B
0250..02AF; IPA Extensions
02B0..02FF; Spacing Modifier Letters
0300..036F; Combining Diacritical Marks
0370..03FF; Greek and Coptic
0400..04FF; Cyrillic
0530..058F; Armenian
0590..05FF; Hebrew
0600..06FF; Arabic
1E00..1EFF; Latin Extended Additional
1F00..1FFF; Greek Extended
2000..206F; General Punctuation
2070..209F; Superscripts and Subscripts
20A0..20CF; Currency Symbols
2100..214F; Letterlike Symbols
2190..21FF; Arrows
2200..22FF; Mathematical Operators
2500..257F; Box Drawing
2600..26FF; Miscellaneous Symbols
3000..303F; CJK Symbols and Punctuation
3040..309F; Hiragana
30A0..30FF; Katakana
4E00..9FFF; CJK Unified Ideographs
AC00..D7AF; Hangul Syllables"""


@query(f"""
WITH b AS (SELECT CAST('0x' || split_part(x, '..', 1) AS BIGINT) AS a, CAST('0x' || regexp_extract(x, '[.][.]([0-9A-F]+)', 1) AS BIGINT) AS z, split_part(x, '; ', 2) AS name FROM (SELECT unnest(string_split({quoted(BLOCKS)}, chr(10))) AS x)), c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '')
SELECT coalesce(name, 'No_Block') AS name, count(*) AS n FROM c LEFT JOIN b ON unicode(ch) BETWEEN a AND z GROUP BY ALL""")
def unicode_block_of_char(spark, sf_dir):
    """Characters by block, those of no listed block too."""
    blocks = tables.unicode_blocks(spark.createDataFrame([(x,) for x in BLOCKS.split("\n")], "value string"))
    c = dealt(read(spark, sf_dir, "documents")).where("text <> ''").select(F.explode(chars(F.col("text"))).alias("ch")).groupBy(F.ascii("ch").alias("cp")).agg(F.count("*").alias("n"))
    return search.in_blocks(c, blocks).groupBy(F.coalesce("name", F.lit("No_Block")).alias("name")).agg(F.sum("n").alias("n"))


# Dictionary search


def _part_names(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")).agg(F.min("p_brand").alias("text"))


PART_NAMES = "SELECT replace(p_name, ' ', '-') AS name, min(p_brand) AS text FROM part GROUP BY ALL"


@query(f"""
WITH n AS ({PART_NAMES}), f AS (SELECT 's' || regexp_extract(substr(name, 2), '^[^-]*-?') AS item, name, text FROM n WHERE lower(name) LIKE 's%')
SELECT item, count(*) AS size, arg_min(text, (length(name), name)) AS sample FROM f GROUP BY item""")
def prefix_completion(spark, sf_dir):
    return search.prefix_completion(_part_names(spark, sf_dir), "s")


@query(f"""
WITH n AS ({PART_NAMES}), v AS (SELECT name, text, 1 AS rank FROM n WHERE regexp_extract(name, '-(.*)$', 1) LIKE 'pla%' AND name NOT LIKE 'pla%')
SELECT name, text, CAST(rank AS INTEGER) AS rank FROM v ORDER BY rank, length(name), unicode(text), name LIMIT 1000""")
def loose_completion(spark, sf_dir):
    return search.loose_completion(_part_names(spark, sf_dir), "pla")


@query("SELECT style, array_to_string(list_sort(list_distinct(string_split(replace(style, ' ', '-'), '-'))), '-') AS key FROM (VALUES ('bold italic'), ('italic bold'), ('sans bold bold'), ('bold-italic sans'), ('script')) v(style)")
def style_combination(spark, sf_dir):
    x = spark.createDataFrame([(s,) for s in ("bold italic", "italic bold", "sans bold bold", "bold-italic sans", "script")], "style string")
    return x.select("style", T.combined_key(F.col("style")).alias("key"))


@query(f"""
WITH d(text, form) AS (VALUES {values(LATIN.items())}), c AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[À-ÿ]')) AS text FROM documents)
SELECT text, 'U+' || printf('%04X', unicode(text)) AS code_points, '<:' || form || '>' AS tag FROM c LEFT JOIN d USING (text)""")
def character_description(spark, sf_dir):
    """The letters of Latin-1 that texts have."""
    dictionary = default().tables(spark)
    x = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([À-ÿ])"), F.lit(1))).alias("text")).distinct()
    return search.describe(x, dictionary["chars"], dictionary["names"]).select("text", "code_points", "tag")


READINGS = {"ba": "𐀀", "ko": "𐀒", "mi": "𐀖", "tu": "𐀶", "zen": "𐀽"}


@query(f"""
WITH r(k, s, c) AS (VALUES {values((i, s, c) for i, (s, c) in enumerate(READINGS.items()))})
SELECT p_partkey, a.c || b.c || d.c AS text FROM part JOIN r a ON a.k = p_partkey % 5 JOIN r b ON b.k = p_size % 5 JOIN r d ON d.k = (p_partkey + p_size) % 5""")
def readings_split(spark, sf_dir):
    """Words of whole readings, split into the fewest."""
    from .plans.dictionary import compile_sections, merged
    from .sources.unicode_seed import sections

    e = Engine(spark, compile_sections(merged({"blocks": {"linear": {"*readings": "", **READINGS}}}, {k: v for k, v in sections().items() if k in ("meta", "fonts")})))
    syllable = lambda k: F.get(F.array(*map(F.lit, READINGS)), (k % 5).cast("int"))
    word = F.concat(syllable(F.col("p_partkey")), syllable(F.col("p_size")), syllable(F.col("p_partkey") + F.col("p_size")))
    return read(spark, sf_dir, "part").select("p_partkey", e.to_unicode(F.concat(F.lit("<:linear "), word, F.lit("/>"))).alias("text"))


@query("SELECT n_nationkey, '\\:mars ' || n_name AS explicit, '<:mars> looks like an opening tag: write \\:mars or <:mars/>' AS message, CAST(0 AS INTEGER) AS at FROM nation".replace("\\\\", "\\"))
def inline_tags(spark, sf_dir):
    """The explicit form of an inline tag, and the warning that it is one."""
    e, source = Engine(spark), F.concat(F.lit("<:mars> "), "n_name")
    x = read(spark, sf_dir, "nation").select("n_nationkey", e.explicit(source).alias("explicit"), F.get(e.convert(source)["warnings"], F.lit(0)).alias("w"))
    return x.select("n_nationkey", "explicit", "w.message", "w.at")


@query("SELECT n_nationkey, '<:no-such-' || n_name || '> x' AS text, 'unknown entity: no-such-' || n_name AS message, CAST(0 AS INTEGER) AS at FROM nation")
def lenient_keeps(spark, sf_dir):
    x = read(spark, sf_dir, "nation").select("n_nationkey", Engine(spark).convert(F.concat(F.lit("<:no-such-"), "n_name", F.lit("> x"))).alias("c"))
    return x.select("n_nationkey", "c.text", F.get("c.warnings", F.lit(0)).alias("w")).select("n_nationkey", "text", "w.message", "w.at")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'greek' END AS open_block, CASE WHEN n_nationkey % 3 = 0 THEN 'al' END AS typed FROM nation")
def editor_state(spark, sf_dir):
    """The block that is open at the end of a text and the tag that is being typed."""
    source = F.concat(F.lit("<:bold> a <:/bold> <:alpha/> <:greek> b "), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("<:>"), F.when(F.col("n_nationkey") % 3 == 0, "<:al").otherwise("x"))
    blocks = F.array(F.lit("bold"), F.lit("greek"))
    return read(spark, sf_dir, "nation").select("n_nationkey", search.tag_to_close(source, blocks).alias("open_block"), search.open_tag(source).alias("typed"))


# Dictionary tables


@query("""
WITH s AS (SELECT DISTINCT (p_partkey % 17) * 252645135 AS start FROM part), c AS (SELECT start, CAST(row_number() OVER (ORDER BY start) - 1 AS INTEGER) AS chunk FROM s),
k AS (SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h FROM part)
SELECT p_partkey, h, chunk FROM k ASOF LEFT JOIN c ON h >= start""")
def chunk_of_key(spark, sf_dir):
    """The chunk that a key belongs to: the last one that starts at or before its hash."""
    keys = read(spark, sf_dir, "part").select("p_partkey", T.hash31(F.col("p_name")).alias("h"))
    return packing.chunk_of(keys, "h", [i * 252645135 for i in range(17)])


@query("""
WITH n AS (SELECT DISTINCT replace(p_name, ' ', '-') AS name FROM part), r AS (SELECT name, sum(strlen(name)) OVER (ORDER BY length(name), name ROWS UNBOUNDED PRECEDING) AS upto FROM n)
SELECT name FROM r WHERE upto <= 2000""")
def common_chunk(spark, sf_dir):
    """The shortest names that fit 2000 bytes."""
    n = read(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")).distinct().withColumn("length", F.length("name"))
    return packing.within_budget(n, F.octet_length("name"), 2000, "length", "name").select("name")


@query("SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part WHERE p_name || ' ' || p_brand NOT IN (SELECT p_name || ' ' || p_brand FROM part WHERE p_size <= 25)")
def names_outside(spark, sf_dir):
    """Names of which no entry is in the common chunk."""
    p = read(spark, sf_dir, "part").withColumn("name", F.concat_ws(" ", "p_name", "p_brand"))
    return p.select("name").distinct().join(p.where("p_size <= 25").select("name"), "name", "left_anti")


@query("""
WITH r AS (SELECT p_partkey AS text, split_part(p_name, ' ', 1) AS reading, p_size AS rank FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY rank, text) AS k FROM r)
SELECT text, reading, CASE WHEN reading < 'g' THEN reading || '.' || (k + 1 + CAST(k + 1 >= 3 AS INTEGER)) WHEN k = 1 THEN reading ELSE reading || '.' || k END AS key FROM k""")
def homophone_numbers(spark, sf_dir):
    """Holders of a reading, numbered by rank; the bare reading and the third number of some are taken."""
    p = read(spark, sf_dir, "part")
    readings = p.select(F.col("p_partkey").alias("text"), F.substring_index("p_name", " ", 1).alias("reading"), F.col("p_size").alias("rank"))
    some = readings.select("reading").where("reading < 'g'").distinct()
    return packing.numbered_homophones(readings, some.select(F.explode(F.array("reading", F.concat("reading", F.lit(".3")))).alias("key")))


@query("""
WITH r AS (SELECT p_partkey AS text, string_split(p_name, ' ') AS w, p_size AS own FROM part), e AS (SELECT text, own, unnest(w) AS reading, generate_subscripts(w, 1) AS place FROM r)
SELECT text, reading, CAST(row_number() OVER (PARTITION BY reading ORDER BY place, own, text) AS INTEGER) AS k FROM e""")
def first_readings(spark, sf_dir):
    """Holders of a reading: those that have it as their first one come before those that have it as their second."""
    x = packing.firsts_first(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("text"), F.split("p_name", " ").alias("readings"), F.col("p_size").alias("rank")))
    return x.select("text", "reading", F.row_number().over(Window.partitionBy("reading").orderBy("rank")).alias("k"))


@query("""
WITH u AS (SELECT n_name AS text, 0 AS part, n_nationkey AS rank FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_name, 1, -n_nationkey FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name, 2, n_nationkey FROM nation)
SELECT text, CAST(part AS INTEGER) AS part, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY part, rank) AS r FROM u) WHERE r = 1""")
def interleaved_priority(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("text"), F.col("n_nationkey").alias("rank"))
    return packing.interleaved(n.where("rank < 5"), n.where("rank % 3 = 0").withColumn("rank", -F.col("rank")), n)


@query("""
WITH g AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, CASE WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'middle' END AS place FROM g WHERE i = 1 OR i = n OR i = (n + 1) // 2""")
def boundary_samples(spark, sf_dir):
    return packing.boundary_samples(read(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey")


#: Composite names made of parts: plain, a block's own, controls and operands.
COMPOSED = "SELECT CASE p_size % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN p_brand || ' ' WHEN 2 THEN p_brand || ' *suffix' ELSE p_brand || ' ' || p_name END AS name, p_type AS text FROM part"


@query(f"""
WITH c AS ({COMPOSED.replace('p_brand', "replace(p_brand, ' ', '')")})
SELECT kind, count(*) AS n, count(DISTINCT word) AS words FROM (SELECT CASE WHEN name NOT LIKE '% %' THEN 'name' WHEN name LIKE '% ' THEN 'block' WHEN name LIKE '% *%' THEN 'control' ELSE 'operand' END AS kind, CASE WHEN name LIKE '% %' THEN split_part(name, ' ', 1) END AS word FROM c) GROUP BY kind""")
def names_by_kind(spark, sf_dir):
    word, size = F.replace("p_brand", F.lit(" "), F.lit("")), F.col("p_size") % 4
    name = F.when(size == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).when(size == 1, F.concat(word, F.lit(" "))).when(size == 2, F.concat(word, F.lit(" *suffix"))).otherwise(F.concat_ws(" ", word, "p_name"))
    x = search.kinds(read(spark, sf_dir, "part").select(name.alias("name"), F.col("p_type").alias("text")))
    return x.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("word").alias("words"))


def _operands(spark, sf_dir):
    """Operands of parts by brand, some of them also in capitals."""
    o = read(spark, sf_dir, "part").select(F.col("p_brand").alias("block"), F.explode(F.split("p_name", " ")).alias("operand"), F.col("p_type").alias("text"))
    return o.unionByName(o.where("operand < 'm'").withColumn("operand", F.initcap("operand"))).distinct()


OPERANDS = """o AS (SELECT p_brand AS block, unnest(string_split(p_name, ' ')) AS operand, p_type AS text FROM part),
a AS (SELECT DISTINCT * FROM (SELECT * FROM o UNION ALL SELECT block, upper(operand[1]) || operand[2:], text FROM o WHERE operand < 'm'))"""


@query(f"WITH {OPERANDS} SELECT block, operand, text FROM a WHERE NOT (operand < 'm' AND operand = lower(operand))")
def cased_operands(spark, sf_dir):
    """Operands without twins in lower case."""
    return search.without_twins(_operands(spark, sf_dir))


@query(f"""
WITH {OPERANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY length(operand), operand, text) AS r FROM a)
SELECT block, count(*) AS size, string_agg(text, ' ' ORDER BY r) FILTER (r <= 3) AS samples FROM r GROUP BY block""")
def block_groups(spark, sf_dir):
    """Block words with their size and three samples."""
    return search.group_summary(_operands(spark, sf_dir))


@query(f"WITH {OPERANDS} SELECT 'other' AS block, operand, text, true AS one_way FROM a WHERE block = 'Brand#11'")
def borrowed_block(spark, sf_dir):
    return search.borrowed(_operands(spark, sf_dir), "Brand#11", "other")


@query("SELECT item_id, CASE WHEN text LIKE '%' || chr(10) THEN text ELSE text || chr(10) END AS line FROM benchmark")
def final_newline(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", tables.with_final_newline(F.col("text")).alias("line"))


@query("SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS name, text FROM conversations WHERE NOT regexp_matches(text, '[\n\t]')")
def names_dump(spark, sf_dir):
    return tables.printable_names(read(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("name"), "text"))


@query(r"""
WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '')
SELECT ch, NOT regexp_matches(ch, '[\p{L}\p{M}]') OR regexp_matches(ch, '[\p{Latin}]') AND ch NOT IN ('ª', 'º') AS common FROM c""".replace("\\\\", "\\"))
def common_characters(spark, sf_dir):
    """Characters of texts that are common in all scripts."""
    c = read(spark, sf_dir, "documents").where("text <> ''").select(F.explode(chars(F.col("text"))).alias("ch")).distinct()
    names = default().tables(spark)["names"].where("name like '%-letter-%' or name like 'combining-%'").select(F.col("text").alias("ch"), "name")
    named = c.join(names.groupBy("ch").agg(F.min("name").alias("name")), "ch", "left")
    return named.select("ch", packing.common_everywhere(F.col("ch"), F.coalesce("name", F.lit(""))).alias("common"))


def _sections(spark, sf_dir):
    """Entries of a dictionary made of the tables: names of parts in three sections, and brands as blocks."""
    p = read(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("key"), F.concat_ws("", F.lit("ſ"), F.col("p_partkey").cast("string")).alias("value"), F.col("p_partkey").alias("n"), "p_size", "p_brand")
    section = F.element_at(F.array(F.lit("html"), F.lit("own"), F.lit("names")), (F.col("p_size") % 3 + 1).cast("int"))
    plain = p.select(section.alias("section"), F.lit(None).cast("string").alias("table"), "key", "value", "n")
    blocks = p.where("p_size = 7").select(F.lit("blocks").alias("section"), F.concat(F.lit("b"), F.regexp_extract("p_brand", "[0-9]+", 0)).alias("table"), "key", "value", "n")
    alias = spark.createDataFrame([("block-aliases", None, "again", "b11", 0)], etl.ENTRIES)
    return plain.unionByName(blocks).unionByName(alias)


@query("""
WITH p AS (SELECT replace(p_name, ' ', '-') AS name, 'ſ' || p_partkey AS text, p_partkey AS n, CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS rank FROM part)
SELECT name, text FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, n) AS r FROM p) WHERE r = 1""")
def section_precedence(spark, sf_dir):
    """The text of each name: own names before Unicode names before HTML names, the first of a section."""
    return etl.compiled(_sections(spark, sf_dir))["names"].select("name", "text")


@query("""
WITH p AS (SELECT replace(p_name, ' ', '-') AS name, 'ſ' || p_partkey AS text, p_partkey AS n, p_size, 'b' || regexp_extract(p_brand, '[0-9]+') AS block, CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 0 ELSE 1 END AS rank FROM part),
b AS (SELECT block, name, text FROM (SELECT *, row_number() OVER (PARTITION BY block, name ORDER BY n) AS r FROM p WHERE p_size = 7) WHERE r = 1)
SELECT block, name AS operand, text FROM b UNION ALL SELECT 'again', name, text FROM b WHERE block = 'b11'""")
def aliased_blocks(spark, sf_dir):
    """Operands of blocks, and of a block under an alias."""
    return etl.compiled(_sections(spark, sf_dir))["block_entries"].select("block", F.col("key").alias("operand"), "text")


@query("""
WITH p AS (SELECT replace(p_name, ' ', '-') AS name, p_size, p_brand FROM part)
SELECT 'names' AS "table", count(DISTINCT name) AS rows FROM p UNION ALL SELECT 'block_entries', count(DISTINCT (p_brand, name)) + count(DISTINCT name) FILTER (p_brand = 'Brand#11') FROM p WHERE p_size = 7""")
def table_counts(spark, sf_dir):
    return etl.counts({k: v for k, v in etl.compiled(_sections(spark, sf_dir)).items() if k in ("names", "block_entries")})


@query("SELECT n_nationkey, 'α' || n_name AS text, '𝔄' AS styled, n_nationkey % 2 = 0 AS own FROM nation")
def stored_dictionary(spark, sf_dir):
    """Conversion by a dictionary that was written and read again."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{where.rstrip('/')}/dictionary-{uuid.uuid4().hex}"
    store(default(), spark, path)
    e = Engine(spark, path)
    x = read(spark, sf_dir, "nation").select("n_nationkey", e.to_unicode(F.concat(F.lit("<:alpha/>"), "n_name")).alias("text"), e.to_unicode(F.lit("\\:fracture-A")).alias("styled"))
    return x.withColumn("own", F.col("n_nationkey") % 2 == 0)


@query("SELECT n_nationkey, 'N' || n_nationkey || ' β' AS text FROM nation")
def overlay_names(spark, sf_dir):
    """Names of an overlay before those of the dictionary."""
    n = read(spark, sf_dir, "nation")
    name = F.concat(F.lit("land-"), F.col("n_nationkey").cast("string"))
    own = n.select(F.lit("own").alias("section"), F.lit(None).cast("string").alias("table"), name.alias("key"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("value"), F.col("n_nationkey").cast("long").alias("n"))
    alpha = spark.createDataFrame([("own", None, "alpha", "β", 99)], etl.ENTRIES)
    base = spark.createDataFrame([("own", None, "alpha", "α", 0), ("own", None, "land-1", "x", 1)], etl.ENTRIES)
    e = Engine(spark, compile_entries(etl.layered(own.unionByName(alpha), base)))
    return n.select("n_nationkey", e.to_unicode(F.concat(F.lit("<:"), name, F.lit("/> <:alpha/>"))).alias("text"))


# Reverse spelling, meta and warnings over tables


@query("""
WITH c AS (SELECT event_id, (event_id * 7919) % 1114112 AS cp FROM events)
SELECT event_id, CASE WHEN cp BETWEEN 77824 AND 81919 THEN 'egyptian' WHEN cp BETWEEN 11904 AND 12287 OR cp BETWEEN 12288 AND 40959 OR cp BETWEEN 131072 AND 212991 THEN 'cjk' ELSE '' END AS script FROM c""")
def code_point_scripts(spark, sf_dir):
    """Scripts whose characters have controls of their own."""
    return read(spark, sf_dir, "events").select("event_id", T.script_of(char((F.col("event_id") * 7919 % 1114112).cast("long"))).alias("script"))


RED = SIGIL_ATTACH + "color red"


@query("""
SELECT p_partkey, p_name || m AS text, 'color' AS key, 'red' AS value, CAST(strlen(p_name) - 1 AS INTEGER) AS "start", CAST(strlen(p_name || m) AS INTEGER) AS "end"
FROM (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN chr(769) WHEN 2 THEN chr(65039) ELSE chr(776) || chr(8205) || chr(9792) END AS m FROM part)""")
def attached_clusters(spark, sf_dir):
    """Meta attached to the last character with what extends it: accents, variation selectors, joined characters."""
    marks = F.element_at(F.array(F.lit(""), F.lit("́"), F.lit("️"), F.lit("̈‍♀")), (F.col("p_partkey") % 4 + 1).cast("int"))
    x = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", marks, F.lit(tags(RED))).alias("tagged"))
    return Engine(spark).runs(x, "tagged", "p_partkey").drop("at")


@query("""
SELECT p_partkey, '<:size 2em>' || p_name || '<:/size>' || left(p_name, length(p_name) - 1) || '<:color red ' || right(p_name, 1) || '/>' AS markup FROM part""")
def spelled_meta(spark, sf_dir):
    """Meta around a text and on a character, back as markup."""
    around = F.concat(F.lit(tags(SIGIL_OPEN + "size 2em")), "p_name", F.lit(tags(SIGIL_CLOSE + "size")))
    return read(spark, sf_dir, "part").select("p_partkey", Engine(spark).to_markup(F.concat(around, "p_name", F.lit(tags(RED)))).alias("markup"))


@query("""
SELECT p_partkey, unnest(['color', 'size']) AS key, unnest(['red', '2em']) AS value, p_name AS text, CAST(0 AS INTEGER) AS "start", CAST(strlen(p_name) AS INTEGER) AS "end" FROM part""")
def several_meta_keys(spark, sf_dir):
    """An opener of two keys."""
    e = Engine(spark)
    x = read(spark, sf_dir, "part").select("p_partkey", e.to_unicode(F.concat(F.lit("<:color red size 2em>"), "p_name", F.lit("<:/size><:/color>"))).alias("tagged"))
    return e.runs(x, "tagged", "p_partkey").drop("at")


@query("SELECT p_partkey, '<:mirror red ' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || '/>' || p_name AS markup, true AS reads_back FROM part")
def unstacked_suffixes(spark, sf_dir):
    """Controls after a letter, the last one first."""
    e = Engine(spark)
    text = F.concat(F.char(F.lit(65) + F.col("p_partkey") % 26), F.lit("\U000E0072\U000E004D"), "p_name")
    return read(spark, sf_dir, "part").select("p_partkey", e.to_markup(text).alias("markup"), (e.to_unicode(e.to_markup(text)) == text).alias("reads_back"))


@query(r"""
SELECT n_nationkey, '\:waving-black-flag' || array_to_string(list_transform(string_split(lower(n_name[1:2]) || 'eng', ''), lambda c: chr(917504 + unicode(c))), '') || chr(917631) || n_name AS markup FROM nation""")
def emoji_tag_sequences(spark, sf_dir):
    """Tags that belong to an emoji stay characters."""
    text = F.concat(F.lit("🏴"), T.tag_encode(F.concat(F.lower(F.substring("n_name", 1, 2)), F.lit("eng"))), "n_name")
    return read(spark, sf_dir, "nation").select("n_nationkey", Engine(spark).to_markup(text).alias("markup"))


#: People, skin tones and what is joined to them.
PEOPLE = (("👩", "👨", "🧑"), ("", "🏻", "🏼", "🏽", "🏾", "🏿"), ("", "‍🦰", "‍🔬", "‍❤️‍👨", "‍👧‍👦"))


@query(f"SELECT event_id, {' || '.join(f'list_value({", ".join(map(quoted, p))})[CAST((event_id // {d}) % {len(p)} + 1 AS INTEGER)]' for p, d in zip(PEOPLE, (1, 3, 18)))} || event_type AS text, true AS is_ascii FROM events")
def joined_emoji(spark, sf_dir):
    """Joined emoji through markup in ASCII and back."""
    e = Engine(spark)
    pick = lambda p, d: F.element_at(F.array(*map(F.lit, p)), (F.floor(F.col("event_id") / d) % len(p) + 1).cast("int"))
    markup = e.to_ascii_markup(F.concat(*[pick(p, d) for p, d in zip(PEOPLE, (1, 3, 18))], "event_type"))
    x = read(spark, sf_dir, "events").select("event_id", markup.alias("m"))
    return x.select("event_id", e.to_unicode(F.col("m")).alias("text"), (~F.col("m").rlike(r"[^\x00-\x7F]")).alias("is_ascii"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'left does not apply to ' || c ELSE 'red on ' || c || ' kept as color meta' END AS message, CAST(strlen(p_name) AS INTEGER) AS at
FROM (SELECT *, chr(CAST(77824 + p_partkey % 1000 AS INTEGER)) AS c FROM part)""")
def effect_warnings(spark, sf_dir):
    """What an effect that a character has no control for warns of, by place."""
    effect = F.when(F.col("p_partkey") % 2 == 0, "left").otherwise("red")
    x = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("<:"), effect, F.lit(" "), char((F.col("p_partkey") % 1000 + 77824).cast("long")), F.lit("/>")).alias("markup"))
    return Engine(spark).warnings(x, "markup", "p_partkey")


@query("SELECT p_partkey, left(p_name, 1) || upper(left(p_name, 1)) AS text FROM part")
def spaced_names(spark, sf_dir):
    """Names of several words, with spaces and in capitals."""
    letter = F.upper(F.substring("p_name", 1, 1))
    markup = F.concat(F.lit("<:LATIN SMALL LETTER "), letter, F.lit("/><:latin capital letter "), F.lower(letter), F.lit("/>"))
    return read(spark, sf_dir, "part").select("p_partkey", Engine(spark).to_unicode(markup).alias("text"))


# Dictionary ETL over tables


@query("""
WITH n AS (SELECT DISTINCT CASE WHEN p_brand = 'Brand#11' THEN 'latin' ELSE 's' || regexp_extract(p_brand, '[0-9]+') END AS script, CASE WHEN p_size % 2 = 0 THEN 'capital' ELSE 'small' END AS case_, replace(p_name, ' ', '-') AS rest FROM part),
l AS (SELECT script || '-' || case_ || '-letter-' || rest AS name, script, CASE case_ WHEN 'capital' THEN upper(rest[1]) || rest[2:] ELSE rest END AS letter FROM n),
w AS (SELECT *, count(*) OVER (PARTITION BY letter) AS holders, count(*) FILTER (script = 'latin') OVER (PARTITION BY letter) AS latins, count(*) OVER (PARTITION BY script, letter) AS twice FROM l),
t AS (SELECT DISTINCT replace(p_name, ' ', '-') AS word FROM part WHERE p_size = 9)
SELECT name, CASE WHEN bare THEN letter ELSE script || '-' || letter END AS short
FROM (SELECT *, letter NOT IN (FROM t) AND (holders = 1 OR script = 'latin' AND latins = 1) AS bare FROM w) WHERE bare OR script <> 'latin' AND twice = 1""")
def cased_letter_names(spark, sf_dir):
    """Short names of cased letters: the letter alone where no other script has it, else with the script."""
    p = read(spark, sf_dir, "part")
    rest = F.replace("p_name", F.lit(" "), F.lit("-"))
    script = F.when(F.col("p_brand") == "Brand#11", "latin").otherwise(F.concat(F.lit("s"), F.regexp_extract("p_brand", "[0-9]+", 0)))
    name = F.concat(script, F.lit("-"), F.when(F.col("p_size") % 2 == 0, "capital").otherwise("small"), F.lit("-letter-"), rest)
    return etl.short_names(p.select(name.alias("name")).distinct(), p.where("p_size = 9").select(rest.alias("word")))


@query("""
WITH p AS (SELECT p_partkey % 65534 AS k, arg_min(p_name, p_partkey) AS name, arg_min(p_size, p_partkey) AS size FROM part GROUP BY ALL)
SELECT chr(CAST(983040 + k AS INTEGER)) AS text, CASE size % 5 WHEN 0 THEN 'own-' || k WHEN 1 THEN 'n' || k WHEN 3 THEN 'b11 o' || k ELSE 'mark-' || split_part(name, ' ', 1) || '-n' || k END AS form FROM p""")
def spelled_forms(spark, sf_dir):
    """The preferred spelling of signs: own names, HTML names that end the Unicode name, operands, Unicode names without a filler word. The parts share a plane of signs; the first part of each gives its name."""
    p = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 65534).alias("k")).agg(F.min_by("p_name", "p_partkey").alias("name"), F.min_by("p_size", "p_partkey").alias("size"))
    key = F.col("k").cast("string")
    sign, kind = char((F.col("k") + 0xF0000).cast("long")), F.col("size") % 5
    none = F.lit(None).cast("string")
    entry = lambda where, section, table, k: p.where(where).select(F.lit(section).alias("section"), table.alias("table"), k.alias("key"), sign.alias("value"), F.col("k").cast("long").alias("n"))
    names = entry(F.lit(True), "names", none, F.concat(F.lit("mark-character-"), F.substring_index("name", " ", 1), F.lit("-n"), key))
    own, last, other = entry(kind == 0, "own", none, F.concat(F.lit("own-"), key)), entry(kind == 1, "html", none, F.concat(F.lit("n"), key)), entry(kind == 2, "html", none, F.concat(F.lit("h"), key))
    operands = entry(kind == 3, "blocks", F.lit("b11"), F.concat(F.lit("o"), key))
    return etl.compiled(names.unionByName(own).unionByName(last).unionByName(other).unionByName(operands))["chars"]


@query("""
WITH p AS (SELECT p_partkey AS k, p_type, 'b' || regexp_extract(p_brand, '[0-9]+') AS block FROM part)
SELECT 'suffix' AS "table", 'c' || k % 50 AS key, arg_min(block, k) AS value FROM p GROUP BY k % 50
UNION ALL SELECT 'meta', 'k' || k % 40, arg_min(p_type, k) FROM p GROUP BY k % 40
UNION ALL SELECT 'font', block || ' f' || k % 7, arg_min(p_type, k) FROM p GROUP BY block, k % 7""")
def control_tables(spark, sf_dir):
    """Control characters by block, meta templates and font fields, the first of each."""
    p = read(spark, sf_dir, "part").withColumn("block", F.concat(F.lit("b"), F.regexp_extract("p_brand", "[0-9]+", 0)))
    numbered = lambda prefix, most: F.concat(F.lit(prefix), (F.col("p_partkey") % most).cast("string"))
    none = F.lit(None).cast("string")
    entry = lambda section, table, key, value: p.select(F.lit(section).alias("section"), table.alias("table"), key.alias("key"), value.alias("value"), F.col("p_partkey").cast("long").alias("n"))
    x = entry("blocks", F.col("block"), F.concat(F.lit("*suffix "), F.col("p_partkey").cast("string")), numbered("c", 50))
    t = etl.compiled(x.unionByName(entry("meta", none, numbered("k", 40), F.col("p_type"))).unionByName(entry("fonts", F.col("block"), numbered("f", 7), F.col("p_type"))))
    rows = lambda name, key, value: t[name].select(F.lit(name.rstrip("s") if name != "suffixes" else "suffix").alias("table"), key.alias("key"), F.col(value).alias("value"))
    return rows("suffixes", F.col("control"), "block").unionByName(rows("meta", F.col("key"), "template")).unionByName(rows("fonts", F.concat_ws(" ", "name", "key"), "value"))


@query("""
WITH a AS (SELECT 'alias' || p_partkey AS alias, unnest(['b' || p_size, 'b' || (p_partkey % 90)]) AS target FROM part)
SELECT DISTINCT alias, target FROM a WHERE target NOT IN (SELECT 'b' || p_size FROM part)""")
def missing_alias_targets(spark, sf_dir):
    """Targets of aliases that are no blocks."""
    p = read(spark, sf_dir, "part")
    size, n = F.concat(F.lit("b"), F.col("p_size").cast("string")), F.col("p_partkey").cast("long")
    blocks = p.select(F.lit("blocks").alias("section"), size.alias("table"), F.concat(F.lit("o"), n.cast("string")).alias("key"), F.lit("x").alias("value"), n.alias("n"))
    target = F.concat_ws(" ", size, F.concat(F.lit("b"), (n % 90).cast("string")))
    return etl.missing_targets(blocks.unionByName(p.select(F.lit("block-aliases").alias("section"), F.lit(None).cast("string").alias("table"), F.concat(F.lit("alias"), n.cast("string")).alias("key"), target.alias("value"), n.alias("n"))))


# Search over operands


@query(f"WITH {OPERANDS} SELECT operand, text FROM a WHERE block = 'Brand#11' AND lower(operand) LIKE 'b%' ORDER BY length(operand), operand, text LIMIT 1000")
def operand_completion(spark, sf_dir):
    return search.block_completion(_operands(spark, sf_dir), "Brand#11", "b")


@query(f"""
WITH {OPERANDS}, w AS (SELECT DISTINCT operand FROM a WHERE lower(operand) = (SELECT min(operand) FROM o)),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY block, operand) AS r FROM a WHERE operand IN (FROM w))
SELECT block, operand, text FROM r WHERE r = 1""")
def operand_owners(spark, sf_dir):
    """The blocks of an operand, one for each text."""
    o = _operands(spark, sf_dir)
    return search.across_blocks(o, o.agg(F.min(F.lower("operand"))).first()[0] or "")


@query(f"""
WITH {OPERANDS}, f AS (SELECT p_type AS text, count(*) AS uses FROM part GROUP BY p_type),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY block, operand) AS r FROM a WHERE lower(operand) = (SELECT min(operand) FROM o))
SELECT operand, text, CASE WHEN uses > 3 THEN uses ELSE 0 END AS uses FROM r LEFT JOIN f USING (text) WHERE r = 1""")
def homophones_by_use(spark, sf_dir):
    o = _operands(spark, sf_dir)
    uses = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("text")).agg(F.count("*").alias("uses")).where("uses > 3")
    return search.homophones(o, o.agg(F.min(F.lower("operand"))).first()[0] or "", uses)
