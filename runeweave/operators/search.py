"""Dictionary search: completion, description, first-wins merges, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import endings
from ..plans.format import FILLERS

#: Rows of a completion.
MOST = 1000


def first_wins(entries: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key."""
    ranked = entries.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("__r = 1").drop("__r")


def last_wins(entries: DataFrame, key: str, order: str) -> DataFrame:
    return first_wins(entries, key, F.desc(order))


def prefix_completion(names: DataFrame, typed: str, most: int = MOST) -> DataFrame:
    """(item, size, sample): names that begin with the typed text in any case, folded by the next hyphenated segment; shortest first."""
    low = F.lower("name")
    found = names.where(low.startswith(typed.lower()))
    rest = F.substring(F.col("name"), len(typed) + 1, 1 << 20)
    item = F.concat(F.substring("name", 1, len(typed)), F.regexp_extract(rest, "^[^-]*-?", 0))
    return found.groupBy(item.alias("item")).agg(F.count("*").alias("size"), F.min_by("text", F.struct(F.length("name"), F.col("name"))).alias("sample")).orderBy(F.length("item"), "item").limit(most)


def loose_completion(names: DataFrame, typed: str, most: int = MOST) -> DataFrame:
    """(name, text, rank): names that begin with the typed text once a filler word is dropped (0), or whose later segment does (1)."""
    low, typed = F.lower("name"), typed.lower()
    shorter = F.array_distinct(F.array(*[F.regexp_replace(low, f"-{f}(?=-|$)", "") for f in FILLERS]))
    dropped = F.exists(shorter, lambda n: n.startswith(typed)) & ~low.startswith(typed)
    later = F.exists(F.coalesce(F.when(low.contains("-"), endings(low)), F.array().cast("array<string>")), lambda e: e.startswith(typed)) & ~low.startswith(typed)
    ranked = names.withColumn("rank", F.when(dropped, 0).when(later, 1)).where(F.col("rank").isNotNull() & F.lit(len(typed) >= 3))
    return ranked.orderBy("rank", F.length("name"), F.ascii("text"), "name").select("name", "text", "rank").limit(most)


def block_completion(operands: DataFrame, block: str, typed: str, most: int = MOST) -> DataFrame:
    """(operand, text) of a block that begin with the typed text, shortest first."""
    return operands.where((F.col("block") == block) & F.lower("operand").startswith(typed.lower())).select("operand", "text").orderBy(F.length("operand"), "operand", "text").limit(most)


def across_blocks(operands: DataFrame, typed: str) -> DataFrame:
    """(block, operand, text) of an operand in all blocks, one for each text."""
    found = operands.where(F.lower("operand") == typed.lower())
    return first_wins(found, "text", "block", "operand")


def describe(characters: DataFrame, chars: DataFrame, names: DataFrame) -> DataFrame:
    """(text, code_points, tag, other_names) of each row of characters(text)."""
    points = F.array_join(F.transform(F.split("text", ""), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))), " ")
    other = names.groupBy("text").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("other_names"))
    tag = F.when(F.col("form").isNotNull(), F.concat(F.lit("<:"), "form", F.lit(">")))
    return characters.join(F.broadcast(chars), "text", "left").join(F.broadcast(other), "text", "left").select("text", points.alias("code_points"), tag.alias("tag"), "other_names")


def open_tag(text: Column) -> Column:
    """The tag that is being typed at the end of a text: what follows the last <: without a >."""
    typed = F.regexp_extract(text, r"<:([^<>]*)$", 1)
    return F.when(text.rlike(r"<:[^<>]*$"), typed)


def tag_to_close(text: Column, blocks: Column) -> Column:
    """The block that is open at the end of a text; blocks: an array of block words. Openers do not nest and any closer closes."""
    events = F.regexp_extract_all(text, F.lit(r"<:([^>]*)>"), F.lit(1))
    scopes = F.filter(events, lambda e: (e == "") | e.startswith("/") | F.array_contains(blocks, e))
    last = F.element_at(scopes, -1)
    return F.when(F.size(scopes) > 0, F.when((last != "") & ~last.startswith("/"), last))


def reference_counts(pages: DataFrame, html: str, names: DataFrame) -> DataFrame:
    """(name, text, n) of the character references in a column; text is null for names that are not in names(name, text)."""
    found = pages.select(F.explode(F.regexp_extract_all(html, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1))).alias("name"))
    return found.groupBy("name").agg(F.count("*").alias("n")).join(names, "name", "left").select("name", "text", "n")


def in_blocks(characters: DataFrame, blocks: DataFrame) -> DataFrame:
    """characters(cp, ...) with the `name` of the Unicode block, null outside the blocks(a, z, name): a few hundred ranges, broadcast."""
    return characters.join(F.broadcast(blocks), F.col("cp").between(F.col("a"), F.col("z")), "left").drop("a", "z")


def scopes(tokens: DataFrame, group: str, order: str, event: Column) -> DataFrame:
    """tokens with `scope`: the last opener before each, empty after a closer. event: the opener's word, "" for a closer, null for other tokens."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("scope", F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit("")))


def kinds(entries: DataFrame) -> DataFrame:
    """(name, kind, word, text) of composite names: `block operand`, `block *control`, a block's own `block ` and plain names."""
    word, rest = F.substring_index("name", " ", 1), F.expr("substring(name, instr(name, ' ') + 1)")
    kind = F.when(~F.col("name").contains(" "), "name").when(rest == "", "block").when(rest.startswith("*"), "control").otherwise("operand")
    return entries.select("name", kind.alias("kind"), F.when(F.col("name").contains(" "), word).alias("word"), "text")


def without_twins(operands: DataFrame) -> DataFrame:
    """(block, operand, text) without operands in lower case whose text another spelling of the block has."""
    cased = operands.where(F.col("operand") != F.lower("operand")).select("block", F.lower("operand").alias("operand"), "text").distinct()
    return operands.join(cased, ["block", "operand", "text"], "left_anti")


def group_summary(operands: DataFrame, samples: int = 3) -> DataFrame:
    """(block, size, samples): how many operands a block has, and the texts of the shortest ones."""
    rank = Window.partitionBy("block").orderBy(F.length("operand"), "operand", "text")
    x = operands.withColumn("r", F.row_number().over(rank))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= samples, F.struct("r", "text")))), lambda s: s["text"]), " ")
    return x.groupBy("block").agg(F.count("*").alias("size"), first.alias("samples"))


def borrowed(operands: DataFrame, block: str, alias: str) -> DataFrame:
    """The operands of a block under an alias that is read but never written."""
    return operands.where(F.col("block") == block).withColumn("block", F.lit(alias)).withColumn("one_way", F.lit(True))


def homophones(operands: DataFrame, typed: str, frequency: DataFrame) -> DataFrame:
    """(operand, text, uses) of an operand and its numbered homophones in all blocks, the most frequent text first. frequency: (text, uses)."""
    base = F.regexp_replace(F.lower("operand"), r"\.[0-9]+$", "")
    x = first_wins(operands.where(base == typed.lower()), "text", "block", "operand")
    return x.join(frequency, "text", "left").select("operand", "text", F.coalesce("uses", F.lit(0)).cast("long").alias("uses")).orderBy(F.desc("uses"), "operand")
