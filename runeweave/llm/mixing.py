"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights of the cells (source, language, topic) are raked until their sums over each source,
each language and each topic have the target shares: one margin after the other is scaled to its
targets.  A document is then kept with the probability weight / tokens of its cell, scaled so that
the cell that is wanted most keeps all it has; the draw is a hash of the id, the same on every run
and for every order of rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_enough

#: Rounds over all margins at least and at most, and of those the rounds in one job.
ROUNDS = 12
MOST_ROUNDS = 96
A_JOB = 3
#: Share of all tokens that a margin may be off its target.
TOLERANCE = 1e-6
MARGINS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A topic for documents that have none: the form of the text, by its first kind of mark."""
    return (
        F.when(text.contains("All rights reserved") | text.contains("licensed under"), "notice")
        .when(text.rlike(r"[#$%&*]{3}"), "marked")
        .when(text.contains(" | "), "table")
        .when(text.contains("!!"), "shouted")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """White-space separated words."""
    return F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def targets(cells: DataFrame, margin: str, given: dict[str, float] | None, power: float) -> DataFrame:
    """(margin, share): the given weights of the values that occur, or the tokens to the given power, as shares."""
    x = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens"))
    if given is None:
        weight = F.pow(F.col("tokens").cast("double"), F.lit(power))
    else:
        weight = F.coalesce(*[F.when(F.col(margin) == k, float(v)) for k, v in given.items()], F.lit(0.0))
    x = x.withColumn("weight", weight)
    return x.crossJoin(F.broadcast(x.agg(F.sum("weight").alias("all")))).select(margin, F.when(F.col("all") > 0, F.col("weight") / F.col("all")).otherwise(0.0).alias(f"{margin}_share"))


def rake(cells: DataFrame, given: dict[str, dict[str, float]] | None = None, power: float = 0.7, rounds: int = ROUNDS, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with `weight`: raked to the margins' shares of all tokens. A margin's value with no tokens or no weight gets none.

    After `rounds` rounds, more follow until no margin is off by more than the tolerance; targets
    that cannot be met together (a share for cells without tokens) are left off with a warning.
    """
    x = cells
    for m in MARGINS:
        x = x.join(targets(cells, m, (given or {}).get(m), power), m)
    total = F.broadcast(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")))
    x = cut(x.crossJoin(total).withColumn("weight", F.col("tokens").cast("double")))
    done = 0
    while True:
        for _ in range(A_JOB):
            for m in MARGINS:
                have = F.sum("weight").over(Window.partitionBy(m))
                x = x.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"{m}_share") * F.col("total") / have).otherwise(0.0))
            done += 1
        x = cut(x)
        if done >= rounds:
            off = residual(x)
            if off <= tolerance:
                break
            if done >= most:
                warnings.warn(f"margins are off by up to {off:.3g} of all tokens after {done} rounds", stacklevel=2)
                break
    return x.select(*MARGINS, "tokens", "weight")


def residual(raked: DataFrame) -> float:
    """The most that a margin's share is off its target."""
    off = [raked.groupBy(m).agg(F.abs(F.sum("weight") / F.max("total") - F.max(f"{m}_share")).alias("off")).select("off") for m in MARGINS]
    return off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max(F.coalesce("off", F.lit(0.0)))).first()[0] or 0.0


def probabilities(raked: DataFrame, spare: float = 0.0) -> DataFrame:
    """(source, lang, topic, p): the largest rates with the raked proportions; cells without tokens have rate 1, as they weigh nothing.

    The cells wanted most that together have at most the share `spare` of the weights do not set the
    scale: they keep all they have, which is less than their share, instead of pulling all others down.
    """
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    x = raked.withColumn("rate", rate)
    sets = F.lit(True)
    if spare:
        # One task, over the cells.
        upto = F.sum("weight").over(Window.orderBy(F.desc_nulls_last("rate"), *MARGINS))
        x = cut(x.withColumn("upto", upto).crossJoin(F.broadcast(raked.agg(F.sum("weight").alias("all")))))
        sets = F.col("upto") > spare * F.col("all")
    most = F.broadcast(x.where(sets).agg(F.max("rate").alias("most")))
    p = F.when(F.col("most") > 0, F.least(F.lit(1.0), F.col("rate") / F.col("most"))).otherwise(0.0)
    return x.crossJoin(most).select(*MARGINS, F.when(F.col("rate").isNull(), 1.0).otherwise(p).alias("p"))


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) for an id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mixed(docs: DataFrame, given: dict[str, dict[str, float]] | None = None, power: float = 0.7, topic: Column | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, topic, tokens, p, kept) of each row of docs.

    Null sources and languages are a value of their own, written "". A null or empty text has no
    tokens and is drawn at its cell's rate like any other.  Without given weights a margin's shares follow its tokens to `power`, which
    raises rare values.  Rows that repeat an id are kept or not together if their cells are the
    same.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    x = docs.select(F.col(id_col), value("source").alias("source"), value("lang").alias("lang"), F.coalesce((topic_of(text) if topic is None else topic).cast("string"), F.lit("")).alias("topic"), tokens_of(text).alias("tokens"))
    x = cut(x)
    cells = cut(x.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    p = cut(probabilities(rake(cells, given, power)))
    out = x.join(F.broadcast(p) if small_enough(p) else p, list(MARGINS))
    return out.withColumn("kept", draw(F.col(id_col), seed) < F.col("p"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, seed: str = "mix", given: dict[str, dict[str, float]] | None = None, power: float = 0.7, spare: float = 0.0) -> DataFrame:
    """docs with the rows that `mixed` keeps, all columns as they were: decided in the row, from the cell's rate; `spare` as for `probabilities`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cell = {"source": value("source"), "lang": value("lang"), "topic": F.coalesce((topic_of(text) if topic is None else topic).cast("string"), F.lit(""))}
    cells = cut(docs.select(*[c.alias(k) for k, c in cell.items()], tokens_of(text).alias("tokens")).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    p = cut(probabilities(rake(cells, given, power), spare)).select(F.struct(*MARGINS).alias("__cell"), "p")
    keyed = docs.withColumn("__cell", F.struct(*[c.alias(k) for k, c in cell.items()]))
    return keyed.join(F.broadcast(p) if small_enough(p) else p, "__cell").where(draw(F.col(id_col), seed) < F.col("p")).select(*docs.columns)
