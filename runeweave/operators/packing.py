"""Numbering and packing of dictionary entries: homophones, priorities, budgets, chunks, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a running sum is taken in.
RANGES = 64


def numbered_homophones(readings: DataFrame, taken: DataFrame) -> DataFrame:
    """(text, reading, key): the k-th holder of a reading, by rank, has the key reading.k, the first the bare reading; numbers whose keys are taken are passed over.

    readings: (text, reading, rank); taken: (key).  Taken numbers of a reading shift those after
    them: the k-th free number is the number itself plus the taken ones up to it.
    """
    order = Window.partitionBy("reading").orderBy("rank", "text")
    holders = readings.withColumn("k", F.row_number().over(order))
    number = F.when(F.col("key").rlike(r"\.[0-9]+$"), F.regexp_extract("key", r"\.([0-9]+)$", 1).cast("int")).otherwise(1)
    barred = taken.select(F.regexp_replace("key", r"\.[0-9]+$", "").alias("reading"), number.alias("number")).groupBy("reading").agg(F.array_sort(F.collect_set("number")).alias("barred"))
    free = F.aggregate(F.coalesce("barred", F.array().cast("array<int>")), F.col("k"), lambda k, b: F.when(b <= k, k + 1).otherwise(k))
    x = holders.join(barred, "reading", "left").withColumn("k", free)
    return x.select("text", "reading", F.when(F.col("k") == 1, F.col("reading")).otherwise(F.concat_ws(".", "reading", "k")).alias("key"))


def firsts_first(readings: DataFrame) -> DataFrame:
    """(text, reading, rank) of characters with several readings: all first ones before all second ones. readings: (text, readings array, rank)."""
    x = readings.select("text", F.col("rank").alias("own"), F.posexplode("readings").alias("at", "reading"))
    return x.select("text", "reading", F.struct("at", "own", "text").alias("rank"))


def interleaved(*parts: DataFrame) -> DataFrame:
    """(text, part, rank) of priority lists put one after the other, each text where it comes first. parts: (text, rank)."""
    rows = reduce(DataFrame.unionByName, [p.select("text", F.lit(i).alias("part"), F.col("rank").cast("long").alias("rank")) for i, p in enumerate(parts)])
    return rows.groupBy("text").agg(F.min(F.struct("part", "rank")).alias("m")).select("text", "m.part", "m.rank")


def within_budget(entries: DataFrame, size: Column, budget: int, *order: str) -> DataFrame:
    """The entries, in order, whose sizes together stay within a budget: up to the first that exceeds it.

    The sum runs in two steps, over ranges of the order and then within each, so that no task has all rows.
    """
    x = entries.withColumn("__size", size.cast("long")).repartitionByRange(RANGES, *order).withColumn("__range", F.spark_partition_id())
    x = x.persist()
    sums = x.groupBy("__range").agg(F.sum("__size").alias("s")).withColumn("__before", F.coalesce(F.sum("s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inside = F.sum("__size").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = x.join(F.broadcast(sums.where(F.col("__before") <= budget)), "__range").withColumn("__to", F.col("__before") + inside)
    return out.where(F.col("__to") <= budget).drop("__size", "__range", "__before", "__to")


def chunk_of(keys: DataFrame, hash_col: str, starts: list[int]) -> DataFrame:
    """keys with `chunk`: the place of the last start that is not beyond the hash, null before the first. starts: ascending, a manifest's few thousand at most."""
    listed = F.array(*map(F.lit, starts))
    n = F.size(F.filter(listed, lambda s: s <= F.col(hash_col)))
    return keys.withColumn("chunk", F.when(n > 0, n - 1))


def by_hash_range(entries: DataFrame, hash_col: str, size: Column, width: int) -> DataFrame:
    """(chunk, n, bytes) of entries by ranges of their hash."""
    return entries.groupBy(F.floor(F.col(hash_col) / width).alias("chunk")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def boundary_samples(entries: DataFrame, group: str, order: str) -> DataFrame:
    """The first, the middle and the last entry of each group, with `place`."""
    within, all_ = Window.partitionBy(group).orderBy(order), Window.partitionBy(group)
    x = entries.withColumn("__i", F.row_number().over(within)).withColumn("__n", F.count("*").over(all_))
    place = F.when(F.col("__i") == 1, "first").when(F.col("__i") == F.col("__n"), "last").when(F.col("__i") == F.floor((F.col("__n") + 1) / 2), "middle")
    return x.withColumn("place", place).where("place is not null").drop("__i", "__n")


def common_everywhere(character: Column, name: Column) -> Column:
    """Whether a character is common in texts of all scripts: neither letter nor mark, or Latin, Greek or combining by its name."""
    return ~character.rlike(r"^[\p{L}\p{M}]") | name.rlike("(?i)^(latin|greek|combining)")


def shortest(names: DataFrame, group: str, name: str, *values: str) -> DataFrame:
    """The shortest name of each group; of equal ones that of the lowest first character, then by order."""
    rank = F.struct(F.octet_length(name), F.ascii(name), F.col(name), *values)
    return names.groupBy(group).agg(F.min_by(F.struct(name, *values), rank).alias("m")).select(group, "m.*")
