"""Plain lists that a dictionary is made with: Unicode blocks, common characters, texts, nearest overlay files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codepoints import char


def unicode_blocks(lines: DataFrame) -> DataFrame:
    """(a, z, name) of lines `start..end; name` in column value; comments and blank lines are passed over."""
    part = lambda i: F.regexp_extract("value", r"^([0-9A-Fa-f]+)\.\.([0-9A-Fa-f]+);\s*(.*\S)\s*$", i)
    number = lambda i: F.conv(part(i), 16, 10).cast("int")
    return lines.where(part(1) != "").select(number(1).alias("a"), number(2).alias("z"), part(3).alias("name"))


def common_characters(lines: DataFrame) -> DataFrame:
    """(text, cp) of lines `U+XXXX` and whatever follows a tab, in column value."""
    cp = F.conv(F.regexp_extract("value", r"^[Uu]\+([0-9A-Fa-f]{1,6})(?:\t|$)", 1), 16, 10).cast("int")
    return lines.select(char(cp).alias("text"), cp.alias("cp")).where("text is not null")


def texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def nearest_files(directory: str, name: str, home: str | None = None) -> list[str]:
    """The overlay files of a folder on the driver, of those above it and of the home folder, the nearest first."""
    out, here = [], os.path.abspath(directory)
    while True:
        out.append(os.path.join(here, name))
        if here == os.path.dirname(here):
            break
        here = os.path.dirname(here)
    if home:
        out.append(os.path.join(os.path.abspath(home), name))
    return [p for p in dict.fromkeys(out) if os.path.isfile(p)]


def with_final_newline(text):
    """A text that ends with a line feed."""
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def printable_names(names: DataFrame) -> DataFrame:
    """(name, text) that fit a line of tab-separated values."""
    return names.where(~F.col("text").rlike(r"[\n\t]")).select("name", "text")


def write_names(names: DataFrame, path: str) -> None:
    """A dump of names as tab-separated lines."""
    printable_names(names).select(F.concat_ws("\t", "name", "text").alias("value")).write.mode("overwrite").text(path)
