"""The training-data pipeline: stages over `documents`, each written as Parquet and read again by the next.

1. quality: documents whose calibrated quality score is below 0.5 go;
2. lines: near-equal lines of the corpus stay once, documents left without text go;
3. near duplicates: one document of each group stays;
4. mixing: documents are sampled by probabilities raked to source, language and topic targets;
5. encoding: the pieces of each text, and whether they decode to it.

A stage gets all that the one before kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeweave.llm import line_dedup, mixing, near_dedup, quality, sentence_pieces
from runeweave.llm.common import cut, read, shared_path, with_side
from runeweave.llm.queries import PIECES

#: Score below which a document is rejected.
QUALITY = 0.5
#: Power of the tokens in the mixing targets, as in op10: rare sources, languages and topics rise.
POWER = 0.7
#: Share of the tokens by which the mix may miss its targets, so that a cell of a few documents does not set the rates of all others.
SPARE = 0.001


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.classify(docs, read(spark, sf_dir, "labels"))
    low = cut(scored.where(F.col("score") < QUALITY).select("doc_id").where("doc_id is not null").distinct())
    return with_side(docs, low, "doc_id", "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, power=POWER, spare=SPARE)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, text, ids, round_trip, n_ids)."""
    encoded = sentence_pieces.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), PIECES, same_col="round_trip")
    return encoded.withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: SQL cannot express the classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result goes to the shared folder and is read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
