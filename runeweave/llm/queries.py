"""The queries opN_<name> over a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, mixing, near_dedup, personal_data, quality, sentence_pieces, sharding, substring_dedup
from .common import read
from .multi_index import nearest
from .topk_search import top_k

#: Vocabulary of the encoding.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the compacted store: each document once, from a file of the last manifest."""
    _, rows = sharding.arrive_and_compact(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


ORACLES["op2_size_tiered_compaction"] = """
SELECT doc_id, lang, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(read(spark, sf_dir, "documents"))


@query
def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


@query
def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(read(spark, sf_dir, "documents"))


@query
def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(read(spark, sf_dir, "documents"), PIECES)


@query
def op7_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(read(spark, sf_dir, "documents"))


@query
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


@query
def op9_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(read(spark, sf_dir, "documents"), size=3, numerator=85)


@query
def op10_proportional_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents")).withColumn("p", F.round("p", 6))


ORACLES["op8_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(q.e, lambda x, i: x * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES["op9_super_minhash"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) END AS g FROM t
), n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN m ON m.id = n.doc_id
"""


def _mixing_sql() -> str:
    """Raking written out: a common table expression for each margin of each round."""
    steps, last = [], "w"
    for r in range(mixing.ROUNDS):
        for m in mixing.MARGINS:
            steps.append(f"{m}{r} AS (SELECT * REPLACE (weight * {m}_share * total / sum(weight) OVER (PARTITION BY {m}) AS weight) FROM {last})")
            last = f"{m}{r}"
    shares = ", ".join(f"t_{m} AS (SELECT {m}, pow(sum(tokens), 0.7) / sum(pow(sum(tokens), 0.7)) OVER () AS {m}_share FROM c GROUP BY {m})" for m in mixing.MARGINS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN text LIKE '%All rights reserved%' OR text LIKE '%licensed under%' THEN 'notice' WHEN regexp_matches(text, '[#$%&*]{{3}}') THEN 'marked'
      WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shouted' ELSE 'prose' END AS topic,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '')) AS BIGINT) AS tokens
  FROM documents
), c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL), {shares},
w AS (SELECT *, tokens AS weight, sum(tokens) OVER () AS total FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
{", ".join(steps)},
p AS (SELECT source, lang, topic, (weight / tokens) / max(weight / tokens) OVER () AS p FROM {last})
SELECT doc_id, source, lang, topic, d.tokens, round(p, 6) AS p,
  CAST(('0x' || substr(md5('mix' || CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) / 281474976710656.0 < p AS kept
FROM d JOIN p USING (source, lang, topic)
"""


ORACLES["op10_proportional_fitting"] = _mixing_sql()
