"""Every query of the subpackage over tables with nulls, empty and very long texts, repeated rows and extra columns, and over empty ones."""

import random

import pytest
from pyspark.sql import functions as F

from runeweave.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"
LABELS = "doc_id long, quality int, toxic int"
#: Names that operators give to columns of their own.
CLASHES = ("score", "predicted", "held_out", "spans", "n_lines", "n_removed", "kept", "h", "key", "node", "ids", "rank", "query_id", "p", "tokens", "topic", "value", "start", "n_bytes", "part", "pairs")


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def documents():
    rows = [(i, words(40, i) + f"\nmail me at u{i}@example.org or 10.0.0.{i}\n" + words(30, i + 500), ["en", "de", None][i % 3], ["a", "b", None, ""][i % 4], 1) for i in range(60)]
    rows += [(100, None, "en", "a", None), (101, "", "en", "a", 0), (102, " \n\t\n", None, None, 4), (103, words(60_000, 9), "en", "b", 1)]
    rows += [rows[5], rows[5], (6, "another text of the sixth id\n" + rows[7][1].split("\n")[0], "en", "a", 1), (104, rows[8][1], "en", "a", 1)]
    return rows


def write(spark, folder, docs, vectors, labels, extra=True):
    for name, rows, schema in (("documents", docs, DOCS), ("embeddings", vectors, VECTORS), ("labels", labels, LABELS)):
        df = spark.createDataFrame(rows, schema)
        if extra:
            df = df.select("*", *[F.lit(7).alias(c) for c in CLASHES])
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return f"file://{folder}"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(3)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)], i) for i in range(300)]
    vectors += [vectors[50], (301, vectors[50][1], None), (350, None, 0), (400, [0.0] * 8, 0), (450, [], 0), (None, vectors[0][1], 0)]
    labels = [(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, 1, None), (999, None, 0)]
    return write(spark, tmp_path_factory.mktemp("edges"), documents(), vectors, labels)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], extra=False)


@pytest.mark.parametrize("name", QUERIES)
def test_edge_rows(spark, tables, name):
    out = QUERIES[name](spark, tables)
    rows = out.collect()
    assert len(out.columns) == len(set(out.columns))
    if "doc_id" in out.columns:
        assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in documents())
        same = [r for r in rows if r.doc_id == 5]
        assert len(same) == 3 and len(set(map(str, same))) == 1  # repeated rows have the same result
    else:
        k = 5 if name.startswith("op4") else 10
        every = 50 if name.startswith("op4") else 100
        queries = {0, 50, 100, 150, 200, 250} if every == 50 else {0, 100, 200, 400}
        assert {r.query_id for r in rows} == queries and all(r.query_id != r.vec_id for r in rows)
        assert min(sum(r.query_id == q for r in rows) for q in queries) >= k


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, tables, name):
    out = QUERIES[name](spark, empty)
    assert out.count() == 0
    assert set(out.columns) == set(QUERIES[name](spark, tables).columns)
