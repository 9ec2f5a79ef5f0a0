"""Queries over the whole of their tables, against brute force on small folders."""

import re

import pytest

from runeweave.plans.dictionary import default
from runeweave.queries import QUERIES

STYLES = ("bold", "italic", "bold-italic", "script", "bold-script", "fracture", "bold-fracture", "double", "sans", "sans-bold", "sans-italic", "sans-bold-italic", "monospace")


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("styles"))
    texts = ["Short one.", "", None, "12 !", "The quick brown fox, " * 9 + "then Z", "Jumps over 7 lazy dogs; " * 400 + "end Q"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder, texts


@pytest.mark.parametrize(("name", "block"), [(f"{b.replace('-', '_')}_block", b) for b in STYLES] + [("fracture_native", "fracture")])
def test_styles_reach_the_end_of_each_text(spark, long_texts, name, block):
    folder, texts = long_texts
    forms = default().blocks[block].forms
    got = {r.doc_id: r.styled for r in QUERIES[name](spark, folder).collect()}
    assert got == {i: None if t is None else "".join(f"{forms.get(c, c)} " for c in re.sub("[^A-Za-z]", "", t)) for i, t in enumerate(texts)}


def test_ideographs_of_all_events(spark, tmp_path):
    ids = [0, 19999, 20000, 20991, 20992, 99999]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.name, r.text) for r in QUERIES["cjk_algorithmic"](spark, str(tmp_path)).collect())
    assert got == sorted((f"CJK UNIFIED IDEOGRAPH-{0x4E00 + i % 20992:04X}", chr(0x4E00 + i % 20992)) for i in ids)
