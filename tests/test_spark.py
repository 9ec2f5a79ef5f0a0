"""Column functions, sources, streams and the registry."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runeweave.functions import text as T
from runeweave.functions.codepoints import char, code_point_value
from runeweave.operators import search
from runeweave.operators.columns import Engine
from runeweave.operators.converter import Converter
from runeweave.plans.dictionary import default, differences
from runeweave.sources import entity_files
from runeweave.streaming.convert import converted, drain

TEXTS = ["", "plain", "é x", "\\é", "a <: b", "αx β-", "𝔄", "x\\U1F60D", "日本語 text", None]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_columns_agree_with_the_converter(spark, engine):
    c = Converter(default())
    x = frame(spark, TEXTS).select("id", engine.to_markup(F.col("text")).alias("m"), engine.to_ascii_markup(F.col("text")).alias("a"))
    for r in x.collect():
        t = TEXTS[r.id]
        assert (r.m, r.a) == ((None, None) if t is None else (c.to_markup(t), c.to_ascii_markup(t)))


def test_native_and_udf_paths_agree(spark, engine):
    x = frame(spark, [t for t in TEXTS if t is not None])
    m = T.escape_ascii(T.escape_markers(F.col("text")))
    for r in x.select("text", T.unescape_codes(m).alias("native"), engine.to_unicode(m).alias("udf")).collect():
        assert r.native == r.text == r.udf


def test_modes(spark, engine):
    x = frame(spark, ["<:none-such-thing> \\:alpha", "<:fracture 7/>"])
    rows = {m: [r.c for r in x.orderBy("id").select(engine.convert(F.col("text"), m).alias("c")).collect()] for m in ("lenient", "warn", "error")}
    assert rows["lenient"][0].text == "<:none-such-thing> α" and rows["lenient"][0].error is None
    assert rows["warn"][0].error.kind == "UnknownEntity" and rows["warn"][1].text == "7"
    assert rows["error"][1].error.kind == "Unsupported"
    assert engine.warnings(x, "text", "id").count() == 2


def test_sql_functions(spark, engine):
    engine.register()
    assert spark.sql(r"SELECT to_unicode('\\:alpha') a, to_markup('α') b").first() == ("α", "\\:alpha")


def test_characters(spark):
    x = spark.createDataFrame([(0x41,), (0xD800,), (0x1F60D,), (0x110000,)], "cp long")
    assert [r[0] for r in x.select(char(F.col("cp"))).collect()] == ["A", None, "😍", None]
    y = spark.createDataFrame([("U+41",), ("0x41",), ("41",), ("0041",), ("u1F60D",), ("zz",)], "t string")
    assert [r[0] for r in y.select(code_point_value(F.col("t"))).collect()] == [0x41, 0x41, None, 0x41, 0x1F60D, None]


def test_entity_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.wasp").write_text('// note\nnames {\n\tone: "1" // x\n}\nblocks {\n\tdots {\n\t\t"*suffix": "\\u{307}"\n\t}\n}\nvirus: 🦠\n')
    (tmp_path / "b" / "c.wasp").write_text("/*\nskip {\n*/\nnames {\n\tone: 2\n\ttwo: 2\n}\n")
    found = entity_files.sections(entity_files.scan(spark, str(tmp_path)))
    assert found == {"names": {"one": "1", "two": "2"}, "blocks": {"dots": {"*suffix": "\u0307"}}, "own": {"virus": "🦠"}}
    with pytest.raises(entity_files.EntityError):
        list(entity_files.parse("a {\n"))


def test_search(spark):
    names = spark.createDataFrame([("greek-small-letter-alpha", "α"), ("greek-small-letter-beta", "β"), ("syriac-letter-taw", "ܬ"), ("great", "g")], "name string, text string")
    assert {(r.item, r["size"]) for r in search.prefix_completion(names, "gre").collect()} == {("greek-", 2), ("great", 1)}
    assert [(r.name, r["rank"]) for r in search.loose_completion(names, "taw").collect()] == [("syriac-letter-taw", 1)]
    assert [(r.name, r["rank"]) for r in search.loose_completion(names, "syriac-t").collect()] == [("syriac-letter-taw", 0)]
    assert differences(names, names, "name", "text").count() == 0
    x = spark.createDataFrame([("<:greek> a <:al",), ("<:greek> a <:>",), ("x",)], "t string")
    rows = x.select(search.tag_to_close(F.col("t"), F.array(F.lit("greek"))).alias("c"), search.open_tag(F.col("t")).alias("o")).collect()
    assert [tuple(r) for r in rows] == [("greek", "al"), (None, None), (None, None)]


def test_dictionary_tables(spark):
    t = default().tables(spark)
    assert t["names"].groupBy("name").count().where("count > 1").count() == 0
    assert t["block_controls"].where("block = 'flip' and arg = 'cjk'").first()["text"] == ""
    assert t["chars"].where(~F.col("text").rlike(r"[^\x00-\x7F]")).count() == 0


def test_stream(spark, engine, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\\:alpha\n<:nothing-at-all>\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    drain(converted(stream, engine), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("converted.text").collect()) == ["<:nothing-at-all>", "α"]


def test_registry_and_plans(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert isinstance(e.entry(spark).limit(1).toPandas(), pd.DataFrame)
    plan = e._own.QUERIES["text_hash"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan
