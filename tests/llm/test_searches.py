"""Vector searches against brute force."""

import numpy as np
import pytest

from runeweave.llm.multi_index import nearest
from runeweave.llm.topk_search import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, n=400, d=16, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    rows = [(i, x[i].tolist(), i % 3) for i in range(n)]
    rows += [(5000, rows[7][1], 0), (5001, rows[7][1], 0), (5002, None, 0), (5003, [float("nan")] * d, 0), (5004, [None] * d, 0), (5050, [0.0] * d, 0), (None, rows[3][1], 0), (5006, [], 0), (5100, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def usable(rows, zero):
    out = {}
    for i, v, _ in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v)):
            out[i] = np.array(v, np.float64)
    return out


def test_exact_top_k(spark):
    df, rows = table(spark)
    own = usable(rows, True)
    got = {}
    for r in top_k(df.withColumn("score", df.label).withColumn("rank", df.label)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {}
    for q in own:
        if q % 100 == 0:
            s = [(-int(np.floor(1024 * own[q]) @ np.floor(1024 * own[i])), i) for i in own if i != q and len(own[i]) == len(own[q])]
            if s:
                want[q] = [(k + 1, i, -x) for k, (x, i) in enumerate(sorted(s)[:10])]
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_change_nothing(spark, block):
    df, _ = table(spark)
    assert sorted(map(tuple, top_k(df, block=block).collect())) == sorted(map(tuple, top_k(df).collect()))


def test_huge_components(spark):
    df = spark.createDataFrame([(0, [1e30, 2.0], 0), (1, [3.0, 1.0], 0), (2, [-1e30, 0.0], 0)], SCHEMA)
    assert [(r.vec_id, r.score) for r in top_k(df).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert top_k(none).count() == 0 and nearest(none).count() == 0


def test_nearest_recall_and_order(spark):
    df, rows = table(spark, 1500, 32)
    own = usable(rows, False)
    got = {}
    for r in nearest(df, sample_rows=600).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for q in [q for q in own if q % 50 == 0 and len(own[q]) == 32]:
        best = sorted((-round(cos(own[q], own[i]), 12), i) for i in own if i != q and len(own[i]) == 32)[:5]
        assert len(got[q]) == 5
        for i, s in got[q]:
            assert abs(s - cos(own[q], own[i])) < 1e-12
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        hit += len({i for _, i in best} & {i for i, _ in got[q]})
        total += 5
    assert hit / total >= 0.9
    assert 5050 not in got and 5100 not in got


def test_queries_with_few_rows_in_the_radius_are_searched_again(spark):
    df, rows = table(spark, 200, 16, 4)
    from runeweave.llm import multi_index

    near = multi_index.nearest(df, reach=0.0, sample_rows=64)  # a radius that hardly any row is in
    own = usable(rows, False)
    want = {q: min(5, sum(len(own[i]) == len(own[q]) for i in own) - 1) for q in own if q % 50 == 0}
    got = {r.query_id: r.n for r in near.groupBy("query_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {q: n for q, n in want.items() if n}


def test_cutoffs_that_a_double_may_round_are_off():
    from runeweave.llm.topk_search import _cutoff

    assert _cutoff(float(1 << 54), [0.0]) == (-np.inf, [0.0]) and _cutoff(7.0, [1.0]) == (7.0, [1.0])
