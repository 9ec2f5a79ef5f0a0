"""The stages of the pipeline, and all of it, against brute force on small fixtures."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from runeweave.llm import quality, sentence_pieces
from runeweave.llm.queries import PIECES

from test_texts import closure, shingles, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(3)


def test_encoding_stage_decodes_every_text(spark, monkeypatch):
    texts = ["Hello  world\n aü", "", None, "   ", "日本語 <s>", "a b " * 300_000, "\x00\x01", "tail\n", "mark ▁ here"]
    x = docs(spark, texts)
    rows = {r.doc_id: r for r in corpus_pipeline.encoding_stage(spark, x, "").collect()}
    assert {i: r.round_trip for i, r in rows.items()} == {i: "▁" not in (t or "") for i, t in enumerate(texts)}
    assert rows[5].n_ids == len(rows[5].ids) > 0
    back = {r.doc_id: r.decoded for r in sentence_pieces.decode(spark.createDataFrame(list(rows.values())), PIECES).collect()}
    assert all((back[i] == (t or "")) == rows[i].round_trip for i, t in enumerate(texts))


def crc(text):
    return zlib.crc32(text.encode())


def plain_scores(texts, ids, labels):
    """The classifier written out for all rows at once: least squares, and the isotonic fit by its max-min formula."""
    x = np.array([quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for t in texts])
    use = [(k, labels[i]) for k, i in enumerate(ids) if i in labels and crc(str(i)) % 3 != 1]
    rows, y = np.array([k for k, _ in use]), np.array([v for _, v in use], float)
    fold = np.array([crc(f"{ids[k]}fold") % 4 for k in rows])
    mean, scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-9
    r = np.random.default_rng(11)
    k = x.shape[1]
    frequencies, phases = r.standard_normal((k, 160)) / 3.0, r.uniform(0, 2 * np.pi, 160)
    z = np.clip((x - mean) / scale, -6, 6)
    f = np.hstack([np.cos(z @ frequencies + phases) * np.sqrt(2 / 160), z / 10, np.ones((len(z), 1))])
    fits = fold < 3
    w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))[fits]
    a, target = f[rows][fits], (2 * y - 1)[fits]
    ridge = 1e-3 * len(y) / f.shape[1]
    root = np.sqrt(w)[:, None]
    weights = np.linalg.lstsq(np.vstack([a * root, np.sqrt(ridge) * np.eye(f.shape[1])]), np.concatenate([target * root[:, 0], np.zeros(f.shape[1])]), rcond=None)[0]
    raw = f @ weights
    held, own = raw[rows][~fits], y[~fits]
    bins = np.clip(((held + 2) / 4 * 400).astype(int), 0, 399)
    at = np.array([held[bins == b].mean() for b in np.unique(bins)])
    value = np.array([own[bins == b].mean() for b in np.unique(bins)])
    n = np.array([(bins == b).sum() for b in np.unique(bins)])
    over = lambda i, j: (value[i : j + 1] * n[i : j + 1]).sum() / n[i : j + 1].sum()
    fit = np.array([max(min(over(i, j) for j in range(m, len(n))) for i in range(m + 1)) for m in range(len(n))])
    levels = [v for i, v in enumerate(fit) if i == 0 or abs(v - fit[i - 1]) > 1e-12]
    places = [np.average(at[np.abs(fit - v) < 1e-12], weights=n[np.abs(fit - v) < 1e-12]) for v in levels]
    places = [min(places[0], at[0]) - 1, *places, max(places[-1], at[-1]) + 1]
    levels = [levels[0] - 1e-3, *levels, levels[-1] + 1e-3]
    return np.clip(np.interp(raw, places, 1e-3 + (1 - 2e-3) * np.clip(levels, -1e-3, 1 + 1e-3)), 0, 1)


def plain_lines(rows):
    """Rows without the lines that are near an earlier one."""
    lines = [(i, k, line) for i, t in sorted((r[0], r[1]) for r in rows if r[1] is not None) for k, line in enumerate(t.split("\n")) if line.strip()]
    distinct = list(dict.fromkeys(x[2] for x in lines))
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in distinct]
    roots = dict(zip(distinct, closure(len(distinct), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))))
    first, out = {}, []
    for i, k, line in lines:
        first.setdefault(roots[line], (i, k))
    gone = {(i, k) for i, k, line in lines if first[roots[line]] != (i, k)}
    for i, t, *rest, n in rows:
        lost = [k for j, k in gone if j == i]
        kept = t if not lost else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost)
        if not lost or kept.strip():
            out.append((i, kept, *rest, len(kept) if lost else n))
    return out


def plain_near(rows):
    sets = [shingles(r[1], 5) for r in rows]
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    roots = closure(len(rows), lambda i, j: sets[order[i]] and sets[order[j]] and 100 * len(sets[order[i]] & sets[order[j]]) >= 80 * len(sets[order[i]] | sets[order[j]]))
    return [rows[order[i]] for i in range(len(rows)) if roots[i] == i]


def plain_mixing(rows):
    """Raking over cells in a dictionary, draws by the hash of the id."""
    def topic(t):
        t = t or ""
        marks = (("All rights reserved" in t or "licensed under" in t, "notice"), (re.search(r"[#$%&*]{3}", t) is not None, "marked"), (" | " in t, "table"), ("!!" in t, "shouted"))
        return next((k for yes, k in marks if yes), "prose")

    cell = {r[0]: (r[3] or "", r[2] or "", topic(r[1])) for r in rows}
    tokens = {}
    for r in rows:
        tokens[cell[r[0]]] = tokens.get(cell[r[0]], 0) + len((r[1] or "").split())
    total, weight = sum(tokens.values()), dict(tokens)
    by = lambda m, w: {v: sum(x for c, x in w.items() if c[m] == v) for v in {c[m] for c in w}}
    goals = []
    for m in range(3):
        raised = {v: n**corpus_pipeline.POWER for v, n in by(m, tokens).items()}
        goals.append({v: total * x / sum(raised.values()) for v, x in raised.items()})
    for _ in range(12):
        for m in range(3):
            have = by(m, weight)
            weight = {c: x * goals[m][c[m]] / have[c[m]] if have[c[m]] else 0.0 for c, x in weight.items()}
    rate = {c: weight[c] / n for c, n in tokens.items() if n}
    p = {c: rate[c] / max(rate.values()) if c in rate else 1.0 for c in tokens}
    return [r for r in rows if int(hashlib.md5(f"mix{r[0]}".encode()).hexdigest()[:12], 16) / 2**48 < p[cell[r[0]]]]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and bad documents, near and exact copies, repeated lines, a null, an empty and a long text."""
    r = random.Random(12)
    texts = []
    for i in range(150):
        texts.append("\n".join(words(r.randint(8, 30), 3 * i + k).capitalize() + "." for k in range(3)))
        texts.append(" ".join(w + r.choice(["###", "$$$"]) for w in words(r.randint(20, 60), 5000 + i).split()))
    long_ = words(3000, 77)
    texts += [long_, long_ + " end", texts[0], texts[2] + " more", texts[4].split("\n")[0] + "\n" + words(15, 9999), None, "", " \n"]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = {i: 1 - i % 2 for i in range(300) if i % 7}
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


def test_quality_scores_are_those_of_the_plain_fit(spark, corpus):
    folder, rows, labels = corpus
    got = {r.doc_id: r.score for r in quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    want = plain_scores([r[1] for r in rows], [r[0] for r in rows], labels)
    assert max(abs(got[r[0]] - want[k]) for k, r in enumerate(rows)) < 1e-4


def test_whole_pipeline(spark, corpus):
    folder, rows, labels = corpus
    scores = plain_scores([r[1] for r in rows], [r[0] for r in rows], labels)
    want = plain_mixing(plain_near(plain_lines([r for k, r in enumerate(rows) if scores[k] >= 0.5])))
    out = corpus_pipeline.run(spark, folder)
    got = {r.doc_id: r for r in out.collect()}
    assert {i: (r.text, r.lang, r.source, r.n_chars) for i, r in got.items()} == {r[0]: tuple(r[1:]) for r in want}
    assert 60 < len(got) < 250 and all(r.round_trip and r.n_ids == len(r.ids) for r in got.values())
    back = {r.doc_id: r.decoded for r in sentence_pieces.decode(out, PIECES).collect()}
    assert all(back[i] == (r.text or "") for i, r in got.items())


def test_empty_pipeline(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "ids", "round_trip"} <= set(out.columns)


def test_mixing_stage_moves_the_shares_and_keeps_the_corpus(spark):
    texts = [words(30, i) for i in range(1999)] + ["licensed under it"]
    langs = ["es" if i % 10 == 0 else "en" for i in range(1999)] + ["en"]
    x = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(zip(texts, langs))], DOCS).repartition(3)
    kept = [(r.doc_id, r.lang) for r in corpus_pipeline.mixing_stage(spark, x, "").collect()]
    share = 0.1**0.7 / (0.1**0.7 + 0.9**0.7)
    assert abs(sum(lang == "es" for _, lang in kept) / len(kept) - share) < 0.03  # 0.177 instead of 0.1
    assert len(kept) > 900 and {i for i in range(0, 1999, 10)} | {1999} <= {i for i, _ in kept}
