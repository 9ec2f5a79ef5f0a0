"""Text operators against brute force on small fixtures with nulls, empty and very long texts, ties and repeats."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runeweave.llm import line_dedup, mixing, near_dedup, personal_data, quality, sentence_pieces, sharding, substring_dedup
from runeweave.llm.linking import Links
from runeweave.llm.minhash import super_minhash
from runeweave.llm.queries import PIECES
from runeweave.llm.textstats import char_shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(3)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(n))


def variants(n=60, length=60, seed=3):
    """Copies of one text with one to twelve changed words: near and far from each other."""
    r, base = random.Random(seed), words(length, seed).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(length)] = f"w{i}x{r.randrange(9)}"
        out.append(" ".join(w))
    return out


def closure(n, linked):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return [top(i) for i in range(n)]


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@pytest.mark.parametrize(("size", "numerator"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, numerator):
    texts = [*variants(), None, "", " \t\n", "One two", "one TWO", "one", words(20000, 5), words(20000, 5) + " more", *["copy of a text that is here often"] * 9]
    got = {r.doc_id: r for r in near_dedup.groups(docs(spark, texts), size=size, numerator=numerator).collect()}
    sets = [shingles(t, size) for t in texts]
    roots = closure(len(texts), lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= numerator * len(sets[i] | sets[j]))
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i].kept == (roots[i] == i) for i in range(len(texts)))


def test_near_duplicates_keep_rows_without_id_and_one_of_repeats(spark):
    x = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (2, "A b c d e f", "y")], "doc_id long, text string, kept string")
    assert sorted((r.doc_id or 0) for r in near_dedup.deduplicate(x).collect()) == [0, 1]
    assert near_dedup.groups(x.where("false")).count() == 0


def test_forest_finds_all_links_of_a_group(monkeypatch, spark):
    """Blocks smaller than the group, so that all paths of the linking run."""
    from runeweave.llm import linking

    monkeypatch.setattr(linking, "BLOCK", 7)
    texts = variants(50, 50, 8)
    sets = [set(char_shingles(t, 8).tolist()) for t in texts]
    roots = closure(len(texts), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    shared = spark.createDataFrame([(b, i) for b in (1, 2) for i in range(len(texts))], "band long, node long")
    found = {r.id: r.root for r in Links(lambda t: char_shingles(t, 8), 80, 100).components(shared, spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == roots


def test_super_minhash_estimates_similarity():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 63, 900, np.uint64)
    both = np.concatenate([a[:600], a[300:]])
    s = super_minhash(both, np.repeat([0, 1], 600), 2, 200)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.12
    one = super_minhash(a[:1], np.zeros(1, int), 1, 64)
    assert len(np.unique(one >> np.uint64(56))) == 64


def test_fuzzy_lines(spark):
    base = words(40, 9)
    texts = ["\n".join([base, words(12, i), "short", "", "  "]) for i in range(4)]
    texts += [base[:-1] + "zz\nown line of this text", None, "", "short", "\n\n", words(15000, 4), base + "\n" + base, "x"]
    out = {r.doc_id: r for r in line_dedup.deduplicate(docs(spark, texts).withColumn("gone", F.lit(1))).collect()}
    lines = [(i, k, line) for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n")) if t is not None and line.strip()]
    distinct = list(dict.fromkeys(x[2] for x in lines))
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in distinct]
    roots = dict(zip(distinct, closure(len(distinct), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))))
    first = {}
    for i, k, line in lines:
        first.setdefault(roots[line], (i, k))
    gone = {(i, k) for i, k, line in lines if first[roots[line]] != (i, k)}
    for i, t in enumerate(texts):
        want = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert out[i].text == want and out[i].n_removed == sum(g[0] == i for g in gone)


def removed(texts, length):
    seen: dict[bytes, int] = {}
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        flags = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                flags[i : i + length] = True
        kept = np.frombuffer(r, np.uint8)[~flags].tobytes()
        out.append((len(r), int(flags.sum()), len(substring_dedup.runs(flags)) // 2, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "hot"), [(30, 8192), (30, 1), (11, 3)])
def test_repeated_substrings(spark, length, hot):
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("ab cé") for _ in range(n))
    passage = noise(70)
    texts = [noise(40) + passage + noise(30) for _ in range(6)] + [None, "", passage, passage, "a" * 200, "xy" * 60, passage * 2] + [noise(20) + passage[:25] + noise(10) for _ in range(5)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.digest(docs(spark, texts), length=length, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, length)


def test_repeated_substrings_at_the_contracts_length(spark):
    """Copies around one frequent gram, near and far, at 400 bytes, a long text and repeated rows among them."""
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefgh ijklmnop é") for _ in range(n))
    passage, common = noise(600), noise(120)
    texts = [noise(300) + common + noise(300) for _ in range(40)] + [noise(50) + passage[k:] + noise(80) for k in (0, 0, 90, 260)] + [noise(60_000), None, "", passage, passage, noise(399)]
    want = removed(texts, 400)
    for hot in (2048, 4):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substring_dedup.digest(docs(spark, texts).withColumn("spans", F.lit(1)).withColumn("key", F.lit(2)), hot=hot).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert substring_dedup.digest(docs(spark, texts).where("false")).count() == 0


def test_interval_expansion_gives_the_short_prefixes():
    r = np.random.default_rng(0)
    text = r.integers(1, 4, 400).astype(np.uint16)
    text[-1] = 0
    order, found = substring_dedup.boundaries(text, 6)
    raw = text.astype(np.uint8).tobytes()
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :][:6], raw[order[k] :][:6]
        assert a <= b and found[k] == (a != b)


PERSONAL = ["mail a@b.co or c_d@e.f.gh now", "at 10.0.0.1, 300.1.1.1, 1.2.3.4.5", "card 4539 1488 0343 6467 and 4539-1488-0343-6468", "call +1 (415) 555-0133.", "write to jane.doe (at) mail.org please", None, "", "1" * 5000, "a" * 50000, "x@y" + ".z" * 5000, "order 1234567 on 2019-01-02", "é+33 1 23 45 67 89 é"]


def plain_spans(text):
    out = []
    text = text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_data(spark):
    x = docs(spark, PERSONAL)
    got = {r.doc_id: r for r in personal_data.digest(x).collect()}
    for i, t in enumerate(PERSONAL):
        assert got[i].base_sha256 == hashlib.sha256(plain_spans(t).encode()).hexdigest()
        assert set(filter(None, plain_spans(t).split(","))) <= set(got[i].spans.split(","))
    assert "address" in got[4].spans and got[10].spans == ""
    clean = {r.doc_id: r.text for r in personal_data.redact(x).collect()}
    assert clean[0] == "mail [email] or [email] now" and clean[5] is None and clean[10] == PERSONAL[10]
    assert personal_data.digest(x.where("false")).count() == 0


def test_quality_on_held_out_rows(spark):
    r = random.Random(6)
    good = [words(r.randint(20, 200), i).capitalize() + "." for i in range(300)]
    bad = [" ".join(w + "###" for w in words(r.randint(20, 200), 1000 + i).split()) for i in range(300)]
    texts = [x for pair in zip(good, bad) for x in pair] + [None, "", words(30000, 1)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(600)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in quality.classify(docs(spark, texts), labels).collect()}
    assert len(rows) == len(texts) and all(0 <= x.score <= 1 for x in rows.values())
    held = [i for i in range(600) if rows[i].held_out]
    assert 100 < len(held) < 300 and sum(rows[i].predicted == 1 - i % 2 for i in held) / len(held) > 0.95
    none = quality.classify(docs(spark, texts).where("false"), labels)
    assert none.count() == 0
    flat = quality.classify(docs(spark, texts[:4]), labels.where("false")).collect()
    assert {x.score for x in flat} == {0.5}


def test_mixing_meets_the_margins(spark):
    texts = [words(20 + i % 7, i) + (" | " if i % 5 == 0 else "") for i in range(600)] + [None, ""]
    x = docs(spark, texts)
    given = {"source": {"s0": 0.8, "s1": 0.2}}
    rows = mixing.mixed(x, given).collect()
    by = {s: sum(r.tokens * r.p for r in rows if r.source == s) for s in ("s0", "s1")}
    assert abs(by["s0"] / (by["s0"] + by["s1"]) - 0.8) < 1e-6
    assert max(r.p for r in rows) <= 1 + 1e-12 and len(rows) == len(texts)
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in mixing.sample(x, given=given).collect()} == kept
    assert mixing.mixed(x.where("false")).count() == 0


def test_pieces(spark):
    texts = ["Hello  world\n aü", "", None, "   ", "日本語 <s>", "a" * 3000, words(3000, 2), "\x00\x01", "tail\n", "mark ▁ here"]
    x = docs(spark, texts)
    encoded = sentence_pieces.encode(x, PIECES)
    back = {r.doc_id: r for r in sentence_pieces.decode(encoded, PIECES).collect()}
    model = sentence_pieces.Model.load(spark, PIECES)
    known = {model.pieces[i]: i for i in range(len(model.pieces)) if model.kinds[i] in (1, 4)}
    for i, t in enumerate(texts):
        t = (t or "").replace("▁", " ")
        assert back[i].decoded == t
        raw = (" " + t).encode() if t else b""
        best = [(0.0, None, [])] + [(-np.inf, None, [])] * len(raw)
        for a in range(len(raw)):
            for b in range(a + 1, min(len(raw), a + model.longest) + 1):
                if raw[a:b] in known and best[a][0] + model.scores[known[raw[a:b]]] > best[b][0]:
                    best[b] = (best[a][0] + model.scores[known[raw[a:b]]], a, [known[raw[a:b]]])
            b = a + 1 + (raw[a] >= 0xC0) + (raw[a] >= 0xE0) + (raw[a] >= 0xF0)
            if best[a][0] + model.unknown_score > best[min(b, len(raw))][0]:
                best[b] = (best[a][0] + model.unknown_score, a, [int(model.byte_ids[c]) for c in raw[a:b]])
        ids, at = [], len(raw)
        while at:
            ids, at = best[at][2] + ids, best[at][1]
        assert back[i].ids == ids
    flags = {r.doc_id: r.round_trip for r in sentence_pieces.digest(x, PIECES).collect()}
    assert [i for i in flags if not flags[i]] == [9]


def test_shard_store(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=40_000, small=4_000, fanout=2)
    assert store.read(schema=DOCS).count() == 0 and store.compact() == 0
    texts = [words(60, i) for i in range(400)] + [None, ""]
    x = docs(spark, texts)
    for i in range(4):
        store.append(x.where(f"doc_id % 4 = {i}"))
    before, old = len(store.shards()), store.read(2).count()
    store.compact()
    assert len(store.shards()) < before and old == x.where("doc_id % 4 < 2").count()
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(map(tuple, x.collect()), key=str)
    with pytest.raises(sharding.Conflict):
        store.commit([], store.versions()[-1] - 1)


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, few):
    from runeweave.llm.components import components

    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    parent = list(range(600))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    found = {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    assert all(found.get(i, i) == top(i) for i in range(600))
    assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_addresses_do_not_depend_on_unrelated_marks(spark):
    texts = ["write to joe at example (dot) com", "mail joe at example.com", "write joe at example [dot] org please", "contact ann at example dot net", "meet me at noon."]
    pattern, needs, _ = personal_data.PROPOSED["address"]
    x = docs(spark, texts + [f"{t} ; a @ b" for t in texts])
    got = {r.doc_id: [s.value for s in r.s] for r in x.select("doc_id", personal_data.found(F.col("text"), pattern, needs).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == got[i + len(texts)] == [m[0] for m in re.finditer(pattern, t)]
    assert got[0] == ["joe at example (dot) com"]
    spans = {r.doc_id: r.spans for r in personal_data.digest(x).collect()}
    assert all(spans[i] == spans[i + len(texts)] for i in range(len(texts)))
    assert "address" in spans[0]


def test_lines_of_rows_that_share_an_id(spark):
    x = spark.createDataFrame([(1, "a line that is here twice or more\nfirst"), (2, "a line that is here twice or more\nsecond"), (2, "another text of the same id\nits own line stays"), (2, "another text of the same id\nits own line stays")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.deduplicate(x).collect())
    assert got == [(1, "a line that is here twice or more\nfirst", 0), (2, "another text of the same id\nits own line stays", 0), (2, "another text of the same id\nits own line stays", 0), (2, "second", 1)]
    assert line_dedup.deduplicate(x.where("false")).count() == 0


def test_bands_that_many_share_are_known_at_once():
    from runeweave.llm.linking import PAIR, packed

    nodes = np.arange(50)
    part, pairs = packed(np.stack([np.full(50, 7), (nodes << 33) + nodes + 100], axis=1), nodes, 4)
    assert sum(len(np.frombuffer(p, PAIR)) for p in pairs[:-1]) == 51 and part[-1] is None
    assert sorted(np.frombuffer(pairs[-1], np.int64).reshape(-1, 2)[:, 1].tolist()) == list(range(50))


def test_two_writers_of_a_store(spark, tmp_path):
    x = docs(spark, [words(60, i) for i in range(80)])
    a, b = (sharding.ShardStore(spark, f"file://{tmp_path}/store", target=40_000, small=4_000, fanout=2) for _ in range(2))
    for i in range(3):
        a.append(x.where(f"doc_id % 4 = {i}"))
    written = b._written(x.where("doc_id % 4 = 3"))  # the other writer has not committed yet
    a.compact(reclaim=0)
    a.vacuum(retention=0)
    b._changed(lambda shards: shards + written)
    assert sorted(r.doc_id for r in a.read().collect()) == list(range(80))
    old = a.versions()[-1]
    a.compact()
    assert sorted(r.doc_id for r in a.read(old).collect()) == list(range(80))


def test_mixing_warns_of_targets_that_cannot_be_met(spark):
    x = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="margins are off"):
        mixing.rake(x, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}, most=15)
    raked = mixing.rake(x, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.9, "y": 0.1}})
    assert raked.where("weight is null").count() == 0


PLANTED = [
    ("call me at (743) 555-3824 or", "number:11:25"), ("handy 743-555-3824 und", "number:6:18"), ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" the', "secret:9:49"),
    ("write to jane.doe (at) mail.org please", "address:9:31"), ("mail me: ann at example dot net", "address:9:31"), ("transfer to DE44 5001 0517 5407 3249 31 now", "account:12:39"),
]
CLEAN = ["order 1234567 on 2019-01-02", "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 of", "isbn 978-3-16-148410-0 said", "about 100 000 000 of them", "version 10.2.33.44444 was", "serial 5927243074273350 of", "see chapter-eleven-1999-revised-fo there", "look at that one dot on it"]


def test_planted_variants_are_added_and_others_are_not(spark):
    r = random.Random(3)
    noise = [f"{words(8, i)} +1 ({r.randrange(1000):03}) 555-{r.randrange(10000):04} {words(6, i + 500)} {words(1, i)}.{i}@mail{i % 9}.example.com {words(5, i)} {r.randrange(10**15, 10**16)} on" for i in range(300)]
    x = docs(spark, [t for t, _ in PLANTED] + CLEAN + noise)
    got = {r.doc_id: r.spans for r in personal_data.digest(x).collect()}
    hit = sum(span in got[i].split(",") for i, (_, span) in enumerate(PLANTED))
    false = [CLEAN[i] for i in range(len(CLEAN)) if got[len(PLANTED) + i]]
    print("caught", hit, "of", len(PLANTED), "false", false)
    assert hit >= 5 and len(false) <= 1
    assert all(got[len(PLANTED) + len(CLEAN) + i].count(":") == 4 or "card" in got[len(PLANTED) + len(CLEAN) + i] for i in range(300))


def test_places_of_many_matches_are_in_proportion(spark):
    text = "a1@b.co " * 3000
    x = spark.createDataFrame([(text,), ("",), ("none",)], "text string")
    pattern, needs = personal_data.BASE["email"]
    rows = [r.s for r in x.select(personal_data.found(F.col("text"), pattern, needs).alias("s")).collect()]
    assert [(s.start, s.end) for s in rows[0]] == [(m.start(), m.end()) for m in re.finditer("a1@b.co", text)] and not rows[1] and not rows[2]


def test_personal_data_is_learned_from_all_documents(spark):
    shown = [f"{words(4, i)} +1 ({i:03}) 555-{i:04} {words(3, i + 999)} {words(1, i)}.{i}@mail.example.com on {9 * 10**14 + i * 7919} and" for i in range(400)]
    texts = spark.createDataFrame([(t, "@" in t) for t in [*shown, *(words(6, i) for i in range(5000))]], "text string, shown boolean")
    x = texts.where("shown = (xxhash64(text) > 0)").cache()  # what can be learned is behind the first 2000 in order of their hashes
    assert x.where("not shown").count() > 2000
    assert personal_data.fit(spark, x) != personal_data.fit(spark)
    learned = personal_data.learned_from(x)
    n = x.where("shown").count()
    assert {(r.kind, r.label): r.n for r in learned.groupBy("kind", "label").agg(F.count("*").alias("n")).collect()}["address", 1.0] == 3 * n
    assert personal_data.learned_from(x.union(x)).count() == learned.count()
    by = {(r.kind, r.label): r.w for r in personal_data.weighed(spark, x.union(x)).groupBy("kind", "label").agg(F.sum("weight").alias("w")).collect()}
    alone = {(r.kind, r.label): r.w for r in personal_data.weighed(spark).groupBy("kind", "label").agg(F.sum("weight").alias("w")).collect()}
    assert all(alone[k] <= by[k] <= 2 * alone[k] + 1e-6 for k in alone) and by["address", 1.0] > alone["address", 1.0]
