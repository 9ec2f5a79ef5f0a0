"""Personal data by candidate gradient boosting, in DataFrame functions only.

Rules with exact formats find base spans (email, ip, card, phone), which always stay.  High-recall
generators propose further, overlapping spans: numbers in groups, spelled-out or spaced addresses,
account numbers.  Boosted trees score each proposal by its format and by the words before it; a
threshold for each generator, calibrated on held-out examples to `precision`, selects what is added.

No spans are labelled, so the examples are made: in all documents, base spans are rewritten in ways
that the base rules do not read and stand in their own contexts as personal, numbers that the base
rules reject as not personal; further ones are composed from formats and contexts.  Equal examples
are summed up, and the trees are fitted by the JVM's gradient boosting and unrolled into one SQL
expression: a document's spans are found, scored and selected within its own row, with no join, no
shuffle and no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, whole_text

#: Base kinds in their fixed order: pattern, and what a text must hold to have one.  The possessive
#: forms and look-behinds match what the plain forms match, without recursion or rescans.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", "[0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
#: Generators: pattern, what a text must hold, digits at least.
PROPOSED = {
    "number": (r"(?<![0-9A-Za-z.,=/_-])[(+]?[0-9](?:[ ().-]{0,2}[0-9])++(?![0-9A-Za-z=/_])", "[0-9]", 7),
    "address": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++", r"@|\(at\)|\[at\]| at ", 0),
    "secret": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])", "[A-Za-z0-9+/_-]{20}", 2),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 10),
}
KINDS = [*BASE, *PROPOSED]
CONTEXT = 20
SPAN = "array<struct<start:int,end:int,value:string>>"


#: Matches whose places are summed up at once.
BLOCK = 512


def found(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points, summed up block by block: a text with very many takes no more than in proportion."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(gaps, values, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value"))), lambda x: x["value"].isNotNull())
    width = lambda x: x["gap"] + F.length(x["value"])

    def placed(state: Column, x: Column) -> Column:
        start = state["pos"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("pos"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    def of_block(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("pos"), F.array().cast(SPAN).alias("out")), placed, lambda state: state["out"])

    def spans(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / BLOCK).cast("int")), lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK)))
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + width(x)))
        ends = F.aggregate(sums, F.array(F.lit(0)), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))
        return F.flatten(F.zip_with(blocks, F.slice(ends, 1, F.size(blocks)), of_block))

    # Bound by a lambda, the matches are found once.
    once = F.transform(F.array(pairs), lambda all_: F.when(F.size(all_) <= BLOCK, of_block(all_, F.lit(0))).otherwise(spans(all_)))
    return F.when(text.rlike(needs), F.get(once, F.lit(0))).otherwise(F.array().cast(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(number), ""), lambda x, i: F.when(i % 2 == 1, (F.ascii(x) - 48) * 2 - F.when(x > "4", 9).otherwise(0)).otherwise(F.ascii(x) - 48))
    return (F.length(number) > 0) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)


def byte_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: F.lpad(F.regexp_replace(x, "^0+", ""), 3, "0").between("000", "255") & (F.length(F.regexp_replace(x, "^0+", "")) <= 3))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": byte_parts,
    "card": lambda v: F.length(digits(v)).between(12, 19) & luhn(digits(v)),
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}

def kept(text: Column, kind: str, pattern: str, needs: str, keep) -> Column:
    """The matches that are kept: (start, kind's number, end, value)."""
    typed = lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    return F.transform(F.filter(found(text, pattern, needs), keep), typed)


def base_spans(text: Column) -> Column:
    def valid(kind: str):
        return lambda s: VALID[kind](s["value"])

    return F.concat(*[kept(text, k, p, needs, valid(k)) for k, (p, needs) in BASE.items()])


FEATURES = ["length", "digits", "upper", "groups", "spaces", "dashes", "dots", "parens", "plus", "at", "longest", "luhn", "reach", "identity", "money", "secrecy", "assigned", "reference", "date", "grouped"]
#: Words before a span, in the languages of the corpus.
WORDS = {
    "reach": r"(?i)(call|phone|tel|mobile|cell|fax|reach|contact|write|mail|e-mail|whatsapp|telefon|handy|appel|llam)",
    "identity": r"(?i)(ssn|social|passport|licen[cs]e no|driver|born|birth|patient|identity|ausweis|geboren|numéro de)",
    "money": r"(?i)(iban|account|konto|compte|cuenta|card|visa|bank|transfer)",
    "secrecy": r"(?i)(token|secret|passw|api.?key|access.?key|auth|bearer|credential|private)",
    "assigned": r"(?:[=:]|=>) ?[\"'`]?$",
    "reference": r"(?i)(order|invoice|version|page|isbn|issn|serial|ticket|build|article|vol|ref|item|figure|chapter|doi|sku)",
}


def features(value: Column, before: Column) -> dict[str, Column]:
    """Of a proposal and the characters before it."""
    count = lambda chars: (F.length(value) - F.length(F.regexp_replace(value, chars, ""))).cast("double")
    yes = lambda x: F.when(x, 1.0).otherwise(0.0)
    runs = F.split(value, "[^0-9]+")
    return {
        "length": F.length(value).cast("double"),
        "digits": count("[0-9]"),
        "upper": count("[A-Z]"),
        "groups": F.size(F.filter(runs, lambda x: F.length(x) > 0)).cast("double"),
        "spaces": count(" "),
        "dashes": count("-"),
        "dots": count(r"\."),
        "parens": count("[()]"),
        "plus": count(r"\+"),
        "at": yes(value.rlike(r"@|\(at\)|\[at\]| at ")),
        "longest": F.array_max(F.transform(runs, lambda x: F.length(x))).cast("double"),
        "luhn": yes(luhn(digits(value))),
        **{k: yes(before.rlike(v)) for k, v in WORDS.items()},
        "date": yes(value.rlike(r"^(?:(?:19|20)[0-9]{2}[-./ ]?[01]?[0-9][-./ ]?[0-3]?[0-9]|[0-3]?[0-9][-./ ][01]?[0-9][-./ ](?:19|20)?[0-9]{2})\b")),
        "grouped": yes(value.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{3}-[0-9]{4}$")),
    }


#: Examples: format (9: a digit, A: a capital, a: a letter), kind, personal or not, contexts.
FORMATS = [
    ("999-9999", 1, ["call ", "phone ", "tel "]),
    ("(999) 999-9999", 1, ["call me at ", "my mobile is ", "tel: ", "reach us on ", "she left "]),
    ("999-999-9999", 1, ["contact ", "fax ", "cell ", "and then "]),
    ("999.999.9999", 1, ["phone: ", "whatsapp "]),
    ("0999 9999999", 1, ["telefon ", "handy "]),
    ("99 99 99 99 99", 1, ["appel ", "phone "]),
    ("999-99-9999", 1, ["ssn ", "social security ", "patient "]),
    ("999999999", 1, ["passport ", "identity no ", "ausweis "]),
    ("AA99 9999 9999 9999 9999", 1, ["iban ", "transfer to ", "konto "]),
    ("AA99999999999999999999", 1, ["iban ", "account "]),
    ("aaaa.aaa (at) aaaaaa.aaa", 1, ["write to ", "mail ", "under "]),
    ("aaaaaa at aaaaa dot aaa", 1, ["mail me: ", "contact ", "e-mail "]),
    ("aaaa [at] aaaaaa [dot] aa", 1, ["write ", "reach him at "]),
    ("aaaa99 @ aaaaaa.aaa", 1, ["mail ", "contact "]),
    ("9a9aaa9a99aa9a9a9a999aa9a9a99aa9a9a99a9a", 1, ["token = \"", "secret: ", "API_KEY=", "password = '", "access key "]),
    ("AA99AAA9A9A99AAAA9A9", 1, ["access_key = \"", "api key: ", "auth token "]),
    ("a9aaAA9aaA9aAaA99aaAaaAAa9", 1, ["bearer ", "client secret = \"", "private_key: "]),
    ("9a9aaa9a99aa9a9a9a999aa9a9a99aa9a9a99a9a", 0, ["commit ", "sha1 of ", "digest ", "the page ", "checksum: "]),
    ("aaaaaaa-aaaaaa-9999-aaaaaaaa-aa", 0, ["chapter ", "see ", "the ", "file = "]),
    ("aaaaaa/aaaaaaa/aaaaa9/aaaaaaa99", 0, ["in ", "path: ", "from ", "href="]),
    ("aaaaaaaaaaaaaaaaaaaaaaaaa9", 0, ["word ", "and the ", "which "]),
    ("9999999", 0, ["order ", "about ", "item ", "the ", "was "]),
    ("99999999999", 0, ["order ", "serial ", "number of ", "in "]),
    ("9999999999999", 0, ["isbn ", "sku ", "reads ", "of "]),
    ("9999999999999999", 0, ["ticket ", "and ", "the ", "build "]),
    ("2019-09-19", 0, ["on ", "dated ", "since ", "ref "]),
    ("19.09.2019", 0, ["am ", "on ", "le "]),
    ("999-999-99999-9", 0, ["isbn ", "article ", "ref "]),
    ("9.99.9.9999", 0, ["version ", "build ", "of "]),
    ("999 999 999", 0, ["about ", "of ", "some "]),
    ("9999-9999", 0, ["issn ", "page ", "vol ", "from "]),
    ("999999 999999", 0, ["serial ", "figure ", "the "]),
    ("AA99AAAA99AAAA99AAA", 0, ["serial ", "sku ", "item ", "build "]),
    ("aaa at aaaa dot aaaaaaaaaa", 0, ["look ", "the ", "of ", "a "]),
    ("aaaaa@9.9", 0, ["build ", "version "]),
]


def tagged(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["value"].alias("value"))


def proposals(text: Column) -> Column:
    """All proposals of a text, typed."""
    return F.concat(*[F.transform(found(text, p, needs), tagged(k)) for k, (p, needs, _) in PROPOSED.items()])


def before(text: Column, start: Column) -> Column:
    return F.substring(text, F.greatest(F.lit(1), start - CONTEXT + 1), F.least(F.lit(CONTEXT), start))


def composed(spark: SparkSession, rows: int) -> DataFrame:
    """(kind, value, before, label, fold): composed by SQL from FORMATS, the same for every run."""
    formats = F.array(*[F.struct(F.lit(f).alias("form"), F.lit(float(y)).alias("label"), F.array(*map(F.lit, c)).alias("contexts")) for f, y, c in FORMATS])
    dealt = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    x = spark.range(rows).withColumn("f", F.get(formats, dealt(1, len(FORMATS))))
    letters = F.transform(F.split("f.form", ""), lambda c, i: F.when(c == "9", F.pmod(F.xxhash64("id", i), F.lit(10)).cast("string")).when(c == "A", F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(F.xxhash64("id", i), F.lit(26)).cast("int") + 1, F.lit(1))).when((c == "a") & ~F.col("f.form").rlike(" (?:at|dot) "), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(F.xxhash64("id", i), F.lit(26)).cast("int") + 1, F.lit(1))).otherwise(c))
    context = F.get("f.contexts", F.pmod(dealt(2, 1000), F.size("f.contexts")).cast("int"))
    noise = F.get(F.array(*map(F.lit, ["the and of ", "der und die ", "", "was with that ", "que los de "])), dealt(3, 5))
    x = x.select("id", F.col("f.label").alias("label"), dealt(4, 4).alias("fold"), F.concat(noise, context).alias("context"), F.array_join(letters, "").alias("planted"))
    x = x.withColumn("text", F.concat("context", "planted", F.lit(" on"))).select("label", "fold", "text", F.explode(proposals(F.col("text"))).alias("s"))
    return x.select("label", "fold", "s.kind", "s.value", before(F.col("text"), F.col("s.start")).alias("before"))


#: Ways to write base spans that the base rules do not read: kind, and patterns with what they become.
REWRITTEN = [
    ("phone", [(r"^\+[0-9]{1,3}[ .-]?", "")]),
    ("phone", [(r"^\+[0-9]{1,3}[ .-]?|[()]", "")]),
    ("email", [("@", " (at) "), (r"\.(?=[A-Za-z0-9-]+$)", " (dot) ")]),
    ("email", [("@", " at "), (r"\.(?=[A-Za-z0-9-]+$)", " dot ")]),
    ("email", [("@", "[at]")]),
]


def learned_from(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, value, before, label, fold) from all documents: rewritten base spans in their contexts, and numbers as long as a card's that the base rules reject.

    Copies of a text count once.  Other proposals of the documents are not used: nothing tells which
    of them are personal.
    """
    text = F.col("text")
    x = docs.select(whole_text(text_col).alias("text")).withColumn("base", base_spans(text))
    in_context = lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), before(text, s["start"]).alias("context"))
    rejected = lambda s: (F.length(digits(s["value"])) >= 12) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    written = F.filter("base", lambda s: s["kind"].isin(sorted({KINDS.index(kind) for kind, _ in REWRITTEN})))
    x = x.select(F.xxhash64("text").alias("h"), F.transform(written, in_context).alias("yes"), F.transform(kept(text, "number", *PROPOSED["number"][:2], rejected), in_context).alias("no"))
    x = cut(x.where("size(yes) + size(no) > 0").dropDuplicates(["h"]).withColumn("fold", F.pmod("h", F.lit(4)).cast("int")))
    forms = [F.when(F.col("b.kind") == KINDS.index(kind), reduce(lambda v, step: F.regexp_replace(v, *step), steps, F.col("b.value"))) for kind, steps in REWRITTEN]
    yes = x.select("fold", F.explode("yes").alias("b")).select("fold", "b.context", F.explode(F.array(*forms)).alias("value")).where("value is not null")
    yes = yes.withColumn("text", F.concat("context", "value", F.lit(" "))).select("fold", "text", F.length("context").alias("from"), F.explode(proposals(text)).alias("s")).where("s.start >= from")
    yes = yes.select(F.lit(1.0).alias("label"), "fold", "s.kind", "s.value", before(text, F.col("s.start")).alias("before"))
    no = x.select("fold", F.explode("no").alias("s")).select(F.lit(0.0).alias("label"), "fold", F.lit("number").alias("kind"), "s.value", F.col("s.context").alias("before"))
    return yes.unionByName(no)


@dataclass(frozen=True)
class Model:
    """Trees as (weight, nested splits), and the threshold of each generator."""

    trees: tuple
    thresholds: dict

    def score(self, value: Column, context: Column) -> Column:
        """Probability that a proposal is personal."""
        return self.of(features(value, context))

    def of(self, x: dict[str, Column]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, cut, left, right = node
            return F.when(x[FEATURES[at]] <= cut, walk(left)).otherwise(walk(right))

        margin = sum((F.lit(w) * walk(t) for w, t in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def weighed(spark: SparkSession, docs: DataFrame | None = None, rows: int = 6000, text_col: str = "text") -> DataFrame:
    """(kind, label, fold, x, weight): every composed example and every one of the documents, equal ones summed up; x holds the features.

    Of a kind and label, the documents' examples weigh 1 each, or together as much as the composed
    ones: neither the trees nor the thresholds lean further to what documents show as these grow.
    """
    x = composed(spark, rows).withColumn("of_docs", F.lit(False))
    if docs is not None:
        x = x.unionByName(learned_from(docs, text_col).withColumn("of_docs", F.lit(True)))
    x = x.where(F.length(digits(F.col("value"))) >= F.coalesce(*[F.when(F.col("kind") == k, n) for k, (_, _, n) in PROPOSED.items()], F.lit(0)))
    x = x.withColumn("f", F.struct("value", "before")).withColumn("x", F.array(*[features(F.col("f.value"), F.col("f.before"))[k] for k in FEATURES]))
    x = cut(x.groupBy("kind", "label", "fold", "x", "of_docs").agg(F.count("*").alias("n")))
    one = lambda docs_: F.sum(F.when(F.col("of_docs") == docs_, F.col("n")))
    share = x.groupBy("kind", "label").agg(F.coalesce(F.least(F.lit(1.0), one(False) / one(True)), F.lit(1.0)).alias("share"))
    return x.join(F.broadcast(share), ["kind", "label"]).groupBy("kind", "label", "fold", "x").agg(F.sum(F.when(F.col("of_docs"), F.col("n") * F.col("share")).otherwise(F.col("n"))).alias("weight"))


#: Distinct examples of a task when the trees are fitted.
A_TASK = 100_000


def fit(spark: SparkSession, docs: DataFrame | None = None, rows: int = 6000, trees: int = 12, depth: int = 4, precision: float = 0.99, text_col: str = "text") -> Model:
    """Boosted trees on `rows` composed examples and those of all documents; thresholds from the fold that the trees have not seen."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    x = cut(weighed(spark, docs, rows, text_col).orderBy("kind", "label", "fold", "x"))
    n = x.count()
    x = x.withColumn("features", array_to_vector("x")).coalesce(2 + n // A_TASK).cache()
    # With so many bins the candidate cuts come from all examples: beyond maxBins squared, MLlib would draw some.
    bins = max(32, isqrt(n) + 1)
    grown = GBTClassifier(maxIter=trees, maxDepth=depth, seed=3, stepSize=0.3, weightCol="weight", maxBins=bins).fit(x.where("fold <> 0"))

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        return (node.split().featureIndex(), float(node.split().threshold()), read(node.leftChild()), read(node.rightChild()))

    model = Model(tuple((float(w), read(t._call_java("rootNode"))) for w, t in zip(grown.treeWeights, grown.trees)), {})
    held = x.where("fold = 0").select("kind", "label", "weight", F.round(model.of({k: F.get("x", F.lit(i)) for i, k in enumerate(FEATURES)}), 3).alias("score")).groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect()
    x.unpersist()
    thresholds = {}
    for kind in PROPOSED:
        good = n = 0
        thresholds[kind] = 1.01
        for r in sorted((r for r in held if r["kind"] == kind), key=lambda r: -r["score"]):
            good, n = good + r["good"], n + r["n"]
            if good >= precision * n and r["score"] >= 0.5:
                thresholds[kind] = r["score"] - 0.0005
    return Model(model.trees, thresholds)


def spans(text: Column, model: Model) -> tuple[Column, Column]:
    """Base spans and added spans of a text: arrays of (start, kind's number, end, value)."""

    def chosen(kind: str):
        def keep(s: Column) -> Column:
            return (F.length(digits(s["value"])) >= PROPOSED[kind][2]) & (model.score(s["value"], before(text, s["start"])) >= model.thresholds[kind])

        return keep

    return base_spans(text), F.concat(*[kept(text, k, p, needs, chosen(k)) for k, (p, needs, _) in PROPOSED.items()])


def find(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """docs with `base` and `added`: arrays of (start, kind, end, value), by start, then kind; kind is a place in KINDS.

    A null or empty text has none.  An added span that overlaps a base span is dropped.  Every row
    is treated by itself, so repeated rows and other columns do not matter; columns named base or
    added are replaced.
    """
    base, added = spans(F.col("__text"), model or fit(docs.sparkSession, docs, text_col=text_col))
    out = docs.withColumn("__text", whole_text(text_col)).withColumn("base", F.array_sort(base)).withColumn("added", F.array_sort(added))
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return out.withColumn("added", apart).drop("__text")


def written(found_spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found_spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text", mask: str = "[{}]") -> DataFrame:
    """docs with every span found replaced by its kind in brackets; overlapping spans are replaced once, by the first."""
    x = find(docs, model, text_col).withColumn("__all", F.array_sort(F.concat("base", "added")))
    names = F.array(*[F.lit(mask.format(k)) for k in KINDS])

    def put(state: Column, s: Column) -> Column:
        kept = F.concat(state["out"], F.substring(F.col(text_col), state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"]))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), kept.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate("__all", start, put, lambda state: F.concat(state["out"], F.substring(F.col(text_col), state["at"] + 1, F.length(F.col(text_col)))))
    return x.withColumn(text_col, whole).drop("__all")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row."""
    x = find(docs.select(id_col, text_col), None, text_col)
    of = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return x.select(id_col, *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"))
