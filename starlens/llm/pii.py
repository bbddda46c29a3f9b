"""Operator 1: personal data (DataFrame only).

Base patterns give exact spans. Generators with high recall propose further,
overlapping spans (spaced, dotted or spelled-out forms). Gradient boosted trees
(MLlib) learn from format and context features which proposals look like the
base spans of their kind; the trees become a column expression, and per kind a
threshold calibrated on held-back proposals selects what is added. Base spans
always stay.

The trees are fitted on at most ``TRAIN_ROWS`` proposals, an equal share per kind
and label: those with the least hash of text and place, copies of a text once.
The thresholds come from the scores of all other rows, as everything else.

Within a text all steps are linear in its matches (but for one sort), so a log
of a hundred thousand addresses is one row like others.

Edge cases: null or empty text has no spans; repeated rows give equal results;
without proposals of both classes nothing is added; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 20_000
PRECISION = 0.9           # least calibrated precision of added spans
TREES, DEPTH = 10, 3
CHUNK = 128               # elements of a running sum made at once

# The base patterns. Written so that a run is entered at its
# start only and repeats never backtrack, which leaves the matches as they are.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[(\[{]at[)\]}]| at ) ?[A-Za-z0-9-]{1,63}+"
             r"(?: ?(?:\.|[(\[{]dot[)\]}]| dot ) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}+(?: ?\. ?[0-9]{1,3}+){3}|(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+)(?![0-9A-Fa-f])",
    "card": r"(?<![0-9])(?<![0-9][ ./_-])[0-9](?:[ ./_-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+ ?)?\(?[0-9]{1,5}+\)?(?:[ ./-]{1,2}+\(?[0-9]{2,5}+\)?){2,5}+(?![0-9])",
}
#: Words that speak for a kind, looked for in the characters before a proposal.
CONTEXT = ["mail|write|contact|at", "ip|host|server|address|from", "card|visa|pay|account|iban", "call|phone|tel|fax|dial"]
FEATURES = ["kind", "length", "digits", "letters", "blanks", "seps", "groups", "kinds_of_digit", "plus", "at",
            "first_group", "last_group", "start_of_text", "glued", *[f"word_{k}" for k in KINDS]]


def _digits(x):
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x):
    d = F.reverse(_digits(x))
    place = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(place, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind, m):
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(14, 19) & _luhn(m)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3)
                        & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    return F.lit(True)


def _with_matches(df: DataFrame, wanted: dict) -> DataFrame:
    """``df`` with, per name of ``wanted`` (pattern, condition on the text ``t``),
    the matches in order ``m_<name>`` (before, m, n) and their ends ``e_<name>``
    in code points. Each step is a column of its own, so nothing is spelled out
    or matched twice; ends are running sums in chunks, so that an array is never
    copied once per element."""
    t = F.col("t")

    def matches(pattern, condition):
        both = F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
                          lambda p, m: F.when(m.isNotNull(), F.struct(
                              F.length(p).alias("gap"), F.right(p, F.lit(24)).alias("before"), m.alias("m"), F.length(m).alias("n"))))
        none = F.array().cast("array<struct<gap:int,before:string,m:string,n:int>>")
        return F.when(condition, F.filter(both, lambda x: x.isNotNull())).otherwise(none)

    def running(values, first):
        return F.slice(F.aggregate(values, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 2, 1 << 30)

    def chunks(sizes):
        last = F.floor((F.size(sizes) - 1) / CHUNK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(sizes, k * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(sizes) > 0, cut).otherwise(F.array().cast("array<array<int>>"))

    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    named = lambda prefix, make: {prefix + k: make(k) for k in wanted}
    df = df.withColumns(named("m_", lambda k: matches(*wanted[k])))
    df = df.withColumns(named("s_", lambda k: F.transform(f"m_{k}", lambda x: x.gap + x.n)))
    df = df.withColumns(named("c_", lambda k: chunks(F.col(f"s_{k}"))))
    df = df.withColumns(named("u_", lambda k: running(F.transform(f"c_{k}", total), F.lit(0))))
    df = df.withColumns(named("e_", lambda k: F.flatten(F.zip_with(f"c_{k}", f"u_{k}", lambda c, u: running(c, u - total(c))))))
    return df.drop(*[f"{x}_{k}" for x in "scu" for k in wanted])


def _spans(name, build):
    """``build(before, match, start, end)`` for every match of ``name``."""
    return F.zip_with(f"m_{name}", f"e_{name}", lambda x, e: build(x.before, x.m, e - x.n, e))


def _base():
    found = []
    for kind in BASE:
        spans = _spans(f"base_{kind}", lambda b, m, s, e, kind=kind: F.struct(
            F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"), _valid(kind, m).alias("ok")))
        found.append(F.filter(spans, lambda x: x.ok))
    return F.transform(F.concat(*found), lambda x: F.struct(x.kind, x.start, x.end))


def _features(kind, before, m, start):
    count = lambda p: (F.length(m) - F.length(F.regexp_replace(m, p, ""))).cast("double")
    groups = F.filter(F.split(m, "[^0-9]+", -1), lambda g: g != "")
    size = lambda g: F.coalesce(F.length(g), F.lit(0)).cast("double")
    low = F.lower(before)
    flag = lambda c: c.cast("double")
    return F.array(
        F.lit(float(KINDS.index(kind))), F.length(m).cast("double"), count("[0-9]"), count("[A-Za-z]"), count(" "),
        count("[^A-Za-z0-9 ]"), F.size(groups).cast("double"),
        F.size(F.array_distinct(F.split(_digits(m), ""))).cast("double"), flag(m.startswith("+")), count("@"),
        size(F.get(groups, F.lit(0))), size(F.get(groups, F.size(groups) - 1)), flag(start == 0),
        flag(before.rlike(r"[\p{L}\p{N}]$")), *[flag(low.rlike(rf"\b(?:{w})\b")) for w in CONTEXT])


def _proposals():
    return F.concat(*[_spans(k, lambda b, m, s, e, k=k: F.struct(
        F.lit(k).alias("kind"), s.alias("start"), e.alias("end"), _features(k, b, m, s).alias("x"))) for k in GENERATORS])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and proposals (kind, start, end, features, label);
    the label says whether a base span of the kind is the proposal or lies in it."""
    t = F.col("t")
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    df = df.withColumn("key", F.xxhash64("t"))
    wanted = {f"base_{k}": (p, t.contains(hint) if hint else t.rlike(r"[0-9](?:[ -]?[0-9]){13}")) for k, (p, hint) in BASE.items()}
    maybe = {"email": r"@|[(\[{ ]at[)\]} ]", "ip": r"[0-9] ?\.|:[0-9A-Fa-f]", "card": r"[0-9](?:[ ./_-]?[0-9]){12}",
             "phone": r"[0-9]\)?[ ./-]{1,2}\(?[0-9]{2}"}
    wanted |= {k: (p, t.rlike(maybe[k])) for k, p in GENERATORS.items()}
    df = _with_matches(df, wanted).select("doc_id", "key", _base().alias("base"), _proposals().alias("p"))
    # Neither base spans nor proposals of a kind overlap among themselves, so a
    # base span in a proposal is the next span of the kind in order of start.
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x.kind)
    no_x = F.lit(None).cast("array<double>")
    span = lambda x, base, features: F.struct(
        rank(x).alias("rank"), x.start.alias("start"), F.lit(base).alias("is_base"), x.end.alias("end"),
        x.kind.alias("kind"), features.alias("x"))
    df = df.withColumn("all", F.sort_array(F.concat(F.transform("base", lambda x: span(x, True, no_x)),
                                                    F.transform("p", lambda x: span(x, False, x.x)))))
    after = lambda i: F.get("all", i + 1)
    known = lambda x, i: F.coalesce(after(i).is_base & (after(i).kind == x.kind) & (after(i).end <= x.end), F.lit(False))
    df = df.select("doc_id", "key", "base", F.transform("all", lambda x, i: F.struct(
        x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"), x.x.alias("x"),
        known(x, i).cast("double").alias("label"), x.is_base.alias("is_base"))).alias("p"))
    df = df.withColumn("p", F.transform(F.filter("p", lambda x: ~x.is_base), lambda x: F.struct(
        x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"), x.x.alias("x"), x.label.alias("label"))))
    # Pinned: a filter on the proposals would otherwise be pushed down and spell out all steps.
    return cut_lineage(df)


def _tree(node, x):
    """A regression tree as a column over the feature array ``x``."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(x, F.lit(int(split.featureIndex()))) <= float(split.threshold()),
                  _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


class Redactor:
    """Boosted trees as a column expression, and a threshold per kind."""

    def __init__(self, trees, weights, thresholds):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, x):
        if not self.trees:
            return F.lit(0.0)
        margin = reduce(lambda a, b: a + b, [w * _tree(t, x) for t, w in zip(self.trees, self.weights)])
        return 1 / (1 + F.exp(-2 * margin))

    def selected(self, spans):
        def ok(x):
            limit = F.lit(2.0)
            for kind, at in self.thresholds.items():
                limit = F.when(x.kind == kind, F.lit(at)).otherwise(limit)
            return (x.label == 0) & (self.score(x.x) >= limit)
        return F.transform(F.filter(spans, ok), lambda x: F.struct(x.kind, x.start, x.end))


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` distinct proposals of least ``o`` of every kind and label.
    A count of distinct proposals bounds what is ranked to about twice that."""
    counts = rows.groupBy("kind", "label").agg(F.approx_count_distinct("o").alias("n")).collect()
    low = F.lit(False)
    for r in counts:
        limit = min(1.0, 2 * (most + 50) / max(1, r.n)) * 2.0 ** 64 - 2.0 ** 63
        low = low | ((F.col("kind") == r.kind) & (F.col("label") == r.label) & (F.col("o").cast("double") <= limit))
    some = rows.filter(low).groupBy("key", "kind", "start", "label", "o").agg(F.first("x").alias("x"))
    first = F.row_number().over(Window.partitionBy("kind", "label").orderBy("o", "key", "start"))
    return cut_lineage(some.withColumn("rn", first).filter(F.col("rn") <= most).drop("rn"))


def fit_redactor(found: DataFrame) -> Redactor:
    rows = found.select("key", F.explode("p").alias("p")).select("key", "p.*")
    rows = rows.withColumn("o", F.xxhash64("key", "kind", "start"))
    # One half may be learned from; what is not in the sample counts for the thresholds.
    train = _sample(rows.filter(F.pmod("o", F.lit(2)) == 0), TRAIN_ROWS // (2 * len(KINDS)))
    if train.agg(F.count_distinct("label")).first()[0] < 2:
        return Redactor([], [], {})
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, labelCol="label", featuresCol="v",
                          cacheNodeIds=False).fit(train.select("label", array_to_vector("x").alias("v")))
    trees = [t._java_obj.rootNode() for t in model.trees]
    red = Redactor(trees, list(model.treeWeights), {})
    learned = F.lit(False)
    for r in train.groupBy("kind", "label").agg(F.max("o").alias("o")).collect():
        learned = learned | ((F.col("kind") == r.kind) & (F.col("label") == r.label) & (F.col("o") <= r.o))
    held = rows.filter((F.pmod("o", F.lit(2)) == 1) | ~learned).groupBy(
        "kind", F.round(red.score(F.col("x")), 4).alias("s")).agg(F.sum("label").alias("hit"), F.count("*").alias("n"))
    by_kind: dict = {}
    for r in sorted(held.collect(), key=lambda r: -r.s):
        by_kind.setdefault(r.kind, []).append((r.s, r.hit, r.n))
    for kind, points in by_kind.items():
        hit = n = 0
        for s, h, c in points:
            hit, n = hit + h, n + c
            if hit >= PRECISION * n:
                red.thresholds[kind] = s
    return red


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, ``base_spans`` and ``all_spans`` (kind, start, end) per row."""
    found = candidates(docs)
    red = fit_redactor(found)
    place = lambda x: F.struct(x.start.alias("start"), F.array_position(
        F.array(*[F.lit(k) for k in KINDS]), x.kind).alias("rank"), x.end.alias("end"), x.kind.alias("kind"))
    ordered = lambda a: F.sort_array(F.transform(a, place))
    out = found.select("doc_id", ordered(F.col("base")).alias("base_spans"),
                       ordered(F.concat("base", red.selected("p"))).alias("all"))
    # Equal spans stand side by side.
    new = lambda x, i: (i == 0) | (x != F.get("all", i - 1))
    return out.select("doc_id", "base_spans", F.filter("all", new).alias("all_spans"))


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op1_pii(spark, sf_dir):
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x.kind == k)).cast("long").alias("n_" + k)
    return found.select("doc_id", *[count(k) for k in KINDS],
                        F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))
