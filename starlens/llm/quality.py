"""Operator 10: quality rules combined by weak supervision (DataFrame only).

Rules vote good (+1), bad (-1) or abstain (0). Expectation-maximisation over a
two-class latent model estimates, per rule and class, how often it casts each
vote; a document's posterior probability of being good replaces an
all-rules-must-pass filter. No label is read.

The model needs only the number of documents per vote pattern, so one
aggregate over all rows feeds it: at most 3 ** 8 rows, whatever the corpus.

Edge cases: null or blank text has no words and fails the base rules; repeated
rows get equal verdicts; an empty table gives an empty result and a prior-only
model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.session import cut_lineage

WINDOW = 8                       # words of a repeated passage
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
BLANK = " \t\n\x0b\x0c\r"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_digits", "n_odd", "n_echo"]
KEEP_AT = 0.5                    # least posterior probability of a kept document


def _count(text, pattern):
    """Characters of ``text`` in a character class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts in STATS and EXTRA to ``docs`` (extra columns stay)."""
    keep = [c for c in docs.columns if c not in (*STATS, *EXTRA)]
    df = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    trim = F.btrim("__t", F.lit(BLANK))
    df = df.withColumn("__w", F.when(trim == "", F.array().cast("array<string>"))
                       .otherwise(F.split(trim, r"[\x20\x09-\x0D]+", -1)))
    w = F.col("__w")
    df = df.withColumn("__h", F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")))
    h = F.col("__h")
    # Only a text with a repeated window sorts its windows.
    order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), order))
    s = F.col("__s")

    def twice(x, i):
        before, after = F.get(s, i - 1).h, F.get(s, i + 1).h
        return F.coalesce(x.h == before, F.lit(False)) | F.coalesce(x.h == after, F.lit(False))

    df = df.withColumn("__p", F.sort_array(F.transform(F.filter(s, twice), lambda x: x.i)))
    p = F.col("__p")
    gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    df = df.withColumn("__l", lines)
    t = F.col("__t")
    return df.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        _count(t, r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        _count(t, r"\p{Lu}").cast("long").alias("n_upper"),
        _count(t, r"[0-9]").cast("long").alias("n_digits"),
        _count(t, r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()-]").cast("long").alias("n_odd"),
        F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).cast("long").alias("n_echo"))


def _vote(good, bad):
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict:
    """name -> vote column over the counts of ``text_stats``."""
    c = F.col
    return {
        "length": _vote(c("n_words") >= 50, c("n_words") < MIN_WORDS),
        "symbols": _vote(20 * c("n_symbols") <= c("n_words"), 10 * c("n_symbols") > c("n_words")),
        "odd_chars": _vote(50 * c("n_odd") <= c("word_chars"), 12 * c("n_odd") > c("word_chars")),
        "upper": _vote(5 * c("n_upper") <= c("word_chars"), 5 * c("n_upper") > 2 * c("word_chars")),
        "lines": _vote(2 * c("n_dup_lines") <= c("n_lines"), 2 * c("n_dup_lines") > c("n_lines")),
        "passages": _vote(10 * c("n_repeat_words") <= c("n_words"),
                          100 * c("n_repeat_words") > MAX_REPEAT_PCT * c("n_words")),
        "echo": _vote(20 * c("n_echo") <= c("n_words"), 5 * c("n_echo") > c("n_words")),
        "word_length": _vote((2 * c("word_chars") >= 5 * c("n_words")) & (c("word_chars") <= 12 * c("n_words")),
                             (2 * c("word_chars") < 5 * c("n_words")) | (c("word_chars") > 16 * c("n_words"))),
    }


@dataclass(frozen=True)
class LabelModel:
    """Prior log-odds of good and, per rule, the log-odds each vote adds."""
    prior: float
    weights: dict            # rule -> {vote: log P(vote | good) - log P(vote | bad)}
    iterations: int
    converged: bool

    def posterior(self):
        score = F.lit(self.prior)
        for name, by_vote in self.weights.items():
            v = F.col("v_" + name)
            score = score + F.when(v == 1, by_vote[1]).when(v == -1, by_vote[-1]).otherwise(by_vote[0])
        return 1 / (1 + F.exp(-score))


def with_votes(stats: DataFrame) -> DataFrame:
    votes = rules()
    return stats.select(*[c for c in stats.columns if c[2:] not in votes or c[:2] != "v_"],
                        *[v.alias("v_" + k) for k, v in votes.items()])


def fit_label_model(votes: DataFrame, max_iter: int = 500, tol: float = 1e-9) -> LabelModel:
    """EM over the counts of vote patterns. It starts from rules that vote bad
    on one good document in 200 and on three bad ones in ten, so every kind of
    bad document starts, and can stay, in the same class."""
    names = list(rules())
    seen = [(tuple(r[:-1]), r[-1]) for r in sorted(
        tuple(r) for r in votes.groupBy(*["v_" + k for k in names]).count().collect())]
    total = sum(n for _, n in seen)
    prior = 0.8
    p = {c: [{1: 0.9 - b, 0: 0.1, -1: b} for _ in names] for c, b in ((1, 0.005), (0, 0.3))}
    done, step = total == 0, 0
    while not done and step < max_iter:
        step += 1
        soft = {c: [{1: 0.01, 0: 0.01, -1: 0.01} for _ in names] for c in (0, 1)}
        good, change = 0.0, 0.0
        for pattern, n in seen:
            lo = math.log(prior / (1 - prior)) + sum(
                math.log(p[1][k][v] / p[0][k][v]) for k, v in enumerate(pattern))
            q = 1 / (1 + math.exp(-max(-500.0, min(500.0, lo))))
            good += n * q
            for k, v in enumerate(pattern):
                soft[1][k][v] += n * q
                soft[0][k][v] += n * (1 - q)
        fresh = min(1 - 1e-6, max(1e-6, (good + 1) / (total + 2)))
        change, prior = abs(fresh - prior), fresh
        for c in (0, 1):
            for k, by_vote in enumerate(soft[c]):
                mass = sum(by_vote.values())
                for v, x in by_vote.items():
                    change = max(change, abs(x / mass - p[c][k][v]))
                    p[c][k][v] = x / mass
        done = change < tol
    weights = {name: {v: math.log(p[1][k][v] / p[0][k][v]) for v in (-1, 0, 1)} for k, name in enumerate(names)}
    return LabelModel(math.log(prior / (1 - prior)), weights, step, done)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def judge(votes: DataFrame, model: LabelModel) -> DataFrame:
    """Adds ``p_good``, ``base_failed`` and ``kept``."""
    return (votes.withColumn("p_good", model.posterior()).withColumn("base_failed", base_failed())
                 .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT)))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, with its columns. Two scans, no shuffle
    of texts: one counts the votes, one applies the verdicts."""
    stats = with_votes(text_stats(docs.select("text")))
    model = fit_label_model(stats)
    row = docs.select(F.struct(*docs.columns).alias("row"), "text")
    judged = judge(with_votes(text_stats(row)), model)
    # The partition id keeps the optimiser from pushing the verdict down through
    # the projections below, where it would spell out every shared count anew.
    return judged.withColumn("__at", F.spark_partition_id()).filter("kept and __at >= 0").select("row.*")


def op10_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    votes = cut_lineage(with_votes(text_stats(docs)).drop("text"))
    out = judge(votes, fit_label_model(votes))
    return out.select("doc_id", *STATS, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))
