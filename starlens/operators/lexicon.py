"""Lexicon polarity (C3), scored inside each review's row.

A lexicon of bounded size (``MAX_WORDS``, ``MAX_CHARS``, checked each time)
becomes one literal of the plan: an array of small maps, dealt by the words'
CRC-32, so a token finds its valence with one hash and a few comparisons. The
tokens of a review stay an array of its row, and the score is a chain of
higher-order functions: no explode, no shuffle of tokens or texts, and no key
is needed, so reviews with equal or null ids are scored each on its own.
A larger lexicon stays a table: tokens are exploded, joined with it and summed
by a handle of the row, which a checkpoint has pinned.

Score definitions (rule family from Hutto & Gilbert, ICWSM 2014):
  S = sum of valences; compound = S / sqrt(S^2 + alpha), clamped, round 4;
  pos_sum = sum(v + 1 | v > 0), neg_sum = sum(v - 1 | v < 0), neutral = tokens
  with valence 0; shares = |part| / (pos_sum + |neg_sum| + neutral), round 3.
A word listed several times has the mean of its valences; rows of the lexicon
without word or valence do not count.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions.text import WHITESPACE
from starlens.session import cut_lineage

#: Bounds under which a lexicon is a literal of the plan.
MAX_WORDS, MAX_CHARS = 100_000, 4_000_000


@dataclass(frozen=True)
class PolarityRules:
    """Switchable rule set with its constants (all parameters)."""
    enabled: bool = False
    booster_incr: float = 0.293
    caps_incr: float = 0.733
    negation_scalar: float = -0.74
    but_before: float = 0.5
    but_after: float = 1.5
    distance_decay: tuple[float, float, float] = (1.0, 0.95, 0.9)
    exclaim_incr: float = 0.292
    exclaim_max: int = 4
    question_incr: float = 0.18
    question_max_incr: float = 0.96
    # Parameter word lists (lower case); callers may pass their own.
    negators: tuple[str, ...] = (
        "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere",
        "cannot", "without", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't",
        "didn't", "won't", "wouldn't", "can't", "couldn't", "shouldn't", "hasn't",
        "haven't", "hadn't", "ain't", "nope", "rarely", "seldom", "despite")
    boosters_up: tuple[str, ...] = (
        "absolutely", "amazingly", "completely", "considerably", "decidedly", "deeply",
        "enormously", "entirely", "especially", "exceptionally", "extremely", "greatly",
        "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most",
        "particularly", "purely", "quite", "really", "remarkably", "so", "substantially",
        "thoroughly", "totally", "tremendously", "truly", "unbelievably", "utterly", "very")
    boosters_down: tuple[str, ...] = (
        "almost", "barely", "hardly", "less", "little", "marginally", "occasionally",
        "partly", "scarcely", "slightly", "somewhat", "sort", "kind")
    but_word: str = "but"
    extra: dict = field(default_factory=dict)


BASE = PolarityRules(enabled=False)
FULL = PolarityRules(enabled=True)

# Punctuation stripped from both ends of a token before lookup.
EDGE_PUNCT = r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$"
# The same, applied to every token of a text at once (runs touching whitespace
# or the text ends).
EDGE_PUNCT_IN_TEXT = r"(?<!\S)[\p{P}\p{S}]+|[\p{P}\p{S}]+(?!\S)"


def tokens(text: Column) -> Column:
    """Whitespace tokens without empties."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def core(token: Column) -> Column:
    """Lower-case token with outer punctuation removed (lookup form)."""
    return F.lower(F.regexp_replace(token, EDGE_PUNCT, ""))


def _is_caps(tok: Column) -> Column:
    """Token has letters and all of them upper case."""
    return (tok == F.upper(tok)) & (tok != F.lower(tok))


def word_table(lexicon: DataFrame) -> DataFrame:
    """(word, valence), each word once."""
    words = lexicon.select(F.col("word").cast("string"), F.col("valence").cast("double")).dropna()
    return words.groupBy("word").agg(F.avg("valence").alias("valence"))


def literal_lookup(lexicon: DataFrame, max_words: int = MAX_WORDS,
                   max_chars: int = MAX_CHARS) -> Callable[[Column], Column] | None:
    """token -> valence (null if not listed) as an expression, or None if the
    lexicon is beyond the bounds. At most ``max_words + 1`` rows are read."""
    rows = word_table(lexicon).limit(max_words + 1).collect()
    if len(rows) > max_words or sum(len(r.word) for r in rows) > max_chars:
        return None
    slots: list[dict] = [{} for _ in range(max(1, len(rows) // 2))]
    for r in rows:
        slots[zlib.crc32(r.word.encode()) % len(slots)][r.word] = r.valence
    table = F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<map<string,double>>")
    return lambda tok: F.try_element_at(F.get(table, F.pmod(F.crc32(tok), F.lit(len(slots)))), tok)


def lexicon_polarity(df: DataFrame, lexicon: DataFrame, text: str = "text", rules: PolarityRules = BASE,
                     alpha: float = 15.0, prefix: str = "lex_", max_words: int = MAX_WORDS) -> DataFrame:
    """``df`` with ``{prefix}neg, neu, pos, compound`` (null text: as empty)."""
    names = [c for c in df.columns if c not in {prefix + x for x in ("neg", "neu", "pos", "compound")}]
    look = literal_lookup(lexicon, max_words)
    df = df.select(*names)
    if look is None:
        return _by_join(df, lexicon, text, rules, alpha, prefix)
    return _scores(_summed(_counts(df, text, rules), look, rules), rules, alpha, prefix, names)


def polarity_scores(df: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "review_id",
                    rules: PolarityRules = BASE, alpha: float = 15.0, prefix: str = "lex_",
                    max_words: int = MAX_WORDS) -> DataFrame:
    """C3 alone: ``key`` and the four scores, one row per row of ``df``."""
    out = lexicon_polarity(df.select(key, text), lexicon, text, rules, alpha, prefix, max_words)
    return out.select(key, *[prefix + c for c in ("neg", "neu", "pos", "compound")])


def _counts(df: DataFrame, text: str, rules: PolarityRules) -> DataFrame:
    """Trimmed text, number of tokens and, for the rules, of marks. Every step
    is a column of its own: Catalyst does not spell out one used twice."""
    t = F.col("__text")
    out = df.withColumn("__text", F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WHITESPACE)))
    out = out.withColumn("__n_tokens", F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+"))))
    if rules.enabled:
        out = out.withColumns({f"__n_{name}": F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))
                               for name, mark in (("excl", "!"), ("q", "?"))})
    return out


def _hits(df: DataFrame, look, rules: PolarityRules) -> DataFrame:
    """``__hits``: valences of a review's listed tokens. The edges of all
    tokens are stripped in one pass over the text; a token of marks alone
    vanishes, as it can never be listed."""
    cores = F.split(F.lower(F.regexp_replace("__text", EDGE_PUNCT_IN_TEXT, "")), r"\s+")
    return df.withColumn("__hits", F.filter(F.transform(cores, look), lambda v: v.isNotNull()))


def _hits_with_rules(df: DataFrame, look, rules: PolarityRules) -> DataFrame:
    """The same with each valence changed by the tokens around it."""
    toks, cores = F.col("__toks"), F.col("__cores")
    df = df.withColumn("__toks", F.when(F.col("__text") == "", F.array().cast("array<string>"))
                                  .otherwise(F.split("__text", r"\s+")))
    df = df.withColumn("__cores", F.transform(toks, core))
    df = df.withColumns({
        # mixed case: some token is all caps while another is not
        "__cap_diff": F.exists(toks, _is_caps) & F.exists(toks, lambda t: ~_is_caps(t)),
        "__but_idx": F.array_position(cores, F.lit(rules.but_word)).cast("int") - 1,
        "__at": F.filter(F.transform(cores, lambda c, i: F.when(look(c).isNotNull(), i)), lambda i: i.isNotNull())})

    def hit(i):
        before = [x.alias(f"{n}{d}") for d in (1, 2, 3) for n, x in (("t", F.get(toks, i - d)), ("c", F.get(cores, i - d)))]
        return F.struct(i.alias("pos"), F.get(toks, i).alias("tok"), look(F.get(cores, i)).alias("v"),
                        F.lit(0.0).alias("sc"), *before)

    cap_diff, but_idx = F.col("__cap_diff"), F.col("__but_idx")

    def near(d, decay):
        """Steps for the token ``d`` places before a hit."""
        return (lambda x: x.withField("sc", _booster(x.v, x[f"c{d}"], rules)),
                lambda x: x.withField("sc", _booster_caps(x.sc, x.v, x[f"t{d}"], cap_diff, rules)),
                lambda x: x.withField("v", x.v + x.sc * F.lit(decay)),
                lambda x: x.withField("v", _negated(x.v, x[f"c{d}"], rules)))

    h = F.transform("__at", hit)
    h = F.transform(h, lambda x: x.withField("v", _own_caps(x.v, x.tok, cap_diff, rules)))
    for d, decay in zip((1, 2, 3), rules.distance_decay):
        for step in near(d, decay):
            h = F.transform(h, step)
    return df.withColumn("__hits", F.transform(h, lambda x: _around_but(x.v, x.pos, but_idx, rules)))


def _summed(df: DataFrame, look, rules: PolarityRules) -> DataFrame:
    """Sums over a row's hits."""
    df = (_hits_with_rules if rules.enabled else _hits)(df, look, rules)
    v = F.col("__hits")
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))
    return df.withColumns({
        "__s": total(lambda x: x), "__pos_sum": total(lambda x: F.when(x > 0, x + 1).otherwise(F.lit(0.0))),
        "__neg_sum": total(lambda x: F.when(x < 0, x - 1).otherwise(F.lit(0.0))),
        "__n_polar": F.size(F.filter(v, lambda x: x != 0))})


def _own_caps(v: Column, tok: Column, cap_diff: Column, r: PolarityRules) -> Column:
    return F.when(cap_diff & _is_caps(tok), F.when(v > 0, v + r.caps_incr).otherwise(v - r.caps_incr)).otherwise(v)


def _booster(v: Column, word: Column, r: PolarityRules) -> Column:
    """Increment of the token ``word`` before a hit, away from zero for boosters."""
    up, down = word.isin(*r.boosters_up), word.isin(*r.boosters_down)
    sign = F.when(v < 0, F.lit(-r.booster_incr)).otherwise(F.lit(r.booster_incr))
    return F.when(up, sign).when(down, -sign).otherwise(F.lit(0.0))


def _booster_caps(sc: Column, v: Column, tok: Column, cap_diff: Column, r: PolarityRules) -> Column:
    return F.when((sc != 0) & cap_diff & _is_caps(tok),
                  F.when(v > 0, sc + r.caps_incr).otherwise(sc - r.caps_incr)).otherwise(sc)


def _negated(v: Column, word: Column, r: PolarityRules) -> Column:
    return F.when(word.isin(*r.negators), v * F.lit(r.negation_scalar)).otherwise(v)


def _around_but(v: Column, pos: Column, but_idx: Column, r: PolarityRules) -> Column:
    return (F.when((but_idx >= 0) & (pos < but_idx), v * F.lit(r.but_before))
             .when((but_idx >= 0) & (pos > but_idx), v * F.lit(r.but_after)).otherwise(v))


def _scores(df: DataFrame, rules: PolarityRules, alpha: float, prefix: str, names: list[str]) -> DataFrame:
    """The four scores from a row's sums."""
    s, pos_sum, neg_sum = F.col("__s"), F.col("__pos_sum"), F.col("__neg_sum")
    neu = (F.col("__n_tokens") - F.col("__n_polar")).cast("double")
    if rules.enabled:
        ep = F.least(F.col("__n_excl"), F.lit(rules.exclaim_max)) * F.lit(rules.exclaim_incr)
        qm = (F.when(F.col("__n_q") > 3, F.lit(rules.question_max_incr))
               .when(F.col("__n_q") > 1, F.col("__n_q") * F.lit(rules.question_incr))
               .otherwise(F.lit(0.0)))
        punct = ep + qm
        s = F.when(s > 0, s + punct).when(s < 0, s - punct).otherwise(s)
        pos_adj = F.when(pos_sum > F.abs(neg_sum), pos_sum + punct).otherwise(pos_sum)
        neg_sum = F.when(pos_sum < F.abs(neg_sum), neg_sum - punct).otherwise(neg_sum)
        pos_sum = pos_adj
    df = df.select(*names, "__n_tokens", s.alias("__S"), pos_sum.alias("__P"), neg_sum.alias("__N"), neu.alias("__U"))
    total = F.col("__P") + F.abs(F.col("__N")) + F.col("__U")
    compound = F.col("__S") / F.sqrt(F.col("__S") * F.col("__S") + F.lit(alpha))
    compound = F.greatest(F.least(compound, F.lit(1.0)), F.lit(-1.0))
    empty = F.col("__n_tokens") == 0

    def share(x):
        return F.when(empty | (total == 0), F.lit(0.0)).otherwise(F.round(F.abs(x / total), 3))

    return df.select(
        *names,
        share(F.col("__N")).alias(prefix + "neg"),
        share(F.col("__U")).alias(prefix + "neu"),
        share(F.col("__P")).alias(prefix + "pos"),
        F.when(empty, F.lit(0.0)).otherwise(F.round(compound, 4)).alias(prefix + "compound"))


def _by_join(df: DataFrame, lexicon: DataFrame, text: str, rules: PolarityRules, alpha: float, prefix: str) -> DataFrame:
    """C3 with a lexicon too large for a literal: the listed tokens of a row
    come from a join, their valences return to the row as one array."""
    names = df.columns
    rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
    words = word_table(lexicon).select(F.col("word").alias("__core"), F.col("valence").alias("__v"))
    cores = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), core)
    own = rows.select("__row", F.explode(F.array_distinct(cores)).alias("__core"))
    own = own.join(words, "__core").groupBy("__row").agg(
        F.map_from_entries(F.collect_list(F.struct("__core", "__v"))).alias("__map"))
    scored = rows.join(own, "__row", "left").drop("__row").withColumn(
        "__map", F.coalesce("__map", F.create_map().cast("map<string,double>")))
    look = lambda tok: F.try_element_at(F.col("__map"), tok)
    return _scores(_summed(_counts(scored, text, rules), look, rules), rules, alpha, prefix, names)
