"""Label, rule and badge expressions.

All are plain Column expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class ids and names used throughout the reference.
LABEL_NAMES = ["Negative", "Neutral", "Positive"]
LABEL_IDS = {"Negative": 0, "Neutral": 1, "Positive": 2}

# Conflict types of the star-vs-text audit.
AGREE = "agree"
LOW_STAR_POSITIVE = "low_star_positive_text"
HIGH_STAR_NEGATIVE = "high_star_negative_text"
NEUTRAL_STAR_STRONG = "neutral_star_strong_text"
STAR_POLAR_MIXED = "star_polar_text_mixed"
OTHER_CONFLICT = "other_conflict"
STRONG_CONFLICTS = [LOW_STAR_POSITIVE, HIGH_STAR_NEGATIVE]

# Thresholds of the default and strict lexicon labels.
DEFAULT_THRESHOLD = 0.05
STRICT_THRESHOLD = 0.35


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def star_label(rating) -> Column:
    """<=2 -> 0, 3 -> 1, else 2."""
    r = _c(rating)
    return F.when(r <= 2, 0).when(r == 3, 1).otherwise(2)


def label_name(label_id) -> Column:
    """0/1/2 -> Negative/Neutral/Positive (other -> null)."""
    i = _c(label_id)
    return (F.when(i == 0, "Negative").when(i == 1, "Neutral").when(i == 2, "Positive")
             .otherwise(F.lit(None).cast("string")))


def label_id(name) -> Column:
    """C2 inverse: Negative/Neutral/Positive -> 0/1/2."""
    n = _c(name)
    return (F.when(n == "Negative", 0).when(n == "Neutral", 1).when(n == "Positive", 2)
             .otherwise(F.lit(None).cast("int")))


def threshold_label(compound, t: float) -> Column:
    """C4: >= t -> 2, <= -t -> 0, else 1 (inclusive bounds)."""
    c = _c(compound)
    return F.when(c >= t, 2).when(c <= -t, 0).otherwise(1)


def conflict_type(star, strict) -> Column:
    """Ordered rule chain over (star label, strict text label)."""
    s, v = _c(star), _c(strict)
    return (F.when(s == v, AGREE)
             .when((s == 0) & (v == 2), LOW_STAR_POSITIVE)
             .when((s == 2) & (v == 0), HIGH_STAR_NEGATIVE)
             .when((s == 1) & v.isin(0, 2), NEUTRAL_STAR_STRONG)
             .when(s.isin(0, 2) & (v == 1), STAR_POLAR_MIXED)
             .otherwise(OTHER_CONFLICT))


def quality_weight(conflict) -> Column:
    """1.0 agree, 0.7 mild conflict, 0.3 strong conflict, 0.5 otherwise."""
    c = _c(conflict)
    return (F.when(c == AGREE, 1.0)
             .when(c.isin(STAR_POLAR_MIXED, NEUTRAL_STAR_STRONG), 0.7)
             .when(c.isin(LOW_STAR_POSITIVE, HIGH_STAR_NEGATIVE), 0.3)
             .otherwise(0.5))


def overall_badge(pos_pct) -> Column:
    """C11: >60 Positive, >40 Mixed, else Negative."""
    p = _c(pos_pct)
    return F.when(p > 60, "Positive").when(p > 40, "Mixed").otherwise("Negative")


def normalize_label(label) -> Column:
    """Lower-case, then family by substring (pos, else neg, else neutral).
    Null stays null."""
    low = F.lower(_c(label))
    return (F.when(low.isNull(), F.lit(None).cast("string"))
             .when(low.contains("pos"), "positive")
             .when(low.contains("neg"), "negative")
             .otherwise("neutral"))


def softmax(logits) -> Column:
    """Max-shifted softmax over an array<double> column."""
    arr = _c(logits)
    shifted = F.transform(arr, lambda x: F.exp(x - F.array_max(arr)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(probs) -> Column:
    """Index of the first maximum (0-based)."""
    p = _c(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def predict_columns(probs: str = "probs", true_label: str | None = "star_label"):
    """Columns derived from a probability array: pred_label, confidence,
    one column per class, and ``correct`` when a true label is given."""
    p = F.col(probs)
    cols = {
        "pred_label": argmax(p),
        "pred_confidence": F.array_max(p),
        "prob_negative": F.element_at(p, 1),
        "prob_neutral": F.element_at(p, 2),
        "prob_positive": F.element_at(p, 3),
    }
    if true_label:
        cols["correct"] = argmax(p) == F.col(true_label)
    return cols
