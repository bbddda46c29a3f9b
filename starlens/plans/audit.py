"""Audit plan (NB1): clean -> weak label -> lexicon polarity -> labels ->
conflict audit -> weights. One narrow chain within the row, and one tiny
class-count aggregate where weights are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame

from starlens.operators.audit import (add_class_weight, add_conflicts, add_sample_weight,
                                      add_text_labels)
from starlens.operators.clean import clean_reviews
from starlens.operators.lexicon import BASE, PolarityRules, lexicon_polarity
from starlens.session import cut_lineage


def scored_reviews(raw: DataFrame, lexicon: DataFrame, rules: PolarityRules = BASE) -> DataFrame:
    """B9 -> C3: cleaned reviews with lexicon polarity columns."""
    return lexicon_polarity(clean_reviews(raw), lexicon, rules=rules)


def conflicted_reviews(raw: DataFrame, lexicon: DataFrame, rules: PolarityRules = BASE) -> DataFrame:
    """B9 -> C3 -> C4 -> C5/C6: the audit without weights; every step works
    within a row, so the plan is one scan without an exchange."""
    return add_conflicts(add_text_labels(scored_reviews(raw, lexicon, rules)))


def audited_reviews(raw: DataFrame, lexicon: DataFrame, rules: PolarityRules = BASE,
                    columns: list[str] | None = None) -> DataFrame:
    """B9 -> C3 -> C4 -> C5/C6 -> C7 -> C8: the audited review table.

    Class weights need counts over all rows before any row has its weight.
    With ``columns`` only those are carried: the scored rows, so narrowed, are
    pinned, and counts and rows come from one reading of the texts. Without,
    whole rows are kept as they are and the star labels are counted on a second
    reading, which scores nothing."""
    if columns is not None:
        need = [*columns, *[c for c in ("star_label", "quality_weight") if c not in columns]]
        rows = cut_lineage(conflicted_reviews(raw, lexicon, rules).select(*need))
        return add_sample_weight(add_class_weight(rows)).select(*columns, *[
            c for c in ("class_weight", "sample_weight") if c not in columns])
    return add_sample_weight(add_class_weight(conflicted_reviews(raw, lexicon, rules), fit_on=clean_reviews(raw)))


def tfidf_featurizer(audited: DataFrame, split: str = "split", key: str = "review_id",
                     max_features: int | None = None):
    """J1-J4 fitted on the train split only: returns (featurize, train rows)
    where ``featurize(df)`` builds TF-IDF (train vocabulary and idf) plus the
    polarity columns as one sparse vector for any rows. ``audited`` is read
    several times and must be pinned."""
    from pyspark.sql import functions as F

    from starlens.operators import features as ft
    from starlens.operators.models import assemble
    from starlens.operators.packed import matched, n_buckets, packed_terms

    train = audited.filter(F.col(split) == "train")
    packed = None
    if max_features is None:
        packed = packed_terms(ft.document_terms(train, key=key), key, n_buckets(audited))
        n_train, vocab = packed.n_docs, packed.ranked().select("term", "df", "cnt", "term_index")
    else:
        tf_train, n_train = ft.counted_terms(train, key=key)
        vocab = cut_lineage(ft.vocabulary(tf_train, n_train, max_features=max_features))
    vocab_size, near = vocab.count(), ft.near_vocabulary(vocab)

    def featurize(df: DataFrame) -> DataFrame:
        own = matched(ft.document_terms(df, key=key), key, packed) if packed else None
        if own and own.keyed():
            return assemble(df, own, vocab_size, key)
        # A repeated key's rows have one norm together.
        tf = ft.term_frequencies(ft.document_terms(df, key=key), key)
        weights = ft.tfidf(tf, near, n_train, key)
        return assemble(df, weights, vocab_size, key)

    return featurize, train


def tfidf_lr_model(audited: DataFrame, split: str = "split", key: str = "review_id",
                   max_features: int | None = None):
    """NB1 baseline (J1-J6): TF-IDF fitted on the train split, assembled with
    the polarity columns, balanced L2 logistic regression; returns
    (model, featurize)."""
    from starlens.operators.models import LEX_FEATURES, fit_sentiment_lr

    featurize, train = tfidf_featurizer(audited, split, key, max_features)
    model = fit_sentiment_lr(featurize(train), dense=len(LEX_FEATURES))
    return model, featurize
