"""Text features (J1-J3, J11, J12) as long tables.

Plan: terms counted in the row of their document -> document frequencies
``groupBy(term)`` (map-side first) -> vocabulary, cut to ``max_features`` rows
if asked -> texts read again, join on the term -> TF-IDF with a per-document
L2 norm, which deals term rows out by key.

TF-IDF definition: ``(1 + ln tf) * (ln((1 + N) / (1 + df)) + 1)``, then L2
normalised per document (sublinear tf, smoothed idf). MLlib's ``IDF`` has
neither the ``+1`` nor sublinear tf, hence the explicit columns.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


HANGUL = range(0xAC00, 0xD7A4)
#: Characters from here on may stand for several; below it, only the listed ones do.
_WIDE = 0x0132


def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """Built by rule over all of Unicode: the compatibility decomposition of a
    character without combining marks. One character: a pair of ``translate``;
    none (a mark itself): deleted by it; several (ligatures, fractions): a
    table. Hangul syllables follow arithmetic, see ``_jamo``."""
    src, dst, gone, many = [], [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000 or cp in HANGUL:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base == ch:
            continue
        if len(base) == 1:
            src.append(ch)
            dst.append(base)
        elif base:
            many[ch] = base
        else:
            gone.append(ch)
    return "".join(src + gone), "".join(dst), many


ACCENT_SRC, ACCENT_DST, EXPANDED = _accent_tables()


def _jamo(char: Column) -> Column:
    """The letters of a Hangul syllable: 19 x 21 x (27 + none), in order."""
    def letters(first, n):
        return F.lit("".join(map(chr, range(first, first + n))))

    at = F.ascii(char) - F.lit(HANGUL.start)
    part = lambda table, i: F.substring(table, i.cast("int") + 1, F.lit(1))
    tail = (at % 28).cast("int")
    return F.concat(part(letters(0x1100, 19), F.floor(at / 588)), part(letters(0x1161, 21), F.floor(at % 588 / 28)),
                    F.when(tail > 0, part(letters(0x11A8, 27), tail - 1)).otherwise(F.lit("")))


def strip_accents(col: Column) -> Column:
    """NFKD without combining marks, in any script. Texts that hold no
    character standing for several (a cheap test) need one ``translate``."""
    plain = F.translate(col, ACCENT_SRC, ACCENT_DST)
    slots: list[dict] = [{} for _ in EXPANDED]
    for ch, base in EXPANDED.items():
        slots[zlib.crc32(ch.encode()) % len(slots)][ch] = base
    table = F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<map<string,string>>")

    def spelled(c):
        found = F.try_element_at(F.get(table, F.pmod(F.crc32(c), F.lit(len(slots)))), c)
        return F.when(c.between(F.lit(chr(HANGUL.start)), F.lit(chr(HANGUL.stop - 1))), _jamo(c)).otherwise(F.coalesce(found, c))

    low = "".join(c for c in EXPANDED if ord(c) < _WIDE)
    wide = col.rlike(f"[{low}\\x{{{_WIDE:X}}}-\\x{{10FFFF}}]")
    return F.when(wide, F.array_join(F.transform(F.split(plain, ""), spelled), "")).otherwise(plain)


def word_tokens(text: Column) -> Column:
    """J1 unigrams: lower-case, accents stripped, runs of >= 2 word chars."""
    return F.regexp_extract_all(strip_accents(F.lower(F.coalesce(text, F.lit("")))),
                                F.lit(TOKEN_PATTERN), 0)


def bigrams(toks: Column) -> Column:
    """Adjacent token pairs joined by a space."""
    pairs = F.transform(toks, lambda x, i: F.when(i + 1 < F.size(toks),
                                                  F.concat(x, F.lit(" "), F.get(toks, i + 1))))
    return F.filter(pairs, lambda x: x.isNotNull())


def terms(df: DataFrame, text: str = "text", key: str = "review_id",
          ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """One row per term occurrence: (key, term).

    Tokens are materialised as a column first so the bigram lambda indexes
    the array instead of re-running the tokeniser per element."""
    df = df.select(key, word_tokens(F.col(text)).alias("__toks"))
    toks = F.col("__toks")
    parts = []
    if ngram_range[0] <= 1 <= ngram_range[1]:
        parts.append(toks)
    if ngram_range[0] <= 2 <= ngram_range[1]:
        parts.append(bigrams(toks))
    all_terms = F.concat(*parts) if len(parts) > 1 else parts[0]
    return df.select(key, F.explode_outer(all_terms).alias("term")).filter("term is not null")


def document_terms(df: DataFrame, text: str = "text", key: str = "review_id", *more: str) -> DataFrame:
    """One row per row of ``df``: (key, ``more``, tokens), unigrams in their order."""
    return df.select(key, *more, word_tokens(F.col(text)).alias("tokens"))


#: Tokens counted at once in a Python worker; bounds its memory.
TOKENS_AT_ONCE = 1 << 18


def term_frequencies(docs: DataFrame, key: str = "review_id", *more: str, at_once: int = TOKENS_AT_ONCE) -> DataFrame:
    """(key, ``more``, term, tf) from the rows of ``document_terms``, unigrams
    and bigrams. A document is one row, so its terms are counted where it is:
    tokens become numbers by a dictionary of their batch, bigrams pairs of
    them, and equal numbers of a row are counted. No shuffle."""
    names = [key, *more]

    def count(tokens):
        """(row, place in the dictionary, count) arrays and the dictionary."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        coded = tokens.flatten().dictionary_encode()
        words, code = coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        inside = row[1:] == row[:-1]
        pairs, pair = np.unique((code[:-1] * len(words) + code[1:])[inside], return_inverse=True)
        both = pc.binary_join_element_wise(words.take(pa.array(pairs // max(1, len(words)))),
                                           words.take(pa.array(pairs % max(1, len(words)))), pa.scalar(" ", pa.large_string()))
        n = len(words) + len(pairs)
        at = np.concatenate([row * n + code, row[1:][inside] * n + len(words) + pair])
        found, tf = np.unique(at, return_counts=True)
        return found // max(1, n), found % max(1, n), tf, pa.concat_arrays([words, both])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            tokens = batch.column(batch.num_columns - 1)
            ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(ends):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + at_once, side="right")))
                row, place, tf, terms = count(tokens.slice(start, stop - start))
                if len(row):
                    own = pa.array(row + start)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(i).take(own) for i in range(len(names))],
                         terms.take(pa.array(place)).cast(pa.string()), pa.array(tf.astype(np.int64))], [*names, "term", "tf"])
                start = stop

    rows = docs.select(*names, "tokens")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}, term string, tf long")


def counted_terms(df: DataFrame, text: str = "text", key: str = "review_id") -> tuple[DataFrame, int]:
    """((key, __row, term, tf), number of documents), a row per term of a
    document. Terms are counted in the row of their document, so nothing is
    shuffled or pinned: a vocabulary needs one map-side combined exchange of
    its terms, and weights read the texts once more, when only terms of the
    vocabulary go on."""
    docs = document_terms(df.withColumn("__row", F.monotonically_increasing_id()), text, key, "__row")
    return term_frequencies(docs, key, "__row"), df.count()


def vocabulary(tf: DataFrame, n_docs: int, max_features: int | None = None, min_df: int = 2,
               max_df: float = 0.95) -> DataFrame:
    """Terms in >= min_df docs and <= max_df * N docs; with
    ``max_features`` the most frequent by corpus count (ties: term asc). Columns: term, df, cnt,
    term_index (alphabetical, 0-based).

    The top-N cut is exact and distributed: a histogram of corpus counts
    (one row per distinct count value) gives the count c* of the N-th term;
    only terms with cnt >= c* are ranked, by running counts from
    ``prefix_sums`` in (cnt desc, term asc) order. No task merges per-partition
    top-N lists.
    """
    from starlens.operators.metrics import prefix_sums
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cnt"))
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.lit(n_docs)))
    one = [F.lit(0).alias("__g"), F.lit(1).alias("__one")]
    if max_features is None:
        top = kept.select("term", "df", "cnt")
        return (prefix_sums(top.select("*", *one), ["__g"], [F.col("term").asc()], ["__one"])
                .select("term", "df", "cnt", (F.col("cum___one") - 1).alias("term_index")))
    hist = kept.groupBy("cnt").agg(F.count("*").alias("n_terms"))
    w = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, 0)
    reach = hist.withColumn("covered", F.sum("n_terms").over(w))
    c_star = reach.filter(F.col("covered") >= max_features).agg(F.max("cnt")).first()[0]
    candidates = kept if c_star is None else kept.filter(F.col("cnt") >= c_star)
    ranked = prefix_sums(candidates.withColumn("__g", F.lit(0)).withColumn("__one", F.lit(1)),
                         ["__g"], [F.col("cnt").desc(), F.col("term").asc()], ["__one"])
    top = ranked.filter(F.col("cum___one") <= max_features).select("term", "df", "cnt")
    return (prefix_sums(top.select("*", *one), ["__g"], [F.col("term").asc()], ["__one"])
            .select("term", "df", "cnt", (F.col("cum___one") - 1).alias("term_index")))


def raw_tfidf(tf: DataFrame, vocab: DataFrame, n_docs: int, key: str = "review_id") -> DataFrame:
    """J3 before the norm: (key, __row, term, term_index, w), where ``tf`` has rows."""
    v = vocab.select("term", "df", "term_index")
    idf = F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    doc = "__row" if "__row" in tf.columns else key
    return tf.join(v, "term").select(key, *({doc} - {key}), "term", "term_index",
                                     ((F.lit(1.0) + F.log(F.col("tf"))) * idf).alias("w"))


def tfidf(tf: DataFrame, vocab: DataFrame, n_docs: int, key: str = "review_id") -> DataFrame:
    """L2-normalised sublinear TF-IDF weights, long table (key, term, weight).
    With a vocabulary that is broadcast, only the norm deals rows out. They are
    dealt by key, which holds the rows of a document together, so a join on the
    key after it deals out nothing more."""
    w = raw_tfidf(tf, vocab, n_docs, key)
    doc = [key]
    if "__row" in tf.columns:
        w, doc = w.repartition(F.col(key)), [key, "__row"]
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*doc)))
    return w.select(key, "term", "term_index", (F.col("w") / norm).alias("weight"))


#: Bytes of a vocabulary up to which it is broadcast; they are counted each time.
BROADCAST_BYTES = 64 << 20


def near_table(table: DataFrame, numbers: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The same for a pinned table of a key and ``numbers`` numbers a row."""
    return F.broadcast(table) if table.count() * (64 + 8 * numbers) <= limit else table


def near_vocabulary(vocab: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A pinned vocabulary, marked for broadcast if it is small enough: then
    term rows stay where they are. Beyond that the join shuffles both sides."""
    size = vocab.agg(F.sum(F.octet_length("term") + F.lit(56))).first()[0] or 0
    return F.broadcast(vocab) if size <= limit else vocab


def tfidf_table(df: DataFrame, text: str = "text", key: str = "review_id",
                max_features: int | None = None, min_df: int = 2, max_df: float = 0.95, norm: bool = True,
                spell: bool = True, packed: bool = False):
    """J1 -> J2 -> J3 in one call; returns (tfidf long table, vocabulary, N).
    Without ``norm`` the weights are those of ``raw_tfidf``. Unit weights of a
    whole vocabulary come from ``packed``, a few bytes an entry on the way; they
    have no ``term`` but its number unless ``spell``. ``packed``: weights stay
    packed, and the vocabulary (t, p, term, df, cnt) is not in order."""
    from starlens.operators.packed import n_buckets, packed_terms
    from starlens.session import cut_lineage
    if norm and max_features is None:
        out = packed_terms(document_terms(df, text, key), key, n_buckets(df), min_df, max_df)
        if packed:
            return out, out.vocabulary(), out.n_docs
        return out.rows(spell), out.ranked().select("term", "df", "cnt", "term_index"), out.n_docs
    tf, n_docs = counted_terms(df, text, key)
    vocab = cut_lineage(vocabulary(tf, n_docs, max_features, min_df, max_df))
    return (tfidf if norm else raw_tfidf)(tf, near_vocabulary(vocab), n_docs, key), vocab, n_docs


def cluster_keywords(weights, assignments: DataFrame, n: int = 10,
                     key: str = "review_id", cluster: str = "cluster_name") -> DataFrame:
    """Top n terms per cluster by mean TF-IDF weight over the cluster's
    documents (documents without the term count as 0). Of packed weights, terms
    are numbers and a bucket hands on the candidates for a cluster's first only."""
    if not isinstance(weights, DataFrame):
        from starlens.operators.sparse_models import cluster_tops
        found = spelled(cluster_tops(weights, assignments, n, key, cluster).withColumn("__number", F.col("term")), weights.vocabulary(), weights.number())
        w = Window.partitionBy(cluster).orderBy(F.desc("mean_weight"), F.asc("term"))
        return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
                     .select(cluster, F.col("__number").alias("term"), "mean_weight", "rank"))
    sizes = assignments.groupBy(cluster).agg(F.count("*").alias("n_docs"))
    sums = (weights.join(assignments.select(key, cluster), key)
                   .groupBy(cluster, "term").agg(F.sum("weight").alias("w_sum")))
    means = sums.join(sizes, cluster).select(cluster, "term",
                                             (F.col("w_sum") / F.col("n_docs")).alias("mean_weight"))
    w = Window.partitionBy(cluster).orderBy(F.desc("mean_weight"), F.asc("term"))
    return means.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def numbered(weights, key: str = "review_id"):
    """Weights with a term's number in the place of its text: a fraction of the
    bytes to deal out by document, in the same order among themselves. Packed
    weights are numbered as they are."""
    if not isinstance(weights, DataFrame):
        return weights
    return weights.select(key, F.col("term_index").alias("term"), "weight")


def spelled(keywords: DataFrame, vocab: DataFrame, number: Column | None = None) -> DataFrame:
    """Keywords of ``numbered`` weights with the texts of their terms; of packed
    weights, ``number`` is that of a term of their vocabulary."""
    names = vocab.select((F.col("term_index") if number is None else number).alias("__n"), F.col("term").alias("__term"))
    if number is not None:
        from starlens.session import cut_lineage
        keywords = cut_lineage(keywords)
        few = keywords.select(F.col("term").alias("__n")).distinct()
        names = names.join(near_table(cut_lineage(few), 1), "__n")
    return keywords.join(names, F.col("term") == F.col("__n")).select(
        *[F.col("__term").alias("term") if c == "term" else F.col(c) for c in keywords.columns])


def name_clusters(assignments: DataFrame, names: DataFrame, cluster: str = "cluster_name",
                  name_col: str = "cluster_label") -> DataFrame:
    """Attach a readable name to each cluster id (names: one row per cluster)."""
    return assignments.join(names.select(cluster, name_col), cluster, "left")


def keyword_names(keywords: DataFrame, k: int = 3, cluster: str = "cluster_name") -> DataFrame:
    """Readable cluster name from its top-k keywords, e.g. 'battery / screen / charge'."""
    top = keywords.filter(F.col("rank") <= k)
    return top.groupBy(cluster).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), " / ")
        .alias("cluster_label"))
