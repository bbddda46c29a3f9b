"""Operator 13: alignment of two tokenizers over the same bytes.

A is a byte-level vocabulary read with ``tokenizers``, B a merge vocabulary
with byte fallback read with ``sentencepiece``; both encode a space and the
text. Each side is an incidence matrix in hand-built CSR (pointers, columns):
tokens x bytes, and tokens x groups, where a group lies between two offsets at
which tokens of both sides end. Gustavson's row products give the links:
A.Bt the overlaps (with the bytes shared), of which those that end together
are the end links; G_A.G_Bt the pairs of one group.

Neither side merges across a single blank between two other characters: A
always starts a token there, and no piece of B has a word mark after another
character (checked when it is loaded). Both sides also end a token there, so
texts are cut into such units, and equal units are encoded and aligned once
while a worker remembers them. A unit whose joined bytes differ from its own makes its text one without
tokens.

The corpus count of an id pair is a plain aggregate. Pairs with a share of at
least 1 / HOT of all links (so at most HOT of them, whatever the corpus) are
broadcast; the links of all other pairs, none of which can be a hot key, are
shuffled to their counts. Both ways are always there.

Edge cases: null and empty texts, and texts that hold U+2581 (which B writes
as a blank), have no tokens: zeros and an empty string. Repeated rows, ids and
null ids keep a row each and count each. Texts of any length are cut into
units; one unit without blanks is handled whole. Other columns are not looked
at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.scratch import Scratch
from starlens.llm.shingles import blocks, flat
from starlens.llm.worker import kept
from starlens.session import cut_lineage

HOT = 1 << 20             # id pairs broadcast at most
CACHE = 250_000           # units remembered in a worker before it starts afresh
BLOCK = 1 << 18           # bytes of texts handled at once
TOGETHER = 1 << 14        # characters of units encoded in one text
KEEP = 64                 # longer units are not remembered
PRODUCTS = 1 << 20        # products expanded at once
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
MARK = "▁"

_cut = re.compile(r"(?<=\S) (?=\S)").split


# -- sparse products ---------------------------------------------------------

def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    ends = np.cumsum(size)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    some = size > 0
    first, size, ends = first[some], size[some], ends[some]
    if len(first):
        out[0] = first[0]
        out[ends[:-1]] = first[1:] - (first[:-1] + size[:-1] - 1)
    return np.cumsum(out)


def gustavson(a_ptr, a_idx, b_ptr, b_idx):
    """Rows of the product of two 0/1 matrices in CSR, as (row, column, value)
    in blocks of whole rows: row i adds the rows of B that its entries name."""
    size = b_ptr[a_idx + 1] - b_ptr[a_idx]
    work = np.r_[0, np.cumsum(size)][a_ptr]
    i, n = 0, len(a_ptr) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(work, work[i] + PRODUCTS, "right")) - 1)
        part = slice(a_ptr[i], a_ptr[j])
        row = np.repeat(np.repeat(np.arange(i, j), np.diff(a_ptr[i:j + 1])), size[part])
        col = b_idx[ranges(b_ptr[a_idx[part]], size[part])]
        if len(row):
            place = np.lexsort((col, row))
            row, col = row[place], col[place]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1])])
            yield row[first], col[first], np.diff(np.r_[first, len(row)])
        i = j


def pointers(size: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(size)].astype(np.int64)


class Alignment:
    """Links of A tokens of ``a_len`` bytes with B tokens of ``b_len`` bytes."""

    def __init__(self, a_len: np.ndarray, b_len: np.ndarray):
        self.a_ptr, self.b_ptr = pointers(a_len), pointers(b_len)
        total = int(self.a_ptr[-1])
        if total != self.b_ptr[-1]:
            raise ValueError("both sides must cover the same bytes")
        self.a_cols = np.arange(total)                                # A: tokens x bytes
        self.bt_ptr = np.arange(total + 1)                            # Bt: bytes x tokens
        self.bt_cols = np.repeat(np.arange(len(b_len)), b_len)
        a_end, b_end = self.a_ptr[1:], self.b_ptr[1:]
        over, links = [np.zeros(0, np.int64)], [(np.zeros(0, np.int64),) * 2]
        for row, col, _ in self.overlaps():
            over.append(row)
            same = a_end[row] == b_end[col]
            links.append((row[same], col[same]))
        self.overlap_rows = np.concatenate(over)
        self.link_a, self.link_b = (np.concatenate(x) for x in zip(*links))
        cuts = a_end[self.link_a]
        self.groups = len(cuts)
        self.a_group = np.searchsorted(cuts, a_end)                   # the only column of each row of G_A, G_B
        self.b_group = np.searchsorted(cuts, b_end)
        self.gt_ptr = pointers(np.bincount(self.b_group, minlength=self.groups))

    def overlaps(self):
        """A.Bt: (A token, B token, bytes shared)."""
        return gustavson(self.a_ptr, self.a_cols, self.bt_ptr, self.bt_cols)

    def shared(self):
        """G_A.G_Bt: (A token, B token, 1) for every pair of a group."""
        return gustavson(np.arange(len(self.a_group) + 1), self.a_group, self.gt_ptr, np.arange(len(self.b_group)))

    def shared_of(self) -> np.ndarray:
        """Links of each A token in G_A.G_Bt, without writing them out."""
        return np.diff(self.gt_ptr)[self.a_group]


# -- tokenizers --------------------------------------------------------------

class Pair:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sp = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        if sp.normalize(" a  \t\n") != f"{MARK}{MARK}a{MARK}{MARK}\t\n":
            raise ValueError("B must keep blanks and put one in front")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(self.b_size)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses words")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_comma, self.a_bar = (np.array([f"{i}{c}" for i in range(len(self.a_bytes))], object) for c in ",|")
        self.b_comma, self.b_semi = (np.array([f"{i}{c}" for i in range(self.b_size)], object) for c in ",;")

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)

    def whole(self, text: str, a: list[int], b: list[int]) -> bool:
        want = (" " + text).encode()
        return b"".join([self.a_bytes[i] for i in a]) == want == b"".join([self.b_bytes[i] for i in b])

    def encode_units(self, units: list[str]):
        """(A ids, their number per unit, B ids, their number per unit, whether
        the unit's bytes come back on both sides; no ids if not)."""
        parts, start, size = [], 0, 0
        for k, u in enumerate(units):
            size += len(u) + 1
            if size > TOGETHER:
                parts.append((start, k + 1))
                start, size = k + 1, 0
        parts.append((start, len(units)))
        a, n_a, b, n_b, good = [], [], [], [], []
        for i, j in parts:
            own = units[i:j]
            got = self._joined(own) if own else None
            if got is None:
                for u in own:
                    x, y = self.encode(u)
                    ok = self.whole(u, x, y)
                    good.append(np.array([ok]))
                    for side, count, ids in ((a, n_a, x), (b, n_b, y)):
                        side.append(np.array(ids if ok else [], np.int64))
                        count.append(np.array([len(side[-1])]))
            else:
                good.append(np.ones(len(own), bool))
                for part, whole in zip((a, n_a, b, n_b), got):
                    part.append(whole)
        flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
        return flat(a), flat(n_a), flat(b), flat(n_b), flat(good).astype(bool)

    def _joined(self, units: list[str]):
        """Several units in one text. None if a unit has a blank at an end, or
        bytes do not come back; its units then go one by one."""
        if any(u[:1].isspace() or u[-1:].isspace() for u in units):
            return None
        text = " ".join(units)
        x, y = self.encode(text)
        if not self.whole(text, x, y):
            return None
        ends = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units)))
        out = []
        for ids, size in ((x, self.a_len), (y, self.b_len)):
            ids = np.array(ids, np.int64)
            token_end = np.cumsum(size[ids])
            last = np.searchsorted(token_end, ends)
            if (token_end[last] != ends).any():
                raise AssertionError("a token crosses two units")
            out += [ids, np.diff(np.r_[0, last + 1])]
        return out


class Units:
    """What is known of each distinct unit, in rows by its number."""

    COUNTS = ("n_a", "n_b", "n_links", "n_overlaps", "n_shared")

    def __init__(self, pair: Pair):
        self.pair, self.number = pair, {}
        self.counts = np.zeros((0, len(self.COUNTS)), np.int64)
        self.good = np.zeros(0, bool)
        self.groups: list[str] = []
        self.link_ptr, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        p = self.pair
        a_ids, n_a, b_ids, n_b, good = p.encode_units(new)
        at = Alignment(p.a_len[a_ids], p.b_len[b_ids])
        unit_of = np.repeat(np.arange(len(new)), n_a)
        tally = lambda rows, weights=None: np.bincount(unit_of[rows], weights, len(new)).astype(np.int64)
        n_links = tally(at.link_a)
        counts = np.stack([n_a, n_b, n_links, tally(at.overlap_rows), tally(slice(None), at.shared_of())], axis=1)
        # A tokens of a group, then its B tokens: places among all tokens of the block.
        text = np.empty(len(a_ids) + len(b_ids), object)
        a_last, b_last = (np.r_[g[1:] != g[:-1], True][:len(g)] for g in (at.a_group, at.b_group))
        ga_ptr = pointers(np.bincount(at.a_group, minlength=at.groups))
        text[np.arange(len(a_ids)) + at.gt_ptr[at.a_group]] = np.where(a_last, p.a_bar[a_ids], p.a_comma[a_ids])
        text[np.arange(len(b_ids)) + ga_ptr[at.b_group + 1]] = np.where(b_last, p.b_semi[b_ids], p.b_comma[b_ids])
        ends = pointers(n_a + n_b).tolist()
        text = text.tolist()
        self.groups += ["".join(text[i:j])[:-1] for i, j in zip(ends, ends[1:])]
        self.number.update((u, len(self.good) + k) for k, u in enumerate(new))
        self.counts, self.good = np.concatenate([self.counts, counts]), np.r_[self.good, good]
        self.link_ptr = np.r_[self.link_ptr, self.link_ptr[-1] + np.cumsum(n_links)]
        self.links = np.r_[self.links, a_ids[at.link_a] * p.b_size + b_ids[at.link_b]]


    def forget(self, longest: int) -> None:
        """Drop what is known of longer units (their numbers stay unused)."""
        self.number = {u: k for u, k in self.number.items() if len(u) <= longest}
        long = np.ones(len(self.good), bool)
        long[list(self.number.values())] = False
        for k in np.flatnonzero(long).tolist():
            self.groups[k] = ""
        size = np.where(long, 0, np.diff(self.link_ptr))
        self.links = self.links[np.repeat(~long, np.diff(self.link_ptr))]
        self.link_ptr = pointers(size)


DIGESTS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_shared long, "
           "groups_sha256 string, pairs array<long>, times array<int>")


def _aligner(a_json: str, b_model: bytes):
    def run(batches):
        key = hash((a_json, b_model))
        pair = kept("alignment", key, lambda: Pair(a_json, b_model))
        known = kept("units", key, lambda: Units(pair))
        for batch in batches:
            _, off = flat(batch.column(1))
            for i, j in blocks(off, BLOCK):
                cut = [_cut(t) if t else [] for t in batch.column(1).slice(i, j - i).to_pylist()]
                if len(known.good) > CACHE:
                    known.__init__(pair)
                new = list(set(chain.from_iterable(cut)).difference(known.number))
                if new:
                    known.learn(new)
                yield _digest(known, batch.column(0).slice(i, j - i), cut)
                if any(len(u) > KEEP for u in new):
                    known.forget(KEEP)

    return run


def _digest(units: Units, ids: pa.Array, cut: list[list[str]]) -> pa.RecordBatch:
    n, number = len(cut), units.number
    size = np.array([len(c) for c in cut], np.int64)
    seq = np.fromiter((number[u] for u in chain.from_iterable(cut)), np.int64, int(size.sum()))
    doc = np.repeat(np.arange(n), size)
    good = np.ones(n, bool)
    good[doc[~units.good[seq]]] = False
    seq, size = seq[good[doc]], np.where(good, size, 0)
    doc = np.repeat(np.arange(n), size)
    ends = pointers(size)
    total = np.concatenate([np.zeros((1, units.counts.shape[1]), np.int64), np.cumsum(units.counts[seq], axis=0)])
    counts = total[ends[1:]] - total[ends[:-1]]
    hashes, at, flat = [], ends.tolist(), seq.tolist()
    for k in range(n):
        own = flat[at[k]:at[k + 1]]
        hashes.append(hashlib.sha256(";".join([units.groups[x] for x in own]).encode()).hexdigest() if own else "")
    many = units.link_ptr[seq + 1] - units.link_ptr[seq]
    key = (np.repeat(doc, many) << 40) | units.links[ranges(units.link_ptr[seq], many)]
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(key)]).astype(np.int32)
    pair_ptr = pointers(np.bincount(key[first] >> 40, minlength=n)).astype(np.int32)
    pairs = key[first] & ((1 << 40) - 1)
    n_a, n_b, n_links, n_overlaps, n_shared = (pa.array(c) for c in counts.T)
    return pa.RecordBatch.from_arrays(
        [ids, n_a, n_b, n_links, n_links, n_overlaps, n_shared, pa.array(hashes, pa.string()),
         pa.ListArray.from_arrays(pair_ptr, pa.array(pairs)), pa.ListArray.from_arrays(pair_ptr, pa.array(times))],
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared", "groups_sha256", "pairs", "times"])


def _linker(a_json: str, b_model: bytes):
    """Links of whole texts one by one, in blocks of bounded size."""
    def run(batches):
        pair = kept("alignment", hash((a_json, b_model)), lambda: Pair(a_json, b_model))
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                units = _cut(text.as_py()) if text.as_py() else []
                a, _, b, _, good = pair.encode_units(units)
                if not units or not good.all():
                    continue
                at = Alignment(pair.a_len[a], pair.b_len[b])
                a_end, b_end = at.a_ptr[1:], at.b_ptr[1:]
                for kind, links in (("overlap", at.overlaps()), ("group", at.shared())):
                    for row, col, value in links:
                        together = a_end[row] == b_end[col]
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(doc_id, len(row)), pa.repeat(kind, len(row)), pa.array(row), pa.array(col),
                             pa.array(a[row]), pa.array(b[col]), pa.array(value), pa.array(together)],
                            ["doc_id", "kind", "a_place", "b_place", "a_id", "b_id", "value", "ends_together"])

    return run


# -- Spark -------------------------------------------------------------------

def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)


def _models(paths) -> tuple[str, bytes]:
    a, b = paths or default_models()
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return f.read(), g.read()


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def token_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths=None) -> DataFrame:
    """Every link as a row: kind ``overlap`` (value: bytes shared) or ``group``
    (value 1), places and ids of both tokens, and whether they end together."""
    return _narrow(docs, id_col, text_col).mapInArrow(
        _linker(*_models(paths)), "doc_id long, kind string, a_place long, b_place long, a_id long, b_id long, "
                                  "value long, ends_together boolean")


def _partial_counts(batches):
    """(pair, links) of a bounded stretch of rows; the shuffle adds them up."""
    def reduced(parts):
        key = np.concatenate([k for k, _ in parts])
        weight = np.concatenate([w for _, w in parts])
        place = np.argsort(key, kind="stable")
        key = key[place]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.add.reduceat(weight[place], first)

    def out(parts):
        key, weight = reduced(parts)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(weight)], ["pair", "n"])

    parts, rows = [], 0
    for b in batches:
        key = b.column(0).flatten().to_numpy(zero_copy_only=False)
        if len(key):
            parts.append((key, b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            rows += len(key)
        if rows > 1 << 21:
            parts = [reduced(parts)]
            rows = len(parts[0][0])
            if rows > 1 << 20:
                yield out(parts)
                parts, rows = [], 0
    if parts:
        yield out(parts)


def _summed(hot):
    """Sums over a row's links to hot pairs; the others go on as arrays."""
    def run(batches):
        keys, counts, best = hot.value
        for b in batches:
            n = b.num_rows
            lists, times = b.column(b.schema.get_field_index("pairs")), b.column(b.schema.get_field_index("times"))
            key = lists.flatten().to_numpy(zero_copy_only=False)
            weight = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), np.asarray(lists.value_lengths().fill_null(0)))
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            found = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            total, tops = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, row[found], counts[at[found]] * weight[found])
            np.add.at(tops, row[found], weight[found] * best[at[found]])
            ptr = pa.array(pointers(np.bincount(row[~found], minlength=n)).astype(np.int32))
            keep = [k for k, name in enumerate(b.schema.names) if name not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in keep], pa.array(total), pa.array(tops),
                 pa.ListArray.from_arrays(ptr, pa.array(key[~found])),
                 pa.ListArray.from_arrays(ptr, pa.array(weight[~found].astype(np.int32)))],
                [*[b.schema.names[k] for k in keep], "count_sum", "n_best", "pairs", "times"])

    return run


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): links of each id pair over all rows, and whether no
    pair of the same B id has more. The B vocabulary bounds the broadcast side."""
    n = cut_lineage(aligned.select("pairs", "times").mapInArrow(_partial_counts, "pair long, n long")
                           .groupBy("pair").agg(F.sum("n").alias("n")))
    b_id = F.col("pair") % b_size
    most = n.groupBy(b_id.alias("__b")).agg(F.max("n").alias("__most"))
    return n.join(F.broadcast(most), b_id == F.col("__b")).select("pair", "n", (F.col("n") == F.col("__most")).alias("best"))


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths=None,
                     hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256, and n_overlaps, n_shared (links of A.Bt and G_A.G_Bt)."""
    spark = docs.sparkSession
    a_json, b_model = _models(paths)
    b_size = Pair(a_json, b_model).b_size
    with Scratch(spark, "alignment") as scratch:
        rows = _narrow(docs, id_col, text_col).mapInArrow(_aligner(a_json, b_model), DIGESTS)
        rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        counts = scratch.keep(pair_counts(rows, b_size), "counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        is_hot = F.col("n") * F.lit(hot).cast("decimal(20,0)") >= F.lit(total).cast("decimal(20,0)")
        top = counts.filter(is_hot).sort("pair").toArrow()
        lookup = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
        schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_shared long, "
                  "groups_sha256 string, row long, count_sum long, n_best long, pairs array<long>, times array<int>")
        summed = rows.mapInArrow(_summed(lookup), schema)
        rare = summed.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
        more = (rare.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("t"))
                    .join(counts.filter(~is_hot), "pair").groupBy("row")
                    .agg(F.sum(F.col("n") * F.col("t")).alias("__sum"), F.sum(F.when(F.col("best"), F.col("t"))).alias("__best")))
        out = summed.drop("pairs", "times").join(more, "row", "left")
        return cut_lineage(out.select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links",
            (F.col("n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"),
            (F.col("count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"),
            "groups_sha256", "n_overlaps", "n_shared"))


def op13_alignment(spark, sf_dir):
    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
