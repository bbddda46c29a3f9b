"""TF-IDF in packed form (J1-J3): what a long table of weights would hold, in
a few bytes an entry.

Documents are counted in chunks where their texts lie. Terms are dealt into
buckets ``t`` by a hash of their words; a chunk sends one row to every bucket,
with its terms in order, their documents and counts as compressed arrays of the
narrowest type. A bucket finds the terms of the vocabulary and is pinned as one
row. So texts are read once, the exchange by term is the only one of all terms,
and weights, norms and rows follow from counts: no weight is ever stored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.operators.metrics import prefix_sums
from starlens.session import pin_rows

#: Python workers get the functions below by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a chunk of documents, about; bounds what a Python worker holds.
CHUNK_TOKENS = 1 << 19
#: Bytes of input for each bucket of terms, about.
BUCKET_BYTES = 8 << 20

_KINDS = ("u1", "u2", "u4", "i8")


def squeezed(a) -> bytes:
    """Whole numbers as bytes: the narrowest type, compressed."""
    import pyarrow as pa
    a = np.asarray(a)
    least, most = (int(a.min()), int(a.max())) if len(a) else (0, 0)
    kind = 3 if least < 0 else next(j for j, top in enumerate((1 << 8, 1 << 16, 1 << 32, 1 << 64)) if most < top)
    raw = np.ascontiguousarray(a, _KINDS[kind]).tobytes()
    return bytes([kind]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def spread(b: bytes) -> np.ndarray:
    import pyarrow as pa
    size = int.from_bytes(b[1:9], "little")
    return np.frombuffer(pa.decompress(b[9:], size, "zstd", asbytes=True), _KINDS[b[0]]) if size else np.zeros(0, _KINDS[b[0]])


def squeezed_text(strings) -> bytes:
    """An array of strings without line ends, none null."""
    import pyarrow as pa
    import pyarrow.compute as pc
    strings = strings.cast(pa.large_string())
    lengths = pc.binary_length(strings).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1] if len(strings) else [0, 0]
    text = memoryview(strings.buffers()[2])[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else b""
    size = squeezed(lengths)
    return len(size).to_bytes(8, "little") + size + len(text).to_bytes(8, "little") + pa.compress(bytes(text), "zstd", asbytes=True)


def spread_text(b: bytes):
    import pyarrow as pa
    n = int.from_bytes(b[:8], "little")
    lengths = spread(b[8:8 + n]).astype(np.int64)
    size = int.from_bytes(b[8 + n:16 + n], "little")
    text = pa.decompress(b[16 + n:], size, "zstd") if size else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64).tobytes()), text)


def _mixed(a, b):
    """A hash of two hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def counted(tokens, buckets: int):
    """Unigrams and bigrams of the rows of a list array: (bucket, terms, entries
    a term, row, count) of every bucket with entries, terms in order, rows in
    order within a term. Words sort before what begins with them, and a blank
    before any letter, so terms are in order as pairs of word numbers are."""
    import zlib

    import pyarrow as pa
    import pyarrow.compute as pc
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    coded = tokens.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_string())
    if not len(row):
        return
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words, code = words.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]
    w, n = len(words) + 1, len(lengths)
    inside = row[1:] == row[:-1]
    at = np.concatenate([code * w, (code[:-1] * w + code[1:] + 1)[inside]])
    terms, at = np.unique(at, return_inverse=True)
    found, tf = np.unique(at * n + np.concatenate([row, row[1:][inside]]), return_counts=True)
    per_term = np.bincount(found // n, minlength=len(terms))
    first, second = terms // w, terms % w - 1
    own = np.fromiter((zlib.crc32(s) for s in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
    t = (_mixed(own[first], np.where(second < 0, np.uint64(0), own[second] + np.uint64(1))) % np.uint64(buckets)).astype(np.int64)
    texts = pc.if_else(pa.array(second < 0), words.take(pa.array(first)), pc.binary_join_element_wise(
        words.take(pa.array(first)), words.take(pa.array(np.maximum(second, 0))), pa.scalar(" ", pa.large_string())))
    by = np.argsort(t.astype(np.uint16) if buckets < 1 << 16 else t, kind="stable")
    texts, ends = texts.take(pa.array(by)), np.searchsorted(t[by], np.arange(buckets + 1))
    entry = np.argsort(np.repeat(t, per_term).astype(np.uint16) if buckets < 1 << 16 else np.repeat(t, per_term), kind="stable")
    rows, tf, per_term = (found % n)[entry], tf[entry], per_term[by]
    place = np.r_[0, np.cumsum(per_term)]
    for b in range(buckets):
        a, z = ends[b], ends[b + 1]
        if z > a:
            yield b, texts.slice(a, z - a), per_term[a:z], rows[place[a]:place[z]], tf[place[a]:place[z]]


#: What a chunk sends to a bucket, or, as bucket -1 - d, the keys of its documents.
_SENT = ["t", "d", "terms", "per", "i", "tf", "keys"]


def _sent_schema(key_type: str) -> str:
    return f"t long, d long, terms binary, per binary, i binary, tf binary, keys array<{key_type}>"


def _chunks(docs: DataFrame, key: str, buckets: int, at_once: int) -> DataFrame:
    """Rows ``_SENT`` from rows (key, tokens)."""
    rows = docs.select(key, "tokens")
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        d = TaskContext.get().partitionId() << 32
        for batch in batches:
            tokens, keys = batch.column(1), batch.column(0)
            ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(ends):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + at_once, side="right")))
                own = keys.slice(start, stop - start)
                out = [(-1 - d, d, None, None, None, None)]
                out += [(b, d, squeezed_text(s), squeezed(per), squeezed(i), squeezed(tf - 1))
                        for b, s, per, i, tf in counted(tokens.slice(start, stop - start), buckets)]
                cells = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), *[pa.binary()] * 4))]
                held = pa.ListArray.from_arrays(pa.array([0, *[len(own)] * len(out)], pa.int32()), own,
                                                mask=pa.array([False] + [True] * (len(out) - 1)))
                yield pa.RecordBatch.from_arrays([*cells, held], _SENT)
                start, d = stop, d + 1

    return rows.mapInArrow(run, _sent_schema(key_type))


def _joined(pieces, known=None, min_df: int = 1):
    """One bucket: (terms, df, cnt, [(d, place, i, tf)]) of rows ``_SENT``. Terms
    in at least ``min_df`` documents, in order, or those of ``known``."""
    import pyarrow as pa
    import pyarrow.compute as pc
    texts = [spread_text(b.as_py()) for b in pieces.column("terms")]
    pers = [spread(b.as_py()).astype(np.int64) for b in pieces.column("per")]
    tfs = [spread(b.as_py()).astype(np.int64) + 1 for b in pieces.column("tf")]
    rows = [spread(b.as_py()) for b in pieces.column("i")]
    every = pa.concat_arrays(texts) if texts else pa.array([], pa.large_string())
    if known is None:
        coded = every.dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        df = np.bincount(code, np.concatenate([*pers, []]), len(words)).astype(np.int64)
        kept = np.flatnonzero(df >= min_df)
        kept = kept[pc.sort_indices(words.take(pa.array(kept))).to_numpy()] if len(kept) else kept
        place = np.full(len(words), -1, np.int64)
        place[kept] = np.arange(len(kept))
        words, df, code = words.take(pa.array(kept)), df[kept], place[code]
    else:
        words, df = known, None
        code = pc.fill_null(pc.index_in(every, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    cnt, out, at = np.zeros(len(words), np.int64), [], 0
    for d, per, i, tf in zip(pieces.column("d").to_pylist(), pers, rows, tfs):
        p = np.repeat(code[at:at + len(per)], per)
        at += len(per)
        own = p >= 0
        p, i, tf = p[own], i[own], tf[own]
        cnt += np.bincount(p, tf, len(words)).astype(np.int64)
        if len(p):
            out.append((d, p, i, tf))
    return words, df, cnt, out


#: A pinned row: a bucket with its terms and the entries of its chunks ``ds``, ``ns`` of each; or the keys of a chunk.
_PINNED = ["t", "terms", "df", "cnt", "ds", "ns", "p", "i", "tf", "keys"]


def _pinned_schema(key_type: str) -> str:
    return f"t long, terms binary, df binary, cnt binary, ds array<long>, ns array<long>, p binary, i binary, tf binary, keys array<{key_type}>"


def _pinned_row(t, terms, df, cnt, entries, key_kind):
    import pyarrow as pa
    p = np.concatenate([np.diff(e[1], prepend=0) for e in entries]) if entries else []
    i, tf = (np.concatenate([e[j] for e in entries]) if entries else np.zeros(0, np.int64) for j in (2, 3))
    cells = [t, squeezed_text(terms), squeezed(df), squeezed(cnt), [e[0] for e in entries], [len(e[1]) for e in entries],
             squeezed(p), squeezed(i), squeezed(np.asarray(tf) - 1), None]
    kinds = [pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3, key_kind]
    return pa.table([pa.array([c], k) for c, k in zip(cells, kinds)], _PINNED)


def _keys_row(group, table):
    """The pinned row of a chunk's keys."""
    import pyarrow as pa
    kinds = [pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3]
    return pa.table([pa.array([group], kinds[0]), *[pa.nulls(1, k) for k in kinds[1:]], table.column("keys")], _PINNED)


def entries_of(row) -> list[tuple]:
    """[(d, place, i, tf)] of a pinned bucket (a dict of Arrow scalars)."""
    ns = row["ns"].as_py()
    at = np.r_[0, np.cumsum(ns)].astype(np.int64)
    p, i, tf = (spread(row[c].as_py()) for c in ("p", "i", "tf"))
    return [(d, np.cumsum(p[a:z].astype(np.int64)), i[a:z], tf[a:z].astype(np.int64) + 1) for d, a, z in zip(row["ds"].as_py(), at, at[1:])]


def each_row(batches):
    for batch in batches:
        for j in range(batch.num_rows):
            yield {n: batch.column(n)[j] for n in batch.schema.names}


def n_buckets(df: DataFrame) -> int:
    """From the planner's size of ``df``, held near the number of shuffle
    partitions, as the size may be no more than a guess."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    p = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(p, size // BUCKET_BYTES), 16 * p)


@dataclass
class Packed:
    """Terms and entries of documents. ``pinned``: rows ``_PINNED``. Terms in
    more than ``max_df`` of the ``n_docs`` documents that the vocabulary was
    counted in are not of it; their entries are left out on reading."""
    pinned: DataFrame
    key: str
    buckets: int
    n_docs: int
    max_df: float
    numbers: DataFrame | None = None

    @property
    def terms(self) -> DataFrame:
        return self.pinned.filter("t >= 0")

    @property
    def chunks(self) -> DataFrame:
        """(d, keys)"""
        return self.pinned.filter("t < 0").select((F.lit(-1) - F.col("t")).alias("d"), "keys")

    def known(self):
        """A function of a bucket's df, for tasks: which of its terms are of the vocabulary."""
        most = self.max_df * self.n_docs
        return lambda df: df <= most

    def idf(self):
        n = self.n_docs
        return lambda df: np.log((1.0 + n) / (1.0 + df)) + 1.0

    def weigh(self):
        """A function of a pinned bucket, for tasks: [(d, place, i, weight before the norm)] of its entries."""
        known, idf = self.known(), self.idf()

        def entries(row):
            df = spread(row["df"].as_py()).astype(np.int64)
            there, each = known(df), idf(df)
            for d, p, i, tf in entries_of(row):
                own = there[p]
                yield d, p[own], i[own].astype(np.int64), (1.0 + np.log(tf[own])) * each[p[own]]

        return entries

    def sizes(self) -> dict[int, int]:
        """The number of places of every bucket."""
        def run(batches):
            import pyarrow as pa
            for row in each_row(batches):
                yield pa.RecordBatch.from_arrays([pa.array([row["t"].as_py()]), pa.array([len(spread(row["df"].as_py()))])], ["t", "m"])

        return {r.t: r.m for r in self.terms.select("t", "df").mapInArrow(run, "t long, m long").collect()}

    def keyed(self) -> bool:
        """Whether every document has a key of its own."""
        keys = self.chunks.select(F.explode("keys").alias("k"))
        return keys.groupBy("k").count().filter("k is null or count > 1").isEmpty()

    def n_numbers(self) -> int:
        return self.buckets * max(self.sizes().values(), default=0)

    def number(self) -> Column:
        """A term's number by bucket and place, the one that ``sparse_models`` takes."""
        return F.col("p") * self.buckets + F.col("t")

    def numbered(self) -> DataFrame:
        """Unit weights (key, term: its number, weight)."""
        return self.rows(False, self.vocabulary().withColumn("term_index", self.number())).withColumnRenamed("term_index", "term")

    def vocabulary(self) -> DataFrame:
        """(t, p, term, df, cnt), a row per term of the vocabulary."""
        known = self.known()

        def run(batches):
            import pyarrow as pa
            for row in each_row(batches):
                df, cnt = spread(row["df"].as_py()).astype(np.int64), spread(row["cnt"].as_py()).astype(np.int64)
                at = np.flatnonzero(known(df))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["t"].as_py())), pa.array(at),
                                                  spread_text(row["terms"].as_py()).take(pa.array(at)).cast(pa.string()),
                                                  pa.array(df[at]), pa.array(cnt[at])], ["t", "p", "term", "df", "cnt"])

        return self.terms.select("t", "terms", "df", "cnt").mapInArrow(run, "t long, p long, term string, df long, cnt long")

    def ranked(self) -> DataFrame:
        """``vocabulary`` with ``term_index`` (alphabetical, 0-based), pinned."""
        if self.numbers is None:
            one = [F.lit(0).alias("__g"), F.lit(1).alias("__one")]
            self.numbers = pin_rows(prefix_sums(self.vocabulary().select("*", *one), ["__g"], [F.col("term").asc()], ["__one"])
                                    .select("t", "p", "term", "df", "cnt", (F.col("cum___one") - 1).alias("term_index")))
        return self.numbers

    def by_bucket(self, table: DataFrame, columns: list[str]) -> DataFrame:
        """(t, p, and of each column of numbers an array), from rows (t, p, columns)."""
        def run(group, rows):
            import pyarrow as pa
            at = np.argsort(rows.column("p").to_numpy(), kind="stable")
            cells = [squeezed(rows.column("p").to_numpy()[at]), *[rows.column(c).to_numpy().astype(float)[at].tobytes() for c in columns]]
            return pa.table([pa.array([group[0].as_py()], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], ["t", "p", *columns])

        return table.select("t", "p", *columns).groupBy("t").applyInArrow(run, f"t long, p binary, {', '.join(f'{c} binary' for c in columns)}")

    def documents(self, emit, schema: str, columns: list[str] = (), table: DataFrame | None = None, spell: bool = False) -> DataFrame:
        """``emit(keys, parts)`` of every chunk, where parts are (i, tf, idf,
        numbers, terms) of its entries from each bucket: numbers by entry, one
        array for each of the ``columns`` of ``table`` (t, p, columns); entries
        of terms that it does not have are left out. Pieces of entries go from
        their bucket to their chunk, packed as they are."""
        known, idf, columns = self.known(), self.idf(), list(columns)
        names = ["d", "per", "i", "tf", "df", "terms", *columns]

        def split(batches):
            import pyarrow as pa
            for row in each_row(batches):
                df = spread(row["df"].as_py()).astype(np.int64)
                there = known(df)
                values = []
                if columns:
                    own, at = np.zeros(len(df), bool), spread(row["__p"].as_py()).astype(np.int64) if row["__p"].is_valid else []
                    own[at] = True
                    there = there & own
                    for c in columns:
                        v = np.zeros(len(df))
                        v[at] = np.frombuffer(row[c].as_py(), float) if len(at) else []
                        values.append(v)
                texts = spread_text(row["terms"].as_py()) if spell else None
                out = []
                for d, p, i, tf in entries_of(row):
                    own = there[p]
                    p, i, tf = p[own], i[own], tf[own]
                    if not len(p):
                        continue
                    first = np.flatnonzero(np.diff(p, prepend=-1))
                    here = p[first]
                    out.append((d, squeezed(np.diff(np.r_[first, len(p)])), squeezed(i), squeezed(tf - 1), squeezed(df[here]),
                                squeezed_text(texts.take(pa.array(here))) if spell else None, *[_floats(v[here]) for v in values]))
                    if len(out) >= 64:
                        yield _batch(out, names)
                        out = []
                if out:
                    yield _batch(out, names)

        rows = self.terms.select("t", "df", "terms", "ds", "ns", "p", "i", "tf") if spell else self.terms.select("t", "df", "ds", "ns", "p", "i", "tf")
        if columns:
            rows = rows.join(self.by_bucket(table, columns).withColumnRenamed("p", "__p"), "t")
        pieces = rows.mapInArrow(split, f"d long, per binary, i binary, tf binary, df binary, terms binary{''.join(f', {c} binary' for c in columns)}")

        def meet(sent, own):
            import pyarrow as pa
            keys = own.column("keys").combine_chunks()
            keys = (keys if isinstance(keys, pa.Array) else keys.chunk(0)).flatten()
            parts = []
            for row in each_row(sent.to_batches()):
                per = spread(row["per"].as_py()).astype(np.int64)
                again = lambda a: np.repeat(a, per)
                parts.append((spread(row["i"].as_py()).astype(np.int64), spread(row["tf"].as_py()).astype(np.int64) + 1,
                              again(idf(spread(row["df"].as_py()).astype(np.int64))), [again(_numbers(row[c].as_py())) for c in columns],
                              spread_text(row["terms"].as_py()).take(pa.array(again(np.arange(len(per))))) if spell else None))
            return emit(keys, parts)

        return pieces.groupBy("d").cogroup(self.chunks.groupBy("d")).applyInArrow(meet, schema)

    def rows(self, spell: bool = True, numbers: DataFrame | None = None) -> DataFrame:
        """Unit weights (key, term, term_index, weight), without ``term`` unless ``spell``.
        ``numbers``: other numbers in the place of ``term_index``."""
        key = self.key
        kind = self.pinned.schema["keys"].dataType.elementType.simpleString()

        def emit(keys, parts):
            import pyarrow as pa
            names = [key, *["term"] * spell, "term_index", "weight"]
            i, w, numbers = weights_of(parts, len(keys))
            cells = [keys.take(pa.array(i))]
            if spell:
                cells.append(pa.concat_arrays([p[4] for p in parts]).cast(pa.string()) if parts else pa.array([], pa.string()))
            return pa.table([*cells, pa.array(numbers[0].astype(np.int64) if numbers else [], pa.int64()), pa.array(w, pa.float64())], names)

        return self.documents(emit, f"`{key}` {kind}, {'term string, ' * spell}term_index long, weight double", ["term_index"], self.ranked() if numbers is None else numbers, spell)


    def vectors(self, name: str) -> DataFrame:
        """(key, ``name``: an array of (i: term_index, w: unit weight) in order) of every document."""
        key, kind = self.key, self.pinned.schema["keys"].dataType.elementType.simpleString()

        def emit(keys, parts):
            import pyarrow as pa
            i, w, numbers = weights_of(parts, len(keys))
            at = numbers[0].astype(np.int64) if numbers else np.zeros(0, np.int64)
            by = np.lexsort((at, i))
            ends = np.r_[0, np.cumsum(np.bincount(i, minlength=len(keys)))].astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array(at[by].astype(np.int32)), pa.array(w[by])], ["i", "w"])
            return pa.table([keys, pa.ListArray.from_arrays(pa.array(ends), cells)], [key, name])

        return self.documents(emit, f"`{key}` {kind}, {name} array<struct<i:int,w:double>>", ["term_index"], self.ranked())


def weights_of(parts, n: int):
    """(i, unit weight, numbers) of the entries of a chunk of ``n`` documents."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), []
    i, tf, idf = (np.concatenate([p[j] for p in parts]) for j in range(3))
    w = (1.0 + np.log(tf)) * idf
    return i, w / np.sqrt(np.bincount(i, w * w, n))[i], [np.concatenate(c) for c in zip(*[p[3] for p in parts])]


def _floats(a: np.ndarray) -> bytes:
    import pyarrow as pa
    raw = np.ascontiguousarray(a, float).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _numbers(b: bytes) -> np.ndarray:
    import pyarrow as pa
    size = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], size, "zstd", asbytes=True), float)


def _batch(out, names):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "d" else pa.binary()) for c, n in zip(zip(*out), names)], names)


def packed_terms(docs: DataFrame, key: str, buckets: int, min_df: int = 2, max_df: float = 0.95, at_once: int = CHUNK_TOKENS) -> Packed:
    """J1 and J2 of rows (key, tokens), each a document of its own: terms in
    ``min_df`` documents at least and a share of ``max_df`` of them at most."""
    kind = docs.schema[key].dataType.simpleString()

    def bucket(group, table):
        t = group[0].as_py()
        if t < 0:
            return _keys_row(t, table)
        return _pinned_row(t, *_joined(table, min_df=min_df), table.schema.field("keys").type)

    pinned = pin_rows(_chunks(docs, key, buckets, at_once).groupBy("t").applyInArrow(bucket, _pinned_schema(kind)))
    return Packed(pinned, key, buckets, pinned.filter("t < 0").agg(F.sum(F.size("keys"))).first()[0] or 0, max_df)


def matched(docs: DataFrame, key: str, of: Packed, at_once: int = CHUNK_TOKENS) -> Packed:
    """Documents (key, tokens) by the vocabulary of others: its terms, places, df and number of documents."""
    kind = docs.schema[key].dataType.simpleString()

    def bucket(sent, vocab):
        import pyarrow as pa
        if not sent.num_rows or not vocab.num_rows and sent.column("t")[0].as_py() >= 0:
            return pa.table([pa.array([], f.type) for f in pinned_types(sent)], _PINNED)
        t = sent.column("t")[0].as_py()
        if t < 0:
            return _keys_row(t, sent)
        words = spread_text(vocab.column("terms")[0].as_py())
        _, _, cnt, entries = _joined(sent, words)
        return _pinned_row(t, words, spread(vocab.column("df")[0].as_py()), cnt, entries, sent.schema.field("keys").type)

    def pinned_types(sent):
        import pyarrow as pa
        kinds = [pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3, sent.schema.field("keys").type]
        return [pa.field(n, k) for n, k in zip(_PINNED, kinds)]

    pinned = pin_rows(_chunks(docs, key, of.buckets, at_once).groupBy("t").cogroup(of.terms.select("t", "terms", "df").groupBy("t"))
                      .applyInArrow(bucket, _pinned_schema(kind)))
    return Packed(pinned, key, of.buckets, of.n_docs, of.max_df, of.numbers)
