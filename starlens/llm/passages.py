"""Operator 12: removal of repeated passages by suffix arrays.

Texts are packed into shards of at most 2 MB (a longer text is cut, the pieces
overlapping by one byte less than a passage). Every shard gets a suffix array
(Larsson-Sadakane refinement) with common prefixes (Kasai), which tell for each
place whether its ``length`` bytes start elsewhere in the shard too.

Between shards, no suffix is sent as such. A place is filed under its anchor:
the least hash among the GRAM-byte stretches of its passage. Equal passages
have equal anchors, and neighbouring places share one, so a shard sends one
narrow row per range of places: (anchor hash, hash of all bytes that the range
covers). An anchor that no other shard has settles its places. Equal ranges in
two shards are repeated as a whole. What is left, different ranges with a
common anchor, is sent as bytes, once per distinct range, sorted by anchor, and
cut into shards again; the windows of an anchor that lies in several of them
are merged by binary search in the sorted windows of the shards before,
confirmed on the bytes. Anchors with more than CROWD different ranges are not
kept in one task: their windows are counted as rows of their own.

The texts lie in a table bucketed by row, so that neither the cutting of ranges
nor the removal moves them again.

Edge cases: null and empty texts have no bytes, a text shorter than a passage
stays as it is; equal texts of that length go entirely, copies and repeated
rows included (each other's copy "also starts elsewhere"); matches never cross
texts; ids may be null or repeated. Other columns are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.alignment import pointers, ranges
from starlens.llm.scratch import Scratch
from starlens.llm.shingles import flat
from starlens.llm.suffixes import END, LIMIT, Rolling, look_up, repeated, sliding_least
from starlens.session import cut_lineage

LENGTH = 200
GRAM = 64                 # bytes of an anchor
RANGE = 256               # places in a range at most
SHARD = LIMIT - 4096      # bytes of a shard, separators included
CROWD = 1 << 15           # different ranges of an anchor that one task merges

RANGES = "row long, at long, stop long, anchor long, bytes long, lead boolean, many boolean"


# -- shards of whole texts ---------------------------------------------------

def shards(rows: np.ndarray, data: np.ndarray, off: np.ndarray, length: int):
    """(bytes with separators, first place, row, offset in its text, size) of
    pieces: whole texts as long as they fit, longer ones in pieces."""
    parts, room = [], 0
    for k in range(len(rows)):
        a, b = int(off[k]), int(off[k + 1])
        if b - a < length:
            continue
        step = SHARD - length
        for start in range(a, max(b - length + 1, a + 1), step):
            size = min(b, start + step + length - 1) - start
            if parts and room + size + 1 > SHARD:
                yield _joined(parts, data)
                parts, room = [], 0
            parts.append((int(rows[k]), start - a, start, size))
            room += size + 1
    if parts:
        yield _joined(parts, data)


def _joined(parts, data):
    row, at, start, size = (np.array(x, np.int64) for x in zip(*parts))
    ends = pointers(size + 1)
    out = np.full(int(ends[-1]), END, np.uint8)
    for s, k, first in zip(start.tolist(), size.tolist(), ends.tolist()):
        out[first:first + k] = data[s:s + k]
    return out, ends[:-1], row, at, size


def stretches(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.r_[False, flag, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def _batch(**columns) -> pa.RecordBatch:
    n = len(columns["row"])
    names = [c.split()[0] for c in RANGES.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in RANGES.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names)


def _first_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first of each distinct key, how many, number of each key)."""
    _, first, number, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, count, number


def _shard_rows(length: int):
    """Per shard: repeated places as spans (rows without anchor), and ranges."""
    def run(batches):
        rolling = Rolling()
        for b in batches:
            data, off = flat(b.column(1))
            for text, first, row, at, size in shards(b.column(0).to_numpy(), data, off, length):
                places = size - length + 1
                where = ranges(first, places)                       # every place with a whole passage
                piece = np.repeat(np.arange(len(row)), places)
                same = repeated(text, length)[where]
                yield _spans(same, where, piece, first, row, at, length)
                prefix = rolling.prefixes(text)
                least = sliding_least(rolling.windows(prefix, GRAM), length - GRAM + 1)[where]
                new = np.r_[True, (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])]
                start = np.flatnonzero(new)
                count = np.diff(np.r_[start, len(where)])
                cuts = -(-count // RANGE)                            # long ranges are cut
                start = np.repeat(start, cuts) + RANGE * ranges(np.zeros(len(cuts), np.int64), cuts)
                stop = np.r_[start[1:], len(where)]                  # in places; ranges follow one another
                byte = rolling.stretches(prefix, where[start], where[stop - 1] + length)
                anchor = least[start]
                one, times, _ = _first_of(anchor ^ (byte * np.uint64(3)))
                lead = np.zeros(len(one), bool)
                lead[_first_of(anchor[one])[0]] = True
                start, stop = start[one], stop[one]
                p = piece[start]
                begin = where[start] - first[p] + at[p]
                yield _batch(row=row[p], at=begin, stop=begin + stop - start, anchor=anchor[one].view(np.int64),
                             bytes=byte[one].view(np.int64), lead=lead, many=times > 1)
    return run


def _spans(same, where, piece, first, row, at, length) -> pa.RecordBatch:
    """Bytes covered by repeated places, as rows without anchor."""
    a, b = stretches(same)
    borders = np.flatnonzero(piece[1:] != piece[:-1]) + 1           # a stretch of one piece each
    cut = np.unique(np.r_[a, borders[same[borders]] if len(borders) else borders])
    stop = np.minimum(b[np.searchsorted(a, cut, "right") - 1], np.r_[cut[1:], len(same)]) if len(cut) else cut
    p = piece[cut]
    begin = where[cut] - first[p] + at[p]
    return _batch(row=row[p], at=begin, stop=begin + (stop - cut) + length - 1)


# -- ranges that share an anchor and differ ----------------------------------

CONTEXTS = "anchor long, row long, at long, wanted boolean, crowd long, bytes binary"


def _cut_out(length: int):
    """The bytes that ranges cover, out of their texts."""
    def run(batches):
        for b in batches:
            data, off = flat(b.column(1))
            n = np.asarray(b.column(2).value_lengths().fill_null(0))
            items = b.column(2).flatten()
            row = np.repeat(np.arange(len(n)), n)
            at, stop = (items.field(c).to_numpy(zero_copy_only=False) for c in ("at", "stop"))
            start, size = off[row] + at, stop - at + length - 1
            for i in range(0, len(row), 1 << 14):
                part = slice(i, i + (1 << 14))
                ptr = pointers(size[part])
                body = data[ranges(start[part], size[part])]
                held = pa.Array.from_buffers(pa.binary(), len(ptr) - 1,
                                             [None, pa.py_buffer(ptr.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [items.field("anchor").slice(i, 1 << 14), b.column(0).take(pa.array(row[part])),
                     items.field("at").slice(i, 1 << 14), items.field("wanted").slice(i, 1 << 14),
                     items.field("crowd").slice(i, 1 << 14), held],
                    ["anchor", "row", "at", "wanted", "crowd", "bytes"])
    return run


class Merger:
    """Shards of ranges sorted by anchor, one after the other. The windows of
    the last anchor are kept, sorted, until a shard without it comes."""

    def __init__(self, length: int):
        self.length, self.rolling, self.anchor = length, Rolling(), None

    def add(self, anchor: np.ndarray, row: np.ndarray, at: np.ndarray, wanted: np.ndarray, bodies: list[bytes]):
        """Places that are repeated, as (row, place) arrays."""
        size = np.array([len(x) for x in bodies], np.int64)
        first = pointers(size + 1)[:-1]
        text = np.frombuffer(b"\xff".join([*bodies, b""]), np.uint8)
        places = size - self.length + 1
        where = ranges(first, places)
        item = np.repeat(np.arange(len(row)), places)
        offset = at[item] + where - first[item]
        same = repeated(text, self.length)[where]
        key = self.rolling.windows(self.rolling.prefixes(text), self.length)[where]
        out = []
        if self.anchor is not None and anchor[0] == self.anchor:
            mine = np.flatnonzero(anchor[item] == self.anchor)
            hit = look_up(self.key, key[mine])
            mine, hit = mine[hit >= 0], hit[hit >= 0]
            equal = self._equal(text, where[mine], self.place[hit])
            same[mine[equal]] = True
            old = np.unique(hit[equal])
            old = old[self.wanted[old]]
            out.append((self.row[old], self.offset[old]))
        got = np.flatnonzero(same & wanted[item])
        out.append((row[item[got]], offset[got]))
        self._keep(anchor, text, where, item, key, row, offset, wanted)
        return out

    def _equal(self, text, here, there):
        ok = np.zeros(len(here), bool)
        span = np.arange(self.length)
        for i in range(0, len(here), 1 << 12):
            a, b = here[i:i + (1 << 12), None] + span, there[i:i + (1 << 12), None] + span
            ok[i:i + (1 << 12)] = (text[a] == self.text[b]).all(axis=1)
        return ok

    def _keep(self, anchor, text, where, item, key, row, offset, wanted):
        again = self.anchor is not None and anchor[-1] == self.anchor
        mine = np.flatnonzero(anchor[item] == anchor[-1])
        start = where[mine[0]]
        new = (key[mine], where[mine] - start, row[item[mine]], offset[mine], wanted[item[mine]])
        text = text[start:]
        if again:
            new = tuple(np.r_[a, b] for a, b in zip((self.key, self.place, self.row, self.offset, self.wanted),
                                                    (new[0], new[1] + len(self.text), *new[2:])))
            text = np.r_[self.text, text]
        keys, one = np.unique(new[0], return_index=True)
        self.anchor, self.text, self.key = anchor[-1], text, keys
        self.place, self.row, self.offset, self.wanted = (x[one] for x in new[1:])


def _merged(length: int, shard: int):
    """Spans of the repeated places of contexts that come sorted by anchor."""
    def run(batches):
        merger, held, room = Merger(length), [], 0

        def flush():
            anchor, row, at = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 2))
            wanted = np.array([h[3] for h in held], bool)
            for r, place in merger.add(anchor, row, at, wanted, [h[4] for h in held]):
                order = np.lexsort((place, r))
                r, place = r[order], place[order]
                if len(r):
                    new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (place[1:] != place[:-1] + 1)])
                    last = np.r_[new[1:], len(r)] - 1
                    yield _batch(row=r[new], at=place[new], stop=place[last] + length)

        for b in batches:
            for item in zip(*[b.column(k).to_pylist() for k in range(5)]):
                if held and room + len(item[4]) + 1 > shard:
                    yield from flush()
                    held, room = [], 0
                held.append(item)
                room += len(item[4]) + 1
        if held:
            yield from flush()

    return run


def _crowded(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated places of crowded anchors: windows counted as rows."""
    places = F.explode(F.sequence(F.lit(1), F.length("bytes") - F.lit(length - 1)))
    w = contexts.select("row", "at", "wanted", "bytes", places.alias("k"))
    w = w.select("row", (F.col("at") + F.col("k") - 1).alias("at"), "wanted",
                 F.unhex(F.md5(F.substring("bytes", F.col("k"), F.lit(length)))).alias("window"))
    often = w.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    return w.filter("wanted").join(often, "window", "left_semi").select("row", "at", (F.col("at") + length).alias("stop"))


# -- Spark -------------------------------------------------------------------

def repeated_spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, crowd: int = CROWD,
                   shard: int = SHARD) -> DataFrame:
    """(row, at, stop): bytes of ``texts`` (row, text) that lie in passages
    found elsewhere; spans may overlap."""
    own = scratch.keep(texts.select("row", "text").mapInArrow(_shard_rows(length), RANGES), "ranges")
    rows = own.filter("anchor is not null")
    shared = rows.filter("lead").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    met = scratch.keep(rows.join(shared, "anchor", "left_semi").drop("lead"), "met")
    groups = met.groupBy("anchor", "bytes").agg(
        (F.count("*") + F.max(F.col("many").cast("int"))).alias("n"), F.min(F.struct("row", "at", "stop")).alias("r"))
    groups = scratch.keep(groups, "groups")
    whole = (met.filter("not many").join(groups.filter("n > 1").select("anchor", "bytes"), ["anchor", "bytes"], "left_semi")
                .select("row", "at", (F.col("stop") + length - 1).alias("stop")))
    differ = groups.groupBy("anchor").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    ranges_of = (groups.join(differ, "anchor")
                       .groupBy(F.col("r.row").alias("row"))
                       .agg(F.collect_list(F.struct("anchor", "r.at", "r.stop", (F.col("n") == 1).alias("wanted"), "crowd")).alias("items")))
    contexts = scratch.keep(texts.join(ranges_of, "row").select("row", "text", "items")
                                 .mapInArrow(_cut_out(length), CONTEXTS), "contexts")
    merged = (contexts.filter(F.col("crowd") <= crowd).select("anchor", "row", "at", "wanted", "bytes")
                      .repartition("anchor").sortWithinPartitions("anchor", "row", "at")
                      .mapInArrow(_merged(length, shard), RANGES))
    spans = [own.filter("anchor is null"), whole, merged, _crowded(contexts.filter(F.col("crowd") > crowd), length)]
    out = spans[0].select("row", "at", "stop")
    for more in spans[1:]:
        out = out.unionAll(more.select("row", "at", "stop"))
    return out


def _without(batches):
    """Texts without the bytes of their spans."""
    for b in batches:
        data, off = flat(b.column(1))
        lists = b.column(2)
        n = np.asarray(lists.value_lengths().fill_null(0))
        at, stop = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at", "stop"))
        ends = pointers(n).tolist()
        removed, spans, kept = [], [], []
        for k in range(b.num_rows):
            i, j, own = ends[k], ends[k + 1], data[off[k]:off[k + 1]]
            if i == j:
                removed.append(0), spans.append([]), kept.append(own.tobytes())
                continue
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, at[i:j], 1)
            np.add.at(edge, stop[i:j], -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append([{"at": int(x), "stop": int(y)} for x, y in zip(*stretches(gone))])
            kept.append(own[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("at", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def cut_passages(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                 length: int = LENGTH, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``spans``
    (byte runs removed), ``kept`` (the bytes left). To be read while ``scratch`` is open."""
    if length <= GRAM:
        raise ValueError(f"passages must be longer than {GRAM} bytes")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = scratch.bucketed(narrow.withColumn("row", F.monotonically_increasing_id()), "texts", "row")
    spans = repeated_spans(texts, scratch, length, crowd, shard)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("at", "stop")).alias("spans"))
    return (texts.join(spans, "row", "left").select("doc_id", "text", "spans")
                 .mapInArrow(_without, "doc_id long, n_bytes long, n_removed long, "
                                       "spans array<struct<at:long,stop:long>>, kept binary"))


def op12_passages(spark, sf_dir):
    with Scratch(spark, "passages") as scratch:
        out = cut_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)
        return cut_lineage(out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                      F.sha2("kept", 256).alias("kept_sha256")))
