"""Operator 6: SentencePiece encoding and decoding for merge-type vocabularies.

An agenda holds the adjacent symbol pairs of a string that form a piece, best
score first, leftmost first among equals; the top pair is merged and its new
neighbours enter the agenda until it is empty. Symbols outside the vocabulary
fall back to byte pieces.

No piece of such a vocabulary has a word mark after another character (checked
when it is loaded), so merges never leave a unit of marks and the word after
them: texts are cut into these units, equal units are encoded once while a
worker remembers them, short ones together as numpy rows of one length, each
popping its best pair per round, long ones by a heap. Every new unit is checked
against the sentencepiece library, batch by batch; a difference raises.

Edge cases: null or empty text has no ids and decodes to an empty text; any
code point is encoded (bytes); repeated rows give equal results; an empty table
gives an empty result; texts of any length are read whole. Input columns named
``ids`` and ``decoded`` are replaced.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.alignment import ranges
from starlens.llm.shingles import blocks, flat
from starlens.llm.worker import kept

MARK = "\u2581"
SHORT = 40                 # units up to so many characters are encoded together
BLOCK = 1 << 20            # bytes of texts whose new units are encoded at once
CACHE = 400_000            # units that a worker remembers
LONGEST = 200              # characters of a unit that outlives a shrinking of the memory
CHECKED = 200              # units compared with the library in one text
NONE = np.iinfo(np.int32).max
SLOT_BITS, HASH = 19, np.uint64(0x9E3779B97F4A7C15)      # table of merges


class MergeVocabulary:
    """Pieces, merge table and byte pieces of a model given as bytes."""

    def __init__(self, model: bytes):
        import re

        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if sp.normalize(f" a  \t{chr(0xFB01)}\n") != f"{MARK}{MARK}a{MARK}{MARK}\t{chr(0xFB01)}\n":
            raise ValueError("only identity normalisation with a word mark in front is supported")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in text.values()):
            raise ValueError("a piece crosses words")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.byte_ids = frozenset(self.bytes)
        self.surface = {i: p.replace(MARK, " ") for i, p in text.items()}
        ids = {p: i for i, p in text.items()}
        for p in text.values():                       # characters that are no piece by themselves
            for c in p:
                ids.setdefault(c, n + len(ids))
        self.size, self.ids = n, ids
        self.width = max(ids.values()) + 1
        self.char = -1 - np.arange(0x110000, dtype=np.int32)        # symbol per character; -1 - code point if no piece has it
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        rank, last = {}, None
        for i in order:                               # equal scores share a rank: leftmost wins
            if sp.get_score(i) != last:
                last, place = sp.get_score(i), len(rank)
            rank[i] = place
        merges = {}
        for i, p in text.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    merges[a * self.width + b] = (rank[i], i)
        self.merges = merges
        self._fill_slots()
        self.split = re.compile(f"{MARK}+[^{MARK}]*").findall

    def units(self, text: str) -> list[str]:
        """Units of a text without their first mark."""
        if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []
        return [u[1:] for u in self.split(MARK + text.replace(" ", MARK))] if text else []

    def symbols(self, units: list[str]) -> np.ndarray:
        """Symbols of units of one length, a row each, the first mark included."""
        text = "".join([MARK + u for u in units])
        return self.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)].reshape(len(units), -1)

    def agenda(self, sym: list[int]) -> list[int]:
        """Merges of one string by a heap of (rank, place)."""
        n = len(sym)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list = []

        def offer(i, j):
            if i >= 0 and j < n and sym[i] >= 0 and sym[j] >= 0:
                hit = self.merges.get(sym[i] * self.width + sym[j])
                if hit:
                    heapq.heappush(heap, (hit[0], i, j, sym[i], sym[j], hit[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b, new = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or right[i] != j or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], right[i] = new, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s, ok in zip(sym, alive) if ok]

    def _look(self, a, b):
        """Rank and symbol of pairs: one probe of an open hash table settles most."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.width + b, -2)
        slot = ((key.astype(np.uint64) * HASH) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        held = self.slot_key[slot]
        open_ = np.nonzero((held != key) & (held != -1))
        while len(open_[0]):
            slot[open_] = (slot[open_] + 1) & ((1 << SLOT_BITS) - 1)
            now = self.slot_key[slot[open_]]
            more = (now != key[open_]) & (now != -1)
            open_ = tuple(x[more] for x in open_)
        ok = self.slot_key[slot] == key
        return np.where(ok, self.slot_rank[slot], NONE), np.where(ok, self.slot_into[slot], -1)

    def _fill_slots(self) -> None:
        n = 1 << SLOT_BITS
        if 2 * len(self.merges) > n:
            raise ValueError("the vocabulary has too many merges for the table")
        self.slot_key = np.full(n, -1, np.int64)
        self.slot_rank, self.slot_into = np.zeros(n, np.int32), np.zeros(n, np.int32)
        key = np.array(list(self.merges), np.int64)
        value = np.array(list(self.merges.values()), np.int32).reshape(-1, 2)
        slot = ((key.astype(np.uint64) * HASH) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        for k, v, at in zip(key.tolist(), value.tolist(), slot.tolist()):
            while self.slot_key[at] != -1:
                at = (at + 1) & (n - 1)
            self.slot_key[at], self.slot_rank[at], self.slot_into[at] = k, v[0], v[1]

    def together(self, rows: np.ndarray) -> list[tuple]:
        """Ids of strings of one length; every round pops each row's best pair."""
        out: list = [None] * len(rows)
        which, s = np.arange(len(rows)), rows
        r, into = self._look(s[:, :-1], s[:, 1:])
        while len(s):
            if s.shape[1] == 1:
                done = np.ones(len(s), bool)
            else:
                p = r.argmin(axis=1)
                at = np.arange(len(s))
                done = r[at, p] == NONE
            final = s[done]
            plain = ((final >= 0) & (final < self.size)).all(axis=1).tolist()
            for k, ids, ok in zip(which[done].tolist(), final.tolist(), plain):
                out[k] = tuple(ids) if ok else self.finish(ids)
            if done.all():
                break
            go = ~done
            which, s, r, into, p = which[go], s[go], r[go], into[go], p[go]
            at, n, width = np.arange(len(s)), len(s), s.shape[1]
            s[at, p] = into[at, p]
            s = s[np.arange(width) != p[:, None] + 1].reshape(n, width - 1)
            gone = np.arange(width - 1) != p[:, None]
            r, into = r[gone].reshape(n, width - 2), into[gone].reshape(n, width - 2)
            for shift in (-1, 0):
                q = p + shift
                ok = np.flatnonzero((q >= 0) & (q < width - 2))
                r[ok, q[ok]], into[ok, q[ok]] = self._look(s[ok, q[ok]], s[ok, q[ok] + 1])
        return out

    def finish(self, sym: list[int]) -> tuple:
        """Piece ids; what is no piece becomes the bytes of its characters."""
        if min(sym) >= 0 and max(sym) < self.size:
            return tuple(sym)
        chars = {v: c for c, v in self.ids.items() if v >= self.size} if max(sym) >= self.size else {}
        out = []
        for x in sym:
            if 0 <= x < self.size:
                out.append(x)
            else:
                out += [self.bytes[b] for b in (chr(-1 - x) if x < 0 else chars[x]).encode("utf-8")]
        return tuple(out)

    def encode_units(self, units: list[str]) -> dict[str, tuple]:
        groups: dict[int, list[str]] = {}
        got = {}
        for u in units:
            if len(u) < SHORT:
                groups.setdefault(len(u), []).append(u)
            else:
                got[u] = self.finish(self.agenda(self.symbols([u])[0].tolist()))
        for own in groups.values():
            got.update(zip(own, self.together(self.symbols(own))))
        return got

    def decode(self, ids) -> str:
        """Text of a unit's ids, its first mark as a space."""
        if self.byte_ids.isdisjoint(ids):
            return "".join([self.surface[i] for i in ids])
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.surface[i].encode() for i in ids)
        return raw.decode("utf-8", "replace")

    def check(self, got: dict[str, tuple], texts: dict[str, str]) -> None:
        """Compare new units with the library: encoding and decoding."""
        plain = [u for u in got if not u.startswith(MARK) and u]
        other = [u for u in got if u.startswith(MARK) or not u]
        parts = [plain[i:i + CHECKED] for i in range(0, len(plain), CHECKED)]     # its agenda is slow on long texts
        jobs = [(" ".join(p), list(chain.from_iterable([got[u] for u in p])), "".join([texts[u] for u in p])) for p in parts]
        jobs += [(u.replace(MARK, " "), list(got[u]), texts[u]) for u in other if u]
        for text, ids, decoded in jobs:
            if text and (self.library.encode(text) != ids or self.library.decode(ids) != decoded[1:]):
                raise AssertionError(f"differs from the library near {text[:80]!r}")


class Remembered:
    """Units by number: their ids in one flat array, their text, whether it is
    the unit itself, and how often each was met. Beyond CACHE units the half
    met most often is kept."""

    def __init__(self, voc: MergeVocabulary):
        self.voc, self.number, self.texts = voc, {}, []
        self.ptr, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.same, self.met = np.zeros(0, bool), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """New units are encoded and checked."""
        got = self.voc.encode_units(new)
        decoded = {u: self.voc.decode(x) for u, x in got.items()}
        self.voc.check(got, decoded)
        self.number.update((u, len(self.texts) + k) for k, u in enumerate(new))
        self.texts += [decoded[u] for u in new]
        size = np.fromiter((len(got[u]) for u in new), np.int64, len(new))
        ids = np.fromiter(chain.from_iterable([got[u] for u in new]), np.int32, int(size.sum()))
        self.ptr = np.r_[self.ptr, self.ptr[-1] + np.cumsum(size)]
        self.flat = np.r_[self.flat, ids]
        self.same = np.r_[self.same, np.fromiter((decoded[u][1:] == u for u in new), bool, len(new))]
        self.met = np.r_[self.met, np.zeros(len(new), np.int64)]

    def shrink(self) -> None:
        if len(self.texts) <= CACHE:
            return
        keep = np.sort(np.argsort(-self.met, kind="stable")[:CACHE // 2])
        size = np.diff(self.ptr)[keep]
        place = dict(zip(keep.tolist(), range(len(keep))))
        self.flat = self.flat[ranges(self.ptr[keep], size)]
        self.ptr = np.r_[0, np.cumsum(size)]
        self.texts = [self.texts[k] for k in place]
        self.number = {u: place[k] for u, k in self.number.items() if k in place and len(u) <= LONGEST}
        self.same, self.met = self.same[keep], self.met[keep] // 2


def _encoder(model: bytes):
    def run(batches):
        key = hash(model)
        voc = kept("pieces", key, lambda: MergeVocabulary(model))
        known = kept("remembered", key, lambda: Remembered(voc))
        for b in batches:
            column = b.column(b.schema.get_field_index("text"))
            _, off = flat(column)
            for i, j in blocks(off, BLOCK):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                cut = [voc.units(t) for t in texts]
                new = list(set(chain.from_iterable(cut)).difference(known.number))
                if new:
                    known.learn(new)
                n = np.fromiter(map(len, cut), np.int64, len(cut))
                seq = np.fromiter(map(known.number.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
                known.met += np.bincount(seq, minlength=len(known.met))
                size = known.ptr[seq + 1] - known.ptr[seq]
                ids = known.flat[ranges(known.ptr[seq], size)]
                ends = np.r_[0, np.cumsum(n)]
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)][ends].astype(np.int32), pa.array(ids))
                odd = np.r_[0, np.cumsum(~known.same[seq])][ends]
                back = []
                for k, t in enumerate(texts):
                    if odd[k] != odd[k + 1] or MARK in t:        # else every unit comes back as it was
                        t = "".join([known.texts[x] for x in seq[ends[k]:ends[k + 1]].tolist()])[1:]
                    back.append(t)
                part = b.slice(i, j - i)
                keep = [k for k, name in enumerate(part.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], lists, pa.array(back, pa.string())],
                                                 [*[part.schema.names[k] for k in keep], "ids", "decoded"])
                known.shrink()

    return run


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded`` in place of ``text``."""
    with open(model_path or default_model(), "rb") as f:
        model = f.read()
    docs = docs.drop("ids", "decoded")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_encoder(model), schema + "ids array<int>, decoded string")


def digests(encoded: DataFrame) -> list:
    return [F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256")]


def op6_sentencepiece(spark, sf_dir):
    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *digests(out))
