"""Operator 9: secret scans through nested encodings, in Arrow batches.

A worklist holds the layers of a text. Every layer is scanned for the base
patterns, then unwrapped: percent escapes, backslash escapes, base64 runs (over
single line breaks too), and gzip, zlib or bzip2 data with all its members.
Bytes that are no UTF-8 are kept as lone surrogates, so that an archive inside
an archive, in base64 or between escapes is still whole. A layer seen before
(by content and place) is not queued again, so the list ends at a fixpoint.
Spans found in a layer are mapped back to code points of the original text; a
base64 run and an archive map as a whole.

Unpacked data is read in pieces of ``PIECE`` bytes that overlap by
``OVERLAP``, each worked off before the next, so a small run that unpacks to
gigabytes stays in bounded memory and is still scanned to its end; an archive
inside it is unpacked in a pass of its own. A base64, percent or backslash run
that reaches the end of a piece is carried over whole, so a border does not
shift it; one of more than ``CARRY`` bytes is cut where all codes are in step
(60 characters from its start, or at a line).

Edge cases: null or empty text has no spans, an empty table no rows; malformed
escapes, base64 or archives stay as they are; repeated rows give equal results;
texts of any length are read whole. Columns named ``base_spans`` and
``all_spans`` are replaced by ``find_secrets``; ``redact_secrets`` keeps all
columns of its input.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
PIECE, OVERLAP, CARRY = 4 << 20, 4 << 10, 16 << 20
_HINTS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_ONE_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|[uxU]([0-9A-Fa-f]+))")
_BYTES = re.compile(r"""(?:\\(?:x[0-9A-Fa-f]{2}|u00[0-9A-Fa-f]{2}|[abfnrtv0'"\\]))+""")
_ONE_BYTE = re.compile(r"\\(?:x(..)|u00(..)|(.))")
_SIMPLE = dict(zip("abfnrtv0'\"\\", b"\a\b\f\n\r\t\v\0'\"\\"))
_B64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: The two bytes that may begin zlib data: deflate in any window, check bits right, no preset dictionary.
_ZLIB = b"|".join(re.escape(bytes([c, f])) for c in range(0x08, 0x80, 0x10) for f in range(256)
                  if (c * 256 + f) % 31 == 0 and not f & 32)
_ARCHIVE = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|" + _ZLIB)
#: Bytes of which runs consist that may go on in the next piece.
_HEXDIGITS = b"0123456789abcdefABCDEF"
_IN_RUNS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", b"%" + _HEXDIGITS,
            b"\\{}xuUabfnrtv0'\"" + _HEXDIGITS)
_BETWEEN_LINES = _IN_RUNS[0] + b"= \t\r\n"
_BINARY = re.compile(r"[\x00-\x08\x0e-\x1f\udc80-\udcff]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def _identity(s, e):
    return s, e


def _rewritten(text, pattern, decode, place):
    """The layer in which every match of ``pattern`` that decodes is replaced,
    and the map of its spans to the original text; None if nothing decodes."""
    parts, starts, origin, at, size, changed = [], [], [], 0, 0, False

    def add(piece, s, e, literal):
        nonlocal size
        if piece:
            starts.append(size)
            origin.append((s, e, literal))
            parts.append(piece)
            size += len(piece)

    for m in pattern.finditer(text):
        new = decode(m[0])
        if new is None:
            continue
        add(text[at:m.start()], at, m.start(), True)
        add(new, *m.span(), False)
        at, changed = m.end(), True
    if not changed:
        return None
    add(text[at:], at, len(text), True)

    def back(s, e):
        i, j = bisect_right(starts, s) - 1, bisect_right(starts, e - 1) - 1
        s0, _, lit = origin[i]
        left = s0 + (s - starts[i]) if lit else s0
        s1, e1, lit = origin[j]
        return place(left, s1 + (e - starts[j]) if lit else e1)

    return "".join(parts), back


def _text(raw):
    """Bytes as a text that ``_raw`` turns into the same bytes."""
    return raw.decode("utf-8", "surrogateescape")


def _raw(text):
    return text.encode("utf-8", "surrogateescape")


def _from_url(run):
    return _text(binascii.unhexlify(run.replace("%", "")))


def _from_bytes(run):
    """Backslash escapes as in a literal of bytes."""
    return _text(bytes(int(x or u, 16) if x or u else _SIMPLE[c] for x, u, c in _ONE_BYTE.findall(run)))


def _from_escapes(run):
    units = [int(a or b, 16) for a, b in _ONE_ESCAPE.findall(run)]
    if any(u > 0x10FFFF for u in units):
        return None
    raw = b"".join(chr(u).encode("utf-16-le", "surrogatepass") for u in units)
    return raw.decode("utf-16-le", "replace")


class _Members:
    """Where the archives of a stream that were read begin, and the byte after
    the last that was read to its end."""

    def __init__(self):
        self.starts, self.end = set(), 0


def _unpacker(data):
    return bz2.BZ2Decompressor() if data[:1] == b"B" else zlib.decompressobj(31 if data[:1] == b"\x1f" else 15)


def _unpacked(chunks, start, members):
    """Chunks of at most ``PIECE`` unpacked bytes of the archive at byte
    ``start`` of the stream and of the members that follow it; stops at damage."""
    end, unpacker, head = 0, None, b""
    try:
        for data in chunks():
            end += len(data)
            data = data[max(0, len(data) - max(0, end - start)):]
            while data:
                if unpacker is None:
                    data, head = head + data, b""
                    if len(data) < 10:
                        head = data
                        break
                    if not _ARCHIVE.match(data):
                        return
                    members.starts.add(end - len(data))
                    unpacker = _unpacker(data)
                while True:
                    new = unpacker.decompress(data, PIECE)
                    if new:
                        yield new
                    data = unpacker.unused_data if unpacker.eof else getattr(unpacker, "unconsumed_tail", b"")
                    if unpacker.eof:
                        unpacker, members.end = None, max(members.end, end - len(data))
                        break
                    if not data and len(new) < PIECE:
                        break
    except (zlib.error, OSError, EOFError):
        return


def _unpacks(data):
    try:
        return bool(zlib.decompressobj().decompress(data, 64))
    except zlib.error:
        return False


def _archives(data):
    """Places where an archive begins; the two bytes of zlib count if what follows unpacks."""
    return [m.start() for m in _ARCHIVE.finditer(data)
            if len(m[0]) > 2 or _unpacks(data[m.start():m.start() + 1024])]


def _byte_starts(layer):
    """Bytes of ``_raw(layer)`` before each of its characters."""
    points = np.frombuffer(layer.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    size[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
    return np.cumsum(size) - size


def _carried(piece):
    """Where the part of ``piece`` begins that the next piece repeats."""
    at = max(0, len(piece) - OVERLAP)
    run = min(len(piece.rstrip(x)) for x in _IN_RUNS)
    start = min(at, run, len(piece.rstrip(_BETWEEN_LINES)))
    if len(piece) - start <= CARRY:
        return start
    if run < at:
        return run + (at - run) // 60 * 60
    line = piece.rfind(b"\n", start, at + 1)
    return line + 1 if line >= 0 else at


def _readings(raw):
    """Texts that bytes may stand for: UTF-8, where other bytes are kept as
    surrogates and ASCII around them survives, and UTF-16 from an even or odd
    byte on if there is a null byte."""
    yield _text(raw)
    if b"\0" in raw:
        for start in (0, 1):
            yield raw[start:].decode("utf-16-le", "replace")
            yield raw[start:].decode("utf-16-be", "replace")


def _runs(layer):
    """(start, end) of base64 runs: those on one line, those over all adjoining
    lines, and lines of one width with the line before and a shorter one after."""
    for m in _B64.finditer(layer):
        yield m.span()
    for m in _WRAPPED.finditer(layer) if "\n" in layer else ():
        lines = [x.span() for x in _LINE.finditer(layer, *m.span())]
        width = [e - s for s, e in lines]
        last, i = len(lines) - 1, 0
        found = {(0, last)}
        while i < last:
            j = i + 1
            while j < last and width[j + 1] == width[i + 1]:
                j += 1
            stop = j + 1 if j < last and width[j + 1] < width[j] else j
            found |= {(i, stop)} | ({(i + 1, stop)} if stop > i + 1 else set())
            i = j
        for i, j in sorted(found):
            if lines[j][1] - lines[i][0] > 16:
                yield lines[i][0], lines[j][1]


def _decoded(run):
    """Bytes of a base64 run."""
    body = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def scan(text: str | None) -> tuple[list, list]:
    """(base spans, all spans), each ordered by start, kind and end."""
    text = text or ""
    rank = {k: i for i, k in enumerate(KINDS)}
    base = base_spans(text)
    spans, seen = set(base), set()

    def fresh(*key):
        new = key not in seen
        seen.add(key)
        return new

    def digest(layer):
        return hashlib.sha1(layer.encode("utf-8", "surrogatepass")).digest()

    # Each of these reads a layer and yields the layers inside it.
    def read_text(layer, place):
        if place is not _identity:
            spans.update((k, *place(s, e)) for k, s, e in base_spans(layer))
        for mark, pattern, decode in (("%", _URL, _from_url), ("\\", _ESCAPE, _from_escapes)):
            child = _rewritten(layer, pattern, decode, place) if mark in layer else None
            if child and child[0] and fresh("text", digest(child[0]), child[1](0, len(child[0]))):
                yield partial(read_text, *child)
                if mark == "%":
                    yield partial(read_escaped, *child)
        child = _rewritten(layer, _BYTES, _from_bytes, place) if "\\x" in layer or "\\u00" in layer else None
        if child:
            yield partial(read_escaped, *child)
        for s, e in _runs(layer):
            raw, here = _decoded(layer[s:e]), place(s, e)
            if fresh("run", hashlib.sha1(raw).digest(), here):
                yield partial(read_bytes, lambda raw=raw: [raw], here)

    def read_escaped(layer, place):
        raw = _raw(layer)
        free, found = 0, _archives(raw)
        starts, last = _byte_starts(layer) if found else None, None
        for start in found:
            if start < free:
                continue
            members = _Members()
            for _ in _unpacked(lambda: [raw], start, members):
                pass
            free = members.end
            # A damaged archive reaches to the last byte that is no text.
            first = int(np.searchsorted(starts, start))
            if free:
                end = int(np.searchsorted(starts, free))
            else:
                last = max((m.end() for m in _BINARY.finditer(layer)), default=0) if last is None else last
                end = last
            here = place(first, max(min(end, len(layer)), first + 1))
            yield partial(read_bytes, partial(_unpacked, lambda: [raw], start, members), here)

    def read_bytes(chunks, here):
        whole, tail, piece, at, n, found = hashlib.sha1(), b"", b"", 0, 0, {}
        for chunk in chunks():
            whole.update(chunk)
            piece = tail + chunk
            for layer in _readings(piece):
                if layer and fresh("text", digest(layer), here):
                    yield partial(read_text, layer, lambda s, e: here)
            found.update(dict.fromkeys(at - len(tail) + a for a in _archives(piece)))
            tail, at, n = piece[_carried(piece):], at + len(chunk), n + 1
        if found and fresh("bytes", whole.digest(), here):
            again, members = chunks if n > 1 else lambda: [piece], _Members()
            for start in found:
                if start >= members.end and start not in members.starts:
                    yield partial(read_bytes, partial(_unpacked, again, start, members), here)

    todo = [read_text(text, _identity)]
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
        else:
            todo.append(layer())
    order = lambda x: (x[1], rank[x[0]], x[2])
    return sorted(base, key=order), sorted(spans, key=order)


SPAN = "array<struct<kind:string,start:int,end:int>>"


def _scan_batches(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            found = [scan(t.as_py()) for t in part.column(part.schema.get_field_index("text"))]
            as_list = lambda k: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[k]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*part.columns, as_list(0), as_list(1)],
                                             [*part.schema.names, "base_spans", "all_spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans`` (kind, start, end in code points)."""
    docs = docs.drop("base_spans", "all_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scan_batches, f"{schema}, base_spans {SPAN}, all_spans {SPAN}")


def without_spans(text, spans, mark):
    """``text`` with ``mark`` for every span; spans that overlap one before are part of it."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _redacted(mark, has_count):
    def run(batches):
        for b in batches:
            names, at = b.schema.names, b.schema.get_field_index("text")
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column(at).to_pylist()
                spans = [scan(t)[1] for t in texts]
                texts = [without_spans(t, s, mark) if s else t for t, s in zip(texts, spans)]
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.column(at).type)
                if has_count:
                    k = names.index("n_chars")
                    columns[k] = pa.array([len(t) if s else c for t, s, c in zip(texts, spans, part.column(k).to_pylist())],
                                          part.column(k).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span cut out of ``text`` and ``mark`` put in
    its place (overlapping spans once); ``n_chars``, if there, is counted anew."""
    return docs.mapInArrow(_redacted(mark, "n_chars" in docs.columns), docs.schema)


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op9_secret_scan(spark, sf_dir):
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x.kind == k)).cast("long").alias("n_" + k)
    return found.select("doc_id", *[count(k) for k in KINDS],
                        F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))
