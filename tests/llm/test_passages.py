import hashlib
import random

import duckdb
import numpy as np
import pytest

from starlens.llm import passages as ps
from starlens.llm import suffixes as sx
from starlens.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, spans string, row int"


def brute(texts, length=200):
    """(n_bytes, n_removed, n_spans, sha256 of what is left) by counting every window."""
    count = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def got(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    with Scratch(spark, "t") as s:
        rows = ps.cut_passages(df, s, **kw).collect()
    return [(r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in sorted(rows, key=lambda r: r.doc_id)]


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common = [prose(rng.choice([25, 45, 60, 200])) for _ in range(12)]
    line = prose(22)                                            # shared, but mostly under a passage
    texts = [None, "", "short", "a" * 199, "a" * 199, "b" * 700, "b" * 700, "c" * 400, common[3], common[3]]
    for _ in range(120):
        parts = [prose(rng.randint(0, 60)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            i = rng.randint(0, 40)
            parts.insert(rng.randint(0, len(parts)), c[i:len(c) - rng.randint(0, 40)])
        if rng.random() < 0.4:
            parts.insert(rng.randint(0, len(parts)), line)
        texts.append(" ".join(parts))
    t = texts[50] + prose(80)
    for _ in range(20):                                         # near copies
        k = rng.randrange(len(t))
        texts.append(t[:k] + word() + t[k + 3:])
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"shard": 3000}), (3, {"crowd": 3}), (4, {"shard": 900, "crowd": 40})])
def test_against_all_windows(spark, seed, kw):
    """One shard of ranges, several that are merged, and crowded anchors."""
    texts = passages(seed)
    assert got(spark, texts, **kw) == brute(texts)


def test_small_shards(spark, monkeypatch):
    """Texts cut into pieces: what runs across a border counts."""
    monkeypatch.setattr(ps, "SHARD", 1500)
    texts = passages(7)
    texts += [" ".join(t for t in texts if t), "x" * 5000]
    assert got(spark, texts) == brute(texts)


def test_table(spark):
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()]
    assert got(spark, texts) == brute(texts)
    rows = ps.op12_passages(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts)


def test_edges(spark):
    with Scratch(spark, "t") as s:
        assert ps.cut_passages(spark.createDataFrame([], SCHEMA), s).count() == 0
    with Scratch(spark, "t") as s:
        text = "".join(chr(97 + i * i % 23) for i in range(300))
        df = spark.createDataFrame([(None, text, "x", 1), (None, text, "x", 1), (3, None, "x", 1)], SCHEMA)
        rows = ps.cut_passages(df, s).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(0, 0), (300, 300), (300, 300)]


@pytest.mark.parametrize("seed", range(12))
def test_suffix_arrays(seed, monkeypatch):
    """Order, common prefixes and repeats by definition."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(sx, "LANES", int(rng.integers(1, 40)))
    data = rng.integers(0, rng.integers(1, 6), int(rng.integers(1, 300))).astype(np.uint8)
    if seed % 3 == 0:
        data = np.tile(data[:max(1, len(data) // 5)], 7)
    b, n = data.tobytes(), len(data)
    for length in (2, 9, 30):
        sa, least, below = sx.suffix_array(data, length)
        assert sorted(sa.tolist()) == list(range(n))
        assert [b[i:i + length] for i in sa] == sorted(b[i:i + length] for i in range(n))
        lcp = sx.common_prefixes(data, sa, least, below, length)
        for k in range(1, n):
            x, y = b[sa[k - 1]:], b[sa[k]:]
            true = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert least[k] <= true < below[k] or below[k] > 2 ** 30
            assert (lcp[k] >= length) == (true >= length)
        count = {}
        for i in range(n - length + 1):
            count[b[i:i + length]] = count.get(b[i:i + length], 0) + 1
        assert sx.repeated(data, length).tolist() == [count.get(b[i:i + length], 0) > 1 and i + length <= n for i in range(n)]
