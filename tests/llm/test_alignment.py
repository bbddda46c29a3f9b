import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from starlens.llm import alignment as al

SCHEMA = "doc_id long, text string, pairs string, n_a int"
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared")


def sides():
    a_path, b_path = al.default_models()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def byte_table():
    """The usual table of byte-level vocabularies."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts):
    """The contract on whole texts, one by one."""
    a, b = sides()
    table = byte_table()
    docs = []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        by_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        by_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or not (b"".join(by_a) == b"".join(by_b) == (" " + t).encode()):
            docs.append(None)
            continue
        spans = []
        for ids, pieces in ((ids_a, by_a), (ids_b, by_b)):
            at, out = 0, []
            for i, p in zip(ids, pieces):
                out.append((at, at + len(p), i))
                at += len(p)
            spans.append(out)
        ends_a, ends_b = ({e: i for _, e, i in s} for s in spans)
        cuts = sorted(set(ends_a) & set(ends_b))
        group, start = [], 0
        for c in cuts:
            group.append(tuple([i for s, e, i in side if start <= s and e <= c] for side in spans))
            start = c
        over = sum(s < f and g < e for s, e, _ in spans[0] for g, f, _ in spans[1] if len(spans[0]) < 2000) if len(t) < 3000 else None
        docs.append((len(ids_a), len(ids_b), group, [(ends_a[c], ends_b[c]) for c in cuts], over))
    counts = Counter(p for d in docs if d for p in d[3])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0, 0))
            continue
        n_a, n_b, group, links, over = d
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in group)
        out.append((n_a, n_b, len(group), len(links), sum(counts[p] == most[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest(), over,
                    sum(len(x) * len(y) for x, y in group)))
    return out


def same(got, texts):
    want = brute(texts)
    for i, r in enumerate(sorted(got, key=lambda r: r.doc_id)):
        for name, value in zip(FIELDS, want[i]):
            assert value is None or r[name] == value, (i, name, texts[i] and texts[i][:80])


@pytest.mark.parametrize("hot", [1 << 20, 50, 0])
def test_hard_texts(spark, hot):
    """All id pairs broadcast, some, or none: the same rows."""
    rng = random.Random(8)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "🙂", "ß", "<s>", "<|endoftext|>", "\u0000", "漢字", "word", "123", ".",
            "'s", " ", " ", "\x1c", "naïve", "====", "don't", " the", " word"]
    texts = [None, "", " ", "  lead", "trail  ", "x" * 500, " " * 70, "a▁b c", "x ▁", "plain words only", "ab" * 2000 + " y",
             "漢字" * 300, "= " * 50 + "=" * 200]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(250)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = al.align_tokenizers(df, hot=hot).collect()
    assert len(got) == len(texts)
    same(got, texts)


def test_table(spark):
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(al.align_tokenizers(df).collect(), texts)
    assert al.align_tokenizers(df.limit(0)).count() == 0
    both = al.align_tokenizers(spark.createDataFrame([(None, "two words"), (None, "two words"), (1, None)], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in both.collect()) == [(0, 2, 4), (0, 2, 4), (1, 0, 0)]


def test_links(spark):
    """Links written out agree with the counts."""
    texts = ["international naïve 漢字", "====== a  b", "", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = al.token_links(df).collect()
    for r in al.align_tokenizers(df).collect():
        own = [x for x in rows if x.doc_id == r.doc_id]
        assert sum(x.kind == "overlap" for x in own) == r.n_overlaps
        assert sum(x.kind == "group" for x in own) == r.n_shared
        assert sum(x.kind == "overlap" and x.ends_together for x in own) == r.n_links
        assert sum(x.value for x in own if x.kind == "overlap") == (len(texts[r.doc_id].encode()) + 1 if texts[r.doc_id] else 0)


@pytest.mark.parametrize("seed", range(4))
def test_products(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(al, "PRODUCTS", int(rng.integers(1, 60)))
    a, b = (rng.random((n, m)) < 0.3 for n, m in ((13, 9), (9, 11)))
    csr = [(al.pointers(m.sum(axis=1)), np.nonzero(m)[1]) for m in (a, b)]
    got = np.zeros((13, 11), int)
    for row, col, value in al.gustavson(*csr[0], *csr[1]):
        got[row, col] += value
    assert (got == a.astype(int) @ b.astype(int)).all()
