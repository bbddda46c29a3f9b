import random
import zlib

import duckdb
import numpy as np

from starlens.llm import langid, toxicity

SF = "/root/testdata/sf0.1"


def test_gradients():
    """Backpropagation through time against finite differences."""
    net = langid.ByteGru(["a", "b"], seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, size, owner = langid.matrix(["ab", "xyz", "été"])
    y = np.array([0, 1, 0])[owner]
    _, g = net.gradients(x, size, y)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if k == "emb":
                at = (int(x[0, 1]), at[1])
            old, e = v[at], 1e-3
            v[at] = old + e
            up = net.gradients(x, size, y)[0]
            v[at] = old - e
            down = net.gradients(x, size, y)[0]
            v[at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-4, k


def test_language_edges(spark):
    docs = [(i, t, lang, 0.5) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("der hund und die katze", "de")] * 40 + [("unlabelled", None)])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    net = langid.train(df)
    odd = spark.createDataFrame([(1, None, "x", 1.0), (2, "", "x", 1.0), (3, "12 -- 3", "x", 1.0), (4, "the dog", "x", 1.0),
                                 (4, "the dog", "x", 1.0), (5, "die katze " + "a" * 100_000, "x", 1.0)],
                                "doc_id long, text string, lang_pred string, score double")
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(odd, net).collect())
    assert got[:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert langid.train(df.filter("lang is null")) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(odd.limit(0), net).count() == 0


def test_language_held_out(spark):
    lang = dict(duckdb.sql(f"select doc_id, lang from read_parquet('{SF}/documents.parquet')").fetchall())
    rows = langid.op7_language_id(spark, SF).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.98 * len(test)


def subsequences(s, span=toxicity.SPAN):
    """The kernel's features by definition: three places, weighted by their span."""
    s, out = f"^{s}^", {}
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, min(len(s), i + span)):
                key = s[i] + s[j] + s[k]
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
    norm = sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(len(s)) for j in range(i + 1, len(s))
               for k in range(j + 1, min(len(s), i + span))) ** 0.5
    return {k: v / norm for k, v in out.items()}


def test_kernel_by_definition():
    rng = random.Random(2)
    words = ["".join(rng.choice("abco") for _ in range(rng.randint(1, 9))) for _ in range(12)]
    feats = [subsequences(w) for w in words]
    want = [[sum(v * b.get(k, 0) for k, v in a.items()) for b in feats] for a in feats]
    assert np.allclose(toxicity.kernel(words, words), want, atol=1e-5)


def test_toxicity_edges(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeiourstnl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    line = lambda: " ".join(rng.choice(words) for _ in range(30))
    docs = [(i, line() + (" you blockhead " if i % 3 == 0 else " ") + line(), int(i % 3 == 0), 0.0) for i in range(300)]
    known = spark.createDataFrame(docs, "doc_id long, text string, toxic int, score double")
    machine = toxicity.train(known.drop("toxic"), known)
    odd = [(1, None), (2, ""), (3, "12 !!"), (4, line()), (5, "you blockhead"), (5, "you blockhead"), (6, "a bl-ock.head here"),
           (7, "one blockxhead more"), (8, "b l o c k h e a d"), (9, line() * 500)]
    df = spark.createDataFrame([(i, t, "x") for i, t in odd], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, machine).collect()}
    assert all(got[k] >= 0.5 for k in (5, 6, 7, 8)) and all(0 <= got[k] < 0.5 for k in (1, 2, 3, 4, 9)), got
    assert toxicity.train(known.drop("toxic"), known.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score_toxicity(df, None).collect()} == {0.0}
    assert toxicity.score_toxicity(df.limit(0), machine).count() == 0


def test_toxicity_marks():
    for t, want in (("id.iot", "idiot"), ("idi!ot", "idiot"), ("i-d.i0t", "idit"), ("you/idiot/now", "idiot"), ("you-idiot,now", "idiot")):
        assert want in toxicity.strings_of(f"see {t} here"), t
    rng = random.Random(6)
    words = ["".join(rng.choice("aeiourstnl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    line = lambda: " ".join(rng.choice(words) for _ in range(30))
    labels = [int(i % 3 == 0) for i in range(300)]
    machine = toxicity.fit([line() + (" you blockhead " if y else " ") + line() for y in labels], labels)
    score = lambda t: machine.probability(machine.margins(sorted(toxicity.strings_of(t))).max())
    assert all(score(t) >= 0.5 for t in ("bl.ockhead", "block!head", "blo,ck.head", "you/blockhead/now")) and score(line()) < 0.5


def test_toxicity_held_out(spark):
    rows = {r.doc_id: r for r in toxicity.op5_toxicity(spark, SF).collect()}
    test = [(rows[d], y) for d, y in duckdb.sql(
        f"select doc_id, toxic from read_parquet('{SF}/labels.parquet')").fetchall() if rows[d].held_out]
    assert len(rows) == 10_000 and len(test) > 500
    assert sum(r.predicted == y for r, y in test) >= 0.95 * len(test)
    toxic = [r.score for r, y in test if y]
    clean = [r.score for r, y in test if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) >= 0.92 * len(toxic) * len(clean)


def test_language_rows_without_id(spark, monkeypatch):
    """Rows that share an id, or have none, are learned from, ``sample`` per language at most."""
    docs = [(i % 2 or None, f"{t} {i % 400}", lang) for i in range(800) for t, lang in (("the cat", "en"), ("die katze", "de"))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    read = []
    monkeypatch.setattr(langid, "words_of", lambda t: read.append(t) or t.split())
    monkeypatch.setattr(langid.ByteGru, "fit", lambda self, words, labels: self)
    langid.train(df, sample=20)
    for word in ("cat", "katze"):
        assert 10 <= sum(word in t for t in read) <= 20
    read.clear()
    langid.train(df, sample=1000)
    assert len(read) == len(set(docs))
