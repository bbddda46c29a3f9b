import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np

from starlens.llm import chat
from starlens.llm.sharding import assign_shards, minimax_cuts, op4_shard, place_ranges

CONV = "conv_id long, turn long, role string, text string, perspective string, size int"


def chat_brute(turns):
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((-1 if t is None else t, r or "unknown", x or "", t))
    out = []
    for c, rows in by.items():
        for me in {r for _, r, _, _ in rows} - {"system"}:
            at, segments = 0, []
            for o, r, x, t in rows:
                head = "<|system|>\n" if r == "system" else "<|assistant|>\n" if r == me else f"<|user name={r}|>\n"
                segments.append((o, r, head + x + "<|end|>\n", len(head), t))
            for k, (_, r, seg, n, t) in enumerate(sorted(segments, key=lambda s: s[:3])):
                mask = (at + n, at + len(seg)) if r == me else (None, None)
                out.append((c, me, k, t, r, seg, at, at + len(seg), *mask))
                at += len(seg)
    return sorted(out, key=repr)


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi 🙂"), (1, 2, "bob", None), (1, 3, None, "who?"), (1, 3, None, "who?"),
             (2, 0, "system", "alone"), (3, None, "a", "x"), (3, 5, "a", ""), (None, 1, "z", "no id")]
    turns += [(9, i, random.Random(i).choice("abc"), "t" * (i % 7)) for i in range(1500)]
    df = spark.createDataFrame([(*t, "p", 1) for t in turns], CONV)
    assert sorted((tuple(r) for r in chat.rotate_perspectives(df).collect()), key=repr) == chat_brute(turns)
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    want = sorted((tuple(r) for r in con.sql(chat.OP3_SQL).fetchall()), key=repr)
    assert sorted((tuple(r) for r in chat.op3_chat_format(spark, sf).collect()), key=repr) == want


def test_capacity_is_least():
    rng = random.Random(8)
    for _ in range(300):
        sizes, k = [rng.randint(0, 30) for _ in range(rng.randint(1, 12))], rng.randint(1, 6)
        best = {(0, 0): 0}
        for i in range(len(sizes) + 1):
            for j in range(1, k + 1):
                best[i, j] = min((max(best.get((p, j - 1), 10 ** 9), sum(sizes[p:i])) for p in range(i + 1)), default=0)
        cap, ends = minimax_cuts(np.array(sizes), k)
        pieces = [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)]
        assert cap == best[len(sizes), k] and len(ends) == k and ends[-1] == len(sizes) and max(pieces) <= cap
    assert len(set(place_ranges({0: 1000, 1: 1, 2: 1, 3: 1}, 3).values())) == 3


def check(out, docs):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    slots, home = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    text = dict(docs)
    for r in out:
        if r.doc_id is not None:
            home[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in home.values())


def test_shards(spark):
    docs = [(i, "hot text " * 20) for i in range(3000)] + [(5000 + i, f"text {i} " * (i % 9)) for i in range(900)]
    docs += [(7000, None), (7001, None), (7002, ""), (7000, None), (8000, "x" * 100_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, size int")
    check(assign_shards(df).collect(), docs)
    assert assign_shards(df.limit(0)).count() == 0
    sf = "/root/testdata/sf0.1"
    out = op4_shard(spark, sf).collect()
    check(out, duckdb.sql(f"select doc_id, text from read_parquet('{sf}/documents.parquet')").fetchall())
    size = Counter()
    for r in out:
        size[r.shard] += r.size
    assert max(size.values()) <= 1.01 * sum(size.values()) / 40 and max(size.values()) <= 1.25 * min(size.values())
