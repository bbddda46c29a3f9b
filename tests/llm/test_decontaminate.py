import hashlib

import duckdb
from brute import BW, LOW

from starlens.llm import decontaminate as op

DOCS = "doc_id long, text string, item_id string, h int"
ITEMS = "item_id long, text string, doc_id int"


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = BW.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            grams.setdefault(tuple(w[k:k + 13]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = BW.findall((t or "").translate(LOW))
        hit, ids = set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (own := grams.get(tuple(w[k:k + size]))):
                    ids |= own
                    hit |= set(range(k, k + size))
        out.append((d, len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return df, b, sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated)
                          for r in op.contamination(df, b).collect()), key=repr)


def test_edges(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(20))
    items = [(1, item), (2, "Tiny item"), (2, "tiny ITEM"), (3, None), (4, "..."), (None, "lost words here"), (5, item),
             (6, "É x")]
    docs = [(1, None), (2, ""), (3, item.upper()), (4, "a tiny,item b " * 3), (4, "a tiny,item b " * 3), (5, "lost words here"),
            (6, "pad " * 5000 + item + " pad" * 5000), (None, "tiny item"), (7, "é x"), (8, "É x"), (9, item[:-4])]
    df, b, got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert sorted(r.doc_id for r in op.drop_contaminated(df, b).filter("doc_id is not null").collect()) == [1, 2, 5, 6, 7]
    assert op.drop_contaminated(df, b).columns == df.columns
    monkeypatch.setattr(op, "SET_ROWS", 3)
    assert run(spark, docs, items)[2] == brute(docs, items)
    assert run(spark, docs, [])[2] == brute(docs, []) and run(spark, [], items)[2] == []


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{sf}/documents.parquet')").fetchall()
    items = duckdb.sql(f"select item_id, text from read_parquet('{sf}/benchmark.parquet')").fetchall()
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, n, h, i, c in brute(docs, items)]
    got = sorted((tuple(r) for r in op.op2_decontaminate(spark, sf).collect()), key=repr)
    assert got == sorted(want, key=repr)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    assert sorted((tuple(r) for r in con.sql(op.OP2_SQL).fetchall()), key=repr) == got
