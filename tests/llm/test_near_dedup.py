import hashlib
import random

import duckdb
import pytest
from brute import near

from starlens.llm.near_dedup import drop_near_duplicates, near_duplicates

SCHEMA = "doc_id long, text string, set_id string, n int"


def got(spark, docs):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "two one"), (7, "a b c d e"),
            (8, "A b c d e"), (8, "a b c d e"), (8, "a b c d e"), (None, "a b c d e"), (9, "a b c d e f"),
            (10, "w " * 40000), (11, "É x"), (12, "é x")]
    want = sorted(near(docs), key=repr)
    assert got(spark, docs) == want
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sorted(r.doc_id for r in drop_near_duplicates(
        spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)).collect()) == [1, 2, 3, 4, 6, 7, 9, 10, 11, 12]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    """Chains of edited copies around the threshold, with a shared passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, common = [], [rng.choice(words) for _ in range(25)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 30, 90]))]
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 14))):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                base = t
            docs.append((len(docs), " ".join(t + common * (g % 3 == 0))))
    rng.shuffle(docs)
    assert got(spark, docs) == sorted(near(docs), key=repr)


def stage(docs):
    """(id, text) that stay, from the groups of all pairs."""
    group = near([(i, t) for i, (_, t) in enumerate(docs)])
    best = {}
    for i, (d, t) in enumerate(docs):
        if group[i][1]:
            rank = (d is None, d or 0, hashlib.md5(t.encode()).digest())
            best[group[i][2]] = min(best.get(group[i][2], (rank, d, t)), (rank, d, t), key=lambda x: x[0])
    return sorted([(d, t) for _, d, t in best.values()]
                  + [(d, t) for i, (d, t) in enumerate(docs) if not group[i][1]], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_without_and_with_equal_ids(spark, seed):
    """Near copies without id, ids shared by different texts, repeated rows."""
    rng = random.Random(seed)
    base = [" ".join(f"v{rng.randrange(300)}" for _ in range(30)) for _ in range(8)]
    docs = [(None, base[0] + " tail"), (5, base[0]), (None, base[1]), (None, base[1] + " end"), (None, None), (None, ""), (7, " ")]
    for k in range(120):
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(300)}"
        docs.append((rng.choice([None, None, 3, 5, 9, 100 + k]), " ".join(t)))
    docs += docs[20:30]
    rng.shuffle(docs)
    assert got(spark, docs) == sorted(near(docs), key=repr)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    assert sorted(((r.doc_id, r.text) for r in drop_near_duplicates(df).collect()), key=repr) == stage(docs)


def test_table(spark):
    docs = duckdb.sql("select doc_id, text from read_parquet('/root/testdata/sf0.01/documents.parquet')").fetchall()
    assert got(spark, docs) == sorted(near(docs), key=repr)
