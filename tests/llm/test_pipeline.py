import random
import sys

import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from brute import near, quality
from test_decontaminate import brute as contaminated

from starlens.llm.pieces import default_model


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am", "con") for b in ("em", "sum", "or", "et", "ad")]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n)) + "."
    item, base = prose(30), prose(90)
    docs = [(i, prose(80)) for i in range(60)]
    docs += [(100, base), (101, base), (102, base + " more words here"), (103, prose(20) + " " + item), (104, "too short"),
             (105, "same line of words again\n" * 20), (106, prose(60) + " password=hunter2hunter2 " + prose(20)), (107, None)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(d, t) for d, t in docs if not quality(t)[5]]
    kept = {d for d, _, _, k in near(left) if k}
    left = [(d, t) for d, t in left if d in kept]
    dirty = {d for d, *_, c in contaminated(left, [(1, item)]) if c}
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = {d: sp.encode(t.replace("password=hunter2hunter2", "[SECRET]")) for d, t in left if d not in dirty}
    assert {100, 106} <= set(want) and not {101, 102, 103, 104, 105, 107} & set(want)
    assert got == want


def test_stage_columns_and_entry(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.dtypes == docs.dtypes
        docs = out
    names = [f"op{n}_" for n in range(1, 11)] + ["pipeline"]
    assert all(any(q.startswith(n) for q in entry.queries()) for n in names)


def test_entry_without_the_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert entry._training_data() == ({}, {})
