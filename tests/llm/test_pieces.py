import random

import duckdb
import sentencepiece

from starlens.llm.pieces import MARK, MergeVocabulary, default_model, encode_documents


def test_against_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    rng = random.Random(5)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "🙂", "ß", "<s>", MARK, "\u0000", "漢字", "word", "123", "."]
    texts = ["", None, " ", "  lead", "trail  ", "x" * 500, " " * 70, "ab" * 3000 + " y"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [r[0] for r in duckdb.sql("select text from read_parquet('/root/testdata/sf0.001/documents.parquet')").fetchall()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in encode_documents(df).collect():
        want = sp.encode(texts[r.doc_id] or "")
        assert list(r.ids) == want, repr(texts[r.doc_id])[:200]
        assert r.decoded == sp.decode(want), repr(texts[r.doc_id])[:200]
    assert encode_documents(df.limit(0)).count() == 0


def test_heap_and_rows_agree():
    voc = MergeVocabulary(open(default_model(), "rb").read())
    for u in ("international", "Anthehes,", "été", MARK * 3 + "x", "aaaaaaaa", "🙂🙂", "<s>"):
        assert voc.finish(voc.agenda(voc.symbols([u])[0].tolist())) == voc.encode_units([u])[u]
