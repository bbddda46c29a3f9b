"""Corpus pipeline: quality rules, near-duplicates, decontamination, secret
redaction, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage's rows as
Parquet under the shared checkpoint folder and reads them again, so a stage
starts from files and a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from starlens.llm.decontaminate import drop_contaminated
from starlens.llm.near_dedup import drop_near_duplicates
from starlens.llm.pieces import encode_documents
from starlens.llm.quality import drop_low_quality
from starlens.llm.secrets import redact_secrets
from starlens.session import ensure_checkpoint_dir


def quality(spark, docs, sf_dir):
    return drop_low_quality(docs)


def near_duplicates(spark, docs, sf_dir):
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark, docs, sf_dir):
    return redact_secrets(docs)


def encoding(spark, docs, sf_dir):
    """(doc_id, lang, source, n_tokens, ids): what a trainer reads."""
    out = encode_documents(docs)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontaminate", decontamination),
          ("secret_scan", secrets), ("sentencepiece", encoding)]
#: Minimum-wise hashing, decoding of nested layers and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
