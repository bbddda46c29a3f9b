"""The registered queries of this package and their DuckDB SQL."""

from starlens.llm import (alignment, chat, decontaminate, langid, near_dedup, passages, pieces, pii, quality,
                          secrets, sharding, toxicity, whitening)

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_chat_format": chat.op3_chat_format,
    "op4_shard": sharding.op4_shard,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_language_id": langid.op7_language_id,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_whitening": whitening.op11_whitening,
    "op12_passages": passages.op12_passages,
    "op13_alignment": alignment.op13_alignment,
}
ORACLE = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
}
