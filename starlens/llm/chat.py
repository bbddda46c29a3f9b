"""Operator 3: multi-party chat formatting by perspective rotation (DataFrame only).

For every participant the dialogue is rendered with that speaker as the
assistant, the others as named users and system turns as they are. The result
has one row per (conversation, perspective, turn): the rendered segment, its
place in the rendered dialogue and the part of it that is trained on. A
dialogue is the concatenation of its segments in order, so a conversation of
any length is never one cell or one task: running places are summed in blocks
of ``BLOCK`` turn numbers and the blocks' offsets are joined in.

Edge cases: null role is a participant named ``unknown``; null text is empty;
a null turn comes first; equal turns are ordered by role and text; a
conversation of system turns only has no perspective and no rows; rows
without conv_id form one conversation; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
SYSTEM = "system"
END = "<|end|>\n"


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, seq, turn, speaker, segment, start, end,
    mask_start, mask_end (null where the turn is context only)."""
    role = F.coalesce("role", F.lit("unknown"))
    rows = turns.select("conv_id", "turn", role.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    who = (rows.filter(F.col("speaker") != SYSTEM).groupBy(F.col("conv_id").alias("c"))
               .agg(F.collect_set("speaker").alias("who")))
    own = F.col("speaker") == F.col("perspective")
    head = (F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n"))))
    seen = (rows.join(who, F.col("conv_id").eqNullSafe(F.col("c")))
                .select("conv_id", "turn", "speaker", "text", F.explode("who").alias("perspective"))
                .withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit(END)))
                .withColumn("size", F.length("segment").cast("long"))
                .withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK)).drop("text"))
    key = ["conv_id", "perspective", "block"]
    order = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "speaker", "segment")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    inside = (seen.withColumn("rn", F.row_number().over(order).cast("long"))
                  .withColumn("upto", F.sum("size").over(running)))
    totals = seen.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("conv_id").alias("oc"), F.col("perspective").alias("op"), F.col("block").alias("ob"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                            F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    out = inside.join(offsets, F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("perspective") == F.col("op"))
                      & (F.col("block") == F.col("ob")))
    stop = F.col("s0") + F.col("upto")
    start = stop - F.col("size")
    return out.select("conv_id", "perspective", (F.col("n0") + F.col("rn") - 1).alias("seq"), "turn", "speaker", "segment",
                      start.alias("start"), stop.alias("end"),
                      F.when(own & (F.col("speaker") != SYSTEM), start + F.col("head")).alias("mask_start"),
                      F.when(own & (F.col("speaker") != SYSTEM), stop).alias("mask_end"))


def op3_chat_format(spark, sf_dir):
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT t.conv_id, perspective, turn, speaker,
        CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>'
             ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head,
        text || '<|end|>' || chr(10) AS body
      FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
p AS (SELECT *, row_number() OVER o - 1 AS seq,
        sum(length(head) + length(body)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
      FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, head || body))
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, speaker, head || body AS segment,
  CAST(stop - length(head) - length(body) AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end",
  CASE WHEN speaker = perspective THEN CAST(stop - length(body) AS BIGINT) END AS mask_start,
  CASE WHEN speaker = perspective THEN CAST(stop AS BIGINT) END AS mask_end
FROM p
"""
