"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets a rendering of its own, in which the participant is the
assistant and everybody else is a named user. Only the assistant's words are trained on: the mask
is the span of the words in the participant's own turns, without the markers around them.

Scale: plain DataFrame operations. A rendering is given as its segments, one row per turn, with
the place of each segment in the whole; places come from prefix sums over range-partitioned rows,
so a conversation of any length is spread over many tasks and never is one string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import shuffle_partitions, store

NOT_PARTICIPANTS = ("system", "tool")
UNKNOWN = "unknown"


def _speaker(role):
    trimmed = F.trim(role)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", UNKNOWN).otherwise(F.lower(trimmed))


def rotate(turns: DataFrame) -> DataFrame:
    """One row per participant and turn of ``turns(conv_id, turn, role, text)``.

    Returns ``conv_id, perspective, position`` (from 0), ``turn, speaker, role, name, segment, start``
    (characters before the segment), ``mask_start, mask_end`` (of the words to learn in the whole
    rendering; null outside the participant's own turns).

    Turns are in the order of turn, speaker and text (nulls first); repeated rows are rendered
    each. Speakers are compared trimmed and in lower case; a null or blank one is ``unknown``, which
    like system and tool gets no perspective of its own. A null text is empty. Rows with a null conv_id
    make one conversation. A conversation without participants gives no rows.
    """
    t = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                     _speaker(F.col("role").cast("string")).alias("speaker"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    who = t.where(~F.col("speaker").isin(*NOT_PARTICIPANTS, UNKNOWN)).select(
        "conv", F.col("speaker").alias("perspective")).distinct()
    r = t.join(who, "conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker").isin(*NOT_PARTICIPANTS), F.col("speaker")).otherwise("user")
    r = r.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit("<|im_start|>"), F.col("role"),
                    F.coalesce(F.concat(F.lit(" name="), F.regexp_replace("name", r"\s+", "_")), F.lit("")), F.lit("\n"))
    r = r.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, F.col("text"), F.lit("<|im_end|>\n")))
    order = ["conv", "perspective", "turn", "speaker", "text"]
    r = r.withColumn("size", F.length("segment").cast("bigint"))
    r = store(r.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
               .withColumn("_part", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()), "turns")
    group = ["conv", "perspective"]
    parts = r.groupBy(*group, "_part").agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "_part", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
                         F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    run = Window.partitionBy("_part", *group).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_chars", F.coalesce(F.sum("size").over(run), F.lit(0))).withColumn(
        "_rows", F.coalesce(F.count(F.lit(1)).over(run), F.lit(0))).join(parts, [*group, "_part"])
    start = F.col("_chars") + F.col("chars_before")
    own = F.col("role") == "assistant"
    return r.select("conv_id", "perspective", (F.col("_rows") + F.col("rows_before")).alias("position"), "turn",
                    "speaker", "role", "name", "segment", start.alias("start"),
                    F.when(own, start + F.col("head")).alias("mask_start"),
                    F.when(own, start + F.col("head") + F.length("text")).alias("mask_end"))
