"""Chat formatting with rotated perspectives.

Every speaker of a conversation gets a rendering of the whole dialogue in which that speaker is the
assistant and the others are named users; system turns stay system turns. The loss mask covers the
assistant's texts and their end marks.

A rendering is returned turn by turn: segment, its first character in the whole rendering, and the
masked characters. Concatenating a rendering's segments by ``seq`` gives its text. Turn rows keep the
result splittable when one conversation holds a large share of all turns; offsets and positions come
from running totals inside chunks of ``CHUNK`` turns plus totals of the chunks before.

Order is (turn, role, text), null turns first. A null text is empty, a null role speaks as
``unknown``, rows without a conversation id form one conversation. Rows that repeat are turns of their
own. A conversation of system turns only has no speaker and so no rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM, UNKNOWN = "system", "unknown"
START, END = "<|im_start|>", "<|im_end|>"
CHUNK = 256


def _header(role: Column, speaker: Column) -> Column:
    name = (
        F.when(role == speaker, F.lit("assistant"))
        .when(role == SYSTEM, F.lit(SYSTEM))
        .otherwise(F.concat(F.lit("user name="), role))
    )
    return F.concat(F.lit(START), name, F.lit("\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """Per conversation, speaker and turn: seq, segment, start, mask_start, mask_end.

    ``start`` is the segment's first character in the rendering; the mask is half open, in characters
    of the rendering, and null for turns of others.
    """
    turns = conversations.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 60))).cast("long"))
    speakers = turns.where(F.col("role") != SYSTEM).select(
        F.col("conv_id").alias("__conv"), F.col("role").alias("speaker")).distinct()
    seen = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    header = _header(F.col("role"), F.col("speaker"))
    drawn = seen.withColumn("header", header).withColumn(
        "segment", F.concat("header", "text", F.lit(END + "\n"))).withColumn("size", F.length("segment"))
    key = ["conv_id", "speaker", "chunk"]
    within = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(
        Window.unboundedPreceding, 0)
    placed = drawn.withColumns({
        "__seq": F.count(F.lit(1)).over(within) - 1,
        "__start": F.sum("size").over(within) - F.col("size"),
    })
    chunks = Window.partitionBy("conv_id", "speaker").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = drawn.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).select(
        *[F.col(c).alias(f"__{c}") for c in key],
        F.coalesce(F.sum("n").over(chunks), F.lit(0)).alias("__n"),
        F.coalesce(F.sum("size").over(chunks), F.lit(0)).alias("__size"),
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("speaker") == F.col("__speaker"))
        & (F.col("chunk") == F.col("__chunk"))
    )
    start = (F.col("__size") + F.col("__start")).cast("long")
    own = F.col("role") == F.col("speaker")
    return placed.join(before, same).select(
        "conv_id", "speaker", (F.col("__n") + F.col("__seq")).cast("long").alias("seq"), "turn", "role",
        "segment", start.alias("start"),
        F.when(own, start + F.length("header")).alias("mask_start"),
        F.when(own, start + F.col("size") - 1).alias("mask_end"),
    )


ROTATE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS text FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> '{SYSTEM}'
), drawn AS (
  SELECT t.conv_id, s.speaker, t.turn, t.role, t.text,
    '{START}' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = '{SYSTEM}' THEN '{SYSTEM}'
      ELSE 'user name=' || t.role END || chr(10) AS header
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), whole AS (
  SELECT *, header || text || '{END}' || chr(10) AS segment FROM drawn
), placed AS (
  SELECT *, row_number() OVER w - 1 AS seq, sum(length(segment)) OVER w - length(segment) AS start
  FROM whole
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, speaker, CAST(seq AS BIGINT) AS seq, turn, role, segment, CAST(start AS BIGINT) AS start,
  CASE WHEN role = speaker THEN CAST(start + length(header) AS BIGINT) END AS mask_start,
  CASE WHEN role = speaker THEN CAST(start + length(segment) - 1 AS BIGINT) END AS mask_end
FROM placed
"""
