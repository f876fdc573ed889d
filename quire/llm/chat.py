"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that
participant as assistant, all others as named users, and a mask on what the
assistant says. Participants are the distinct speakers other than ``system``.

A rendering is a table of segments, one for each turn and perspective, in turn
order; ``dialogues`` joins segments into texts. A segment is a header line, the
content, and an end mark; the mask covers content and end mark of the assistant's
segments, as code-point offsets inside the segment, end exclusive.

Everything is DataFrame functions: the participants of each conversation are
made distinct and joined to its turns, so a conversation that holds very many
rows is a join key that adaptive execution splits, and no task gathers it.

Defined results: a null speaker is rendered as a user without a name and takes no
perspective; a null text is an empty content; a conversation without
participants has one rendering with a null perspective and no mask; a null
conversation id is a conversation of its own; repeated turns and rows are each
rendered; marks inside texts are broken up, so a text cannot forge
them, and letters of names that would break a header are escaped; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import table

SYSTEM = "system"
END = "<|end|>\n"
#: Consecutive turn numbers that one text of ``op7_dialogues`` covers, which bounds its memory.
PART_TURNS = 64
#: Characters that would end a header early, and what stands for them; names stay distinct.
_ESCAPES = {"%": "%25", "<": "%3C", ">": "%3E", "|": "%7C", "\n": "%0A", "\r": "%0D"}


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _user(speaker: Column) -> Column:
    for letter, escape in _ESCAPES.items():
        speaker = F.replace(speaker, F.lit(letter), F.lit(escape))
    return F.coalesce(F.concat(F.lit("<|user:"), speaker, F.lit("|>\n")), F.lit("<|user|>\n"))


def segments(
    conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", speaker_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """(conv, perspective, turn, speaker, segment, mask_start, mask_end) of every turn in every perspective."""
    turns = conversations.select(
        F.col(conv_column).alias("conv"),
        F.col(turn_column).alias("turn"),
        F.col(speaker_column).cast("string").alias("speaker"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    taking = turns.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = turns.join(taking, turns["conv"].eqNullSafe(taking["of"]), "left")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    header = (
        F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n"))
        .when(own, F.lit("<|assistant|>\n"))
        .otherwise(_user(F.col("speaker")))
    )
    parts = seen.select("conv", "perspective", "turn", "speaker", own.alias("own"), header.alias("header"), _safe(F.col("text")).alias("content"))
    segment = F.concat("header", "content", F.lit(END))
    return parts.select(
        F.col("conv").alias(conv_column),
        "perspective",
        F.col("turn").alias(turn_column),
        "speaker",
        segment.alias("segment"),
        F.when(F.col("own"), F.length("header")).cast("long").alias("mask_start"),
        F.when(F.col("own"), F.length(segment) - 1).cast("long").alias("mask_end"),
    )


def dialogues(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", part_turns: int | None = None, **columns) -> DataFrame:
    """(conv, perspective, part, text, masks): segments joined in turn order.

    A conversation is one text, which one task joins, in time that goes with its
    length; given ``part_turns`` a part covers that many turn numbers, so that a very
    long conversation is several texts. Turns of equal number, null ones too, are in
    one part, however many they are. A part begins with its first turn: the system's
    turns aren't repeated in later ones. Masks are offsets in the part's text.
    """
    rows = segments(conversations, conv_column, turn_column, **columns)
    turn = F.coalesce(F.col(turn_column), F.lit(0))
    part = (F.floor(turn / part_turns) if part_turns else F.lit(0)).cast("long").alias("part")
    rows = rows.select(F.col(conv_column).alias("conv"), "perspective", part, F.col(turn_column).alias("turn"), "speaker", "segment", "mask_start", "mask_end")
    order = Window.partitionBy("conv", "perspective", "part").orderBy("turn", "speaker", "segment", "mask_start")
    sizes = F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("before", sizes - F.length("segment"))
    mask = F.when(F.col("mask_start").isNotNull(), F.struct((F.col("before") + F.col("mask_start")).alias("start"), (F.col("before") + F.col("mask_end")).alias("end")))
    made = placed.groupBy("conv", "perspective", "part").agg(
        F.sort_array(F.collect_list(F.struct("place", "segment"))).alias("all"), F.sort_array(F.collect_list(mask)).alias("masks")
    )
    text = F.array_join(F.transform("all", lambda one: one["segment"]), "")
    return made.select(F.col("conv").alias(conv_column), "perspective", "part", text.alias("text"), "masks")


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation from every participant's perspective."""
    return segments(table(spark, sf_dir, "conversations"))


def op7_dialogues(spark, sf_dir: str) -> DataFrame:
    """Every conversation in turn order, in texts of ``PART_TURNS`` turns, from every participant's perspective; masks are start-end, by commas."""
    shown = F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return dialogues(table(spark, sf_dir, "conversations"), part_turns=PART_TURNS).withColumn("masks", F.array_join(shown, ","))


QUERIES = {"op7_chat": op7_chat, "op7_dialogues": op7_dialogues}

_SQL_NAME = "c.role"
for _letter, _escape in _ESCAPES.items():
    _SQL_NAME = f"replace({_SQL_NAME}, chr({ord(_letter)}), '{_escape}')"

ORACLE_SQL = {
    "op7_chat": f"""
WITH taking AS (
  SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'
), seen AS (
  SELECT c.conv_id, t.perspective, c.turn, c.role AS speaker, coalesce(c.role = t.perspective, false) AS own,
    CASE WHEN c.role = 'system' THEN '<|system|>' WHEN c.role = t.perspective THEN '<|assistant|>'
         ELSE coalesce('<|user:' || {_SQL_NAME} || '|>', '<|user|>') END || chr(10) AS header,
    replace(coalesce(c.text, ''), '<|', '< |') AS content
  FROM conversations c LEFT JOIN taking t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
)
SELECT conv_id, perspective, turn, speaker, header || content || '<|end|>' || chr(10) AS segment,
  CASE WHEN own THEN length(header) END AS mask_start,
  CASE WHEN own THEN length(header) + length(content) + 7 END AS mask_end
FROM seen
"""
}

ORACLE_SQL["op7_dialogues"] = f"""
WITH rows AS ({ORACLE_SQL["op7_chat"]}), placed AS (
  SELECT *, CAST(floor(coalesce(turn, 0) / {PART_TURNS}) AS BIGINT) AS part FROM rows
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, speaker NULLS FIRST, segment, mask_start NULLS FIRST) AS k FROM placed
), begun AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective, part ORDER BY k) - length(segment) AS BIGINT) AS begin FROM ordered
)
SELECT conv_id, perspective, part, string_agg(segment, '' ORDER BY k) AS text,
  coalesce(string_agg((begin + mask_start) || '-' || (begin + mask_end), ',' ORDER BY k) FILTER (mask_start IS NOT NULL), '') AS masks
FROM begun GROUP BY 1, 2, 3
"""
