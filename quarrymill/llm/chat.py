"""Chat formatting by perspective rotation, in DataFrame functions only: each participant once is the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns of one part of a rendered dialogue.
TURNS = 64
SYSTEM, END = "system", "<|end|>\n"


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, role, said and place: turns numbered from 0 within their conversation, by turn, role and text.

    Rows are dealt out by range of all they are ordered by, so that one endless conversation, or one turn repeated without end, lies in
    many tasks; a task numbers its own, and what the tasks before it hold of a conversation is added.
    """
    c = F.col
    rows = turns.filter(c("conv_id").isNotNull()).select(
        c("conv_id").cast("long").alias("conv_id"),
        c("turn").cast("long").alias("turn"),
        F.coalesce(c("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(c("text").cast("string"), F.lit("")).alias("said"),
        F.monotonically_increasing_id().alias("copy"),  # equal rows are alike, whichever comes first
    )
    dealt = rows.repartitionByRange("conv_id", "turn", "role", "said", "copy").withColumn("task", F.spark_partition_id())
    dealt = common.cut(dealt, "turns")  # written, as a task's number holds for one run only
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("conv_id", "task").agg(F.count("*").alias("size")).select("conv_id", "task", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("conv_id", "task").orderBy("turn", "role", "said", "copy"))
    return dealt.withColumn("own", own).join(base, ["conv_id", "task"]).select("conv_id", "role", "said", (c("base") + c("own") - 1).alias("place"))


def rotate(turns: DataFrame, turns_a_part: int = TURNS) -> DataFrame:
    """conv_id, speaker, part, n_turns, start, text and mask for each participant of each conversation.

    The dialogue is rendered with the speaker's turns as assistant, other participants' as named user turns, and system turns, which
    aren't a participant's, as system; mask lists start:end (code points of the whole dialogue, end exclusive) of what the speaker
    says, end mark included. A dialogue comes in parts of turns_a_part turns; start is the part's place in it, so that texts and masks
    of the parts, one behind the other, are those of the whole dialogue, however long. Turns are ordered by turn, role and text, a null
    turn first; repeated rows are all rendered. A null role is "unknown", a null text empty; rows without a conversation are no one's
    and give nothing, nor do conversations with system turns only, nor an empty table.
    """
    c = F.col
    rows = placed(turns).withColumn("part", F.floor(c("place") / turns_a_part))
    speakers = rows.filter(c("role") != SYSTEM).select("conv_id", c("role").alias("speaker")).distinct()
    line = F.struct("place", "role", "said")
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # turns_a_part at most
    seen = parts.join(speakers, "conv_id")

    def head(role: Column) -> Column:
        named = F.concat(F.lit("<|user name="), role, F.lit("|>\n"))
        return F.when(role == c("speaker"), F.lit("<|assistant|>\n")).when(role == SYSTEM, F.lit("<|system|>\n")).otherwise(named)

    text = F.array_join(F.transform("lines", lambda x: F.concat(head(x["role"]), x["said"], F.lit(END))), "")
    shown = seen.select("conv_id", "speaker", "part", F.size("lines").alias("n_turns"), text.alias("text"), F.transform("lines", lambda x: F.struct(x["role"].alias("role"), F.length(x["said"]).alias("n"))).alias("sizes"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = seen.select("conv_id", "speaker", "part", F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(head(x["role"])) + F.length(x["said"]) + len(END)).alias("chars"))
    starts = starts.select("conv_id", "speaker", "part", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("start"))  # a row a part, without its text
    shown = shown.join(starts, ["conv_id", "speaker", "part"])

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + F.length(head(x["role"]))
        end = first + x["n"] + len(END)
        span = F.when(x["role"] == c("speaker"), F.array(F.concat_ws(":", first, end))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(state["spans"], span).alias("spans"))

    none = F.struct(c("start").alias("at"), F.array().cast("array<string>").alias("spans"))
    mask = F.aggregate("sizes", none, step, lambda s: F.array_join(s["spans"], ","))
    return shown.select("conv_id", "speaker", "part", "n_turns", "start", "text", mask.alias("mask"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    return rotate(common.table(spark, sf_dir, "conversations"))


ORACLE = rf"""
WITH r AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> '{SYSTEM}'),
l AS (
  SELECT r.*, speaker, role = speaker AS mine,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = '{SYSTEM}' THEN '<|system|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head,
    said || '<|end|>' || chr(10) AS body
  FROM r JOIN d USING (conv_id)),
o AS (SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY place) AS BIGINT) AS e FROM l)
SELECT conv_id, speaker, CAST(place // {TURNS} AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n_turns, min(e - length(head) - length(body)) AS start,
  string_agg(head || body, '' ORDER BY place) AS text, coalesce(string_agg((e - length(body)) || ':' || e, ',' ORDER BY place) FILTER (WHERE mine), '') AS mask
FROM o GROUP BY conv_id, speaker, place // {TURNS}
"""
