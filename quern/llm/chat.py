"""Preference examples for chat models: one prompt, two masked completions.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is
the prompt, rendered once; what follows it in either is its completion, with the spans
of characters that count for the loss: the assistant's own turns.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"

#: How a turn is rendered, and the role whose turns are learned.
HEAD = ("<|", "|>\n")
END = "<|end|>\n"
LEARNED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` from rows ``(conv_id, turn, role, text)``.

    Turns are in order of ``turn``, nulls last; of equal numbers by role and text, and
    rows repeated as a whole count once. Null roles and texts are empty. Rows without a
    conversation are left out. A conversation is one example, so it is one row here.
    """
    own = F.struct(
        F.col("turn").isNull().alias("late"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return (
        turns.filter(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_set(own)).alias("t"))
        .select(
            "conv_id",
            F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        )
    )


def answer_pairs(convs: DataFrame) -> DataFrame:
    """``(conv_id, chosen, rejected)`` for tables without recorded preferences.

    The chosen conversation ends with its last assistant turn. In the rejected one that
    turn repeats the conversation's previous answer, or, where there is none, echoes
    the turn before it (nothing, if it is the first). Conversations without an assistant
    turn make no pair.
    """
    turns = F.col("turns")
    places = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(turns), F.lit(1))),
        lambda i: F.get(turns, i - 1)["role"] == LEARNED,
    )
    last, previous = F.element_at("places", -1), F.get("places", F.size("places") - 2)
    before = F.coalesce(previous, last - 1)
    text = F.coalesce(F.get(turns, before - 1)["text"], F.lit(""))
    answer = F.struct(F.lit(LEARNED).alias("role"), text.alias("text"))
    return (
        convs.withColumn("places", places)
        .filter(F.size("places") > 0)
        .select(
            "conv_id",
            F.slice(turns, F.lit(1), last).alias("chosen"),
            F.concat(F.slice(turns, F.lit(1), last - 1), F.array(answer)).alias("rejected"),
        )
    )


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the start that are equal in role and text."""
    shorter = F.least(F.size(a), F.size(b))
    differ = F.filter(
        F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))),
        lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)),
    )
    return F.when(shorter == 0, F.lit(0)).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, shorter))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD[0]), turn["role"], F.lit(HEAD[1]), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def learned_spans(turns: Column) -> Column:
    """``array<struct<start, end>>``: characters of the learned turns, heads excluded."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(rendered(turn))
        head = len(HEAD[0] + HEAD[1]) + F.length(turn["role"])
        own = F.array(F.struct((state["at"] + head).alias("start"), end.alias("end")))
        spans = F.when(turn["role"] == LEARNED, F.concat(state["spans"], own)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def preferences(pairs: DataFrame) -> DataFrame:
    """Prompt and masked completions of ``pairs (conv_id, chosen, rejected)``.

    ``chosen_mask`` and ``rejected_mask`` are the character spans of the completion that
    count for the loss. Pairs whose conversations are equal have empty completions and
    masks; a pair without a common turn has an empty prompt. Null conversations are empty.
    """
    none = F.array().cast(f"array<{TURN}>")
    a, b = F.coalesce("chosen", none), F.coalesce("rejected", none)
    shared = F.col("prompt_turns")
    rest = lambda turns: F.slice(turns, shared + 1, F.greatest(F.size(turns), F.lit(1)))
    return (
        pairs.withColumn("chosen", a)
        .withColumn("rejected", b)
        .withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
        .select(
            "conv_id",
            "prompt_turns",
            render(F.slice("chosen", F.lit(1), shared)).alias("prompt"),
            render(rest(F.col("chosen"))).alias("chosen_text"),
            learned_spans(rest(F.col("chosen"))).alias("chosen_mask"),
            render(rest(F.col("rejected"))).alias("rejected_text"),
            learned_spans(rest(F.col("rejected"))).alias("rejected_mask"),
        )
    )


def op6_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    """A preference example of every conversation with an answer."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = preferences(answer_pairs(conversations(turns)))
    spans = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ","
    )
    return rows.select(
        "conv_id",
        F.col("prompt_turns").cast("long").alias("prompt_turns"),
        "prompt",
        "chosen_text",
        spans("chosen_mask").alias("chosen_mask"),
        "rejected_text",
        spans("rejected_mask").alias("rejected_mask"),
    )


QUERIES = {"op6_preference_format": op6_preference_format}
SQL = {
    "op6_preference_format": r"""
WITH told AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS turns
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id
), placed AS (
  SELECT conv_id, turns,
         list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS places
  FROM told
), answers AS (
  SELECT conv_id, turns, places[-1] AS last,
         coalesce(turns[CASE WHEN len(places) > 1 THEN places[-2] ELSE places[-1] - 1 END].text, '') AS echo
  FROM placed WHERE len(places) > 0
), parts AS (
  -- Where the echo is the very answer, the two conversations are equal.
  SELECT conv_id, last, echo, turns[last].text AS answer, turns[1:last - 1] AS before,
         turns[last].text = echo AS same
  FROM answers
), texts AS (
  SELECT conv_id, last, same,
         coalesce(array_to_string(list_transform(before,
           lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS told_before,
         '<|assistant|>' || chr(10) || answer || '<|end|>' || chr(10) AS good,
         '<|assistant|>' || chr(10) || echo || '<|end|>' || chr(10) AS bad
  FROM parts
)
SELECT conv_id,
       CAST(CASE WHEN same THEN last ELSE last - 1 END AS BIGINT) AS prompt_turns,
       CASE WHEN same THEN told_before || good ELSE told_before END AS prompt,
       CASE WHEN same THEN '' ELSE good END AS chosen_text,
       CASE WHEN same THEN '' ELSE '14:' || length(good) END AS chosen_mask,
       CASE WHEN same THEN '' ELSE bad END AS rejected_text,
       CASE WHEN same THEN '' ELSE '14:' || length(bad) END AS rejected_mask
FROM texts
"""
}
