"""Preference formatting of conversations, in SQL functions only.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once as the prompt; what follows in each is its completion, with a
mask that trains on the assistant's words alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _render(turns: Column) -> Column:
    """``<|role|>``, newline, text and ``<|end|>`` with a newline for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _spans(turns: Column) -> Column:
    """Trained spans of a rendered completion as ``from-to`` code points, end excluded.

    They cover the text and the end mark of each assistant turn.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state, t):
        text = state["at"] + F.length(t["role"]) + 5
        end = text + F.length(t["text"]) + 7
        mine = F.array(F.concat_ws("-", text.cast("string"), end.cast("string")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], mine)).otherwise(state["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ";")


def preference_pairs(rows: DataFrame) -> DataFrame:
    """Format pairs from rows of (pair_id, side, turn, role, text), side being chosen or rejected.

    Returns pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask
    and rejected_mask. Two turns are equal if role and text are; null role
    and text are empty. Turns of one number are ordered by role and text. A
    side without turns has an empty prompt and completion. Rows with a null
    pair_id belong to no pair and are left out. Repeated rows are repeated
    turns. Texts of any length are taken whole; other columns are not looked
    at. An empty table gives an empty result. One group is one pair of
    conversations and makes one row, however many pairs share their turns.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = (
        rows.where(F.col("pair_id").isNotNull()).groupBy("pair_id")
        .agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("chosen", "rejected")])
    )
    differs = F.zip_with("chosen", "rejected", lambda a, b: ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])))
    first = F.array_position(differs, True)
    pairs = pairs.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("chosen")).cast("int"))
    pairs = pairs.select(
        "pair_id", "n", F.slice("chosen", 1, F.col("n")).alias("p"),
        *[F.slice(s, F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0))).alias(s) for s in ("chosen", "rejected")],
    )
    return pairs.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _render(F.col("p")).alias("prompt"),
        _render(F.col("chosen")).alias("chosen"), _render(F.col("rejected")).alias("rejected"),
        _spans(F.col("chosen")).alias("chosen_mask"), _spans(F.col("rejected")).alias("rejected_mask"),
    )


def paired(conversations: DataFrame) -> DataFrame:
    """Pairs of a table without preferences: conversation 2k is chosen over 2k + 1."""
    return conversations.select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "turn", "role", "text",
    )


#: The query's oracle.
SQL = r"""
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
same AS (
  SELECT a.pair_id, count(*) AS n FROM (
    SELECT a.pair_id, a.n, row_number() OVER (PARTITION BY a.pair_id ORDER BY a.n) AS m
    FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.n = b.n AND a.role = b.role AND a.text = b.text
    WHERE a.side = 0 AND b.side = 1) a
  WHERE a.n = a.m GROUP BY a.pair_id),
r AS (
  SELECT t.pair_id, t.side, t.n, t.role, t.text, coalesce(s.n, 0) AS k, t.n <= coalesce(s.n, 0) AS shared,
         '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS piece
  FROM t LEFT JOIN same s ON t.pair_id = s.pair_id),
ends AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY pair_id, side, shared ORDER BY n) AS stop FROM r)
SELECT pair_id, CAST(max(k) AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(piece, '' ORDER BY n) FILTER (shared AND side = 0), '') AS prompt,
       coalesce(string_agg(piece, '' ORDER BY n) FILTER (NOT shared AND side = 0), '') AS chosen,
       coalesce(string_agg(piece, '' ORDER BY n) FILTER (NOT shared AND side = 1), '') AS rejected,
       coalesce(string_agg((stop - length(text) - 8) || '-' || (stop - 1), ';' ORDER BY n) FILTER (NOT shared AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((stop - length(text) - 8) || '-' || (stop - 1), ';' ORDER BY n) FILTER (NOT shared AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM ends GROUP BY pair_id
"""
