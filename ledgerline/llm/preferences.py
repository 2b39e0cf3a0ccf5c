"""Preference formatting: chosen and rejected conversations as prompt and masked completions.

Turns of a pair are aligned by their place.  The prompt is the longest run of equal turns from the
start, rendered once; each completion is the rest of its conversation.  A completion's mask says
which of its segments (turns) a loss counts: those of the assistant.

Everything is DataFrame operations; a conversation's turns are gathered in one row, as its
rendering needs them all.

Defined cases: turns with null conv_id belong to no pair and are left out; null role reads as
"user", null text as empty; turns of equal number keep the order of role and text, repeated rows included;
a pair may lack one side, whose completion is then empty; equal conversations have all turns in
the prompt and empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as an array of (turn, role, text)."""
    turn = F.struct(
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def segment(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, segment), "")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Add prompt, completions and masks to rows with ``chosen`` and ``rejected`` arrays of turns."""
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    sides = {s: F.coalesce(F.col(s), none) for s in ("chosen", "rejected")}
    p = pairs.withColumns(sides)
    differs = F.transform(F.arrays_zip("chosen", "rejected"), lambda z: F.when(z["chosen"].isNotNull() & z["rejected"].isNotNull(), (z["chosen"]["role"] != z["rejected"]["role"]) | (z["chosen"]["text"] != z["rejected"]["text"])).otherwise(F.lit(True)))
    first = F.array_position(differs, True)
    p = p.withColumn("n_prompt_turns", F.when(first > 0, first - 1).otherwise(F.size(differs)).cast("long"))
    rest = lambda s: F.slice(F.col(s), (F.col("n_prompt_turns") + 1).cast("int"), F.greatest(F.size(s), F.lit(1)))
    p = p.withColumn("prompt", render(F.slice(F.col("chosen"), F.lit(1), F.col("n_prompt_turns").cast("int"))))
    for s in sides:
        p = p.withColumn(f"{s}_segments", F.transform(rest(s), segment))
        p = p.withColumn(f"{s}_mask", F.transform(rest(s), lambda t: (t["role"] == "assistant").cast("int")))
        p = p.withColumn(f"{s}_completion", F.array_join(f"{s}_segments", ""))
    return p


def pair_up(turns: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k+1 (rejected) as pair k; ids are 64-bit integers, negative ones included."""
    c = conversations(turns)
    side = lambda k: F.max(F.when(F.col("conv_id").bitwiseAND(1) == k, F.col("turns")))
    return c.groupBy(F.shiftright("conv_id", 1).alias("pair_id")).agg(side(0).alias("chosen"), side(1).alias("rejected"))


def formatted(turns: DataFrame) -> DataFrame:
    return format_pairs(pair_up(turns)).select(
        "pair_id", "n_prompt_turns", "prompt", "chosen_completion", "rejected_completion",
        F.array_join(F.col("chosen_mask").cast("array<string>"), "").alias("chosen_mask"), F.array_join(F.col("rejected_mask").cast("array<string>"), "").alias("rejected_mask"),
        F.coalesce(F.aggregate(F.zip_with("chosen_segments", "chosen_mask", lambda s, m: F.length(s) * m), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("chosen_loss_chars"),
        F.coalesce(F.aggregate(F.zip_with("rejected_segments", "rejected_mask", lambda s, m: F.length(s) * m), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("rejected_loss_chars"),
    )


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1), coalesce(role, 'user'), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
aligned AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.n, b.n) AS n,
         coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM turns WHERE side = 0) a FULL JOIN (SELECT * FROM turns WHERE side = 1) b ON a.pair_id = b.pair_id AND a.n = b.n),
prefix AS (SELECT pair_id, coalesce(min(n) FILTER (WHERE NOT same) - 1, max(n)) AS k FROM aligned GROUP BY pair_id),
segments AS (SELECT t.*, k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM turns t JOIN prefix USING (pair_id))
SELECT pair_id, any_value(k)::BIGINT AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY n) FILTER (WHERE side = 0 AND n <= k), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY n) FILTER (WHERE side = 0 AND n > k), '') AS chosen_completion,
  coalesce(string_agg(s, '' ORDER BY n) FILTER (WHERE side = 1 AND n > k), '') AS rejected_completion,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY n) FILTER (WHERE side = 0 AND n > k), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY n) FILTER (WHERE side = 1 AND n > k), '') AS rejected_mask,
  coalesce(sum(length(s)) FILTER (WHERE side = 0 AND n > k AND role = 'assistant'), 0)::BIGINT AS chosen_loss_chars,
  coalesce(sum(length(s)) FILTER (WHERE side = 1 AND n > k AND role = 'assistant'), 0)::BIGINT AS rejected_loss_chars
FROM segments GROUP BY pair_id
"""
