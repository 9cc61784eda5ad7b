"""Preference pairs of conversations as training text.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once as the prompt,
the turns behind it as two completions, each with the character ranges a trainer learns from: the contents of the
assistant's turns and their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapak.functions.once import computed, let
from lapak.llm.registry import query, table

OPEN = "<|im_start|>"
CLOSE = "<|im_end|>"
LEARNED = "assistant"
BLOCK = 128


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as structs of role and text.

    Turns are ordered by number (nulls first), then role and text, so ties have one order; a turn given twice stays
    twice. A null role or text is an empty one. A conversation is one cell, as what is rendered from it is.
    """
    parts = F.sort_array(F.collect_list(F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))))
    return turns.groupBy("conv_id").agg(parts.alias("turns")).withColumn(
        "turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"))


def _body(t: Column) -> Column:
    return F.concat(t["text"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    """Text of a list of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def learned(turns: Column) -> Column:
    """Character ranges ``start:end`` (ends exclusive) of what the assistant says, comma-joined.

    Ranges and the sum of the lengths so far are carried along inside blocks of turns, as appending copies a list; the
    blocks start at the sums of the earlier ones. So very long conversations stay cheap.
    """
    zero = F.lit(0).cast("long")
    length = lambda t: (F.length(_head(t)) + F.length(_body(t)) + 1).cast("long")

    def step(so_far: Column, t: Column) -> Column:
        begin = so_far["at"] + F.length(_head(t))
        end = begin + F.length(_body(t))
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(
            t["role"] == LEARNED, F.array_append(so_far["ranges"], span)).otherwise(so_far["ranges"]).alias("ranges"))

    def ranges(blocks: Column, sums: Column) -> Column:
        def of_block(block: Column, i: Column) -> Column:
            base = F.aggregate(F.slice(sums, F.lit(1), i), zero, lambda a, x: a + x)
            start = F.struct(base.alias("at"), F.array().cast("array<string>").alias("ranges"))
            return F.aggregate(block, start, step)["ranges"]

        return F.array_join(F.flatten(F.transform(blocks, of_block)), ",")

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(turns) / BLOCK).cast("int")),
                         lambda b: F.slice(turns, b * BLOCK + 1, F.lit(BLOCK)))
    return let(blocks, lambda every: let(
        F.transform(every, lambda block: F.aggregate(block, zero, lambda a, t: a + length(t))),
        lambda sums: ranges(every, sums)))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Render ``pairs(pair_id, chosen, rejected)`` of turn lists (structs of role and text).

    Columns: pair_id, n_prompt_turns, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask. A null list is an
    empty one. If one conversation is a prefix of the other, its completion is empty; equal ones are prompt only.
    Repeated pairs give repeated rows; an empty table gives none.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = computed(pairs.select("pair_id", F.coalesce("chosen", none).alias("_c"), F.coalesce("rejected", none).alias("_r")),
                    _differ=F.array_position(F.zip_with("_c", "_r", lambda a, b: a.eqNullSafe(b)), False))
    common = F.when(F.col("_differ") > 0, F.col("_differ") - 1).otherwise(F.least(F.size("_c"), F.size("_r")))
    rows = computed(both, _n=common.cast("int"))
    rest = lambda side: F.slice(side, F.col("_n") + 1, F.greatest(F.size(side) - F.col("_n"), F.lit(0)))
    rows = computed(rows, _head=F.slice("_c", F.lit(1), F.col("_n")), _left=rest("_c"), _right=rest("_r"))
    return rows.select(
        "pair_id", F.col("_n").cast("long").alias("n_prompt_turns"), rendered(F.col("_head")).alias("prompt"),
        rendered(F.col("_left")).alias("chosen_text"), learned(F.col("_left")).alias("chosen_mask"),
        rendered(F.col("_right")).alias("rejected_text"), learned(F.col("_right")).alias("rejected_mask"))


def derived_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: rejected is the chosen one up to a turn, then the next conversation's turns.

    The turn is ``conv_id % number of turns``; the next conversation is that of ``conv_id + 1``, and without one nothing
    follows. Turns with a null conv_id make no pair.
    """
    every = conversations(turns.filter(F.col("conv_id").isNotNull()))
    following = every.select((F.col("conv_id") - 1).alias("conv_id"), F.col("turns").alias("_next"))
    rows = every.join(following, "conv_id", "left")
    at = F.pmod(F.col("conv_id"), F.size("turns")).cast("int")
    none = F.array().cast("array<struct<role:string,text:string>>")
    after = F.coalesce(F.slice("_next", at + 1, F.greatest(F.size("_next") - at, F.lit(0))), none)
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
                       F.concat(F.slice("turns", F.lit(1), at), after).alias("rejected"))


SQL = """
WITH turn AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), side AS (
  SELECT conv_id AS pair_id, 'c' AS side, k, role, text FROM turn
  UNION ALL SELECT conv_id, 'r', k, role, text FROM turn WHERE k <= conv_id % n
  UNION ALL SELECT f.conv_id, 'r', t.k, t.role, t.text
  FROM (SELECT DISTINCT conv_id, n FROM turn) f JOIN turn t ON t.conv_id = f.conv_id + 1 WHERE t.k > f.conv_id % f.n
), paired AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k,
    c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM (SELECT * FROM side WHERE side = 'c') c FULL JOIN (SELECT * FROM side WHERE side = 'r') r
    ON r.pair_id = c.pair_id AND r.k = c.k
), common AS (
  SELECT pair_id, coalesce(min(k) FILTER (WHERE NOT same) - 1, max(k)) AS m FROM paired GROUP BY pair_id
), placed AS (
  SELECT s.*, m, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS body,
    coalesce(sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>') + 1) OVER (
      PARTITION BY s.pair_id, side, k > m ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM side s JOIN common USING (pair_id)
)
SELECT pair_id, any_value(m)::BIGINT AS n_prompt_turns,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (WHERE side = 'c' AND k <= m), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (WHERE side = 'c' AND k > m), '') AS chosen_text,
  coalesce(string_agg((start + length(head))::BIGINT || ':' || (start + length(head) + length(body))::BIGINT, ',' ORDER BY k)
    FILTER (WHERE side = 'c' AND k > m AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (WHERE side = 'r' AND k > m), '') AS rejected_text,
  coalesce(string_agg((start + length(head))::BIGINT || ':' || (start + length(head) + length(body))::BIGINT, ',' ORDER BY k)
    FILTER (WHERE side = 'r' AND k > m AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""


@query("op2_preference_pairs", SQL)
def _(spark, sf_dir):
    return format_pairs(derived_pairs(table(spark, sf_dir, "conversations")))
