"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

Both conversations of a pair are turns (role, text) in order. Their longest common turn prefix is rendered once as
the prompt; the rest of each is its completion. A completion's mask lists runs of characters: ``+n`` are to be
learned (an assistant's text and end marker), ``-n`` are not (headers and other roles' turns).

Roles and texts compare as values, nulls equal to nulls; a null role or text renders as empty. Turns of equal number
stand in order of role and text, and repeated turns are turns of their own. A pair with one side only has an empty
other side. A row without a pair id is a pair of its own with one turn on its side, as nothing tells what belongs to
it. A conversation is put together in one task, so it must fit there, as any one row must; very long texts do not
matter beyond that. If both sides are equal, the prompt is everything and the completions are empty. Empty tables give no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turns(df: DataFrame, pair_col: str, name: str) -> DataFrame:
    whole = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return df.where(F.col(pair_col).isNotNull()).groupBy(pair_col).agg(F.transform(whole, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias(name))


def _header(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t.role, F.lit("")), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t.text, F.lit("")), F.lit("<|end|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    size = lambda c: F.char_length(c).cast("string")
    learned = lambda t: F.concat(F.lit("-"), size(_header(t)), F.lit(",+"), size(_body(t)))
    other = lambda t: F.concat(F.lit("-"), size(F.concat(_header(t), _body(t))))
    return F.array_join(F.transform(turns, lambda t: F.when(t.role == "assistant", learned(t)).otherwise(other(t))), ",")


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str) -> DataFrame:
    """One row for each pair: pair_col, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Both inputs have pair_col, turn, role and text; other columns are not read.
    """
    a, b = _turns(chosen, pair_col, "a"), _turns(rejected, pair_col, "b").withColumnRenamed(pair_col, "_pair")
    both = a.join(b, a[pair_col] == b["_pair"], "full_outer").select(F.coalesce(pair_col, "_pair").alias(pair_col), F.coalesce("a", F.array().cast("array<struct<role:string,text:string>>")).alias("a"), F.coalesce("b", F.array().cast("array<struct<role:string,text:string>>")).alias("b"))
    least = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", F.lit(1), least), F.slice("b", F.lit(1), least), lambda x, y: x.role.eqNullSafe(y.role) & x.text.eqNullSafe(y.text))
    both = both.withColumn("_off", F.array_position(same, False).cast("int")).withColumn("n_prompt_turns", F.when(F.col("_off") == 0, least).otherwise(F.col("_off") - 1))
    n = F.col("n_prompt_turns")
    rest = lambda c: F.slice(c, n + 1, F.size(c))
    pairs = both.select(pair_col, n, _rendered(F.slice("a", F.lit(1), n)).alias("prompt"), _rendered(rest("a")).alias("chosen"), _rendered(rest("b")).alias("rejected"), _mask(rest("a")).alias("chosen_mask"), _mask(rest("b")).alias("rejected_mask"))
    return pairs.union(_alone(chosen, pair_col, True)).union(_alone(rejected, pair_col, False))


def _alone(df: DataFrame, pair_col: str, is_chosen: bool) -> DataFrame:
    """The rows without a pair id, in the form of pairs."""
    turn, none = F.array(F.struct("role", "text")), F.lit("")
    side = lambda c: (c, none) if is_chosen else (none, c)
    return df.where(F.col(pair_col).isNull()).select(pair_col, F.lit(0), none, *side(_rendered(turn)), *side(_mask(turn)))


def answered_by_next(turns: DataFrame) -> DataFrame:
    """Rejected conversations for a table that has none: each one's last assistant turn has the text of the last
    assistant turn of the conversation with the next id (empty if there is none)."""
    last = turns.where("role = 'assistant' and conv_id is not null").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("l"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("l.text").alias("answer"))
    to = last.select("conv_id", F.col("l.turn").alias("turn"), F.lit("assistant").alias("role")).join(other, "conv_id", "left").withColumn("to", F.lit(True))
    out = turns.select("conv_id", "turn", "role", "text").join(to, ["conv_id", "turn", "role"], "left")
    return out.select("conv_id", "turn", "role", F.when(F.col("to"), F.coalesce("answer", F.lit(""))).otherwise(F.col("text")).alias("text"))


ORACLE = """
WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
answer AS (SELECT l.conv_id, max(c.text) AS text FROM last l JOIN conversations c ON c.conv_id = l.conv_id AND c.turn = l.turn AND c.role = 'assistant' GROUP BY l.conv_id),
t AS (SELECT c.conv_id, c.turn, c.role, c.text AS a, CASE WHEN l.conv_id IS NULL THEN c.text ELSE coalesce(n.text, '') END AS b
      FROM conversations c LEFT JOIN last l ON l.conv_id = c.conv_id AND l.turn = c.turn AND c.role = 'assistant' LEFT JOIN answer n ON n.conv_id = c.conv_id + 1),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, a) AS k FROM t),
m AS (SELECT conv_id, coalesce(min(CASE WHEN a IS DISTINCT FROM b THEN k END), count(*) + 1) - 1 AS p FROM o GROUP BY conv_id),
r AS (SELECT o.*, m.p, '<|' || coalesce(role, '') || '|>' || chr(10) AS h, coalesce(a, '') || '<|end|>' || chr(10) AS x, coalesce(b, '') || '<|end|>' || chr(10) AS y FROM o JOIN m USING (conv_id))
SELECT conv_id, CAST(p AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(h || x, '' ORDER BY k) FILTER (k <= p), '') AS prompt,
  coalesce(string_agg(h || x, '' ORDER BY k) FILTER (k > p), '') AS chosen,
  coalesce(string_agg(h || y, '' ORDER BY k) FILTER (k > p), '') AS rejected,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN '-' || length(h) || ',+' || length(x) ELSE '-' || length(h || x) END, ',' ORDER BY k) FILTER (k > p), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN '-' || length(h) || ',+' || length(y) ELSE '-' || length(h || y) END, ',' ORDER BY k) FILTER (k > p), '') AS rejected_mask
FROM r WHERE conv_id IS NOT NULL GROUP BY conv_id, p
UNION ALL
SELECT conv_id, CAST(0 AS INTEGER), '', CASE WHEN s = 1 THEN h || x ELSE '' END, CASE WHEN s = 2 THEN h || x ELSE '' END, CASE WHEN s = 1 THEN k ELSE '' END, CASE WHEN s = 2 THEN k ELSE '' END
FROM (SELECT *, CASE WHEN role = 'assistant' THEN '-' || length(h) || ',+' || length(x) ELSE '-' || length(h || x) END AS k
  FROM (SELECT conv_id, role, '<|' || coalesce(role, '') || '|>' || chr(10) AS h, coalesce(a, '') || '<|end|>' || chr(10) AS x FROM t WHERE conv_id IS NULL)), (VALUES (1), (2)) v(s)
"""
