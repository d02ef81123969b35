"""Preference formatting: one prompt from the turns that two conversations share, and two masked completions.

Windows, arrays and string functions only; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL = ("<|", "|>\n"), "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation as one array of role, rendered turn and the span to train in it."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    head = F.concat(F.lit(HEAD[0]), F.col("role"), F.lit(HEAD[1]))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumns({"n": F.row_number().over(order), "head": F.length(head), "shown": F.concat(head, "text", F.lit(TAIL))})
    t = t.withColumn("at", F.sum(F.length("shown").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("shown"))
    turn = F.struct("n", "role", "shown", "at", (F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.length("shown") - 1).alias("end"))
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns two conversations share from the start on."""
    both = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, both), lambda t: (t["a"]["role"] == t["b"]["role"]) & (t["a"]["shown"] == t["b"]["shown"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(both).cast("int")


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: t["shown"]), "")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Prompts and completions of (pair_id, chosen, rejected), both arrays as ``conversations`` makes them.

    Either side may be null: it counts as a conversation without turns. The spans
    are the character ranges [start, end) of each completion that are trained: the
    text and end mark of assistant turns. What the two conversations share is
    rendered once and trains nothing.
    """
    none = F.expr("array()")
    p = pairs.select("pair_id", *(F.when(F.col(c).isNull(), F.slice(F.coalesce("chosen", "rejected"), 1, 0)).otherwise(F.col(c)).alias(c) for c in ("chosen", "rejected")))
    p = p.withColumn("prompt_turns", common_prefix(F.col("chosen"), F.col("rejected")))
    prompt = _text(F.slice("chosen", 1, F.col("prompt_turns")))
    p = p.withColumns({"prompt": prompt, "skip": F.length(prompt)})
    out = {}
    for side in ("chosen", "rejected"):
        rest = F.slice(side, F.col("prompt_turns") + 1, F.greatest(F.size(side) - F.col("prompt_turns"), F.lit(0)))
        out[f"{side}_text"] = _text(rest)
        spans = F.transform(F.filter(rest, lambda t: t["role"] == TRAINED), lambda t: F.struct((t["start"] - F.col("skip")).alias("start"), (t["end"] - F.col("skip")).alias("end")))
        out[f"{side}_spans"] = F.coalesce(spans, none)
    return p.select("pair_id", "prompt_turns", "prompt", *(c.alias(n) for n, c in out.items()))


def format_preferences(turns: DataFrame) -> DataFrame:
    """Preference pairs of a table of turns (conv_id, turn, role, text).

    The table names no preferences, so neighbours make the pairs: conversation 2k
    is the chosen one and 2k + 1 the rejected one, for all longs. A conversation without its
    neighbour still gives a row, whose other completion is empty. Turns go by turn
    (nulls first), then role and text; repeated rows are turns of their own; null
    roles and texts count as empty. Rows without a conv_id belong to no
    conversation. Other columns are ignored; an empty table gives no rows.
    """
    c = conversations(turns).withColumn("pair_id", F.shiftright(F.col("conv_id").cast("long"), 1))
    side = F.pmod("conv_id", F.lit(2))
    pairs = c.groupBy("pair_id").agg(F.first(F.when(side == 0, F.col("turns")), ignorenulls=True).alias("chosen"), F.first(F.when(side == 1, F.col("turns")), ignorenulls=True).alias("rejected"))
    return format_pairs(pairs)


def preference_query(turns: DataFrame) -> DataFrame:
    """format_preferences with the spans as text, such as ``12-40;55-71``."""
    f = format_preferences(turns)
    show = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ";")
    return f.withColumns({c: show(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT conv_id, conv_id >> 1 AS pair_id, conv_id % 2 = 0 AS chosen, n, role, length(head) AS h, head || text || '<|end|>' || chr(10) AS shown FROM t
), m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.n, b.n) AS n, coalesce(a.role = b.role AND a.shown = b.shown, false) AS same
  FROM (SELECT * FROM s WHERE chosen) a FULL JOIN (SELECT * FROM s WHERE NOT chosen) b ON a.pair_id = b.pair_id AND a.n = b.n
), p AS (
  SELECT pair_id, coalesce(min(n) FILTER (NOT same) - 1, max(n)) AS k FROM m GROUP BY pair_id
), o AS (
  SELECT s.*, k, coalesce(sum(CASE WHEN n > k THEN length(shown) END) OVER (PARTITION BY conv_id ORDER BY n), 0) - length(shown) AS pos FROM s JOIN p USING (pair_id)
)
SELECT pair_id, CAST(any_value(k) AS INT) AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (n <= k AND chosen), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (n > k AND chosen), '') AS chosen_text,
  coalesce(string_agg(CAST(pos + h AS BIGINT) || '-' || CAST(pos + length(shown) - 1 AS BIGINT), ';' ORDER BY n) FILTER (n > k AND chosen AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (n > k AND NOT chosen), '') AS rejected_text,
  coalesce(string_agg(CAST(pos + h AS BIGINT) || '-' || CAST(pos + length(shown) - 1 AS BIGINT), ';' ORDER BY n) FILTER (n > k AND NOT chosen AND role = 'assistant'), '') AS rejected_spans
FROM o GROUP BY pair_id
"""
