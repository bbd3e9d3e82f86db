"""Preference pairs: a common prompt and two masked completions from a chosen and a rejected conversation.

The turns of a conversation are put in order, the longest prefix that both sides share (by role and text) is rendered once as
the prompt, and the turns after it are rendered as the two completions. A mask lists the stretches of a completion that
an assistant wrote (start:end in code points), on which a model is trained.

Both sides of a pair meet in one shuffle by pair. All turns of one pair stand in one row, as its rendered result does.

Defined results: null role and text are empty; a null turn number comes first; equal rows of a side count once; turns of
equal number follow role and text; a pair with one side only has an empty prefix and an empty other side; a null pair id is
a pair of its own; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.llm import tables

TRAINED = "assistant"


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n"))


def _mask(turns: Column) -> Column:
    """Where the assistant's texts stand in the rendered turns."""
    nothing = F.struct(F.lit(0).alias("place"), F.array().cast("array<string>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        start = state["place"] + F.length(turn["role"]) + 5
        end = start + F.length(turn["text"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        spans = F.when(turn["role"] == TRAINED, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + 1).alias("place"), spans.alias("spans"))

    return F.aggregate(turns, nothing, add, lambda state: F.array_join(state["spans"], ","))


def preference_rows(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """From two tables of (pair, turn, role, text): pair_id, n_common, prompt, and each completion with its mask."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            F.col(pair).cast("long").alias("pair_id"), F.lit(name).alias("side"),
            F.struct(
                F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
            ).alias("one"),
        )

    both = side(chosen, "c").unionByName(side(rejected, "r"))
    rows = both.groupBy("pair_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("side") == "c", F.col("one")))).alias("c"),
        F.sort_array(F.collect_set(F.when(F.col("side") == "r", F.col("one")))).alias("r"),
    )
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(
        F.slice("c", F.lit(1), shorter), F.slice("r", F.lit(1), shorter), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"])
    )
    first = F.array_position(same, F.lit(False)).cast("int")
    rows = rows.withColumn("n", F.when(first == 0, shorter).otherwise(first - 1))
    rest = {s: F.slice(s, F.col("n") + 1, F.size(s)) for s in "cr"}
    text = {s: F.array_join(F.transform(rest[s], _render), "") for s in "cr"}
    return rows.select(
        "pair_id", F.col("n").cast("long").alias("n_common"), F.array_join(F.transform(F.slice("c", F.lit(1), F.col("n")), _render), "").alias("prompt"),
        text["c"].alias("chosen"), _mask(rest["c"]).alias("chosen_mask"), text["r"].alias("rejected"), _mask(rest["r"]).alias("rejected_mask"),
    )


def stale_replies(turns: DataFrame) -> DataFrame:
    """Each conversation with its last assistant reply replaced by its first one, or by nothing if it has one only."""
    mine = F.col("role") == TRAINED
    known = turns.groupBy("conv_id").agg(
        F.max(F.when(mine, F.col("turn"))).alias("last"), F.min(F.when(mine, F.col("turn"))).alias("first"),
        F.min(F.when(mine, F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))["text"].alias("early"),
    ).withColumnRenamed("conv_id", "_conv")
    joined = turns.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")))
    stale = F.when(F.col("first") < F.col("last"), F.col("early")).otherwise("")
    return joined.select("conv_id", "turn", "role", F.when(mine & (F.col("turn") == F.col("last")), stale).otherwise(F.col("text")).alias("text"))


def op3_preference_formatting(spark, sf_dir: str) -> DataFrame:
    turns = tables.table(spark, sf_dir, "conversations")
    return preference_rows(turns, stale_replies(turns), pair="conv_id")


OP3_SQL = """
WITH mine AS (
  SELECT conv_id, max(turn) AS last, min(turn) AS first FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), early AS (
  SELECT c.conv_id, min(coalesce(c.text, '')) AS text FROM conversations c JOIN mine m ON c.conv_id = m.conv_id AND c.turn = m.first
  WHERE c.role = 'assistant' GROUP BY c.conv_id
), sides AS (
  SELECT DISTINCT conv_id, 'c' AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT DISTINCT c.conv_id, 'r', c.turn, coalesce(c.role, ''),
    CASE WHEN c.role = 'assistant' AND c.turn = m.last THEN CASE WHEN m.first < m.last THEN e.text ELSE '' END ELSE coalesce(c.text, '') END
  FROM conversations c LEFT JOIN mine m ON c.conv_id = m.conv_id LEFT JOIN early e ON c.conv_id = e.conv_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role, text) AS k, '<|' || role || '|>' || chr(10) || text || chr(10) AS shown
  FROM sides
), sizes AS (
  SELECT conv_id, least(max(CASE WHEN side = 'c' THEN k ELSE 0 END), max(CASE WHEN side = 'r' THEN k ELSE 0 END)) AS shorter FROM placed GROUP BY conv_id
), apart AS (
  SELECT c.conv_id, min(c.k) AS k FROM placed c JOIN placed r ON c.conv_id = r.conv_id AND c.k = r.k AND c.side = 'c' AND r.side = 'r'
  WHERE c.role <> r.role OR c.text <> r.text GROUP BY c.conv_id
), common AS (
  SELECT s.conv_id, coalesce(a.k - 1, s.shorter) AS n FROM sizes s LEFT JOIN apart a ON s.conv_id = a.conv_id
), offsets AS (
  SELECT p.*, c.n, coalesce(sum(CASE WHEN p.k > c.n THEN length(p.shown) ELSE 0 END)
    OVER (PARTITION BY p.conv_id, p.side ORDER BY p.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(p.role) + 5 AS place
  FROM placed p JOIN common c ON p.conv_id = c.conv_id
)
SELECT conv_id AS pair_id, CAST(max(n) AS BIGINT) AS n_common,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 'c' AND k <= n), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 'c' AND k > n), '') AS chosen,
  coalesce(string_agg(CAST(place AS BIGINT) || ':' || CAST(place + length(text) AS BIGINT), ',' ORDER BY k) FILTER (WHERE side = 'c' AND k > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 'r' AND k > n), '') AS rejected,
  coalesce(string_agg(CAST(place AS BIGINT) || ':' || CAST(place + length(text) AS BIGINT), ',' ORDER BY k) FILTER (WHERE side = 'r' AND k > n AND role = 'assistant'), '') AS rejected_mask
FROM offsets GROUP BY conv_id
"""
