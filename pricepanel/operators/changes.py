"""Price-change events of each pair.

A *mark* is a row that opens a new price: the first observation of a pair, or a
row whose price differs from the one before. All columns come from a single
window pass over (seller, product); event tables are filters on its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.operators.panel import pair_days, with_price_lags
from pricepanel.schemas import PANEL, PanelColumns


def with_change_history(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Add the price change of each row and what was known at the mark before it.

    Expects ``rank_prev`` (the rank at the pair's previous observation).
    """
    w = pair_days(cols)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_mark = F.coalesce(F.col("price2_change") != 0, F.lit(True))
    is_change = F.coalesce(F.col("price2_change") != 0, F.lit(False))
    out = with_price_lags(df, cols).withColumns({"is_mark": is_mark, "is_change": is_change})
    out = out.withColumns(
        {
            "__mark_day": F.last(F.when(F.col("is_mark"), F.col(cols.day)), ignorenulls=True).over(earlier),
            "__mark_rank": F.last(F.when(F.col("is_mark"), F.col(cols.rank)), ignorenulls=True).over(earlier),
            "__nth": F.sum(F.col("is_change").cast("int")).over(upto),
        }
    )
    when_change = lambda c: F.when(F.col("is_change"), c)
    out = out.withColumns(
        {
            "price_inc": when_change(S.flag(F.col("price2_change") > 0)),
            "price_dec": when_change(S.flag(F.col("price2_change") < 0)),
            "pct_change": when_change(S.ratio("price2_change", "price2_prev")),
            "days_bet_change": when_change(F.datediff(F.col(cols.day), F.col("__mark_day"))),
            "rank_last_change": when_change(F.col("__mark_rank")),
            "first_change": when_change(S.flag(F.col("__nth") == 1)),
        }
    ).withColumns(
        {
            "ranks_bumped": when_change(F.col("rank_prev") - F.col("rank_last_change")),
            "days_bet_change2": F.when(F.col("first_change") == 0, F.col("days_bet_change")),
        }
    )
    return out.drop("__mark_day", "__mark_rank", "__nth")


def price_changes(history: DataFrame) -> DataFrame:
    """The change rows of a panel with its change history."""
    return history.filter("is_change").drop("is_mark", "is_change")


def with_last_changed_rank(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Carry the rank of the latest mark forward, the current row included."""
    upto = pair_days(cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = F.when(F.coalesce(F.col("price2_change") != 0, F.lit(True)), F.col(cols.rank))
    return with_price_lags(df, cols).withColumn("rank_last_change", F.last(marked, ignorenulls=True).over(upto))


def pair_change_counts(changes: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Increases, decreases and all changes of each pair that changed its price."""
    return (
        changes.groupBy(*cols.pair)
        .agg(F.sum("price_inc").alias("num_price_inc"), F.sum("price_dec").alias("num_price_dec"))
        .withColumn("num_price_change", F.col("num_price_inc") + F.col("num_price_dec"))
    )
