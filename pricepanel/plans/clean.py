"""Clean panel and price-change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.operators import changes as C
from pricepanel.operators import cleaning as K
from pricepanel.operators import panel as P
from pricepanel.schemas import PANEL, PanelColumns


def ranked_quotes(
    raw: DataFrame, list_prices: DataFrame, tie: list[str], cols: PanelColumns = PANEL, captured_rank: bool = False
) -> DataFrame:
    """Raw quotes to one ranked quote per seller, product and day, outliers out.

    The order is that of the analysis: the median of a product-day is taken over all its quotes, also repeated
    ones and those without a seller name; outliers by median and list price go; then quotes without a seller name; then
    repeats. With ``captured_rank`` the rank in the raw layout is kept, and of quotes that
    share one the first stays; otherwise a captured rank is dropped and quotes are ranked by price.
    """
    if not captured_rank:
        raw = raw.drop(cols.rank)
    near = K.drop_above_median(K.typed_quotes(raw, cols), cols=cols).drop("price_median")
    listed = K.drop_above_list(near, list_prices, cols).drop("list_price")
    quotes = K.dedup_seller_day(K.named_sellers(listed, cols), tie, cols)
    ranked = K.dedup_rank_day(quotes, tie, cols) if captured_rank else K.snapshot_rank(quotes, cols).drop("price_median")
    return ranked.drop(*tie_only(tie, cols))


def tie_only(tie: list[str], cols: PanelColumns) -> list[str]:
    return [c for c in tie if c not in (cols.price, cols.rank)]


def clean_panel(
    raw: DataFrame,
    list_prices: DataFrame,
    anchor: str,
    start: str,
    tie: list[str],
    floor: float | Column = K.PRICE_FLOOR,
    cols: PanelColumns = PANEL,
    captured_rank: bool = False,
) -> DataFrame:
    """The clean panel: typed, deduplicated, ranked, screened by product, with observation lags.

    Lags look at all days of a kept pair; the date bound comes last.
    """
    ranked = K.patch_anchor(ranked_quotes(raw, list_prices, tie, cols, captured_rank), anchor, cols)
    return screen_panel(ranked, anchor, start, floor, cols)


def screen_panel(
    ranked: DataFrame, anchor: str, start: str, floor: float | Column = K.PRICE_FLOOR, cols: PanelColumns = PANEL
) -> DataFrame:
    """Product screens, observation lags and the date bound on ranked quotes."""
    kept = K.keep_products(ranked, K.screened_products(ranked, anchor, floor, cols=cols), cols)
    return P.with_observation_lags(kept, cols).filter(F.col(cols.day) >= F.to_date(F.lit(start)))


def change_events(panel: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Price-change events of a clean panel."""
    return C.price_changes(C.with_change_history(panel, cols))
