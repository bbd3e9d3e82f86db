"""Raw quotes to a typed, deduplicated, outlier-free cross-section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.schemas import PANEL, PanelColumns

# The shipping allowance and the two outlier factors.
SHIPPING_ALLOWANCE = 3.99
MEDIAN_FACTOR = 2.0
LIST_PRICE_FACTOR = 1.5
PRICE_FLOOR = SHIPPING_ALLOWANCE + 0.25
FLOOR_SHARE = 0.5
ANCHOR_RATING = 100.0


def named_sellers(quotes: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Quotes with a seller name."""
    return quotes.filter(F.col(cols.seller) != "")


def clean_quotes(raw: DataFrame, cols: PanelColumns = PANEL, drop: tuple[str, ...] = ("condition",)) -> DataFrame:
    """Typed quotes with a landed price; quotes without a seller name go."""
    return typed_quotes(named_sellers(raw, cols), cols, drop)


def typed_quotes(raw: DataFrame, cols: PanelColumns = PANEL, drop: tuple[str, ...] = ("condition",)) -> DataFrame:
    """Typed quotes with a landed price, also those without a seller name."""
    return (
        S.as_dates(raw, cols.day)
        .withColumns(
            {
                cols.price: F.col("price") + F.coalesce(F.col("shipping"), F.lit(0.0)),
                "rating": S.percent("rating"),
                "numrating": S.thousands(F.coalesce(F.col("numrating"), F.lit("0"))),
            }
        )
        .drop("shipping", "price", *drop)
    )


def capture_defaults(captured: DataFrame, anchor: str) -> DataFrame:
    """Defaults set when a quote is captured: the anchor ships free and is fulfilled, unrated."""
    is_anchor = F.col("seller") == anchor
    return captured.withColumns(
        {
            "rating": F.when(~is_anchor, F.col("rating")),
            "numrating": F.when(~is_anchor, F.col("numrating")),
            "fba": F.when(is_anchor, 1).otherwise(F.coalesce(F.col("fba"), F.lit(0))),
            "shipping": F.when(is_anchor | (F.col("fba") == 1), 0.0).otherwise(F.col("shipping")),
        }
    )


def patch_anchor(df: DataFrame, anchor: str, cols: PanelColumns = PANEL) -> DataFrame:
    """Overwrite what capture may have got wrong for the anchor: full rating, no count, fulfilled."""
    is_anchor = F.col(cols.seller) == anchor
    return df.withColumns(
        {
            "rating": F.when(is_anchor, ANCHOR_RATING).otherwise(F.col("rating")),
            "numrating": F.when(~is_anchor, F.col("numrating")),
            "fba": F.when(is_anchor, 1).otherwise(F.col("fba")),
        }
    )


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row per key in a stated total order; missing values come last.

    Written as ``min`` over a struct led by the order columns, so each task
    keeps one row per key before the shuffle: any number of copies of one key
    costs one row per task.
    """
    lead = [part for i, c in enumerate(order) for part in (S.column(c).isNull().alias(f"__n{i}"), S.column(c).alias(f"__o{i}"))]
    led = {c: f"__best.__o{i}" for i, c in enumerate(order) if isinstance(c, str)}
    rest = [c for c in df.columns if c not in keys and c not in led]
    best = F.min(F.struct(*lead, *rest)).alias("__best")
    place = lambda c: F.col(c) if c in keys else F.col(led.get(c, f"__best.{c}"))
    return df.groupBy(*keys).agg(best).select(*[place(c).alias(c) for c in df.columns])


def dedup_seller_day(quotes: DataFrame, tie: list[str], cols: PanelColumns = PANEL) -> DataFrame:
    """One quote per seller, product and day."""
    return first_by(quotes, [*cols.pair, cols.day], tie)


def dedup_rank_day(quotes: DataFrame, tie: list[str], cols: PanelColumns = PANEL) -> DataFrame:
    """One quote per product, day and rank; quotes without a rank all stay."""
    alone = quotes.withColumn("__alone", F.when(F.col(cols.rank).isNull(), F.struct(*cols.pair)))
    return first_by(alone, [*cols.product_day, cols.rank, "__alone"], tie).drop("__alone")


def price_ladder(quotes: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """The distinct prices of each product-day with their counts and the exact median.

    ``n_at`` quotes stand at the price and ``n_below`` under it. Counts are
    pre-aggregated, so the windows see distinct price points of one product-day
    and not its quotes.
    """
    return ladder_of_counts(price_counts(quotes, cols), cols)


def price_counts(quotes: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """The distinct prices of each product-day and the quotes ``n_at`` each; counts of parts add up to counts of the whole."""
    return quotes.groupBy(*cols.product_day, cols.price).agg(F.count(F.lit(1)).alias("n_at"))


def ladder_of_counts(steps: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """`price_ladder` from the counts, one row per price."""
    group = Window.partitionBy(*cols.product_day)
    upward = group.orderBy(cols.price)
    steps = steps.withColumns(
        {"__upto": F.sum("n_at").over(upward), "__total": F.sum("n_at").over(group)}
    ).withColumn("n_below", F.col("__upto") - F.col("n_at"))
    at_or_past = lambda half: F.min(F.when(F.col("__upto") >= half, F.col(cols.price))).over(group)
    low = at_or_past(F.floor((F.col("__total") + 1) / 2))
    high = at_or_past(F.ceil((F.col("__total") + 1) / 2))
    return (
        steps.withColumns({"__low": low, "__high": high})
        .withColumn("price_median", F.col("__low") + (F.col("__high") - F.col("__low")) * 0.5)
        .drop("__upto", "__total", "__low", "__high")
    )


def median_prices(quotes: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """The median price of each product-day."""
    return medians_of_counts(price_counts(quotes, cols), cols)


def medians_of_counts(steps: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return ladder_of_counts(steps, cols).groupBy(*cols.product_day).agg(F.min("price_median").alias("price_median"))


def below_median_cut(cols: PanelColumns = PANEL, allowance: float = SHIPPING_ALLOWANCE, factor: float = MEDIAN_FACTOR) -> Column:
    return F.col(cols.price) - F.lit(allowance) < F.lit(factor) * F.col("price_median")


def below_list_cut(cols: PanelColumns = PANEL, allowance: float = SHIPPING_ALLOWANCE, factor: float = LIST_PRICE_FACTOR) -> Column:
    return (F.col(cols.price) - F.lit(allowance) < F.lit(factor) * F.col("list_price")) | F.col("list_price").isNull()


def drop_above_median(quotes: DataFrame, medians: DataFrame | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """Quotes below twice the product-day median, less shipping; keeps ``price_median``."""
    medians = median_prices(quotes, cols) if medians is None else medians
    return quotes.join(medians, cols.product_day).filter(below_median_cut(cols))


def drop_above_list(quotes: DataFrame, list_prices: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Quotes below 1.5 times the list price, or without a known list price; keeps ``list_price``."""
    priced = list_prices.select(cols.product, "list_price")
    return quotes.join(priced, [cols.product], "left").filter(below_list_cut(cols))


def snapshot_rank(quotes: DataFrame, cols: PanelColumns = PANEL, ladder: DataFrame | None = None) -> DataFrame:
    """Position of each quote in its product-day, by price and then seller.

    Rank is the count of cheaper quotes (from the ladder) plus the position
    among quotes at the same price, so a crowded product-day is split by price
    over many tasks. Needs one quote per seller, product and day.
    """
    ladder = price_ladder(quotes, cols) if ladder is None else ladder
    same_price = Window.partitionBy(*cols.product_day, cols.price).orderBy(cols.seller)
    return (
        quotes.join(ladder, [*cols.product_day, cols.price])
        .withColumn(cols.rank, (F.col("n_below") + F.row_number().over(same_price)).cast("int"))
        .drop("n_at", "n_below")
        .select(*quotes.columns, "price_median", cols.rank)
    )


def _under_floor(floor: float | Column, cols: PanelColumns) -> Column:
    return S.flag(F.col(cols.price) < (floor if isinstance(floor, Column) else F.lit(floor)))


def screened_products(ranked: DataFrame, anchor: str, floor: float | Column = PRICE_FLOOR, share: float = FLOOR_SHARE, cols: PanelColumns = PANEL) -> DataFrame:
    """Products that pass both the price-floor and the anchor rule, in one aggregate pass."""
    lowest_under = F.when(F.col(cols.rank) == 1, _under_floor(floor, cols))
    return (
        ranked.groupBy(cols.product)
        .agg(
            F.avg(lowest_under).alias("share_under_floor"),
            F.max(S.flag(F.col(cols.seller) == anchor)).alias("has_anchor"),
        )
        .filter((F.col("share_under_floor") < share) & (F.col("has_anchor") == 1))
    )


def floor_price_products(ranked: DataFrame, floor: float | Column = PRICE_FLOOR, share: float = FLOOR_SHARE, cols: PanelColumns = PANEL) -> DataFrame:
    """Products whose lowest quote is under the floor on less than ``share`` of their days."""
    under = _under_floor(floor, cols)
    return (
        ranked.filter(F.col(cols.rank) == 1)
        .groupBy(cols.product)
        .agg(F.avg(under).alias("share_under_floor"), F.count(F.lit(1)).alias("days"))
        .filter(F.col("share_under_floor") < share)
    )


def anchor_products(ranked: DataFrame, anchor: str, cols: PanelColumns = PANEL) -> DataFrame:
    """Products the anchor has ever quoted."""
    return ranked.filter(F.col(cols.seller) == anchor).select(cols.product).distinct()


def keep_products(df: DataFrame, products: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Semi join: rows of the listed products."""
    return df.join(products.select(cols.product), [cols.product], "left_semi")


def drop_products(df: DataFrame, products: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Anti join: rows of all other products."""
    return df.join(products.select(cols.product).distinct(), [cols.product], "left_anti")


def unranked_products(profiles: DataFrame, check_days: list[str], cols: PanelColumns = PANEL) -> DataFrame:
    """Products without a sales rank on one of the check days."""
    days = [F.to_date(F.lit(d)) for d in check_days]
    return profiles.filter(F.col(cols.day).isin(days) & F.col("sales_rank").isNull()).select(cols.product).distinct()


def distinct_by_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in the stated order."""
    return first_by(df, keys, order)
