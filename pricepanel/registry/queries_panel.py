"""Queries over raw quotes, the clean panel and its change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.operators import changes as C
from pricepanel.operators import cleaning as K
from pricepanel.operators import panel as P
from pricepanel.operators import products as R
from pricepanel.operators import sellers as L
from pricepanel.plans import clean, profile
from pricepanel.plans.medians import StoredMedians
from pricepanel.registry.core import query
from pricepanel.registry.fixture import ANCHOR, CHECK_DAYS, TIE
from pricepanel.session import scratch_path, stage

QUOTE = "dateacc:d isbn seller rating:f fba:i numrating:f price2:f"
TIED = f"{QUOTE} l_orderkey:i l_linenumber:i l_partkey:i"
PANEL_ROW = f"{QUOTE} rank:i rank_prev:i days_bet:i"
CHANGE = (
    "dateacc:d isbn seller price2:f price2_prev:f price2_change:f price_inc:i price_dec:i pct_change:f "
    "days_bet_change:i rank:i rank_prev:i rank_last_change:i ranks_bumped:i"
)


@query(TIED, "SELECT * FROM typed_quotes")
def clean_quotes(f):
    return K.clean_quotes(f.raw)


@query(
    QUOTE,
    f"""SELECT * REPLACE (CASE WHEN seller = '{ANCHOR}' THEN 100.0 ELSE rating END AS rating,
        CASE WHEN seller <> '{ANCHOR}' THEN numrating END AS numrating,
        CASE WHEN seller = '{ANCHOR}' THEN 1 ELSE fba END AS fba) FROM typed_quotes""",
)
def anchor_patch(f):
    return K.patch_anchor(K.clean_quotes(f.raw), ANCHOR)


@query(
    "dateacc:d isbn seller rating fba:i numrating shipping:f price:f",
    f"""SELECT * REPLACE (CASE WHEN seller <> '{ANCHOR}' THEN rating END AS rating,
        CASE WHEN seller <> '{ANCHOR}' THEN numrating END AS numrating,
        CASE WHEN seller = '{ANCHOR}' THEN 1 ELSE fba END AS fba,
        CASE WHEN seller = '{ANCHOR}' OR fba = 1 THEN 0.0 ELSE shipping END AS shipping) FROM raw_quotes""",
)
def anchor_capture_defaults(f):
    return K.capture_defaults(f.raw, ANCHOR)


@query(TIED, "SELECT * FROM quotes")
def dedup_seller_day(f):
    return f.quotes


@query(
    f"{TIED} rank:i",
    """SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY isbn, dateacc ORDER BY price2) AS rank FROM quotes)
       QUALIFY row_number() OVER (PARTITION BY isbn, dateacc, rank ORDER BY price2, l_orderkey, l_linenumber, l_partkey) = 1""",
)
def dedup_rank_day(f):
    """A captured rank gives quotes at one price the same place; the ladder counts the prices below."""
    quotes = f.quotes
    ladder = K.price_ladder(quotes).withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY isbn, dateacc ORDER BY price2)")
    )
    placed = quotes.join(ladder.select("isbn", "dateacc", "price2", "rank"), ["isbn", "dateacc", "price2"])
    return K.dedup_rank_day(placed, TIE)


@query(f"{QUOTE} price_median:f", "SELECT * FROM below_median")
def outlier_median(f):
    """Of all typed quotes, also repeated ones and those without a seller name."""
    return K.drop_above_median(K.typed_quotes(f.raw))


@query("isbn dateacc:d price_median:f", "SELECT isbn, dateacc, price_median FROM medians")
def incremental_medians(f):
    """Medians from counts that three batches add: one of early days, one of later days, and late quotes of both."""
    quotes = K.typed_quotes(f.raw)
    stored = StoredMedians.of(quotes, scratch_path(f.spark, "medians"))
    part = F.when(F.col("l_orderkey") % 7 == 0, 2).when(F.col("dateacc") < F.to_date(F.lit("1998-01-01")), 0).otherwise(1)
    for k in range(3):
        stored.add(quotes.filter(part == k), f"batch{k}")
    return stored.medians()


@query(
    f"{QUOTE} list_price:f",
    """SELECT q.*, list_price FROM quotes q LEFT JOIN list_prices USING (isbn)
       WHERE price2 - 3.99 < 1.5 * list_price OR list_price IS NULL""",
)
def outlier_list_price(f):
    return K.drop_above_list(f.quotes, f.list_prices)


@query(f"{QUOTE} rank:i", "SELECT * FROM ranked")
def snapshot_rank(f):
    return f.ranked


@query("isbn share_under_floor:f days:i", "SELECT * FROM floor_products")
def floor_price_products(f):
    ranked = stage(f.ranked, "ranked")
    return K.floor_price_products(ranked, f.price_floor(ranked))


@query(f"{QUOTE} rank:i", "SELECT * FROM ranked WHERE isbn IN (SELECT isbn FROM anchored)")
def anchor_products(f):
    ranked = stage(f.ranked, "ranked")
    return K.keep_products(ranked, K.anchor_products(ranked, ANCHOR))


@query(PANEL_ROW, "SELECT * FROM panel WHERE isbn NOT IN (SELECT isbn FROM unranked)")
def unranked_products_anti(f):
    return K.drop_products(f.panel, K.unranked_products(f.profiles, CHECK_DAYS))


@query(PANEL_ROW, "SELECT * FROM panel WHERE isbn IN (SELECT isbn FROM product_master)")
def master_products_semi(f):
    return K.keep_products(f.panel, f.master)


@query(PANEL_ROW, "SELECT * FROM panel")
def panel_clean(f):
    return f.panel


@query(
    f"{PANEL_ROW} price2_prev:f price2_change:f indic_change:i",
    "SELECT *, CASE WHEN price2_change <> 0 THEN 1 WHEN price2_change = 0 THEN 0 END AS indic_change FROM lagged",
)
def panel_lags(f):
    return P.with_price_lags(f.panel)


@query(
    "dateacc:d isbn seller rank:i price2:f price_next_lowest:f price_next_highest:f price_lowest:f price_anchor:f "
    "pct_diff_next_lowest:f pct_diff_next_highest:f pct_diff_lowest:f pct_diff_anchor:f",
    "SELECT * FROM distances",
)
def quote_distances(f):
    return P.with_quote_distances(P.with_day_context(f.staged_panel, ANCHOR))


@query(
    "dateacc:d isbn price_anchor:f price_lowest:f",
    f"""SELECT l.dateacc, l.isbn, a.price2 AS price_anchor, l.price2 AS price_lowest
        FROM (SELECT * FROM panel WHERE seller = '{ANCHOR}') a RIGHT JOIN (SELECT * FROM panel WHERE rank = 1) l
        ON a.isbn = l.isbn AND a.dateacc = l.dateacc""",
)
def special_prices(f):
    return P.special_prices(f.staged_panel, ANCHOR)


@query("dateacc:d isbn price_lowest:f price_anchor:f", "SELECT * FROM paired_days")
def lowest_vs_anchor(f):
    return P.lowest_vs_anchor(f.panel, ANCHOR)


@query("dateacc:d isbn seller_lowest price_lowest:f", "SELECT dateacc, isbn, seller AS seller_lowest, price2 AS price_lowest FROM panel WHERE rank = 1")
def lowest_quote(f):
    return R.lowest_quote(f.panel)


@query(CHANGE, "SELECT * FROM changes")
def price_changes(f):
    return clean.change_events(f.panel)


@query(
    "dateacc:d isbn seller days_bet_change:i first_change:i days_bet_change2:i",
    "SELECT *, CASE WHEN first_change = 0 THEN days_bet_change END AS days_bet_change2 FROM changes",
)
def first_change(f):
    return clean.change_events(f.panel)


@query("seller isbn num_price_inc:i num_price_dec:i num_price_change:i", "SELECT * FROM pair_changes")
def pair_change_counts(f):
    return C.pair_change_counts(clean.change_events(f.panel))


@query(
    "dateacc:d isbn seller rank:i rank_last_change:i",
    """SELECT *, last_value(CASE WHEN price2_change <> 0 OR price2_change IS NULL THEN rank END IGNORE NULLS)
         OVER (PARTITION BY seller, isbn ORDER BY dateacc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank_last_change
       FROM lagged""",
)
def last_changed_rank(f):
    return C.with_last_changed_rank(f.panel)


@query("isbn seller days_observed:i", "SELECT isbn, seller, coalesce(sum(days_bet), 0) + 1 AS days_observed FROM panel GROUP BY ALL")
def days_observed(f):
    return L.days_observed(f.panel)


@query(
    "seller isbn days_observed:i days_first_page:i pct_first_page:f",
    "SELECT *, days_first_page / nullif(days_observed, 0) AS pct_first_page FROM page_days",
)
def first_page_share(f):
    return L.first_page_share(P.with_page_days(f.panel))


@query(
    "dateacc:d price2:f rank:i seller isbn",
    "SELECT dateacc, price2, rank, seller, isbn FROM panel WHERE seller = 'S12'",
)
def seller_series(f):
    return P.seller_series(f.panel, "S12")


@query(
    "seller isbn observations:i price_first:f price_last:f",
    """SELECT seller, isbn, count(*) AS observations, arg_min(price2, dateacc) AS price_first,
              arg_max(price2, dateacc) AS price_last FROM panel GROUP BY seller, isbn""",
)
def group_apply(f):
    """A user function per pair; a pair holds one row per day at most."""
    from pricepanel.operators.apply import group_apply as apply

    def ends(frame):
        import pandas

        days, prices = frame["dateacc"].to_numpy(), frame["price2"].to_numpy()
        return pandas.DataFrame(
            {
                "seller": frame["seller"].to_numpy()[:1],
                "isbn": frame["isbn"].to_numpy()[:1],
                "observations": [len(frame)],
                "price_first": [prices[days.argmin()]],
                "price_last": [prices[days.argmax()]],
            }
        )

    return apply(
        f.panel.select("seller", "isbn", "dateacc", "price2"), ["seller", "isbn"], ends,
        "seller string, isbn string, observations long, price_first double, price_last double",
    )


@query(
    "seller isbn num_price_inc:i num_price_dec:i num_price_change:i days_observed:i days_first_page:i pct_first_page:f "
    "changes_per_day:f inc_per_day:f dec_per_day:f no_change:i",
    "SELECT * FROM pair_rates",
)
def pair_profile(f):
    """The joined form, with the pairs of both sides kept; `seller_profile` uses the one-pass form."""
    panel = f.staged_panel
    return L.with_pair_rates(L.merge_pair_counts(clean.change_events(panel), P.with_page_days(panel)))


@query("seller isbn stdev_price:f mean_price:f mean_rank:f cv:f",
       """SELECT seller, isbn, price_stdev AS stdev_price, price_mean AS mean_price, rank_mean AS mean_rank,
                 price_stdev / nullif(price_mean, 0) AS cv FROM pair_prices
          WHERE price_stdev IS NOT NULL AND price_mean IS NOT NULL""")
def pair_variability(f):
    return profile.pair_variability(f.panel)


@query(
    "seller isbn price_stdev:f price_mean:f rank_mean:f days_observed:i num_unique_price:i price_max:f price_min:f coeff_var:f "
    "price_range:f avg_tgt_rank:f avg_days_bet_change:f avg_pct_change:f num_increase:i num_decrease:i avg_ranks_bumped:f num_change:i",
    "SELECT * FROM features_of_pairs",
)
def pair_features(f):
    return profile.pair_features(f.panel)
