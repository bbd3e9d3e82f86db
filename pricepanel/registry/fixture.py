"""The price panel and its side tables, derived from the given parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricepanel.functions.quantiles import price_quantile
from pricepanel.operators import cleaning as K
from pricepanel.operators import text as X
from pricepanel.operators import products
from pricepanel.plans import clean, profile, variability
from pricepanel.session import stage
from pricepanel.sources.tables import spread

ANCHOR = "ANCHOR"
START = "1996-01-01"
CHECK_DAYS = ["1996-01-01", "1996-02-01"]
TIE = ["price2", "l_orderkey", "l_linenumber", "l_partkey"]

# SQL of the raw quotes; the DuckDB side reads the same text with its own quotes.
RAW_QUOTES = """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dateacc, p_brand AS isbn,
 CASE WHEN l_suppkey = 1 THEN 'ANCHOR' WHEN l_suppkey % 37 = 36 THEN ''
      ELSE concat('S', CAST(l_suppkey AS STRING)) END AS seller,
 CASE WHEN l_discount = 0 THEN NULL ELSE concat(CAST(100 - CAST(round(l_discount*100) AS INT) AS STRING), '%') END AS rating,
 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS fba,
 CASE WHEN l_orderkey % 2000 >= 1000
      THEN concat(CAST(CAST(floor((l_orderkey % 2000)/1000) AS INT) AS STRING), ',', lpad(CAST(l_orderkey % 1000 AS STRING),3,'0'))
      ELSE CAST(l_orderkey % 2000 AS STRING) END AS numrating,
 CASE WHEN l_tax = 0 THEN NULL ELSE CAST(3.99 AS DOUBLE) END AS shipping,
 CAST(100*floor(l_extendedprice/l_quantity/100)+20 AS DOUBLE) AS price,
 l_linestatus AS `condition`, l_orderkey, l_linenumber, l_partkey
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""


# Page text, the same SQL in both engines.
PRODUCT_PAGE = """
concat(html, '<div id="priceBlock" class="buying"><b><span class="priceLarge">$', CAST(page_id % 50 AS STRING),
 '.99</span></b></div><h2>Product Details</h2><div>',
 CASE WHEN page_id % 7 = 0 THEN '' ELSE concat(CAST(page_id % 5 AS STRING), '.5 out of 5 stars (') END,
 CASE WHEN page_id % 6 = 0 THEN '' ELSE concat(CAST(page_id % 200 AS STRING), ' customer reviews) ') END,
 CASE WHEN page_id % 8 = 0 THEN '' ELSE concat('#', CAST(page_id % 9 + 1 AS STRING), ',', lpad(CAST(page_id % 1000 AS STRING), 3, '0'), ' in Books') END,
 '</div>')
"""
OFFER_PAGE = """
replace(replace(html, '<li><a href="', concat(
 '<tbody class="result"><tr><td><span class="price">$', CAST(page_id % 90 + 10 AS STRING), '.50</span>',
 CASE WHEN page_id % 11 = 0 THEN '<img src="x.png" alt="ANCHOR" />' ELSE '' END,
 CASE WHEN page_id % 3 = 0 THEN '' ELSE '<span class="price_shipping">+ $3.99</span>' END,
 CASE WHEN page_id % 5 = 0 THEN '<div class="fba_link"><a>Fulfilled</a></div>' ELSE '' END,
 '<div class="condition">Used - Good</div>',
 CASE page_id % 4 WHEN 0 THEN '<div class="rating"><b>Just Launched</b> seller</div>'
  WHEN 1 THEN '<div class="rating">100% positive. (1 rating)</div>'
  WHEN 2 THEN concat('<div class="rating"><b>9', CAST(page_id % 10 AS STRING), '%</b> positive. (1,', lpad(CAST(page_id % 1000 AS STRING), 3, '0'), ' total ratings)</div>')
  ELSE '' END,
 '<div class="availability">In Stock. Ships from NY, United States. </div>',
 CASE WHEN page_id % 9 = 0 THEN '' ELSE concat('<div class="comments"> copy of page ', CAST(page_id AS STRING), ' </div>') END,
 '<div class="seller"><b>Seller:</b> ')), '</a></li>', '</div></td></tr></tbody>')
"""


class Fixture:
    """Lazy access to the given tables and to what the queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def lineitem(self) -> DataFrame:
        return spread(self.table("lineitem"), "l_orderkey", "l_linenumber")

    @cached_property
    def raw(self) -> DataFrame:
        return self.spark.sql(RAW_QUOTES, lineitem=self.lineitem, part=self.table("part"))

    @cached_property
    def quotes(self) -> DataFrame:
        return K.dedup_seller_day(K.clean_quotes(self.raw), TIE)

    @cached_property
    def ranked(self) -> DataFrame:
        return clean.ranked_quotes(self.raw, self.list_prices, TIE)

    def price_floor(self, ranked: DataFrame):
        """The median of the lowest prices, as a one-row subquery: a floor that fits any scale of the data."""
        lowest = ranked.filter(F.col("rank") == 1)
        return price_quantile(lowest, "price2", 0.5).scalar()

    def screened(self, ranked: DataFrame) -> DataFrame:
        return clean.screen_panel(K.patch_anchor(ranked, ANCHOR), ANCHOR, START, self.price_floor(ranked))

    @cached_property
    def panel(self) -> DataFrame:
        """The clean panel; its screens and its rows read the same staged quotes."""
        return self.screened(stage(self.ranked, "ranked"))

    @cached_property
    def staged_panel(self) -> DataFrame:
        """The panel written once, for queries that read it in several branches."""
        return stage(self.panel, "panel")

    @cached_property
    def list_prices(self) -> DataFrame:
        part = self.table("part")
        return part.groupBy(F.col("p_brand").alias("isbn")).agg(
            F.avg(F.when(F.col("p_brand") != "Brand#7", F.col("p_retailprice"))).alias("list_price"),
            F.min("p_type").alias("format"),
        )

    @cached_property
    def profiles(self) -> DataFrame:
        """Daily product profiles: reviews, rating and a sales rank that is null for some."""
        return self.spark.sql(
            """
            SELECT dateacc, isbn, reviews, book_rating,
                   CASE WHEN reviews % 11 <> 0 THEN position END AS sales_rank
            FROM (SELECT dateacc, isbn, reviews, book_rating,
                         row_number() OVER (PARTITION BY dateacc ORDER BY quantity DESC, isbn) AS position
                  FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dateacc, p_brand AS isbn,
                               count(*) AS reviews, avg(l_quantity) / 10 AS book_rating, sum(l_quantity) AS quantity
                        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2))
            """,
            lineitem=self.lineitem,
            part=self.table("part"),
        )

    @cached_property
    def master(self) -> DataFrame:
        """Product master with a source per product; some products are missing."""
        number = F.expr("CAST(substring(p_brand, 7) AS INT)")
        return (
            self.table("part")
            .select(F.col("p_brand").alias("isbn"), number.alias("n"))
            .distinct()
            .filter(F.col("n") % 13 != 0)
            .select("isbn", F.concat(F.lit("SOURCE"), (F.col("n") % 3).cast("string")).alias("source"))
        )

    @cached_property
    def bestsellers(self) -> DataFrame:
        """Bestseller lists, with repeated rows."""
        return (
            self.table("part")
            .filter(F.expr("CAST(substring(p_brand, 7) AS INT) < 15"))
            .select(F.col("p_type").alias("display_name"), F.col("p_brand").alias("isbn"))
        )

    @cached_property
    def clusters(self) -> DataFrame:
        """A fixed assignment of sellers to three clusters; every fifth seller is left out."""
        key = F.col("s_suppkey")
        return (
            self.table("supplier")
            .filter(key % 5 != 0)
            .select(
                F.when(key == 1, ANCHOR).otherwise(F.concat(F.lit("S"), key.cast("string"))).alias("seller"),
                (key % 3 + 1).cast("int").alias("cluster"),
            )
        )

    @cached_property
    def descriptions(self) -> DataFrame:
        origin = (
            F.when(F.col("lang") == "en", "United States")
            .when(F.col("lang") == "fr", "Maine, United States")
            .when(F.col("lang") == "de", "United Kingdom")
            .otherwise("Spain")
        )
        return spread(self.table("documents").drop("n_chars"), "doc_id").select(
            F.col("source").alias("seller"),
            F.col("doc_id").alias("isbn"),
            (F.col("doc_id") % 2).cast("int").alias("used"),
            F.col("text").alias("comments"),
            origin.alias("shipsfrom"),
        )

    @cached_property
    def pair_descriptions(self) -> DataFrame:
        """Descriptions keyed by the sellers and products of the panel."""
        n = F.col("isbn")
        return self.descriptions.withColumns(
            {
                "seller": F.concat(F.lit("S"), (n % 100).cast("string")),
                "isbn": F.concat(F.lit("Brand#"), (F.floor(n / 100) % 25 + 1).cast("string")),
                "listing": n,
            }
        )

    @cached_property
    def cleaned(self) -> DataFrame:
        """Descriptions cleaned once, for queries that read them in several branches."""
        return stage(X.clean_descriptions(self.descriptions), "cleaned")

    def labelled_grams(self, n: int, top: int = 60) -> DataFrame:
        """The most frequent word runs, labelled as content by the parity of their length."""
        counts = X.gram_counts(self.cleaned, n, top)
        return counts.select("gram", (F.length("gram") % 2).alias("content"))

    @cached_property
    def phrases(self) -> DataFrame:
        return X.informative_phrases(self.labelled_grams(2), self.labelled_grams(3))

    @cached_property
    def product_pages(self) -> DataFrame:
        """The given pages with the blocks of a product page after them."""
        return self.table("pages").select("page_id", F.expr(PRODUCT_PAGE).alias("html"))

    @cached_property
    def offer_pages(self) -> DataFrame:
        """The given pages with each link of their navigation turned into a result block."""
        return self.table("pages").select(
            "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("item"), F.expr(OFFER_PAGE).alias("html")
        )

    @cached_property
    def ticks(self) -> DataFrame:
        """Event stream as price ticks of a pair."""
        return self.table("events").select(
            F.col("user_id").alias("seller"),
            F.col("event_type").alias("isbn"),
            "ts",
            "event_id",
            (F.floor(F.col("value") / 10) * 10).cast("double").alias("price2"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Events as dated snapshots, keyed by user, type and day."""
        return self.table("events").select(
            F.to_date("ts").alias("dateacc"), F.col("event_type").alias("isbn"), F.col("user_id").alias("seller"),
            "ts", "event_id", "value",
        )

    @cached_property
    def eligible(self) -> DataFrame:
        """Quotes of the products in the master with a sales rank on the check days."""
        return variability.eligible_panel(self.staged_panel, self.profiles, self.master, CHECK_DAYS)

    @cached_property
    def days(self) -> DataFrame:
        return products.day_measures(self.eligible, ANCHOR, self.clusters)

    @cached_property
    def weighted_days(self) -> DataFrame:
        return variability.weighted_days(self.days, self.profiles)

    @cached_property
    def fluctuation(self) -> DataFrame:
        return variability.fluctuation(
            stage(self.eligible, "eligible"), ANCHOR, self.profiles, self.clusters, self.master, self.bestsellers, self.list_prices
        )

    @cached_property
    def seller_profile(self) -> DataFrame:
        return profile.seller_profile(self.staged_panel, ANCHOR)
