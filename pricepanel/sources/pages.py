"""Product and listing pages to records, by regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.functions import scalars as S
from pricepanel.functions.ordered import total_before

# The marks and phrases of the source pages.
CURRENT_PRICE_CLASS = "priceLarge"
DETAILS_HEADING = "Product Details"
STARS = r"([\d.]+) out of 5 stars"
REVIEWS = r"(\d+) customer reviews"
SALES_RANK = r"#([\d,]+) in Books"
RESULT_CLASS = "result"
FIELD_MARKS = {
    "price": ("span", "price"),
    "shipping": ("span", "price_shipping"),
    "condition": ("div", "condition"),
    "seller": ("div", "seller"),
    "fba": ("div", "fba_link"),
    "rating": ("div", "rating"),
    "availability": ("div", "availability"),
    "comments": ("div", "comments"),
}
NEW_SELLER = "Just Launched"
SINGLE_RATING = "1 rating"
RATING = r"(\d+%)"
RATING_COUNT = r"([\d,]+) total ratings"
ORIGIN = r"Ships from ([\w,\s]+)."


def found(text: str | Column, pattern: str) -> Column:
    """The first capture of a pattern, null without a match."""
    value = F.regexp_extract(S.column(text), pattern, 1)
    return F.when(value != "", value)


def element_text(html: str | Column, tag: str, mark: str) -> Column:
    """Text inside the first element of a tag and class, tags out; null without the element.

    The element ends at its own closing tag, found by counting equal tags in order, at any depth. Where tags do
    not balance, it ends at the first closing tag.
    """
    rest = F.regexp_extract(S.column(html), rf'(?s)<{tag}[^>]*class="{mark}"[^>]*>(.*)', 1)
    # every piece but the first begins with an opening or closing tag; the element is the pieces before depth 0
    pieces = F.split(rest, rf"(?=</?{tag}\b)")
    begin = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))

    def step(at: Column, piece: Column) -> Column:
        turn = F.when(piece.rlike(rf"^<{tag}\b"), 1).when(piece.rlike(rf"^</{tag}\b"), -1).otherwise(0)
        depth = F.when(at["depth"] > 0, at["depth"] + turn).otherwise(0)
        return F.struct(depth.alias("depth"), (at["taken"] + F.when(depth > 0, F.length(piece)).otherwise(0)).alias("taken"))

    taken = F.aggregate(pieces, begin, step, lambda at: F.when(at["depth"] == 0, at["taken"]))
    whole = F.when(taken.isNotNull(), F.substring(rest, F.lit(1), taken))
    first = F.when(rest.contains(f"</{tag}>"), F.substring_index(rest, f"</{tag}>", 1))
    return F.trim(F.regexp_replace(F.coalesce(whole, first), r"<[^>]*>", ""))


def amount(text: Column) -> Column:
    """A dollar amount such as ``$12.50`` or ``+ $3.99``."""
    return F.replace(F.regexp_replace(text, r"[+$\s]", ""), F.lit(","), F.lit("")).try_cast("double")


def page_profile(pages: DataFrame, html: str = "html") -> DataFrame:
    """Reviews, rating, sales rank and current price of each product page, null where missing."""
    details = F.regexp_extract(F.col(html), rf"(?s){DETAILS_HEADING}(.*)", 1)
    return (
        pages.withColumn("__details", details)
        .withColumns(
            {
                "reviews": found("__details", REVIEWS).try_cast("int"),
                "rating": found("__details", STARS).try_cast("double"),
                "rank": S.thousands(found("__details", SALES_RANK)).cast("int"),
                "currprice": amount(element_text(html, "span", CURRENT_PRICE_CLASS)),
            }
        )
        .drop("__details", html)
    )


def page_listings(pages: DataFrame, anchor: str, html: str = "html") -> DataFrame:
    """One row per result block of each listing page, with its position on the page.

    Every field comes from its own block: a missing rating is null and never
    that of the quote before.
    """
    blocks = F.regexp_extract_all(
        F.col(html), F.lit(rf'(?s)<tbody[^>]*class="{RESULT_CLASS}"[^>]*>(.*?)</tbody>'), F.lit(1)
    )
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(blocks).alias("__at", "__block"))
    rows = rows.withColumns({f"__{f}": element_text("__block", tag, mark) for f, (tag, mark) in FIELD_MARKS.items()})
    is_anchor = F.col("__block").contains(f'alt="{anchor}"')
    rated = F.col("__rating")
    launched, single = rated.contains(NEW_SELLER), rated.contains(SINGLE_RATING)
    fulfilled = F.col("__fba").isNotNull()
    count = F.when(launched, "0").when(single, "1").otherwise(found(rated, RATING_COUNT))
    fields = {
        "pos": F.col("__at") + 1,
        "seller": F.when(is_anchor, anchor).otherwise(F.trim(F.split_part("__seller", F.lit(":"), F.lit(2)))),
        "rating": F.when(~is_anchor & ~launched, found(rated, RATING)),
        "fba": F.when(is_anchor | fulfilled, 1).otherwise(0),
        "numrating": F.when(~is_anchor, count),
        "shipping": F.when(is_anchor | fulfilled, 0.0).otherwise(amount(F.col("__shipping"))),
        "price": amount(F.col("__price")),
        "condition": F.col("__condition"),
        "comments": F.when(~is_anchor, F.col("__comments")),
        "shipsfrom": F.when(~is_anchor, found("__availability", ORIGIN)),
    }
    kept = [c for c in pages.columns if c != html]
    return rows.withColumns(fields).select(*kept, *fields)


def paged_position(listings: DataFrame, item: str, page: str, pos: str = "pos") -> DataFrame:
    """Running position of a listing over all pages of its item; pages are numbered.

    Pages are counted first, and the counts of earlier pages are summed by
    slices of pages, so neither the listings nor the pages of a large item meet
    in one task.
    """
    counted = listings.groupBy(item, page).agg(F.count(F.lit(1)).alias("__n"))
    offsets = total_before(counted, [item], page, "__n", "__before").drop("__n")
    return (
        listings.join(offsets, [item, page])
        .withColumn("position", F.col("__before") + F.col(pos))
        .drop("__before")
    )
