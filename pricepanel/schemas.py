"""Table layouts of a price panel, and the column names the operators use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

STR, INT, DBL, DATE = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


BOOKS = _table(("isbn", STR), ("listprice", DBL))
PROFILES = _table(
    ("dateacc", STR), ("isbn", STR), ("reviews", INT), ("rating", DBL), ("rank", INT), ("currprice", DBL)
)
LISTINGS = _table(
    ("dateacc", STR), ("isbn", STR), ("seller", STR), ("rating", STR), ("fba", INT), ("numrating", STR),
    ("shipping", DBL), ("price", DBL), ("condition", STR), ("rank", INT),
)
LISTING_DESC = _table(("isbn", STR), ("seller", STR), ("used", INT), ("comments", STR), ("shipsfrom", STR))
CLEAN_PANEL = _table(
    ("dateacc", DATE), ("isbn", STR), ("seller", STR), ("rating", DBL), ("fba", INT), ("numrating", DBL),
    ("rank", INT), ("price2", DBL), ("rank_prev", INT), ("days_bet", INT),
)
PRODUCT_MASTER = _table(("isbn", STR), ("source", STR))
LIST_PRICES = _table(("isbn", STR), ("list_price", DBL), ("format", STR), ("category", STR))
BESTSELLERS = _table(("display_name", STR), ("isbn", STR))
MEDIAN_PRICE = _table(("dateacc", STR), ("isbn", STR), ("price_median", DBL))
PHRASES = _table(("gram", STR), ("content", INT))
SELLERS_CLUSTERED = _table(("seller", STR), ("cluster", INT))

# Keys of the write-once tables: the first row stored under a key stays.
UNIQUE_KEYS = {
    "profiles": ["dateacc", "isbn"],
    "listings": ["dateacc", "isbn", "seller", "price"],
    "listing_desc": ["isbn", "seller", "used"],
}


@dataclass(frozen=True)
class PanelColumns:
    """Names of the panel's key and measure columns; pass another instance to rename."""

    product: str = "isbn"
    seller: str = "seller"
    day: str = "dateacc"
    price: str = "price2"
    rank: str = "rank"

    @property
    def pair(self) -> list[str]:
        return [self.seller, self.product]

    @property
    def product_day(self) -> list[str]:
        return [self.product, self.day]


PANEL = PanelColumns()
