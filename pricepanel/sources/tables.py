"""Delimited text, XML and list readers; every schema is stated, none inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "NA"  # fixed value: how the text files write a missing value

BOOK_SCHEMA = """
    list_name string, bestsellers_date string, published_date string, display_name string,
    rank int, rank_last_week int, weeks_on_list int,
    book_details struct<book_detail: struct<title: string, author: string, contributor: string,
        publisher: string, price: double, primary_isbn10: string, primary_isbn13: string>>
"""


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of an input with fewer splits than cores over all cores.

    A file that cannot be split would leave the other cores idle. An input with
    enough splits is returned as it is, so what is moved here never exceeds one
    split per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, sep: str = ",") -> DataFrame:
    """Delimited text with ``NA`` as null. A malformed number or date becomes null as well."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep, nullValue=NULL_MARK, dateFormat="yyyy-MM-dd")


def read_positional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Text without a header: the schema names the columns by position."""
    return read_csv(spark, path, schema, header=False)


def flatten_books(books: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested book records to flat rows; identifiers lists, reviews and descriptions stay out."""
    own = [c for c in books.columns if c != "book_details" and c not in keep]
    flat = books.select(*keep, *own, "book_details.book_detail.*")
    text = [f.name for f in flat.schema.fields if f.dataType == T.StringType() and f.name not in keep]
    return flat.withColumns({c: F.when(F.trim(c) != "", F.trim(c)) for c in text})


def read_books(spark: SparkSession, path: str, schema: str = BOOK_SCHEMA) -> DataFrame:
    """One row per ``book`` element of the XML files under a path."""
    return flatten_books(spark.read.format("xml").option("rowTag", "book").schema(schema).load(path))


def books_from_column(df: DataFrame, xml: str | Column, schema: str = BOOK_SCHEMA, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same rows from a column that holds one ``book`` element each."""
    return flatten_books(df.select(*keep, F.from_xml(xml, schema).alias("__book")).select(*keep, "__book.*"), keep)


def read_lists(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """All list files under a root in one read; the list name is that of a file's folder.

    Folders may be plain (``fiction``) or written by ``partitionBy`` (``list_name=fiction``).
    """
    files = spark.read.schema(schema).option("header", True).option("nullValue", NULL_MARK).csv(f"{root}/*")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return files.select("*", F.regexp_replace(F.url_decode(folder), "^.*=", "").alias("list_name"))


def shuffled_worklist(items: DataFrame, key: str, seed: int) -> DataFrame:
    """The work list in an order that looks random and repeats for a seed."""
    return items.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
