"""Queries over files, pages, descriptions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel import schemas
from pricepanel.functions import text as TX
from pricepanel.functions.quantiles import exact_quantiles
from pricepanel.operators import text as X
from pricepanel.operators.phrase_search import search_phrases
from pricepanel.registry.core import query
from pricepanel.registry.fixture import ANCHOR
from pricepanel.registry.queries_panel import PANEL_ROW
from pricepanel.registry.sql_blocks import dollars, inner
from pricepanel.session import scratch_path, stage
from pricepanel.sources import pages, sinks, store, tables
from pricepanel.streaming import instant, jobs, wall_clock


@query(PANEL_ROW, "SELECT * FROM panel")
def csv_roundtrip(f):
    """The panel through a CSV file with a header, and through a delimited table."""
    path = scratch_path(f.spark, "csv")
    panel = f.panel.select(*schemas.CLEAN_PANEL.names)
    sinks.write_csv(panel, f"{path}/comma")
    comma = tables.read_csv(f.spark, f"{path}/comma", schemas.CLEAN_PANEL)
    sinks.write_csv(comma, f"{path}/bar", sep="|")
    return tables.read_csv(f.spark, f"{path}/bar", schemas.CLEAN_PANEL, sep="|")


@query(
    "dateacc isbn seller rating fba:i numrating shipping:f price:f condition",
    "SELECT CAST(dateacc AS VARCHAR) AS dateacc, * EXCLUDE (dateacc) FROM raw_quotes",
)
def csv_positional_scan(f):
    path = scratch_path(f.spark, "positional")
    sinks.write_csv(f.raw.withColumn("rank", F.lit(None).cast("int")).select(*schemas.LISTINGS.names), path, header=False)
    return tables.read_positional(f.spark, path, schemas.LISTINGS)


@query("display_name isbn", "SELECT * FROM bestsellers")
def csv_append(f):
    path = scratch_path(f.spark, "append")
    rows = f.bestsellers
    for batch in (rows.filter(F.length("isbn") == 7), rows.filter(F.length("isbn") != 7)):
        sinks.append_quoted(batch, path)
    return tables.read_positional(f.spark, path, schemas.BESTSELLERS)


@query("list_name isbn title price:f", "SELECT p_type AS list_name, p_brand AS isbn, p_name AS title, p_retailprice AS price FROM part")
def multi_list_union(f):
    root = scratch_path(f.spark, "lists")
    part = f.table("part").select(
        F.col("p_type").alias("list_name"), F.col("p_brand").alias("isbn"), F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("price"),
    )
    part.write.partitionBy("list_name").csv(root, header=True, nullValue=tables.NULL_MARK)
    return tables.read_lists(f.spark, root, "isbn string, title string, price double")


@query(
    "p_partkey:i list_name display_name published_date rank:i title author price:f primary_isbn10",
    """SELECT p_partkey, p_type AS list_name, p_brand AS display_name, '2012-04-01' AS published_date, p_size AS rank, p_name AS title,
              CASE WHEN p_partkey % 3 <> 0 THEN 'A. Writer' END AS author, p_retailprice AS price,
              CAST(p_partkey AS VARCHAR) AS primary_isbn10 FROM part""",
)
def xml_book_scan(f):
    """One `book` element per part, parsed back to the fields it was written from."""
    c = lambda name: F.col(name).cast("string")
    xml = F.concat(
        F.lit("<book><list_name>"), c("p_type"), F.lit("</list_name><display_name>"), c("p_brand"), F.lit("</display_name><rank>"),
        c("p_size"), F.lit("</rank><isbns><isbn><isbn10>1</isbn10></isbn></isbns><book_details><book_detail><title>"), c("p_name"),
        F.lit("</title><description>long text</description><author>"),
        F.when(F.col("p_partkey") % 3 != 0, "A. Writer").otherwise(""), F.lit("</author><price>"), c("p_retailprice"),
        F.lit("</price><primary_isbn10>"), c("p_partkey"),
        F.lit("</primary_isbn10></book_detail></book_details><reviews/></book>"),
    )
    books = tables.books_from_column(f.table("part").withColumn("xml", xml), F.col("xml"), keep=("p_partkey",))
    return books.withColumn("published_date", F.lit("2012-04-01"))


@query(
    "page_id:i title lang h1 reviews:i rating:f rank:i currprice:f",
    rf"""SELECT page_id, nullif(regexp_extract(source_html, '<title>([^<]*)</title>', 1), '') AS title,
           nullif(regexp_extract(source_html, '<html lang="([^"]*)"', 1), '') AS lang,
           nullif(regexp_extract(source_html, '<h1>([^<]*)</h1>', 1), '') AS h1,
           try_cast(nullif(regexp_extract(tail, '(\d+) customer reviews', 1), '') AS INT) AS reviews,
           try_cast(nullif(regexp_extract(tail, '([\d.]+) out of 5 stars', 1), '') AS DOUBLE) AS rating,
           try_cast(replace(nullif(regexp_extract(tail, '#([\d,]+) in Books', 1), ''), ',', '') AS INT) AS rank,
           {dollars(inner("html", "span", "priceLarge"))} AS currprice
        FROM (SELECT *, regexp_extract(html, '(?s)Product Details(.*)', 1) AS tail FROM product_pages)""",
)
def page_profile_extract(f):
    found = f.product_pages.withColumns(
        {
            "title": pages.found("html", "<title>([^<]*)</title>"),
            "lang": pages.found("html", '<html lang="([^"]*)"'),
            "h1": pages.found("html", "<h1>([^<]*)</h1>"),
        }
    )
    return pages.page_profile(found)


OFFER = "page_id:i item pos:i seller rating fba:i numrating shipping:f price:f condition comments shipsfrom"


@query(OFFER, "SELECT * FROM offers")
def page_listing_explode(f):
    return pages.page_listings(f.offer_pages, ANCHOR)


@query(
    "item page_id:i pos:i position:i",
    "SELECT *, row_number() OVER (PARTITION BY item ORDER BY page_id, pos) AS position FROM offer_blocks",
)
def paged_position(f):
    listings = stage(pages.page_listings(f.offer_pages, ANCHOR).select("item", "page_id", "pos"), "offers")
    return pages.paged_position(listings, "item", "page_id")


@query("p_partkey:i")
def shuffled_worklist(f):
    return tables.shuffled_worklist(f.table("part").select("p_partkey"), "p_partkey", seed=7)


def _store(f, rows, keys, order, day=None):
    """Insert two overlapping batches into an empty write-once table and read it back."""
    path = scratch_path(f.spark, "store")
    sinks.create_store(f.spark, path, rows.schema, [day] if day else None)
    for batch in (rows.filter("first_batch"), rows):
        sinks.insert_ignore(batch, path, rows.schema, keys, order, day)
    return f.spark.read.schema(rows.schema).parquet(path)


@query(
    "dateacc:d isbn seller:i event_id:i value:f",
    """SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY dateacc, isbn
         ORDER BY CASE WHEN dateacc < DATE '2024-01-15' THEN 0 ELSE 1 END, ts, event_id) = 1""",
)
def insert_ignore_profiles(f):
    rows = f.snapshots.withColumn("first_batch", F.col("dateacc") < F.to_date(F.lit("2024-01-15")))
    return _store(f, rows, schemas.UNIQUE_KEYS["profiles"], ["ts", "event_id"], day="dateacc")


@query(
    "dateacc:d isbn seller price:f l_orderkey:i l_linenumber:i l_partkey:i",
    """SELECT * FROM raw_quotes QUALIFY row_number() OVER (PARTITION BY dateacc, isbn, seller, price
         ORDER BY CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 1 END, l_orderkey, l_linenumber, l_partkey) = 1""",
)
def insert_ignore_listings(f):
    rows = f.raw.select("dateacc", "isbn", "seller", "price", "l_orderkey", "l_linenumber", "l_partkey").withColumn(
        "first_batch", F.col("l_orderkey") % 2 == 0
    )
    return _store(f, rows, schemas.UNIQUE_KEYS["listings"], ["l_orderkey", "l_linenumber", "l_partkey"], day="dateacc")


@query(
    "isbn seller used:i doc_id:i shipsfrom",
    """SELECT isbn % 50 AS isbn, seller, used, isbn AS doc_id, shipsfrom FROM descriptions QUALIFY row_number() OVER (
         PARTITION BY isbn % 50, seller, used ORDER BY CASE WHEN isbn % 3 = 0 THEN 0 ELSE 1 END, isbn) = 1""",
)
def insert_ignore_desc(f):
    rows = f.descriptions.select(
        (F.col("isbn") % 50).cast("string").alias("isbn"), "seller", "used", F.col("isbn").alias("doc_id"), "shipsfrom"
    ).withColumn("first_batch", F.col("doc_id") % 3 == 0)
    keyed = store.KeyedStore(f.spark, scratch_path(f.spark, "store"), rows.schema, tuple(schemas.UNIQUE_KEYS["listing_desc"]))
    for batch in (rows.filter("first_batch"), rows):
        keyed.insert(batch, ["doc_id"])
    return keyed.read()


@query(
    "isbn:i shipsfrom origin",
    """SELECT isbn, shipsfrom, nullif(replace(replace(shipsfrom, ', United States', ''), 'United Kingdom', 'UK'), 'United States') AS origin
       FROM descriptions""",
)
def ship_origin(f):
    return f.descriptions.withColumn("origin", TX.ship_origin("shipsfrom"))


@query("isbn:i comments", "SELECT isbn, comments FROM descriptions")
def text_clean(f):
    return X.clean_descriptions(f.descriptions)


@query(r"isbn:i num_words:i", r"SELECT isbn, greatest(len(regexp_extract_all(comments, '\W+')), 1) + 1 AS num_words FROM descriptions")
def word_count(f):
    return X.clean_descriptions(f.descriptions).withColumn("num_words", TX.word_count("comments"))


@query("n:i gram count:i", "SELECT * FROM top_grams")
def ngram_counts(f):
    """The sixty most frequent runs of two and of three words."""
    return X.gram_counts(f.cleaned, 2, 60).unionByName(X.gram_counts(f.cleaned, 3, 60))


@query("n:i gram count:i", "SELECT * FROM top_grams")
def frequent_grams(f):
    """The rows of `ngram_counts` by summaries of each task and an exact count of what they leave."""
    return X.frequent_grams(f.cleaned, 2, 60).unionByName(X.frequent_grams(f.cleaned, 3, 60))


@query(
    "isbn:i seller phrase_count:i informative:i phrases",
    """WITH listed AS (SELECT DISTINCT gram FROM (SELECT n, gram, count(*) AS count FROM all_grams GROUP BY n, gram
                       QUALIFY row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, gram) <= 1000)),
            held AS (SELECT isbn, gram FROM descriptions JOIN listed ON contains(comments, gram)),
            lists AS (SELECT isbn, count(*) AS n, string_agg(gram, '|' ORDER BY gram) AS phrases FROM held GROUP BY isbn)
       SELECT isbn, seller, coalesce(n, 0) AS phrase_count, CASE WHEN n > 0 THEN 1 ELSE 0 END AS informative,
              coalesce(phrases, '') AS phrases FROM descriptions LEFT JOIN lists USING (isbn)""",
)
def phrase_search(f):
    """A list of the 1000 most frequent runs of two and of three words, searched in every description at once."""
    grams = X.frequent_grams(f.cleaned, 2, 1000).unionByName(X.frequent_grams(f.cleaned, 3, 1000))
    return search_phrases(f.cleaned, grams).withColumn("phrases", F.array_join("phrases", "|"))


@query(
    "isbn:i seller phrase_count:i informative:i phrases",
    "SELECT isbn, seller, phrase_count, informative, phrases FROM phrase_hits",
)
def phrase_usage(f):
    used = X.phrase_usage(f.cleaned, stage(f.phrases, "phrases"))
    return used.withColumn("phrases", F.array_join("phrases", "|"))


@query("isbn:i seller repeat_comment:i", "SELECT * FROM repeats")
def text_repeat(f):
    return X.with_repeats(X.clean_descriptions(f.descriptions))


@query(
    "seller repeat_comment:i informative:i listing:i pct_generic:f pct_informative:f",
    """SELECT *, repeat_comment / nullif(listing, 0) AS pct_generic, informative / nullif(listing, 0) AS pct_informative
       FROM (SELECT r.seller, sum(repeat_comment) AS repeat_comment, sum(informative) AS informative, count(*) AS listing
             FROM repeats r JOIN phrase_hits h ON r.isbn = h.isbn GROUP BY r.seller)""",
)
def seller_text_profile(f):
    return X.seller_text_profile(X.phrase_usage(f.cleaned, stage(f.phrases, "phrases")))


def events_stream(f):
    return jobs.file_stream(f.spark, f.sf_dir, f.table("events").schema, glob="events.parquet")


def _checkpoint(f, label):
    return scratch_path(f.spark, f"{label}-checkpoint")


@query(
    "dateacc:d isbn seller:i event_id:i value:f",
    "SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY dateacc, isbn, seller ORDER BY ts, event_id) = 1",
)
def stream_snapshot_ingest(f):
    keyed = store.KeyedStore(f.spark, scratch_path(f.spark, "ingest"), f.snapshots.schema, ("dateacc", "isbn", "seller"))
    stream = events_stream(f).select(
        F.to_date("ts").alias("dateacc"), F.col("event_type").alias("isbn"), F.col("user_id").alias("seller"), "ts", "event_id", "value"
    )
    jobs.keyed_ingest(stream, keyed, ["ts", "event_id"], _checkpoint(f, "ingest")).awaitTermination()
    return keyed.read()


def tick_stream(events):
    return events.select(
        F.col("user_id").alias("seller"), F.col("event_type").alias("isbn"), "ts", "event_id",
        (F.floor(F.col("value") / 10) * 10).cast("double").alias("price2"),
    )


def weekly_counts(f, stream, label):
    """Run the weekly mean over a tick stream and read its closed windows."""
    path = scratch_path(f.spark, label)
    weekly = jobs.weekly_mean(stream.withColumn("at", instant("ts")), ["isbn"], "price2", "at", "1 day")
    schema = weekly.schema
    jobs.append_files(weekly, path, _checkpoint(f, label)).awaitTermination()
    closed = f.spark.read.schema(schema).parquet(path)
    return closed.withColumns({"week_start": F.to_date(wall_clock("week_start")), "week_end": F.to_date(wall_clock("week_end"))})


@query(
    "isbn week_start:d week_end:d avg_price2:f quotes:i",
    """SELECT isbn, week_start, week_start + INTERVAL 7 DAY AS week_end, avg(price2) AS avg_price2, count(*) AS quotes
       FROM (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week_start FROM ticks)
       GROUP BY isbn, week_start
       HAVING week_start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM ticks)""",
)
def stream_weekly_mean(f):
    """Windows the watermark has closed: the last one stays open, on both sides."""
    return weekly_counts(f, tick_stream(events_stream(f)), "weekly-mean")


@query(
    "seller:i isbn ts event_id:i price2:f price2_prev:f price2_change:f",
    """SELECT seller, isbn, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id, price2, before AS price2_prev, price2 - before AS price2_change
       FROM (SELECT *, lag(price2) OVER (PARTITION BY seller, isbn ORDER BY ts, event_id) AS before FROM ticks) WHERE price2 <> before""",
)
def stream_price_changes(f):
    path = scratch_path(f.spark, "changes")
    changes = jobs.price_changes(tick_stream(events_stream(f)), ["seller", "isbn"], ["ts", "event_id"], "price2")
    schema = changes.schema
    jobs.append_files(changes, path, _checkpoint(f, "changes")).awaitTermination()
    found = f.spark.read.schema(schema).parquet(path)
    return found.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _arrivals(f, path, pieces):
    """Write each piece to a folder of its own, as many files as Spark makes of it, and yield after each."""
    for k, piece in enumerate(pieces):
        piece.write.parquet(f"{path}/{k}")
        yield jobs.file_stream(f.spark, f"{path}/*", piece.schema)


DELAY = 86400


@query(
    "seller:i isbn ts event_id:i price2:f price2_prev:f price2_change:f",
    """SELECT seller, isbn, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id, price2, before AS price2_prev, price2 - before AS price2_change
       FROM (SELECT *, lag(price2) OVER w AS before, lag(ts) OVER w AS seen FROM ticks WINDOW w AS (PARTITION BY seller, isbn ORDER BY ts, event_id))
       WHERE price2 <> before AND ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM ticks) AND ts - seen <= INTERVAL 14 DAY""",
)
def stream_ordered_changes(f):
    """Changes in order of event time, though every quote arrives up to a day late and the arrivals come in three runs."""
    path, source, checkpoint = scratch_path(f.spark, "changes"), scratch_path(f.spark, "arrivals"), _checkpoint(f, "changes")
    seconds = F.unix_micros(instant("ts")) / 1e6
    late = stage(f.ticks.withColumn("arrival", seconds + F.pmod(F.xxhash64("event_id"), F.lit(DELAY))), "ticks")
    low, high = (r["quantile"] for r in exact_quantiles(late, ["arrival"], [1 / 3, 2 / 3]).orderBy("prob").collect())
    third = F.when(F.col("arrival") < low, 0).when(F.col("arrival") < high, 1).otherwise(2)
    for stream in _arrivals(f, source, [late.filter(third == k).drop("arrival") for k in range(3)]):
        changes = jobs.ordered_price_changes(stream, ["seller", "isbn"], "ts", ["event_id"], "price2", f"{DELAY} seconds", 14 * DELAY)
        jobs.append_files(changes, path, checkpoint).awaitTermination()
    return f.spark.read.schema(changes.schema).parquet(path).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "isbn week_start:d quotes:i kept:i late:i",
    """SELECT isbn, CAST(week AS DATE) AS week_start, count(*) AS quotes, count(*) FILTER (WHERE CAST(ts AS DATE) >= cut) AS kept,
              count(*) FILTER (WHERE CAST(ts AS DATE) < cut) AS late
       FROM (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week FROM ticks),
            (SELECT CAST(make_timestamp(CAST(quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 2 / 3.0) AS BIGINT)) AS DATE) AS cut, max(ts) AS last FROM ticks)
       WHERE week + INTERVAL 7 DAY <= last - INTERVAL 1 DAY GROUP BY isbn, week""",
)
def stream_late_drop(f):
    """The month arrives backwards, a third of the quotes in each run; the weeks that the newest third closes lose the rest."""
    source, path, checkpoint = scratch_path(f.spark, "arrivals"), scratch_path(f.spark, "late"), _checkpoint(f, "late")
    ticks = f.ticks
    micros = ticks.select(F.unix_micros(instant("ts")).cast("double").alias("us"))
    days = [F.to_date(wall_clock(F.timestamp_micros(F.lit(int(r["quantile"])))))
            for r in exact_quantiles(micros, ["us"], [1 / 3, 2 / 3]).orderBy("prob").collect()]
    date = F.to_date("ts")
    for stream in _arrivals(f, source, [ticks.filter(date >= days[1]), ticks.filter((date >= days[0]) & (date < days[1])), ticks.filter(date < days[0])]):
        weekly = jobs.weekly_mean(stream.withColumn("at", instant("ts")), ["isbn"], "price2", "at", "1 day")
        jobs.append_files(weekly, path, checkpoint).awaitTermination()
    kept = f.spark.read.schema(weekly.schema).parquet(path).withColumn("week_start", F.to_date(wall_clock("week_start")))
    week = F.window(instant("ts"), "7 days")
    last = ticks.agg(F.max(instant("ts"))).scalar()
    closed = ticks.withColumn("week", week).filter(F.col("week.end") <= last - F.expr("INTERVAL 1 DAY"))
    return jobs.late_counts(closed.withColumn("week_start", F.to_date(wall_clock("week.start"))), kept, ["isbn", "week_start"])
