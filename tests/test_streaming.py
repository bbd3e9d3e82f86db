"""Streams replayed from files in several micro-batches against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows
from pricepanel.operators.cleaning import first_by
from pricepanel.session import scratch_path
from pricepanel.sources import sinks
from pricepanel.streaming import instant, jobs, wall_clock

TICK = "seller long, isbn string, ts timestamp_ntz, event_id long, price2 double"


@pytest.fixture(scope="module")
def ticks(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = [
        (rng.randrange(4), rng.choice("xy"), start + dt.timedelta(minutes=rng.randrange(60 * 24 * 28)), n, float(rng.choice([1, 2, 3])))
        for n in range(400)
    ]
    return spark.createDataFrame(data, TICK)


def replay(spark, ticks, cuts, files_per_batch=1):
    """Write the ticks as one file per span between the cuts, in order, and stream them."""
    path = scratch_path(spark, "replay")
    bounds = [dt.datetime(2023, 1, 1), *cuts, dt.datetime(2025, 1, 1)]
    for lo, hi in zip(bounds, bounds[1:]):
        ticks.filter((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, ticks.schema, files_per_batch=files_per_batch)


CUTS = [dt.datetime(2024, 1, 6, 13), dt.datetime(2024, 1, 20)]


def test_ingest_over_batches_equals_first_write(spark, ticks):
    path = scratch_path(spark, "ingest")
    dated = lambda df: df.withColumn("dateacc", F.to_date("ts"))
    schema = dated(ticks).schema
    keys = ["dateacc", "isbn", "seller"]
    sinks.create_store(spark, path, schema, ["dateacc"])
    jobs.snapshot_ingest(dated(replay(spark, ticks, CUTS)), path, schema, keys, ["ts", "event_id"], scratch_path(spark, "c"), day="dateacc").awaitTermination()
    got = spark.read.schema(schema).parquet(path)
    want = first_by(dated(ticks), keys, ["ts", "event_id"])
    assert rows(got.select(*want.columns), *keys) == rows(want, *keys)
    assert got.count() == got.select(*keys).distinct().count()


def test_price_changes_over_batches_equal_the_batch_lag(spark, ticks):
    path = scratch_path(spark, "changes")
    changes = jobs.price_changes(replay(spark, ticks, CUTS), ["seller", "isbn"], ["ts", "event_id"], "price2")
    schema = changes.schema
    jobs.append_files(changes, path, scratch_path(spark, "c")).awaitTermination()
    w = Window.partitionBy("seller", "isbn").orderBy("ts", "event_id")
    want = ticks.withColumn("price2_prev", F.lag("price2").over(w)).withColumn("price2_change", F.col("price2") - F.col("price2_prev")).filter("price2_change <> 0")
    got = spark.read.schema(schema).parquet(path)
    assert rows(got.select(*sorted(got.columns)), "event_id") == rows(want.select(*sorted(got.columns)), "event_id")


def arrivals(spark, path, ticks, delay, parts, only=None):
    """Write ticks by time of arrival, which lies up to ``delay`` after their own, a folder of several files for each part."""
    late = ticks.withColumn("arrival", F.unix_micros(instant("ts")) / 1e6 + F.pmod(F.xxhash64("event_id"), F.lit(delay)))
    lo, hi = late.agg(F.min("arrival"), F.max("arrival")).first()
    place = F.least(F.floor((F.col("arrival") - lo) / ((hi - lo) / parts)), F.lit(parts - 1))
    for k in only or range(parts):
        late.filter(place == k).drop("arrival").coalesce(1).write.mode("append").parquet(path)


def ordered(spark, source, ticks, out, checkpoint, idle=10**9):
    stream = jobs.file_stream(spark, source, ticks.schema, files_per_batch=1)
    changes = jobs.ordered_price_changes(stream, ["seller", "isbn"], "ts", ["event_id"], "price2", "2 days", idle)
    query = jobs.append_files(changes, out, checkpoint)
    query.awaitTermination()
    return query, spark.read.schema(changes.schema).parquet(out)


def lagged(ticks, until=None, idle=10**9):
    w = Window.partitionBy("seller", "isbn").orderBy("ts", "event_id")
    gap = F.unix_micros(instant("ts")) - F.lag(F.unix_micros(instant("ts"))).over(w)
    prev = F.when(gap <= idle * 10**6, F.lag("price2").over(w))
    want = ticks.withColumns({"price2_prev": prev, "price2_change": F.col("price2") - prev}).filter("price2_change <> 0")
    return want if until is None else want.filter(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))


def same_rows(got, want):
    return rows(got.select(*sorted(want.columns)), "event_id") == rows(want.select(*sorted(want.columns)), "event_id")


def test_changes_of_shuffled_arrivals_equal_the_batch_lag_across_a_restart(spark, ticks):
    source, out, checkpoint = (scratch_path(spark, label) for label in ("arrivals", "ordered", "c"))
    parts, last = 5, ticks.agg(F.max("ts")).first()[0]
    arrivals(spark, source, ticks, 2 * 86400, parts, only=range(3))
    _, early = ordered(spark, source, ticks, out, checkpoint)
    seen = early.count()
    arrivals(spark, source, ticks, 2 * 86400, parts, only=range(3, parts))
    _, found = ordered(spark, source, ticks, out, checkpoint)
    assert 0 < seen < found.count()
    assert same_rows(found, lagged(ticks, last - dt.timedelta(days=2)))


def test_idle_pairs_start_anew_and_their_state_ends(spark, ticks):
    source, out, checkpoint = (scratch_path(spark, label) for label in ("arrivals", "ordered", "c"))
    more = spark.createDataFrame([(9, "z", dt.datetime(2024, 6, 1), 9000, 1.0), (9, "z", dt.datetime(2024, 6, 1, 1), 9001, None), (9, "z", dt.datetime(2024, 6, 20), 9002, 4.0)], TICK)
    every = ticks.unionByName(more)
    arrivals(spark, source, ticks, 2 * 86400, 3)
    for k in (9000, 9001, 9002):
        more.filter(F.col("event_id") == k).coalesce(1).write.mode("append").parquet(source)
    query, found = ordered(spark, source, every, out, checkpoint, idle=86400)
    assert same_rows(found, lagged(ticks, idle=86400))
    # only the pair seen last has state: a waiting row and a timer with its index
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_many_pairs_share_few_states_and_keep_apart(spark):
    """State and calls follow the buckets, not the pairs; null keys and ties make pairs and places of their own."""
    start, rng = dt.datetime(2024, 1, 1), random.Random(4)
    kind = "seller long, isbn string, ts timestamp_ntz, event_id long, tie int, price2 double"
    data = [
        (rng.choice([None, 0, *range(40)]), rng.choice([None, "", "x"]), start + dt.timedelta(hours=rng.randrange(24 * 9)), n, rng.choice([None, 1, 2**30]), rng.choice([None, 1.0, 2.0]))
        for n in range(1500)
    ]
    every, (source, out, checkpoint) = spark.createDataFrame(data, kind), (scratch_path(spark, label) for label in ("arrivals", "ordered", "c"))
    arrivals(spark, source, every, 2 * 86400, 3)
    stream = jobs.file_stream(spark, source, every.schema, files_per_batch=1)
    changes = jobs.ordered_price_changes(stream, ["seller", "isbn"], "ts", ["tie", "event_id"], "price2", "2 days", 10**9, buckets=7)
    query = jobs.append_files(changes, out, checkpoint)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 7
    w = Window.partitionBy("seller", "isbn").orderBy("ts", F.asc_nulls_last("tie"), "event_id")
    want = every.filter("price2 IS NOT NULL").withColumn("price2_prev", F.lag("price2").over(w)).withColumn("price2_change", F.col("price2") - F.col("price2_prev"))
    last = every.agg(F.max("ts")).first()[0]
    want = want.filter("price2_change <> 0").filter(F.col("ts") <= F.lit(last - dt.timedelta(days=2)).cast("timestamp_ntz"))
    assert changes.schema.names == ["seller", "isbn", "ts", "tie", "event_id", "price2", "price2_prev", "price2_change"]
    assert want.count() > 300 and same_rows(spark.read.schema(changes.schema).parquet(out), want)


def weekly(spark, stream):
    path = scratch_path(spark, "weekly")
    means = jobs.weekly_mean(stream.withColumn("at", instant("ts")), ["isbn"], "price2", "at", "1 day")
    schema = means.schema
    jobs.append_files(means, path, scratch_path(spark, "c")).awaitTermination()
    return spark.read.schema(schema).parquet(path).withColumn("week_start", wall_clock("week_start"))


def test_closed_weeks_equal_the_batch_means(spark, ticks):
    got = weekly(spark, replay(spark, ticks, CUTS))
    want = ticks.groupBy(wall_clock(F.window(instant("ts"), "7 days").getField("start")).alias("week_start"), "isbn").agg(
        F.avg("price2").alias("avg_price2"), F.count(F.lit(1)).alias("quotes")
    )
    last = ticks.agg(F.max("ts")).first()[0]
    closed = want.filter(F.col("week_start") <= F.lit(last - dt.timedelta(days=8)).cast("timestamp_ntz"))
    order = ("week_start", "isbn")
    assert rows(got.select(*closed.columns), *order) == rows(closed, *order)


def test_late_quotes_are_counted_and_not_merged(spark, ticks):
    late_first = ticks.withColumn("ts", F.when(F.col("event_id") < 200, F.col("ts")).otherwise(F.lit(dt.datetime(2024, 2, 20)).cast("timestamp_ntz")))
    path = scratch_path(spark, "late")
    for part in (late_first.filter("event_id >= 300"), late_first.filter("event_id BETWEEN 200 AND 299"), late_first.filter("event_id < 200")):
        part.coalesce(1).write.mode("append").parquet(path)
    kept = weekly(spark, jobs.file_stream(spark, path, ticks.schema, files_per_batch=1))
    every = late_first.withColumn("week_start", wall_clock(F.window(instant("ts"), "7 days").getField("start")))
    counts = rows(jobs.late_counts(every, kept, ["isbn", "week_start"]))
    assert sum(r["late"] for r in counts if r["week_start"] < dt.datetime(2024, 2, 1)) == 200


def test_repeats_within_the_watermark_are_dropped(spark, ticks):
    stream = replay(spark, ticks.unionByName(ticks), [])
    once = jobs.deduplicated(stream.withColumn("at", instant("ts")), ["event_id"], "at", "60 days").select("event_id")
    path = scratch_path(spark, "once")
    jobs.append_files(once, path, scratch_path(spark, "c")).awaitTermination()
    assert spark.read.parquet(path).count() == ticks.count()


def test_instants_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-04 00:00:00' AS t")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seconds, back = df.select(F.unix_seconds(instant("t")), wall_clock(instant("t"))).first()
            assert seconds == 1704326400 and back == dt.datetime(2024, 1, 4)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
