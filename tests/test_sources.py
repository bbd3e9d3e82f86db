"""Readers, page extraction and write-once sinks."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import day, rows
from pricepanel import schemas
from pricepanel.session import scratch_path, shared_folder, stage
from pricepanel.sources import pages, sinks, tables

BLOCK = """<tbody class="result"><tr><td><span class="price">$1,012.50</span> <span class="price_shipping"> + $3.99 </span>
<div class="condition"> Used - Good </div><div class="seller"><b>Seller:</b> <a href="x">Books: and more</a></div>
<div class="rating"><b>95%</b> positive. (1,234 total ratings)</div><div class="availability">In Stock. Ships from NJ, United States. Fast</div>
<div class="comments">Clean
copy</div></td></tr></tbody>"""
ANCHOR_BLOCK = '<tbody class="result"><img alt="A"/><span class="price">$9.00</span><div class="condition">New</div></tbody>'
NEW_BLOCK = '<tbody class="result"><span class="price">$5.00</span><div class="seller">Seller: n</div><div class="rating">Just Launched</div><div class="fba_link">F</div><div class="availability">In Stock.</div></tbody>'
ONE_BLOCK = '<tbody class="result"><span class="price">$6.00</span><div class="seller">Seller: o</div><div class="rating">100% (1 rating)</div></tbody>'
BARE_BLOCK = '<tbody class="result"><span class="price">$7.00</span><div class="seller">Seller: p</div></tbody>'


def test_listing_blocks_become_rows(spark):
    df = spark.createDataFrame([("01", 0, f"<table>{BLOCK}{ANCHOR_BLOCK}{NEW_BLOCK}{ONE_BLOCK}{BARE_BLOCK}</table>")], "isbn string, used int, html string")
    full, anchor, new, one, bare = rows(pages.page_listings(df, "A"), "pos")
    assert full["price"] == 1012.5 and full["shipping"] == 3.99 and full["condition"] == "Used - Good"
    assert (full["seller"], full["rating"], full["numrating"], full["fba"]) == ("Books", "95%", "1,234", 0)
    assert full["shipsfrom"] == "NJ, United States" and full["comments"] == "Clean\ncopy"
    assert (anchor["seller"], anchor["rating"], anchor["numrating"], anchor["fba"], anchor["shipping"]) == ("A", None, None, 1, 0.0)
    assert (new["rating"], new["numrating"], new["fba"], new["shipping"], new["shipsfrom"]) == (None, "0", 1, 0.0, None)
    assert (one["rating"], one["numrating"], one["shipping"]) == ("100%", "1", None)
    assert (bare["rating"], bare["numrating"], bare["comments"]) == (None, None, None)


def test_nested_elements_end_at_their_own_tag(spark):
    block = '<tbody class="result"><div class="comments">first <div>inner <div>deep</div></div> second<span>!</span></div><div class="condition">New</div></tbody>'
    broken = '<tbody class="result"><div class="comments">open <div>never closed</div><span class="price">$1.00</span></tbody>'
    df = spark.createDataFrame([(block + broken,)], "html string")
    whole, cut = rows(pages.page_listings(df, "A"), "pos")
    assert (whole["comments"], whole["condition"]) == ("first inner deep second!", "New")
    assert (cut["comments"], cut["price"]) == ("open never closed", 1.0)


def test_profile_page(spark):
    html = '<div id="priceBlock"><span class="priceLarge">$12.30</span></div> 4.0 out of 5 stars <h2>Product Details</h2><ul>{}</ul>'
    full = html.format("4.5 out of 5 stars (27 customer reviews) #1,234,567 in Books")
    df = spark.createDataFrame([("a", full), ("b", "<p>gone</p>")], "isbn string, html string")
    a, b = rows(pages.page_profile(df), "isbn")
    assert (a["currprice"], a["rating"], a["reviews"], a["rank"]) == (12.3, 4.5, 27, 1234567)
    assert {b[c] for c in ("currprice", "rating", "reviews", "rank")} == {None}


def test_position_runs_over_the_pages_of_an_item(spark):
    df = spark.createDataFrame([("x", 2, 1), ("x", 1, 1), ("x", 1, 2), ("x", 9, 1), ("y", 1, 1)], "item string, page int, pos int")
    got = rows(pages.paged_position(df, "item", "page"), "item", "position")
    assert [(r["item"], r["page"], r["pos"], r["position"]) for r in got] == [
        ("x", 1, 1, 1), ("x", 1, 2, 2), ("x", 2, 1, 3), ("x", 9, 1, 4), ("y", 1, 1, 1)
    ]


def test_csv_keeps_leading_zeros_and_reads_na_as_null(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([("2012-01-01", "007", 3, None, 0, 1.5), ("2012-01-02", "08", None, 4.5, 1, None)], schemas.PROFILES.names[0] + " string, isbn string, reviews int, rating double, rank int, currprice double")
    sinks.write_csv(df, path)
    assert rows(tables.read_csv(spark, path, schemas.PROFILES), "isbn") == rows(df, "isbn")
    text = "".join(r.value for r in spark.read.text(path).collect())
    assert "NA" in text


def test_positional_and_quoted_append(spark):
    path = scratch_path(spark, "quoted")
    a = spark.createDataFrame([("Fiction", '00"1')], schemas.BESTSELLERS)
    sinks.append_quoted(a, path)
    sinks.append_quoted(spark.createDataFrame([("Trade, paper", None)], schemas.BESTSELLERS), path)
    got = rows(tables.read_positional(spark, path, schemas.BESTSELLERS), "display_name")
    assert [(r["display_name"], r["isbn"]) for r in got] == [("Fiction", '00"1'), ("Trade, paper", None)]


XML = """<results><book><list_name>L</list_name><display_name>Fic</display_name><rank>1</rank>
<isbns><isbn><isbn10>9</isbn10></isbn></isbns><book_details><book_detail><title>One</title><description>d</description>
<author></author><price>12.5</price><primary_isbn10>0012</primary_isbn10></book_detail></book_details><reviews/></book>
<book><list_name>L</list_name><display_name>Fic</display_name><rank>2</rank><book_details><book_detail><title>Two</title>
<author>B &amp; C</author></book_detail></book_details></book></results>"""


def test_xml_files_give_one_row_per_book(spark):
    path = scratch_path(spark, "xml")
    spark.createDataFrame([(XML,)], "value string").coalesce(1).write.text(path)
    one, two = rows(tables.read_books(spark, path), "rank")
    assert (one["title"], one["author"], one["price"], one["primary_isbn10"]) == ("One", None, 12.5, "0012")
    assert (two["author"], two["price"], two["list_name"]) == ("B & C", None, "L")
    assert "description" not in one and "isbns" not in one


def test_lists_carry_the_name_of_their_folder(spark):
    root = scratch_path(spark, "lists")
    for name, isbn in (("trade fiction", "1"), ("graphic", "2")):
        spark.createDataFrame([(isbn,)], "isbn string").write.csv(f"{root}/{name}", header=True)
    got = rows(tables.read_lists(spark, root, "isbn string"), "isbn")
    assert [(r["isbn"], r["list_name"]) for r in got] == [("1", "trade fiction"), ("2", "graphic")]


def test_worklist_is_a_repeatable_permutation(spark):
    items = spark.range(200)
    one = [r["id"] for r in tables.shuffled_worklist(items, "id", 1).collect()]
    assert one == [r["id"] for r in tables.shuffled_worklist(items, "id", 1).collect()]
    assert sorted(one) == list(range(200)) and one != sorted(one)
    assert one != [r["id"] for r in tables.shuffled_worklist(items, "id", 2).collect()]


SNAPSHOT = "dateacc date, isbn string, seq int"


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("xy")), min_size=1, max_size=6), min_size=1, max_size=3))
def test_insert_ignore_keeps_the_first_write(spark, batches):
    schema = spark.createDataFrame([], SNAPSHOT).schema
    path = scratch_path(spark, "store")
    sinks.create_store(spark, path, schema, ["dateacc"])
    want, seq = {}, 0
    for batch in batches:
        data = []
        for d, isbn in batch:
            data.append((day(d), isbn, seq))
            want.setdefault((day(d), isbn), seq)
            seq += 1
        for _ in range(2):  # a repeated batch changes nothing
            sinks.insert_ignore(spark.createDataFrame(data, SNAPSHOT), path, schema, ["dateacc", "isbn"], ["seq"], day="dateacc")
    got = {(r["dateacc"], r["isbn"]): r["seq"] for r in rows(spark.read.schema(schema).parquet(path))}
    assert got == want


def test_null_keys_are_written_once(spark):
    schema = spark.createDataFrame([], SNAPSHOT).schema
    path = scratch_path(spark, "nulls")
    sinks.create_store(spark, path, schema, ["dateacc"])
    batch = spark.createDataFrame([(None, "x", 1), (day(0), None, 2), (None, None, 3), (day(0), "x", 4)], SNAPSHOT)
    for _ in range(3):
        sinks.insert_ignore(batch, path, schema, ["dateacc", "isbn"], ["seq"], day="dateacc")
    assert [r["seq"] for r in rows(spark.read.schema(schema).parquet(path), "seq")] == [1, 2, 3, 4]


def test_insert_reads_only_the_days_of_the_batch(spark):
    schema = spark.createDataFrame([], SNAPSHOT).schema
    path = scratch_path(spark, "pruned")
    spark.createDataFrame([(day(n), "x", n) for n in range(9)], SNAPSHOT).write.partitionBy("dateacc").parquet(path)
    batch = spark.createDataFrame([(day(8), "x", 99), (day(8), "y", 99)], SNAPSHOT)
    fresh = sinks.unseen(batch, spark.read.schema(schema).parquet(path), ["dateacc", "isbn"], ["seq"], day="dateacc")
    assert [r["isbn"] for r in rows(fresh)] == ["y"]
    assert "PartitionFilters: [isnotnull(dateacc" in fresh._jdf.queryExecution().toString()


def test_elements_end_at_their_own_closing_tag_at_any_depth(spark):
    from pricepanel.sources.pages import element_text

    def block(depth, end="</div>"):
        return '<p>x</p><div class="comments">' + "<div a='1'>in " * depth + "</div>out " * depth + f"last{end}<div>other</div>"

    html = [block(0), block(3), block(7), block(40), "<div>none</div>", '<div class="comments"></div>', '<div class="comments"><div>cut</div>', None]
    got = rows(spark.createDataFrame(list(enumerate(html)), "id int, html string").select("id", element_text("html", "div", "comments").alias("text")), "id")
    want = [("in " * d + "out " * d + "last").strip() for d in (0, 3, 7, 40)]
    assert [r["text"] for r in got] == [*want, None, "", "cut", None]


def test_stage_writes_under_the_shared_folder(spark):
    df = stage(spark.range(3), "numbers")
    assert df.inputFiles()[0].removeprefix("file://").startswith(shared_folder(spark))
    assert rows(df, "id") == [{"id": 0}, {"id": 1}, {"id": 2}]


def test_spread_leaves_inputs_with_enough_splits_alone(spark):
    wide = spark.range(100, numPartitions=64)
    assert tables.spread(wide, "id") is wide
    assert tables.spread(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_schemas_name_every_unique_key():
    stores = {"profiles": schemas.PROFILES, "listings": schemas.LISTINGS, "listing_desc": schemas.LISTING_DESC}
    for name, keys in schemas.UNIQUE_KEYS.items():
        assert set(keys) <= set(stores[name].names)
