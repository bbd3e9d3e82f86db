"""The registered queries of the training-data operators and the pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from check_oracle import normal
from pricepanel.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op6_benchmark_decontamination", "op7_token_counts", "op3_preference_formatting", "op11_embedding_links")])
def test_query_answers_for_every_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = QUERIES[name](spark, DATA)
    assert got.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("name", ORACLES)
def test_spark_and_duckdb_agree(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    assert normal(QUERIES[name](spark, DATA).toPandas()) == normal(con.execute(ORACLES[name]).fetchdf())


def test_decontamination_finds_exact_passages(spark):
    con = duckdb.connect()
    want = con.execute(
        f"SELECT doc_id, item_id FROM '{DATA}/documents.parquet' d JOIN '{DATA}/benchmark.parquet' b ON contains(d.text, b.text)"
    ).fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_benchmark_decontamination"](spark, DATA).collect()}
    assert set(want) <= got


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    table, sizes = docs, [docs.count()]
    from pricepanel.session import stage

    for name, apply in corpus_pipeline.STAGES[:-1]:
        table = stage(apply(spark, table, DATA), name)
        assert table.columns == docs.columns
        sizes.append(table.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] // 2 and sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, table, DATA)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
