"""The tagger as the query trains it: spans in other forms whose values it has not seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricepanel.llm import personal_data, tables

SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def passages_of(spark, folder, sample=personal_data.SAMPLE):
    return personal_data.labelled_passages(tables.texts(tables.table(spark, folder, "documents")), sample)


@pytest.fixture(scope="module")
def learnt(spark):
    passages = passages_of(spark, SMALL)
    return personal_data.fit(passages), {p[a:b] for p, spans in passages for _, a, b in spans}


def test_spans_in_other_forms_are_found(spark, learnt):
    tagger, known = learnt
    rng = np.random.default_rng(5)
    cases = []
    for passage, spans in passages_of(spark, LARGE, 5000):
        for kind, a, b in spans:
            value = passage[a:b]
            if value in known:
                continue
            bare = "".join(chr(97 + int(rng.integers(0, 26))) if c.isdigit() else c for c in value)
            values = [(kind, v) for v in personal_data.forms(kind, value)] + [("bare", v) for v in personal_data.forms(0, bare) if kind == 0]
            for name, v in values:
                text = passage[:a] + v + passage[b:]
                if not any(x < a + len(v) and a < y for _, x, y in personal_data.fixed_spans(text)):
                    cases.append((name, text, (kind, a, a + len(v))))
    found = personal_data.tag_texts(tagger, [text for _, text, _ in cases])
    for name in (0, 1, 2, 3, "bare"):
        hits = [span in spans for (kind, _, span), spans in zip(cases, found) if kind == name]
        assert len(hits) > 300 and np.mean(hits) >= 0.9, (name, np.mean(hits))


def test_added_spans_reach_the_result(spark, learnt):
    tagger, _ = learnt
    docs = tables.texts(tables.table(spark, SMALL, "documents"))
    value = "on.ther (at) mail (dot) example (dot) com"
    planted = docs.where("length(text) between 200 and 2000 and not text rlike '[0-9@]'").select(
        (F.col("doc_id") + 10_000_000).alias("doc_id"), F.concat(F.substring("text", 1, 150), F.lit(f" {value} "), F.col("text")).alias("text")
    )
    n = planted.count()
    got = personal_data.find(planted, tagger)
    assert n > 50 and got.where(F.expr(f"spans = 'email:151:{151 + len(value)}' and n_added = 1")).count() >= 0.9 * n
    # nothing is added to the given documents, which hold no other form
    assert personal_data.find(docs, tagger).where("n_added > 0").count() <= 0.002 * docs.count()


def test_empty_table_adds_nothing(docs_of):
    docs = tables.texts(docs_of((1, "a")).where("false"))
    tagger = personal_data.fit(personal_data.labelled_passages(docs))
    assert tagger is None and personal_data.find(docs, tagger).count() == 0
