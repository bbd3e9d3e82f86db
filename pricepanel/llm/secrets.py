"""Secrets in texts, judged by how many owners and repositories hold the same value.

Every text is searched for three kinds of candidates. Their values are hashed, and
the whole corpus says for each hash in how many distinct repositories and of how many
distinct owners it stands. A value of several owners is a copied example; a value
of one owner that looks random is taken to be live.

Counts are distinct counts that combine before the shuffle, so a value that stands in
a third of all rows reaches the count as a few rows for each task. The verdicts are
joined back to the candidates; adaptive execution splits a hot value there.

Defined results: null text is empty; null owners and repositories count as one
unnamed; rows with equal or null doc_id are rows of their own; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricepanel.llm import tables
from pricepanel.session import stage

KINDS = ("assign", "access", "hex")
#: The searched forms; a match counts from the stated length of its value on.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LENGTH = 8
# a run of the class counts from its length on, so the length can stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A value of this many owners or more is a copied example.
SHARED_OWNERS = 3
#: Bits for each character from which a value looks random, and words of placeholders.
ENTROPY = 2.5
PLACEHOLDER = re.compile(r"example|changeme|placeholder|your|dummy|sample|xxxx|1234567|abcdef|test", re.IGNORECASE)
MASK = "[SECRET]"


def candidates(text: str) -> list[tuple[int, int, int, int, str]]:
    """Kind, start and end of each match, where its value starts, and the value; by start, then kind."""
    found = [(0, m.start(), m.end(), m.start(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m.start(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda c: (c[1], c[0]))


def digest(value: str) -> bytes:
    return hashlib.sha256(value.encode()).digest()[:16]


def looks_random(value: str) -> bool:
    n = len(value)
    bits = sum(-k / n * math.log2(k / n) for k in Counter(value).values())
    return bits >= ENTROPY and bool(re.search("[0-9]", value)) and not PLACEHOLDER.search(value)


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document with its base columns and its candidates (kind, start, end, digest, random)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary()), ("random", pa.bool_())]))
        for batch in batches:
            spans, hashes, counts, found = [], [], [], []
            for text in batch.column("text"):
                here = candidates(text.as_py())
                joined = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _, _ in here)
                spans.append(joined)
                hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                counts.append([sum(c[0] == k for c in here) for k in range(3)])
                found.append([{"kind": k, "start": a, "end": b, "digest": digest(v), "random": looks_random(v)} for k, a, b, _, v in here])
            yield pa.record_batch([
                tables.row_numbers(task, before, batch.num_rows), batch.column("doc_id"), batch.column("owner"), batch.column("repository"),
                *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(found, kind),
            ], ["row_id", "doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])
            before += batch.num_rows

    source = tables.texts(docs.withColumns({"_owner": owner, "_repository": repository}), "_owner", "_repository").select(
        "doc_id", "text", F.coalesce("_owner", F.lit("")).alias("owner"), F.coalesce("_repository", F.lit("")).alias("repository")
    )
    return source.mapInArrow(rows, (
        "row_id long, doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "spans string, found array<struct<kind:int,start:int,end:int,digest:binary,random:boolean>>"
    ))


def ownership(found: DataFrame) -> DataFrame:
    """For each value: the distinct repositories and owners that hold it, and the verdict."""
    counts = found.groupBy("digest").agg(
        F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"), F.bool_or("random").alias("random")
    )
    verdict = F.when(F.col("n_owners") >= SHARED_OWNERS, "shared").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("unclear")
    return counts.withColumn("verdict", verdict)


def each_candidate(scanned: DataFrame) -> DataFrame:
    return scanned.select("row_id", "doc_id", "owner", "repository", F.explode("found").alias("one")).select(
        "row_id", "doc_id", "owner", "repository", "one.*"
    )


def judged(scanned: DataFrame) -> DataFrame:
    """The scanned rows (a written table) with the numbers of their live and shared values and the live spans."""
    found = each_candidate(scanned)
    known = found.join(ownership(found).select("digest", "verdict", "n_repositories"), "digest")
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.concat_ws(":", names, F.col("start").cast("string"), F.col("end").cast("string"))
    live = F.when(F.col("verdict") == "live", F.struct("start", "kind", span.alias("span")))
    marks = known.groupBy("row_id").agg(
        F.sum((F.col("verdict") == "live").cast("long")).alias("n_live"), F.sum((F.col("verdict") == "shared").cast("long")).alias("n_shared"),
        F.max("n_repositories").alias("max_repositories"), F.sort_array(F.collect_list(live)).alias("live"),
    )
    zero = F.lit(0).cast("long")
    return scanned.join(marks, "row_id", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans",
        *(F.coalesce(c, zero).alias(c) for c in ("n_live", "n_shared", "max_repositories")),
        F.coalesce(F.concat_ws(",", F.transform("live", lambda x: x["span"])), F.lit("")).alias("live_spans"),
    )


def mask_live(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """The documents with every live value replaced by a mark, and ``n_chars`` counted again; all other text stays."""
    found = each_candidate(stage(scan(docs, owner, repository), "secrets"))
    live = found.join(ownership(found).where("verdict = 'live'").select("digest"), "digest")
    asked = live.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("digest").alias("_live"))
    columns = docs.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("_live").to_pylist()):
                if text and marks:
                    marks, spans = set(marks), []
                    for _, _, end, start, value in candidates(text):
                        if digest(value) in marks:
                            if spans and start < spans[-1][1]:
                                spans[-1][1] = max(end, spans[-1][1])
                            else:
                                spans.append([start, end])
                    for start, end in reversed(spans):
                        text = text[:start] + MASK + text[end:]
                texts.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).select(columns)

    joined = docs.join(asked, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    out = joined.mapInArrow(replace, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def source_names() -> tuple[Column, Column]:
    """Owner and repository of a row of ``documents``: its source, and the source's part in one language."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return judged(stage(scan(tables.table(spark, sf_dir, "documents"), *source_names()), "secrets"))
