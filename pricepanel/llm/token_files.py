"""Token ids on disk as Arrow files of equal-length sequences with masks.

A shard is one Arrow IPC file: record batches with two fixed-size-list columns,
``ids`` and ``mask``, of the same length in every row. Ids of consecutive
documents run on from one sequence into the next; the mask is false on the
padding after a shard's last id. Since all rows have one size and nothing is
compressed, sequence i is found by arithmetic, and a memory-mapped file gives it
without a copy. A small companion file lists the documents of the shard.

Shards follow the order of document ids, so shard k holds what comes before
shard k+1. A task writes under a name of its own attempt and renames at the end:
a task that is run again after a lost executor replaces its file by an equal one.

Defined results: null text is empty and gives the end id alone; rows with a null
doc_id come first; rows with equal doc_id follow their text's order; an empty
table gives no shard and no row; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm import tables, tokens
from pricepanel.session import scratch_path, stage

#: Ids per sequence, and sequences per record batch.
SEQUENCE = 2048
BATCH_ROWS = 128
END_ID = 2


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


class SequenceWriter:
    """Writes a stream of ids into equal sequences; holds one record batch at most."""

    def __init__(self, sink, dtype: np.dtype, sequence: int, batch_rows: int):
        self.sequence, self.size = sequence, sequence * batch_rows
        self.kind = pa.list_(pa.from_numpy_dtype(dtype), sequence)
        self.schema = pa.schema([("ids", self.kind), ("mask", pa.list_(pa.bool_(), sequence))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.buffer, self.filled, self.written = np.zeros(self.size, dtype), 0, 0

    def add(self, ids: np.ndarray) -> None:
        while len(ids):
            n = min(len(ids), self.size - self.filled)
            self.buffer[self.filled : self.filled + n] = ids[:n]
            self.filled, ids = self.filled + n, ids[n:]
            if self.filled == self.size:
                self._flush()

    def _flush(self) -> None:
        full = -(-self.filled // self.sequence) * self.sequence
        self.buffer[self.filled : full] = 0
        mask = np.arange(full) < self.filled
        self.writer.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(self.buffer[:full]), self.sequence),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence),
        ], schema=self.schema))
        self.written, self.filled = self.written + self.filled, 0

    def close(self) -> int:
        if self.filled:
            self._flush()
        self.writer.close()
        return self.written


class SequenceFile:
    """Random access to a shard: sequence i, its mask, or any run of ids."""

    def __init__(self, path: str, batch_rows: int = BATCH_ROWS):
        where, name = store(path)
        local = isinstance(where, fs.LocalFileSystem)
        self.source = pa.memory_map(name) if local else where.open_input_file(name)
        self.reader = pa.ipc.open_file(self.source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.batch_rows = batch_rows
        self._at, self._batch = -1, None

    def _of(self, i: int) -> pa.RecordBatch:
        if i // self.batch_rows != self._at:
            self._at = i // self.batch_rows
            self._batch = self.reader.get_batch(self._at)
        return self._batch

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence ``i``."""
        batch, k = self._of(i), i % self.batch_rows
        ids = batch.column(0).flatten().slice(k * self.sequence, self.sequence)
        mask = batch.column(1).flatten().slice(k * self.sequence, self.sequence)
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard on: a view of the file where one batch holds them."""
        width, parts = self.sequence * self.batch_rows, []
        while n > 0:
            batch, at = self._of(start // self.sequence), start % width
            take = min(n, width - at)
            parts.append(batch.column(0).flatten().slice(at, take).to_numpy(zero_copy_only=True))
            start, n = start + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def close(self) -> None:
        self._batch = None
        self.source.close()


def write_shards(docs: DataFrame, folder: str, end_id: int = END_ID, sequence: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """Encode all texts into shards under ``folder``; one row per shard: shard, n_docs, n_tokens, path, listing.

    Rows are dealt by ranges of doc_id and, for many rows of one id, of the text's
    hash. The result is read from a written table, so the shards exist when this returns.
    """
    path = tokenizer or tokens.tokenizer_path()
    where, base = store(folder)
    where.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, out, place = context.partitionId(), None, 0
        target, name = store(folder)
        made = [f"{name}/ids-{shard:07d}.arrow", f"{name}/docs-{shard:07d}.arrow"]
        own = [f"{m}.{context.taskAttemptId()}" for m in made]
        listed = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = 0
        for batch in batches:
            for part, ids, begin in tokens.encoded(batch, "text", path):
                if out is None:
                    sinks = [target.open_output_stream(o) for o in own]
                    out = SequenceWriter(sinks[0], ids.dtype, sequence, BATCH_ROWS)
                    listing = pa.ipc.new_file(sinks[1], listed)
                n = np.diff(begin)
                out.add(np.insert(ids, begin[1:], np.array(end_id, ids.dtype)))
                starts = place + np.cumsum(n + 1) - (n + 1)
                listing.write_batch(pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(n + 1)], schema=listed))
                place, n_docs = place + int((n + 1).sum()), n_docs + len(n)
        if out is None:
            return
        out.close()
        listing.close()
        for sink, o, m in zip(sinks, own, made):
            sink.close()
            target.move(o, m)
        rows = [[shard], [n_docs], [place], [f"{folder}/ids-{shard:07d}.arrow"], [f"{folder}/docs-{shard:07d}.arrow"]]
        yield pa.record_batch([pa.array(r) for r in rows], ["shard", "n_docs", "n_tokens", "path", "listing"])

    rows = tables.texts(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    return stage(rows.mapInArrow(write, "shard long, n_docs long, n_tokens long, path string, listing string"), "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """Every document as the files hold it: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    One task reads a shard. The list of shards goes through the driver: a few
    numbers for each file written.
    """
    known = sorted(shards.select("shard", "n_tokens", "path", "listing").collect())
    before = np.cumsum([0, *(s["n_tokens"] for s in known)])
    rows = [(int(before[i]), s["path"], s["listing"]) for i, s in enumerate(known)]
    spark = shards.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                where, name = store(r["listing"])
                file = SequenceFile(r["path"])
                with where.open_input_file(name) as source, pa.ipc.open_file(source) as listing:
                    for k in range(listing.num_record_batches):
                        docs = listing.get_batch(k)
                        starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                        crcs = [crc32_of(file.ids(int(a), int(n))) for a, n in zip(starts, sizes)]
                        yield pa.record_batch(
                            [docs.column("doc_id"), pa.array(starts + r["before"]), pa.array(sizes), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                file.close()

    listed = spark.createDataFrame(rows, "before long, path string, listing string")
    if rows:
        listed = listed.repartition(len(rows))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    return read_documents(write_shards(tables.table(spark, sf_dir, "documents"), folder))
