"""Write-once tables whose inserts read what the batch touches, and not the whole table.

A key's hash names its bucket, a folder. An insert reads the keys of the batch's own buckets only, so the
files it opens are at most ``max_files`` for each bucket that the batch touches, however large the table is. A bucket that
holds ``max_files`` files already is written anew as one.

Files become part of the table by a marker, made in one step after all files of a batch are written. What a
killed writer leaves has no marker and is never read; a batch that has one is not inserted again.
One writer at a time; readers see whole batches. Files that a rewritten bucket replaces are left to the folder's retention.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricepanel.operators.cleaning import first_by
from pricepanel.session import stage

BUCKETS = 64
MAX_FILES = 8
_PLACE = re.compile(r"/__bucket=(\d+)/__commit=([^/]+)/__whole=([01])/[^/]+$")


@dataclass(frozen=True)
class KeyedStore:
    """A table at ``path`` with one row per key. Choose ``buckets`` once, so that a task can sort a bucket's keys."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = BUCKETS
    max_files: int = MAX_FILES

    def _found(self, pattern: str) -> list[str]:
        """Paths of a pattern, from listings alone."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        pattern = hadoop.Path(pattern)
        system = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [str(s.getPath()) for s in system.globStatus(pattern) or []]

    def _commits(self) -> dict[str, int]:
        """The place in time of each committed insert."""
        order = {}
        for path in self._found(f"{self.path}/commits/*"):
            number, _, commit = path.rsplit("/", 1)[-1].partition("~")
            order[commit] = int(number)
        return order

    def _mark(self, commit: str, number: int) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        marker = hadoop.Path(f"{self.path}/commits/{number:012d}~{commit}")
        marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(marker)

    def live_files(self, buckets: Iterable[int] | None = None) -> dict[int, list[str]]:
        """The files of the table by bucket: of each bucket those since it was last written as a whole."""
        order = self._commits()
        wanted = "*" if buckets is None else "{" + ",".join(str(b) for b in sorted(set(buckets))) + "}"
        placed: dict[int, list[tuple[int, str, str]]] = defaultdict(list)
        for path in self._found(f"{self.path}/data/__bucket={wanted}/__commit=*/__whole=*/*.parquet"):
            bucket, commit, whole = _PLACE.search(path).groups()
            if commit in order:
                placed[int(bucket)].append((order[commit], whole, path))
        live = {}
        for bucket, files in placed.items():
            since = max((number for number, whole, _ in files if whole == "1"), default=-1)
            live[bucket] = sorted(path for number, _, path in files if number >= since)
        return live

    def _read(self, files: Iterable[str]) -> DataFrame:
        paths = list(files)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The table as of the last committed insert."""
        return self._read(p for files in self.live_files().values() for p in files)

    def insert(self, batch: DataFrame, order: list, batch_id: str | None = None) -> None:
        """Add the first row, in the stated order, of each key that the table does not hold; a null in a key equals a null.

        ``batch_id`` names the batch: its insert takes place once, whatever is retried. Without one the batch is
        inserted under a new name; running it again still adds nothing, as its keys are there.
        """
        done = self._commits()
        name = re.sub(r"[^A-Za-z0-9_-]", "_", batch_id) if batch_id is not None else uuid.uuid4().hex
        if any(commit.split(".")[0] == name for commit in done):
            return
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")
        first = stage(first_by(batch, list(self.keys), order).select(*self.schema.names).withColumn("__bucket", bucket), "batch")
        touched = [r[0] for r in first.select("__bucket").distinct().collect()]  # at most `buckets` numbers
        live = self.live_files(touched)
        stored = self._read(p for files in live.values() for p in files)
        marks = stored.select(*[F.col(k).alias(f"__stored_{k}") for k in self.keys])
        same = [F.col(k).eqNullSafe(F.col(f"__stored_{k}")) for k in self.keys]
        fresh = first.join(marks, same, "left_anti")
        full = [b for b, files in live.items() if len(files) >= self.max_files]
        if full:
            old = self._read(p for b in full for p in live[b]).withColumn("__bucket", bucket)
            fresh = fresh.unionByName(old)
        commit = f"{name}.{uuid.uuid4().hex}"
        rows = fresh.withColumns({"__commit": F.lit(commit), "__whole": F.col("__bucket").isin(full).cast("int") if full else F.lit(0)})
        rows = rows.repartition("__bucket").sortWithinPartitions("__bucket", *self.keys)  # one file per bucket
        rows.write.mode("append").partitionBy("__bucket", "__commit", "__whole").parquet(f"{self.path}/data")
        self._mark(commit, max(done.values(), default=0) + 1)
