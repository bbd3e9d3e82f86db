"""Session settings, and the shared folder for staged tables and stream checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of sessions that name none themselves, by application.
_FOLDERS: dict[str, str] = {}


def build_session(
    app: str = "pricepanel", master: str | None = None, shuffle_partitions: int | None = None, folder: str | None = None
) -> SparkSession:
    """A session with the settings the library expects.

    On a cluster leave ``master`` and ``shuffle_partitions`` to spark-submit;
    adaptive execution then sizes the shuffles from the data. ``folder`` is the
    shared folder for staged tables (``spark.checkpoint.dir``).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is missing, a session inside one process (tests) gets a fresh
    scratch folder; any other session is refused, since a machine-local folder would be
    lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/pricepanel/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    For a result that several branches of one plan read: the lineage is cut, the
    work survives a lost executor, and each branch still reads only its columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
