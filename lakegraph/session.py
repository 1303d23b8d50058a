"""Session settings, shared scratch folder and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of Parquet behind one task of a step that holds all its rows in memory.
TASK_BYTES = 4 << 20

_local_scratch: str | None = None


def build_session(app: str = "lakegraph", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on.

    On a cluster ``master`` and sizing come from spark-submit; tests and the
    bench pass ``local[n]`` and a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session without that setting (tests, a laptop) gets a temporary
    folder of its own.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="lakegraph-")
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder; never reused, so reads and writes never meet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    Loops keep flat plans, a lost executor costs a re-read instead of a
    recomputation, and the optimizer sees the real size of the result.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(df: DataFrame) -> int:
    """Partitions for a step that holds the rows of ``df``: the session's number, or more by the size of the files it reads.

    Only the listing is read. A frame without files gives the session's number.
    """
    spark = df.sparkSession
    files, least = df.inputFiles(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not files:
        return least
    total = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return max(least, -(-(total or 0) // TASK_BYTES))


def looked_up(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as the side of a join that tasks hold by key, in as many tasks as its files call for, so that neither side is sorted."""
    return df.repartition(task_count(df), *keys).hint("shuffle_hash")


def distinct(df: DataFrame) -> DataFrame:
    """``df.distinct()`` whose tasks do not grow with the input: rows are dealt out by value before they are held."""
    tasks = task_count(df)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.distinct()
    return df.repartition(tasks, *df.columns).distinct()
