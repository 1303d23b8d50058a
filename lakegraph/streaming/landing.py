"""Landing and refining event streams.

All jobs read whatever is there and stop (``availableNow``); run them again
with the same checkpoint and they continue where they left off.  Batch sinks
write one folder per batch id, so a repeated batch replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from lakegraph import model
from lakegraph.session import cut


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def _finish(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def land(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Source to landing table, every row once."""
    _finish(stream.writeStream.format("parquet").option("path", target), checkpoint)


def land_once(stream: DataFrame, target: str, checkpoint: str, key: str, watermark: str, delay: str) -> None:
    """Landing that drops repeats of ``key``; the watermark bounds the state kept for it."""
    unique = stream.withWatermark(watermark, delay).dropDuplicatesWithinWatermark([key])
    land(unique, target, checkpoint)


def _stored(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame | None:
    """Rows of a Parquet folder, none before its first write."""
    try:
        return spark.read.option("basePath", folder).schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def land_split(stream: DataFrame, target: str, late: str, checkpoint: str, key: str, ts: str, delay: str) -> None:
    """Landing that drops repeats of ``key`` and keeps late rows apart, so landed and late are all that came.

    A row is late if its time lies more than ``delay`` before the newest time of the batches
    before its own; rows without a time are late. Late rows keep their repeats. A repeat of
    a landed key is dropped as long as the landed row lies within ``delay`` of the newest time;
    within a batch the earliest row of a key lands. Every batch writes the folder of its
    id in ``target``, ``late`` and ``target`` + ``-marks``; the three and the checkpoint belong together.
    Only landed days from the watermark on are read for repeats. Null keys are one key.
    """
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch)
        marks = _stored(spark, f"{target}-marks", "newest bigint, batch_id bigint")
        before = marks and marks.filter(F.col("batch_id") == batch_id - 1).first()
        mark = before.newest if before else None
        on_time, behind = F.col(ts).isNotNull(), F.col(ts).isNull()
        if mark is not None:
            bound = F.expr(f"timestamp_micros({mark}) - interval {delay}")
            on_time, behind = F.col(ts) >= bound, F.coalesce(F.col(ts) < bound, F.lit(True))
        batch.filter(behind).write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")
        rest = [c for c in schema.names if c != key]
        first = batch.filter(on_time).groupBy(key).agg(
            F.min_by(F.struct(*rest), F.struct(ts, F.xxhash64(*rest))).alias("_row")
        ).select(key, "_row.*")
        landed = None
        if mark is not None:
            landed = _stored(spark, target, StructType([*schema.fields, StructField("batch_id", LongType()), StructField("day", DateType())]))
        if landed is not None:
            known = landed.filter((F.col("day") >= F.to_date(bound)) & (F.col(ts) >= bound) & (F.col("batch_id") < batch_id))
            known = known.select(F.col(key).alias("_key"))
            first = first.join(known, first[key].eqNullSafe(known["_key"]), "left_anti")
        first = first.select(*schema.names, F.to_date(ts).alias("day"))
        first.write.mode("overwrite").partitionBy("day").parquet(f"{target}/batch_id={batch_id}")
        newest_row = batch.agg(F.greatest(F.unix_micros(F.max(ts)), F.lit(mark).cast("bigint")).alias("newest"))
        newest_row.write.mode("overwrite").parquet(f"{target}-marks/batch_id={batch_id}")

    _finish(stream.writeStream.foreachBatch(write), checkpoint)


def cleanse(rows: DataFrame, keep: Column, props_schema: str = "k bigint") -> DataFrame:
    """Rows that satisfy ``keep`` with their JSON properties typed; for streams and tables alike."""
    return rows.filter(keep).withColumn("props", F.from_json("props", props_schema))


def _write_batches(target: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return write


def daily_counts(stream: DataFrame, target: str, checkpoint: str, ts: str, key: str, delay: str) -> None:
    """Counts and sums per day and key, updated as events arrive.

    Events later than the watermark are dropped.  Each batch writes the
    windows it changed.
    """
    days = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), key).agg(
        F.count(F.lit(1)).alias("event_count"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total")
    )
    flat = days.select(F.to_date("window.start").alias("day"), key, "event_count", "total")
    _finish(flat.writeStream.outputMode("update").foreachBatch(_write_batches(target)), checkpoint)


def upsert_latest(stream: DataFrame, target: str, checkpoint: str, key: str, order: list[str]) -> None:
    """Change capture: each batch writes the newest row per key it has seen."""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest(batch, [key], order).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    _finish(stream.writeStream.foreachBatch(write), checkpoint)


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key; aggregated map-side, so a hot key stays cheap."""
    rest = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return packed.select(*keys, "_row.*")


def _snapshot(spark: SparkSession, target: str) -> tuple[int, str] | None:
    """Last batch id and folder of the newest snapshot that the manifest names."""
    try:
        listed = spark.read.schema("upto bigint, folder string").json(f"{target}-manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    last = listed.agg(F.max(F.struct("upto", "folder")).alias("last")).first().last
    return (last.upto, last.folder) if last else None


def _open_rows(spark: SparkSession, target: str, snapshot: tuple[int, str] | None) -> DataFrame:
    """The newest snapshot and the batches after it, with ``batch_id``; folders of older batches are pruned."""
    rows = spark.read.option("basePath", target).parquet(target)
    if snapshot is None:
        return rows
    upto, folder = snapshot
    return rows.filter(F.col("batch_id") > upto).unionByName(spark.read.schema(rows.schema).parquet(folder))


def compact(spark: SparkSession, target: str, keys: list[str], order: list[str] | None = None) -> int | None:
    """Merges all finished batches into a new snapshot; the id of the last one it holds.

    The snapshot is written beside the batches, then one line is added to the
    manifest: readers see the old snapshot or the new one, never half of one, and a compaction
    that fails leaves nothing that is read. Without new batches nothing is written.
    Run it between runs of the stream: a batch that runs again is past its snapshot then.
    """
    known = _snapshot(spark, target)
    upto = spark.read.option("basePath", target).parquet(target).agg(F.max("batch_id")).first()[0]
    if upto is None or (known and upto <= known[0]):
        return known and known[0]
    rows = _open_rows(spark, target, known).filter(F.col("batch_id") <= upto)
    folder = f"{target}-snapshots/upto={upto}-{uuid.uuid4().hex}"
    newest(rows, keys, [*(order or []), "batch_id"]).select(*rows.columns).write.parquet(folder)
    line = spark.createDataFrame([(upto, folder)], "upto bigint, folder string")
    line.coalesce(1).write.mode("append").json(f"{target}-manifest")
    return upto


def read_batches(spark: SparkSession, target: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Current state of a batch-folder table: the last word per key, by ``order`` then batch.

    Reads the newest snapshot (see ``compact``) and the batches after it.
    """
    rows = _open_rows(spark, target, _snapshot(spark, target))
    return newest(rows, keys, [*(order or []), "batch_id"]).drop("batch_id")


def revalidate(
    files: DataFrame, checkpoint: str, read_all: Callable[[], tuple[DataFrame, DataFrame]],
    on_findings: Callable[[DataFrame, int], None], on_listing: Callable[[DataFrame, int], None],
) -> None:
    """After an edit, validates and relists only the catalogs of the edited files.

    ``files`` streams ``path, text``; ``read_all`` gives the current concepts
    and links.  Links and bodies of the touched catalogs are checked, against all
    paths; folders that are no catalog are left alone.
    """
    from lakegraph.operators.catalog import listing_lines
    from lakegraph.operators.quality import validate

    def refresh(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(F.split("path", "/")[1].alias("catalog")).distinct()
        # The batch names a few catalogs; as literals they prune an asset table that is partitioned by catalog.
        names = [r.catalog for r in touched.filter(F.col("catalog").isin(*model.CATALOGS)).collect()]
        concepts, links = read_all()
        own = concepts.filter(F.col("catalog").isin(names))
        own_links = links.filter(F.split("src", "/")[1].isin(names))
        on_findings(validate(own, own_links, listed=None, root=None, paths=concepts), batch_id)
        on_listing(listing_lines(own), batch_id)

    _finish(files.writeStream.foreachBatch(refresh), checkpoint)
