"""Streaming jobs over the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegraph.plans.quality import _FINDINGS
from lakegraph.plans.registry import query, with_parts
from lakegraph.plans.sources import derived_files
from lakegraph.session import scratch_path
from lakegraph.sources import bundle, derive
from lakegraph.streaming import landing

C = F.col
_EVENTS = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events"


def _stream(spark, sf):
    schema = derive.table(spark, sf, "events").schema
    return landing.file_stream(spark, sf, schema, "events.parquet").withColumn("ts", C("ts").cast("timestamp"))


def _shown(df):
    return df.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value", "props")


@query("t01_stream_landing", _EVENTS)
def t01(spark, sf):
    target, state = scratch_path(spark, "bronze"), scratch_path(spark, "bronze-state")
    landing.land(_stream(spark, sf), target, state)
    return _shown(spark.read.parquet(target))


@query("t02_idempotent_landing", _EVENTS)
def t02(spark, sf):
    """Events that all arrive twice, landed twice over."""
    target, state = scratch_path(spark, "once"), scratch_path(spark, "once-state")
    for _ in range(2):
        doubled = _stream(spark, sf).unionByName(_stream(spark, sf))
        landing.land_once(doubled, target, state, "event_id", "ts", "1 hour")
    return _shown(spark.read.parquet(target))


_ARRIVALS_SQL = """
WITH first AS (
  SELECT *, least((day(ts) - 1) // 8 + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END, 3) AS arrival FROM events
), arrivals AS (SELECT * FROM first UNION ALL SELECT * REPLACE (arrival + 1 AS arrival) FROM first WHERE event_id % 7 = 0 AND arrival < 3)
"""


def _arrivals(spark, sf):
    """Events as they come in four lots: a tenth a lot late, a seventh again in the next lot."""
    events = derive.table(spark, sf, "events").withColumn("ts", C("ts").cast("timestamp"))
    late = F.when(C("event_id") % 10 == 3, 1).otherwise(0)
    first = F.least(F.floor((F.dayofmonth("ts") - 1) / 8).cast("int") + late, F.lit(3))
    again = F.when((C("event_id") % 7 == 0) & (first < 3), F.array(first, first + 1)).otherwise(F.array(first))
    events = events.withColumn("arrival", F.explode(again))
    return [events.filter(C("arrival") == i).drop("arrival") for i in range(4)]


def _lots(spark, sf, run):
    """Calls ``run(stream, lot)`` after each lot has come in, so that every lot is a batch."""
    folder = scratch_path(spark, "lots")
    for lot, rows in enumerate(_arrivals(spark, sf)):
        rows.write.mode("append").parquet(folder)
        run(landing.file_stream(spark, folder, rows.schema), lot)


@query("t02_late_rows", _ARRIVALS_SQL + """
, newest AS (SELECT arrival, max(ts) AS ts FROM arrivals GROUP BY arrival),
judged AS (
  SELECT a.event_id, a.ts, a.arrival,
         coalesce(a.ts < (SELECT max(n.ts) FROM newest n WHERE n.arrival < a.arrival) - INTERVAL 2 DAY, false) AS late
  FROM arrivals a
)
SELECT event_id, 'late' AS fate, CAST(arrival AS BIGINT) AS lot FROM judged WHERE late
UNION ALL SELECT event_id, 'landed', CAST(min(arrival) AS BIGINT) FROM judged WHERE NOT late GROUP BY event_id
""")
def t02_late(spark, sf):
    """Four lots with late and repeated rows; what comes too late is kept apart."""
    target, late, state = (scratch_path(spark, n) for n in ("split", "split-late", "split-state"))
    _lots(spark, sf, lambda stream, _: landing.land_split(stream, target, late, state, "event_id", "ts", "2 days"))
    read = lambda folder, fate: spark.read.parquet(folder).select(
        "event_id", F.lit(fate).alias("fate"), C("batch_id").cast("bigint").alias("lot"))
    return read(target, "landed").unionByName(read(late, "late"))


@query("t03_stream_cleanse", """
SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error' AND value IS NOT NULL
""")
def t03(spark, sf):
    target, state = scratch_path(spark, "silver"), scratch_path(spark, "silver-state")
    clean = landing.cleanse(_stream(spark, sf), (C("event_type") != "error") & C("value").isNotNull())
    landing.land(clean, target, state)
    return spark.read.parquet(target).select("event_id", "user_id", "event_type", C("props.k").alias("k"))


@query("t04_daily_counts", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS event_count,
       CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS total FROM events GROUP BY ALL
""")
def t04(spark, sf):
    target, state = scratch_path(spark, "daily"), scratch_path(spark, "daily-state")
    landing.daily_counts(_stream(spark, sf), target, state, "ts", "event_type", "2 days")
    return landing.read_batches(spark, target, ["day", "event_type"]).select(
        C("day").cast("string").alias("day"), "event_type", "event_count", C("total").cast("double").alias("total")
    )


@query("t05_cdc_upsert", """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n = 1
""")
def t05(spark, sf):
    """Latest event per user."""
    target, state = scratch_path(spark, "users"), scratch_path(spark, "users-state")
    landing.upsert_latest(_stream(spark, sf), target, state, "user_id", ["ts", "event_id"])
    latest = landing.read_batches(spark, target, ["user_id"], ["ts", "event_id"])
    return latest.select("user_id", "event_id", "event_type", "value")


@query("t05_compacted_state", """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n = 1
""")
def t05_compacted(spark, sf):
    """Latest event per user after four lots, two of them merged into snapshots."""
    target, state, order = scratch_path(spark, "users"), scratch_path(spark, "users-state"), ["ts", "event_id"]

    def run(stream, lot):
        landing.upsert_latest(stream, target, state, "user_id", order)
        if lot in (0, 2):
            landing.compact(spark, target, ["user_id"], order)

    _lots(spark, sf, run)
    return landing.read_batches(spark, target, ["user_id"], order).select("user_id", "event_id", "event_type", "value")


@query("t07_revalidation", with_parts("concepts links", f"""
WITH {_FINDINGS} SELECT path, rule, detail FROM findings WHERE starts_with(path, '/dashboards/')
"""))
def t07(spark, sf):
    """Dashboard files are edited; only their catalog is validated again."""
    root, state, out = (scratch_path(spark, n) for n in ("edited", "edited-state", "findings"))
    concepts, links = derive.concepts(spark, sf), derive.links(spark, sf)
    derived_files(concepts.filter(C("type") == "Dashboard"), root)
    files = bundle.scan_files(spark, root, "*.txt", streaming=True)
    catalog = F.concat(F.lit("/"), F.regexp_extract("path", "/catalog=([^/]+)/", 1), F.lit("/edited.md"))
    landing.revalidate(
        files.withColumn("path", catalog), state, lambda: (concepts, links),
        lambda found, batch: found.write.mode("overwrite").parquet(f"{out}/batch_id={batch}"),
        lambda lines, batch: lines.write.mode("overwrite").parquet(f"{out}-lines/batch_id={batch}"),
    )
    return spark.read.parquet(out).select("path", "rule", "detail")
