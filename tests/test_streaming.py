import re

from pyspark.sql import functions as F

from lakegraph.sources import bundle
from lakegraph.streaming import landing

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def put(spark, folder, name, rows):
    """One file per call, so that later calls arrive as later batches."""
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, value double").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.lit("click").alias("event_type"), "value",
        F.lit('{"k": 4}').alias("props"),
    )
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    reader = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True)
    return reader.parquet(str(folder))


def test_replay_and_repeats_land_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    put(spark, src, "a", [(1, "2024-01-01 00:00:00", 1, 1.0), (1, "2024-01-01 00:00:00", 1, 1.0), (2, "2024-01-01 00:10:00", 1, 1.0)])
    for _ in range(2):
        landing.land_once(stream(spark, src), out, state, "event_id", "ts", "1 hour")
    put(spark, src, "b", [(2, "2024-01-01 00:10:00", 1, 1.0), (3, "2024-01-01 00:20:00", 1, 1.0)])
    landing.land_once(stream(spark, src), out, state, "event_id", "ts", "1 hour")
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_daily_counts_update_and_drop_late_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    run = lambda: landing.daily_counts(stream(spark, src), out, state, "ts", "event_type", "1 day")
    put(spark, src, "a", [(1, "2024-01-01 01:00:00", 1, 1.0), (2, "2024-01-02 01:00:00", 1, 2.0)])
    run()
    put(spark, src, "b", [(3, "2024-01-02 02:00:00", 1, 5.0), (4, "2024-01-09 00:00:00", 1, 1.0)])
    run()
    put(spark, src, "c", [(5, "2024-01-01 03:00:00", 1, 9.0)])
    run()
    rows = {str(r.day): (r.event_count, float(r.total)) for r in landing.read_batches(spark, out, ["day", "event_type"]).collect()}
    assert rows == {"2024-01-01": (1, 1.0), "2024-01-02": (2, 7.0), "2024-01-09": (1, 1.0)}


def test_cdc_keeps_the_newest_row_even_if_it_came_first(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    put(spark, src, "a", [(1, "2024-01-05 00:00:00", 7, 1.0), (2, "2024-01-04 00:00:00", 8, 1.0)])
    landing.upsert_latest(stream(spark, src), out, state, "user_id", ["ts", "event_id"])
    put(spark, src, "b", [(3, "2024-01-01 00:00:00", 7, 1.0), (4, "2024-01-06 00:00:00", 8, 1.0)])
    landing.upsert_latest(stream(spark, src), out, state, "user_id", ["ts", "event_id"])
    latest = landing.read_batches(spark, out, ["user_id"], ["ts", "event_id"])
    assert {r.user_id: r.event_id for r in latest.collect()} == {7: 1, 8: 4}


def test_edit_revalidates_only_its_catalog(spark, tmp_path):
    root, state = tmp_path / "assets", str(tmp_path / "state")
    seen, listed = [], []

    def save(name, text):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    def read_all():
        concepts, _ = bundle.read_concepts(spark, str(root))
        return concepts, bundle.explode_links(concepts)

    def run():
        files = bundle.scan_files(spark, str(root), streaming=True)
        landing.revalidate(
            files, state, read_all,
            lambda found, _: seen.append(sorted((r.path, r.rule) for r in found.collect())),
            lambda lines, _: listed.append({r.catalog for r in lines.collect()}),
        )

    save("tables/a.md", "---\ntype: Table\ntitle: A\nlinks:\n- target: /tables/gone.md\n  rel: feeds\n---\n")
    save("views/v.md", "---\ntype: View\n---\n")
    run()
    assert seen.pop() == [("/tables/a.md", "broken_link"), ("/views/v.md", "missing_field")] and listed.pop() == {"tables", "views"}
    save("views/w.md", "---\ntype: View\ntitle: W\n---\n")
    run()
    assert seen == [[("/views/v.md", "missing_field")]] and listed == [{"views"}]


def test_late_rows_are_kept_apart(spark, tmp_path):
    src, out, late, state = (str(tmp_path / n) for n in ("src", "out", "late", "state"))
    run = lambda: landing.land_split(stream(spark, src), out, late, state, "event_id", "ts", "1 hour")
    at = lambda *keys: sorted([(r.event_id, r.batch_id) for r in spark.read.parquet(*keys).collect()], key=str)
    put(spark, src, "a", [(1, "2024-01-01 23:30:00", 1, 1.0), (1, "2024-01-01 23:30:00", 1, 1.0), (2, "2024-01-02 00:10:00", 1, 1.0),
                          (8, None, 1, 1.0), (None, "2024-01-02 00:00:00", 1, 1.0)])
    run()
    # 1 again and 3 within the hour, 4 too late, 8 without a time, the null key again.
    put(spark, src, "b", [(1, "2024-01-01 23:30:00", 1, 1.0), (3, "2024-01-01 23:15:00", 1, 1.0), (4, "2024-01-01 22:00:00", 1, 1.0),
                          (8, None, 1, 1.0), (5, "2024-01-02 05:00:00", 1, 1.0), (None, "2024-01-02 00:00:00", 1, 1.0)])
    run()
    # Nothing in time: the newest time stays.
    put(spark, src, "c", [(1, "2024-01-01 23:30:00", 1, 1.0), (4, "2024-01-01 22:00:00", 1, 1.0)])
    run()
    put(spark, src, "d", [(6, "2024-01-02 03:59:00", 1, 1.0), (7, "2024-01-02 04:00:00", 1, 1.0)])
    run()
    run()  # no new file
    assert at(out) == sorted([(1, 0), (2, 0), (None, 0), (3, 1), (5, 1), (7, 3)], key=str)
    assert at(late) == sorted([(8, 0), (4, 1), (8, 1), (1, 2), (4, 2), (6, 3)], key=str)


def test_compaction_keeps_state_and_reads_open_batches_only(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    order, keys = ["ts", "event_id"], ["user_id"]

    def lot(name, *rows):
        put(spark, src, name, [(e, f"2024-01-0{day} 00:00:00", user, 1.0) for e, day, user in rows])
        landing.upsert_latest(stream(spark, src), out, state, "user_id", order)
        return {r.user_id: r.event_id for r in landing.read_batches(spark, out, keys, order).collect()}

    lot("a", (1, 5, 7), (2, 4, 8))
    assert lot("b", (3, 1, 7), (4, 6, 8)) == {7: 1, 8: 4}
    assert landing.compact(spark, out, keys, order) == 1 and landing.compact(spark, out, keys, order) == 1
    assert lot("c", (5, 9, 9), (6, 5, 8)) == {7: 1, 8: 4, 9: 5}

    def read_now():
        rows = landing._open_rows(spark, out, landing._snapshot(spark, out))
        assert re.search(r"PartitionFilters: \[isnotnull\(batch_id[^]]+ > \d", rows._jdf.queryExecution().executedPlan().toString())
        return {re.search("/(upto=[0-9]+|batch_id=[0-9]+)", r.f)[1] for r in rows.select(F.input_file_name().alias("f")).collect()}

    assert read_now() == {"upto=1", "batch_id=2"}
    assert landing.compact(spark, out, keys, order) == 2
    assert read_now() == {"upto=2"}
    # A snapshot that no manifest line names, as a failed compaction leaves it, is not read.
    spark.range(1).write.parquet(f"{out}-snapshots/upto=9-x")
    assert lot("d", (9, 9, 7)) == {7: 9, 8: 4, 9: 5}
