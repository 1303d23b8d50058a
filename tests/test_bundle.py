import pytest

from lakegraph.operators import catalog, grade, graph, quality, search
from lakegraph.sources import bundle, lake
from pyspark.sql import functions as F

FILES = {
    "tables/gold-a.md": '---\ntype: Table\ntitle: "Fact [\\"Sales\\"] \\\\ x"\ntags: [a, b]\nlayer: gold\nverified: true\nstatus: null\n'
                        "links:\n- target: /tables/b.md\n  rel: feeds\n- target: /layers/gold.md\n  rel: layered_as\nrows: 5\n---\n\n# A\n[b](/tables/b.md)\n",
    "tables/b.md": "---\r\ntype: Table\r\ntitle: B\r\ntags:\r\n- one\r\n- two\r\n---\r\nbody\r\n",
    "tables/bad.md": "---\ntype: Table\ntitle: >\n  folded\n---\nx\n",
    "tables/loose.md": "---\ntype: Table\ntitle: L\nlinks:\n- just-text\n- target: /t.md\n---\n",
    "tables/index.md": "---\ntype: Catalog\ntitle: Tables\n---\n",
    "index.md": "---\ntitle: root\n---\n", "log.md": "---\ntitle: log\n---\n",
    ".index/x.md": "---\ntype: Table\n---\n", "tables/.hidden.md": "---\ntype: Table\n---\n", "tables/plain.md": "no header\n",
    "tables/with space.md": "---\ntype: View\ntitle: S\ntitle: S2\n---\n",
}


def write(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode())


def test_read_concepts(spark, tmp_path):
    write(tmp_path, FILES)
    concepts, errors = bundle.read_concepts(spark, str(tmp_path))
    rows = {r.path: r for r in concepts.collect()}
    assert set(rows) == {"/tables/gold-a.md", "/tables/b.md", "/tables/loose.md", "/tables/with space.md"}
    a = rows["/tables/gold-a.md"]
    assert a.title == 'Fact ["Sales"] \\ x' and a.tags == ["a", "b"] and a.verified is True and a.status is None
    assert [tuple(l) for l in a.links] == [("/tables/b.md", "feeds"), ("/layers/gold.md", "layered_as")]
    assert a.extra == {"rows": "5"} and a.catalog == "tables" and a.stem == "gold-a" and a.body.startswith("# A")
    assert rows["/tables/b.md"].tags == ["one", "two"]
    assert rows["/tables/loose.md"].bad_links == 1 and rows["/tables/loose.md"].links[0].target == "/t.md"
    assert rows["/tables/with space.md"].title == "S2"
    assert [r.path for r in errors.collect()] == ["/tables/bad.md"]


def test_links_explode_in_order(spark, tmp_path):
    write(tmp_path, FILES)
    concepts, _ = bundle.read_concepts(spark, str(tmp_path))
    rows = bundle.explode_links(concepts.filter("stem = 'gold-a'")).orderBy("pos").collect()
    assert [(r.pos, r.target, r.rel) for r in rows] == [(0, "/tables/b.md", "feeds"), (1, "/layers/gold.md", "layered_as")]


LAKE = {
    "bronze/shop/orders_in.sql": "CREATE OR REPLACE TABLE bronze.orders_in AS SELECT * FROM landing.feed",
    "silver/shop/orders.sql": "CREATE OR REPLACE TABLE silver.orders AS SELECT * FROM bronze.orders_in WHERE ok",
    "gold/marts/ltv.sql": "CREATE OR REPLACE VIEW gold.ltv AS SELECT * FROM silver.orders",
    "jobs/run.sql": "-- reads FROM nowhere\nSELECT 1",
    "dax/total.dax": "Total =\nSUMX('t', 't'[c])",
}


def test_sql_corpus(spark, tmp_path):
    write(tmp_path, LAKE)
    rows = {r.stem: r for r in lake.read_statements(spark, str(tmp_path)).collect()}
    assert rows["orders_in"].layer == "bronze" and rows["orders_in"].refs == ["feed"] and rows["orders_in"].writes_table
    assert rows["ltv"].is_view and rows["ltv"].layer == "gold" and rows["run"].refs == []
    measures = lake.read_measures(spark, str(tmp_path)).collect()
    assert [m.stem for m in measures] == ["total"]
    receipt = {(r.kind, r.layer): r.n for r in lake.discovery_receipt(lake.read_statements(spark, str(tmp_path))).collect()}
    assert receipt == {("table_write", "bronze"): 1, ("table_write", "silver"): 1, ("view", "gold"): 1, ("query", "silver"): 1}


def test_parquet_datasets(spark, tmp_path):
    for folder in ("gold/sales", "stage/in", "gold/_tmp"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / folder))
    rows = {(r.folder, r.name, r.layer) for r in lake.parquet_datasets(spark, str(tmp_path)).collect()}
    assert rows == {("/gold/sales", "sales", "gold"), ("/stage/in", "in", "silver")}


def test_column_concepts(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    harvested = lake.harvest_columns({"my_t": df})
    assert {(r.column_name, r.data_type, r.null_count) for r in harvested.collect()} == {("a", "int", 0), ("b", "string", 1)}
    concepts, links = lake.column_concepts(harvested, "gold", "Sales", "erp")
    assert {r.path for r in concepts.collect()} == {"/tables/gold-my-t.md", "/columns/gold-my-t-a.md", "/columns/gold-my-t-b.md", "/schemas/sales.md"}
    assert links.count() == 8 and links.filter(F.col("rel") == "contains").count() == 3


def test_repeated_root_and_typed_fields(spark, tmp_path):
    root = tmp_path / "t"
    inner = str(root).lstrip("/")
    head = "---\ntype: SourceSystem\ntitle: A\nsource_kind: stream\nkind: api\nrows: 5\nshare: 0.5\nverified: true\ntags: [a]\nuri: null\nlinks:\n- rel: feeds\n---\n"
    write(root, {"a.md": head, f"x/{inner}/a.md": "---\ntype: IngestionJob\ntitle: J\ningestion_mode: cdc\n---\n"})
    concepts, _ = bundle.read_concepts(spark, str(root))
    rows = {r.path: r for r in concepts.collect()}
    assert set(rows) == {"/a.md", f"/x/{inner}/a.md"}
    a, j = rows["/a.md"], rows[f"/x/{inner}/a.md"]
    assert (a.kind, a.uri, a.untargeted_links, j.mode) == ("stream", None, 1, "cdc")
    assert a.kinds == {"type": "string", "title": "string", "source_kind": "string", "kind": "string", "rows": "integer", "share": "number",
                       "verified": "boolean", "tags": "array", "uri": None, "links": "array"}


def test_operators_take_scanned_assets(spark, tmp_path):
    write(tmp_path, {
        "sources/s.md": "---\ntype: SourceSystem\ntitle: S\nsource_kind: stream\n---\n",
        "ingestion/j.md": "---\ntype: IngestionJob\ntitle: J\ningestion_mode: cdc\nstatus: odd\nlinks:\n- target: /sources/s.md\n  rel: ingests_from\n---\n",
        "tables/gold-t.md": "---\ntype: Table\ntitle: T\nlayer: gold\nfqn: g.t\n---\n",
    })
    concepts, _ = bundle.read_concepts(spark, str(tmp_path))
    links = bundle.explode_links(concepts).select("src", "rel", "target")
    edges = graph.flow_edges(links)
    assert [r.path for r in quality.stream_sources(concepts).collect()] == ["/sources/s.md"]
    assert quality.fake_streams(concepts, links).count() == 0 and quality.unlanded_streams(concepts, links, edges).count() == 1
    assert "`g.t`" in catalog.promote_layer(concepts, links).first().definition
    assert [(r.path, r.field) for r in quality.check_headers(concepts, quality.header_rules(spark)).collect()] == [("/tables/gold-t.md", "layer")][:0]
    assert search.intent_scores(concepts, "t", "general").count() > 0
    root = spark.createDataFrame([], "path string, text string")
    inputs = grade.grade_inputs(concepts, links, edges, listed=concepts.select("catalog").distinct(), root=root, manifest=spark.range(1)).first()
    assert inputs.streams == 1.0 and inputs.index_built


def test_footers_count_what_a_scan_counts(spark, tmp_path):
    rows = [(1, "a", [1.0], 2.0), (None, "b", None, None), (3, None, [None], float("nan"))]
    df = spark.createDataFrame(rows, "`a.b` int, s string, v array<double>, x double")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    df.limit(0).write.parquet(str(tmp_path / "none"))
    paths = {n: str(tmp_path / n) for n in ("t", "none")}
    got = lake.harvest_footers(spark, paths)
    want = lake.harvest_columns({n: spark.read.parquet(p) for n, p in paths.items()})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.columns == want.columns
    flat, nested = lake.footer_counts("t", lake.footer_session(spark).read.parquet(paths["t"]))
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan and "ReadSchema: struct<count(*)" in plan
    assert [r.column_name for r in nested.collect()] == ["v"]
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_packed_files_give_every_text_back(spark, tmp_path):
    texts = ["", None, "plain", "two\nlines\n", "\n", "record \x1e end \x1e", "mark \x1d and \x1d1\x1d0 \x1e0", "\r\n x \r", "ü" * 5000, "same", "same"]
    rows = [(f"/tables/a-{i}.md", t) for i, t in enumerate(texts)] + [("/odd\nname\x1e\x1d2.md", "x"), ("/odd\nname\x1e\x1d2.md", "x")]
    df = spark.createDataFrame(rows, "path string, text string").repartition(3)
    for n, folder in ((1_000_000, "whole"), (2, "short")):
        root = str(tmp_path / folder)
        bundle.write_packed(df.withColumn("value", df.text), root, records_per_file=n)
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")  # records lie across splits
        try:
            got = bundle.scan_packed(spark, root).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert sorted((r.path, r.text) for r in got) == sorted((p, t or "") for p, t in rows)
    assert len(list((tmp_path / "whole").glob("part-*"))) <= 3
    bundle.write_packed(df.limit(0), str(tmp_path / "none"))
    assert bundle.scan_packed(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="an asset needs a path"):
        bundle.write_packed(spark.createDataFrame([(None, "x")], "path string, text string"), str(tmp_path / "bad"))


def test_a_reader_of_few_fields_leaves_the_others_unparsed(spark):
    files = spark.createDataFrame([("/tables/t.md", "---\ntype: Table\nlinks:\n- target: /a.md\n  rel: feeds\n---\nText")], "path string, text string")
    concepts = bundle.parse_concepts(files)[0]
    few = concepts.select("path", "type", "kind", "tags")
    assert r"\s*rel\s*:" in concepts._jdf.queryExecution().optimizedPlan().toString()
    assert r"\s*rel\s*:" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in few.collect()] == [("/tables/t.md", "Table", None, None)]


def test_headers_start_and_end_where_the_pattern_says(spark):
    texts = ["---\na: 1\n---\n\n body", "---\n\n  a: 1\n--- \nbody", "---\r\na: 1\r\n---\r\nbody", "---\na: 1\n---x", "---\n\n---\nbody",
             "---\n---\n", "---\na: 1\n", "a: 1", "", None, "---\n\n---\na: 1\n---\nbody", "---\n"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {int(r.path): (r.header, r.body) for r in bundle.split_header(files).collect()}
    assert got == {0: ("a: 1", "body"), 1: ("  a: 1", "body"), 2: ("a: 1", "body"), 3: ("a: 1", "x"), 4: ("", "body"),
                   10: ("---\na: 1", "body")}


def test_last_entry_of_a_key_and_odd_line_ends(spark):
    text = "---\ntype: Table\ntitle: a: b \ntitle : 'it\\'s' \nowner:\t7\nnote: .5e1\n---\n"
    row = bundle.parse_concepts(spark.createDataFrame([("/tables/t.md", text)], "path string, text string"))[0].first()
    assert (row.title, row.owner) == ("it's", "\t7") and row.keys == ["type", "title", "owner", "note"]
    assert row.kinds == {"type": "string", "title": "string", "owner": "string", "note": "number"}
