import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakegraph import model
from lakegraph.operators import catalog, grade, packs, quality, resolve, rules, search
from lakegraph.sources import bundle

CONCEPT = ("path string, catalog string, stem string, type string, title string, description string, layer string, "
           "status string, kind string, mode string, tags array<string>, fqn string, body string, uri string, source string, name string")


def concepts(spark, *rows):
    base = dict(path=None, catalog=None, stem=None, type=None, title=None, description=None, layer=None, status="active",
                kind=None, mode=None, tags=[], fqn=None, body="", uri=None, source=None, name=None)
    full = []
    for r in rows:
        r = {**base, **r}
        r["catalog"] = r["catalog"] or r["path"].split("/")[1]
        r["stem"] = r["stem"] or r["path"].split("/")[-1].removesuffix(".md")
        full.append(tuple(r[k] for k in base))
    return spark.createDataFrame(full, CONCEPT).withColumn("bad_links", F.lit(0))


def links(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, rel string, target string")


# -- search -----------------------------------------------------------------


def test_search_matches_brute_force(spark):
    rng = random.Random(11)
    words = ["rev", "revenue", "revenues", "order", "orders", "gold", "go"]
    docs = {f"d{i}": [rng.choice(words) for _ in range(rng.randrange(1, 8))] for i in range(40)}
    frame = concepts(spark, *[dict(path=f"/tables/{d}.md", body=" ".join(ws)) for d, ws in docs.items()])
    queries = [("a", "rev rev order"), ("b", "go"), ("c", "the")]
    got = {}
    asked = spark.createDataFrame(queries, "query_id string, query string")
    for r in search.search(search.postings(search.index_cards(frame)), asked, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.path, r.score))
    for q, text in queries:
        scores = Counter()
        for token in [w for w in text.split() if w != "the"]:
            for d, ws in docs.items():
                for w in set(ws):
                    scores[f"/tables/{d}.md"] += 1.0 if w == token else 0.25 if w.startswith(token) else 0.0
        best = sorted(((p, s) for p, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got.get(q, [])) == [(i + 1, p, s) for i, (p, s) in enumerate(best)]


def test_fallback_only_for_queries_without_hits(spark):
    frame = concepts(spark, dict(path="/tables/a.md", title="Net: sales", body="x"), dict(path="/tables/b.md", title="other", body="sales"))
    hits = search.search_or_scan(search.postings(search.index_cards(frame)), frame, [("q", "sales"), ("r", "t: s")])
    assert sorted((r.query_id, r.path, r.score) for r in hits.collect()) == [
        ("q", "/tables/a.md", 1.0), ("q", "/tables/b.md", 1.0), ("r", "/tables/a.md", 1.0)]


def test_intent_scores_and_focus(spark):
    frame = concepts(
        spark, dict(path="/metrics/m.md", type="Metric", title="Order revenue", layer="gold"),
        dict(path="/columns/c.md", type="Column", title="order revenue"), dict(path="/tables/t.md", type="Table", title="nothing"),
    )
    scores = {r.path: round(r.score, 6) for r in search.intent_scores(frame, "order revenue", "design-report").collect()}
    assert scores == {"/metrics/m.md": 1.55, "/columns/c.md": 0.45, "/tables/t.md": 0.35}
    top = search.intent_scores(frame, "order revenue", "design-report")
    assert search.focus_of(top, "design-report").first().path == "/metrics/m.md"
    short = concepts(spark, dict(path="/tables/t.md", body="x" * 3000 + " late"))
    assert search.intent_scores(short, "late", "general").first().score == 1.0
    assert search.intent_scores(short, "late", "general", body_chars=2000).count() == 0


def test_pack_body_only_for_focus_and_whole_rejection(spark):
    frame = concepts(spark, dict(path="/tables/a.md", title="A", type="Table", body="# h\nword " * 50),
                     dict(path="/tables/b.md", title="B", type="View", description="near", body="hidden"))
    members = spark.createDataFrame([("/tables/a.md", n, i) for i, n in enumerate(["/tables/a.md", "/tables/b.md", "/x/gone.md"])],
                                    "focus string, node string, depth int")
    cards = {r.node: r for r in packs.card_block(packs.pack_cards(members, frame)).collect()}
    assert "hidden" not in cards["/tables/b.md"].block and "near" in cards["/tables/b.md"].block
    assert cards["/x/gone.md"].type == "?" and cards["/x/gone.md"].title == "gone" and "word" in cards["/tables/a.md"].block
    blocks = packs.card_block(packs.pack_cards(members, frame))
    gated = packs.gate_packs(blocks, "focus", "block", packs.pack_budget(budget=20))
    assert gated.first().accepted is False and packs.accepted_parts(blocks, gated, "focus").count() == 0
    assert packs.pack_budget() == 32_000


# -- names --------------------------------------------------------------------


def test_name_resolution_ranking(spark):
    frame = concepts(spark, dict(path="/views/orders.md"), dict(path="/tables/silver-orders.md"), dict(path="/tables/gold-orders.md"),
                     dict(path="/queries/my-stuff.md"), dict(path="/columns/ghost.md"), dict(path="/tables/ab.md"))
    names = spark.createDataFrame([("Orders",), ("my_stuff",), ("ghost",), ("tuff",), ("a",)], "name string")
    plain = {r.name: r.path for r in resolve.resolve_names(names, frame).collect()}
    assert plain == {"Orders": "/tables/gold-orders.md", "my_stuff": "/queries/my-stuff.md"}
    loose = {r.name: r.path for r in resolve.resolve_names(names, frame, contains=True).collect()}
    assert loose == {**plain, "tuff": "/queries/my-stuff.md", "a": "/tables/ab.md"}


def test_containing_names_that_share_a_piece(spark):
    stems = ["alpha-orders", "beta-orders-x", "orders", "borders", "zz", "gamma-ord", "a-b-c", "ordersorders"]
    frame = concepts(spark, *[dict(path=f"/{'views' if i % 2 else 'tables'}/{s}.md") for i, s in enumerate(stems)])
    asked = ["rders", "ord", "o", "b-c", "rders_x", "zzz", "-", "ordersorders_and_much_longer", "rsor", "", "lph"]
    got = {r.name: r.path for r in resolve.resolve_names(spark.createDataFrame([(a,) for a in asked], "name string"), frame, contains=True).collect()}
    want = {}
    for name in asked:
        key = name.lower().replace("_", "-")
        hits = [(i % 2, 0 if s == key else 1 if s.endswith("-" + key) else 2, f"/{'views' if i % 2 else 'tables'}/{s}.md")
                for i, s in enumerate(stems) if key and key in s]
        exact = [h for h in hits if h[1] < 2]
        if hits:
            want[name] = min(exact or hits)[2]
    assert got == want


def test_subjects(spark):
    frame = concepts(spark, dict(path="/dashboards/sales.md", type="Dashboard", title="Sales"),
                     dict(path="/tables/sales.md", type="Table", title="Sales"))
    got = {r.subject: (r.path, r.score) for r in resolve.resolve_subjects(["sales dashboard", "Sales", "tables/x.md", "ingest job y"], frame).collect()}
    assert got == {"sales dashboard": ("/dashboards/sales.md", 3), "Sales": ("/dashboards/sales.md", 8),
                   "tables/x.md": ("/tables/x.md", 0), "ingest job y": ("/ingestion/ingest-job-y.md", 0)}


def test_stub_layers(spark):
    st = spark.createDataFrame([("gold/a.sql", "gold", "CREATE TABLE a AS SELECT * FROM silver.s JOIN plain p ON true JOIN b"),
                                ("misc/b.sql", "raw", "CREATE TABLE b AS SELECT * FROM odd.thing")], "path string, layer string, sql string")
    assert {(r.name, r.layer) for r in resolve.stub_tables(st).collect()} == {("s", "silver"), ("plain", "bronze"), ("thing", "raw")}
    assert {(r.name, r.layer) for r in resolve.stub_tables(st, compat=True).collect()} == {("s", "bronze"), ("plain", "bronze"), ("thing", "raw")}


# -- catalog --------------------------------------------------------------------


def test_upsert_and_audit(spark):
    mk = lambda rows: spark.createDataFrame(rows, "path string, type string, fingerprint string, timestamp string")
    old = mk([("/a", "Table", "1", "t0"), ("/b", "Table", "1", "t0"), ("/c", "Table", "1", "t0")])
    new = mk([("/a", "Table", "1", "t1"), ("/b", "Table", "2", "t1"), ("/d", "Table", "1", "t1"), ("/e", "WriteEvent", "1", "t1")])
    rows = {r.path: (r.action, r.timestamp, r.fingerprint) for r in catalog.upsert(old, new).collect()}
    assert rows == {"/a": ("skipped", "t0", "1"), "/b": ("updated", "t0", "2"), "/c": ("kept", "t0", "1"),
                    "/d": ("created", "t1", "1"), "/e": ("created", "t1", "1")}
    assert {r.path: r.timestamp for r in catalog.upsert(old, new, stable=False).collect()}["/b"] == "t1"
    done = catalog.upsert(old, new)
    assert sorted(r.target for r in catalog.audit_events(done, "ana", "1").collect()) == ["/b", "/d"]
    with pytest.raises(ValueError):
        catalog.audit_events(done, "  ", "1")


def test_fingerprint_ignores_outer_blanks_but_not_fields(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "\n x \n"), ("b", "x"), (None, "x")], "t string, b string")
    prints = [r.f for r in df.select(catalog.fingerprint({"title": F.col("t")}, F.col("b")).alias("f")).collect()]
    assert prints[0] == prints[1] and len(set(prints)) == 3


def test_links_merge_once_and_invert(spark):
    have = links(spark, ("/a", "feeds", "/b"))
    added = links(spark, ("/a", "feeds", "b"), ("/a", "feeds", "/b"), ("/a", "uses", "/b"))
    assert sorted(tuple(r) for r in catalog.merge_links(have, added).collect()) == [("/a", "feeds", "/b"), ("/a", "uses", "/b")]
    frame = concepts(spark, dict(path="/tables/t.md"), dict(path="/o", type="BusinessObject", catalog="o"), dict(path="/m", type="Metric", catalog="m"))
    back = catalog.inverse_links(links(
        spark, ("/o", "derived_from", "/tables/t.md"), ("/o", "derived_from", "/gone"), ("/m", "derived_from", "/tables/t.md")), frame)
    assert [tuple(r) for r in back.collect()] == [("/tables/t.md", "businessizes", "/o")]


def test_listing_escapes_and_annotates(spark):
    frame = concepts(spark, dict(path="/tables/t.md", title="Fact [Sales]", layer="gold"), dict(path="/glossary/g.md", title="G", layer="gold"))
    assert {r.line for r in catalog.listing_lines(frame).collect()} == {
        "- [Fact \\[Sales\\]](/tables/t.md) · gold", "- [G](/glossary/g.md)"}


def test_promotions_use_adjacent_present_layers(spark):
    t = spark.createDataFrame([("o", "raw"), ("o", "gold"), ("o", "silver"), ("o", "gold"), ("p", "gold")], "base string, layer string")
    assert sorted((r.from_layer, r.to_layer) for r in catalog.promotions(t).collect()) == [("raw", "silver"), ("silver", "gold")]


# -- quality --------------------------------------------------------------------


def test_header_checks(spark):
    rows = [
        ("/1", "Table", {"type": "Table", "title": "x", "layer": "odd", "status": "active"}, {"type": "string", "title": "string", "layer": "string", "status": "string"}, 1),
        ("/2", "IngestionJob", {"type": "IngestionJob", "title": "x", "sla_minutes": "x", "status": "whatever"}, {"title": "string", "sla_minutes": "string", "status": "string"}, 3),
        ("/3", None, {}, {}, 0), ("/4", "Mystery", {"title": "m"}, {"title": "string"}, 0),
        ("/5", "Table", {"type": "Table", "title": "", "layer": ""}, {"title": "string", "layer": "string"}, 0),
    ]
    frame = spark.createDataFrame(rows, "path string, type string, fields map<string,string>, kinds map<string,string>, untargeted_links int")
    check = lambda **o: {(r.path, r.field, r.check) for r in quality.check_headers(frame, quality.header_rules(spark), **o).collect()}
    expected = {("/1", "layer", "enum"), ("/1", "links", "link_target"), ("/2", "sla_minutes", "number"), ("/3", "type", "required"), ("/5", "title", "required"),
                ("/5", "type", "string")} - {("/5", "type", "string")}
    assert check() == expected
    assert check(strict_unknown=True) == expected | {("/4", "type", "unknown_type")}


def _grade(spark, frame, link_rows, **options):
    from lakegraph.operators.graph import flow_edges

    l = links(spark, *link_rows) if link_rows else links(spark, ("x", "feeds", "y")).limit(0)
    listed = frame.select("catalog").distinct() if "catalog" in frame.columns else spark.createDataFrame([], "catalog string")
    root = spark.createDataFrame([("/index.md", "okf_version: 1"), ("/log.md", "")], "path string, text string")
    manifest = spark.range(1 if options.get("index_built", True) else 0)
    return grade.grade(grade.grade_inputs(frame, l, flow_edges(l), listed=listed, root=root, manifest=manifest)).first()


def test_grade_by_hand(spark):
    frame = concepts(
        spark, dict(path="/tables/gold-a.md", type="Table", title="A", layer="gold", description="d" * 40),
        dict(path="/tables/bronze-b.md", type="Table", title="B", layer="bronze"),
        dict(path="/transformations/t.md", type="Transformation", title="T", description="e" * 40),
        dict(path="/business-objects/o.md", type="BusinessObject", title="O", description="A buyer of goods in our shops"),
        dict(path="/glossary/g.md", type="GlossaryTerm", title="G"),
    )
    g = _grade(spark, frame, [("/tables/bronze-b.md", "feeds", "/tables/gold-a.md"), ("/business-objects/o.md", "derived_from", "/tables/gold-a.md")])
    assert g.structural_coverage == pytest.approx(0.35 + 0.25 * 2 / 3 + 0.2 + 0.2, abs=1e-3)
    assert g.lineage_integrity == pytest.approx(0.45 + 0.25 + 0.1) and g.stream_job_landing == 0.75
    assert g.business_fidelity == pytest.approx(0.55 + 0.25 + 0.2 * 0.5)
    assert g.evidence_traceability == pytest.approx(0.5 * 2 / 3 + 0.3 + 0.2, abs=1e-3) and g.adversarial_resistance == 1.0
    assert g.passed and g.hard_fails == []


def test_grade_hard_fails(spark):
    frame = concepts(spark, dict(path="/tables/gold-a.md", type="Table", title="A", layer="gold", body="password = abc"),
                     dict(path="/tables/b.md", type="Table", title="B"))
    g = _grade(spark, frame, [], index_built=False)
    assert g.hard_fail_count == 2 and not g.passed and g.lineage_integrity == 0.25
    assert g.business_fidelity == 0.0 and g.adversarial_resistance == 0.4
    many = [dict(path=f"/tables/t{i}.md", type="Table", title="T") for i in range(60)]
    tied = [(f"/tables/t{i}.md", "feeds", f"/tables/t{i + 1}.md") for i in range(19)]
    few = _grade(spark, concepts(spark, *many), tied)
    more = _grade(spark, concepts(spark, *many), tied[:3])
    assert few.structural_coverage > more.structural_coverage and "orphans:56" in more.revisions
    empty = _grade(spark, frame.limit(0), [])
    assert empty.structural_coverage == 0.4 and empty.stream_job_landing == 0.5 and empty.business_fidelity == 0.8


def test_structure_and_drift(spark):
    frame = concepts(spark, dict(path="/tables/t.md"), dict(path="/layers/gold.md"))
    listed = spark.createDataFrame([("tables",)], "catalog string")
    assert {tuple(r) for r in quality.missing_structure(spark, frame, listed).collect()} == {
        ("catalog", "layers"), ("layer", "bronze"), ("layer", "silver")}


# -- stored expressions -----------------------------------------------------------


def test_dax(spark):
    assert rules.dax_to_sql("Total =\nSUMX(\n 'o',\n 'o'[gross]\n)") == "sum(gross)"
    with pytest.raises(ValueError):
        rules.dax_to_sql("CALCULATE(x)")


def test_rules_fail_without_a_verdict(spark):
    empty = spark.createDataFrame([], "d date")
    rows = rules.evaluate_rules([{"name": "f", "target": "t", "expression": "max(d) >= current_date - 1"}], {"t": empty}, "2024-01-01")
    assert rows.first().passed is False
    fresh = spark.createDataFrame([(datetime.date(2023, 12, 31),)], "d date")
    assert rules.evaluate_rules([{"name": "f", "target": "t", "expression": "max(d) >= current_date - 1"}], {"t": fresh}, "2024-01-01").first().passed


def test_contracts_without_rules_or_limits(spark):
    contracts = spark.createDataFrame(
        [("a", ["r"], None), ("b", [], "late"), ("c", None, None), ("d", ["r", "gone"], "ok"), ("e", ["r"], "never")],
        "contract string, quality_rules array<string>, job string")
    verdicts = spark.createDataFrame([("r", True)], "rule string, passed boolean")
    fresh = spark.createDataFrame([("late", False), ("ok", True)], "job string, in_time boolean")
    got = {r.contract: (r.rules, r.failed, r.passed) for r in rules.check_contracts(contracts, verdicts, fresh).collect()}
    assert got == {"a": (1, 0, True), "b": (0, 0, False), "c": (0, 0, True), "d": (2, 1, False), "e": (1, 0, False)}


def test_schema_drift(spark):
    columns = "table_name string, column_name string, data_type string, nullable boolean"
    actual = spark.createDataFrame([("t", "a", "int", True), ("t", "b", "int", False), ("t", "x", "int", False), ("t", "p", "int", False)], columns)
    captured = spark.createDataFrame(
        [("t", "a", "bigint", True, False), ("t", "b", "int", True, False), ("t", "y", "int", False, False), ("t", "p", "int", False, True)],
        columns + ", pii boolean")
    assert {(r.column_name, r.drift, r.pii) for r in quality.schema_drift(captured, actual).collect()} == {
        ("a", "type", False), ("b", "nullability", False), ("x", "extra", False), ("y", "missing", False), ("p", "none", True)}


def test_quarantine_treats_null_as_broken(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (-1, None)], "n int, s string")
    good, bad = rules.quarantine(df, {"has_s": F.col("s").isNotNull(), "positive": F.col("n") > 0})
    assert [r.n for r in good.collect()] == [1]
    assert {r.n: r.reasons for r in bad.collect()} == {2: ["has_s"], -1: ["has_s", "positive"]}


def test_fixed_tables_are_consistent():
    assert abs(sum(model.GRADE_WEIGHTS.values()) - 1) < 1e-9
    assert all(abs(sum(w.values()) - 1) < 1e-9 for _, w in model.RUBRICS.values())
    assert len(model.CATALOGS) == 33 and not set(model.FORWARD_FLOW) & set(model.REVERSE_FLOW)


# -- captured links, joint evidence, stored index ---------------------------------


def test_captured_links(spark):
    fields = spark.createDataFrame([
        ("/tables/gold-a.md", "Table", "layer", "Gold"), ("/tables/gold-a.md", "Table", "columns", "gold-a id"),
        ("/tables/gold-a.md", "Table", "columns", "gold-a id"), ("/queries/q.md", "Query", "dax_artifact", "dax/Total.md"),
        ("/streams/s.md", "Stream", "table", "/tables/gold-a.md"), ("/tables/gold-a.md", "Table", "nothing", "x"),
        ("/odd/x.md", None, "layer", "Gold"), ("/workflows/w.md", "Workflow", "sources", "a"),
    ], "path string, type string, field string, name string")
    got = sorted(tuple(r) for r in catalog.captured_links(fields).collect())
    assert got == sorted([
        ("/tables/gold-a.md", "layered_as", "/layers/gold.md"), ("/tables/gold-a.md", "contains", "/columns/gold-a-id.md"),
        ("/columns/gold-a-id.md", "defines", "/tables/gold-a.md"), ("/queries/q.md", "implements", "/dax/Total.md"),
        ("/dax/Total.md", "implements", "/queries/q.md"), ("/streams/s.md", "lands_as", "/tables/gold-a.md"),
        ("/streams/s.md", "feeds", "/tables/gold-a.md"),
    ])


def test_fields_of_scanned_assets(spark):
    text = '---\ntype: Report\ntitle: R\nmetrics: ["Net sales", Margin]\ntables:\n- /tables/a.md\n- "b c"\nowner: x\n---\n'
    files = spark.createDataFrame([("/reports/r.md", text)], "path string, text string")
    fields = catalog.asset_fields(bundle.parse_concepts(files)[0])
    assert sorted((r.field, r.name) for r in fields.collect()) == [
        ("metrics", "Margin"), ("metrics", "Net sales"), ("tables", "/tables/a.md"), ("tables", "b c")]
    assert {r.target for r in catalog.captured_links(fields).collect()} == {
        "/metrics/margin.md", "/metrics/net-sales.md", "/tables/a.md", "/tables/b-c.md"}


def test_lineage_path_links(spark):
    rows = spark.createDataFrame([("/p", 1, "a"), ("/p", 2, "b"), ("/p", 3, "c"), ("/q", 1, "z")], "path string, pos int, node string")
    assert sorted(tuple(r) for r in catalog.lineage_path_links(rows).collect()) == sorted([
        *[("/p", "contains", n) for n in "abc"], ("/q", "contains", "z"), ("/p", "feeds", "b"), ("/p", "feeds", "c"),
        *[(x, rel, y) for x, y in ("ab", "bc") for rel in ("feeds", "transforms_to")]])


def test_joint_evidence(spark):
    frame = concepts(spark, dict(path="/j", type="Workflow"), dict(path="/k", type="Transformation"), dict(path="/n", type="Metric"))
    links = spark.createDataFrame([
        ("/j", "reads_from", "a"), ("/j", "writes_to", "b"), ("/k", "reads_from", "a"), ("/k", "documents", "c"),
        ("/n", "derived_from", "a"), ("/n", "derived_from", "d"), ("/k", "x", "/j"), ("/k", "x", "/k")], "src string, rel string, target string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("a", "/k"), ("a", "/j")], "src string, dst string")
    got = {tuple(r) for r in quality.jointly_named_edges(edges, frame, links).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "/j")}


def test_stored_search_reads_only_asked_folders(spark, tmp_path):
    pairs = spark.createDataFrame([("alpha", "/1"), ("alphabet", "/2"), ("beta", "/3"), ("gamma", "/4")], "token string, path string")
    search.write_postings(pairs, str(tmp_path / "index"))
    asked = spark.createDataFrame([("q", "alpha"), ("r", "none-such gamma"), ("s", "")], "query_id string, query string")
    found = search.search_stored(spark, str(tmp_path / "index"), asked)
    assert {(r.query_id, r.path, r.score) for r in found.collect()} == {("q", "/1", 1.0), ("q", "/2", 0.25), ("r", "/4", 1.0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan or "PartitionFilters: [array_contains" in plan
    assert search.search_stored(spark, str(tmp_path / "index"), asked.filter("query_id = 's'")).count() == 0


def test_validation_covers_fields_links_bodies_structure_and_root(spark):
    frame = spark.createDataFrame([
        ("/tables/a.md", "Table", "A", "see [b](/tables/b.md#x), [gone](/tables/gone.md?y=1), [out](https://x.y), [l](/tables/index.md), [v](/views/index.md)", 2),
        ("/tables/b.md", None, None, None, None), ("/views/v.md", "View", "V", "[root](/index.md) [log](/log.md) [/](/) [n](//host/x)", 0),
        ("/layers/gold.md", "Layer", "Gold", "", 0),
    ], "path string, type string, title string, body string, bad_links int")
    rows = spark.createDataFrame([("/tables/a.md", "feeds", "tables/b.md"), ("/tables/a.md", "feeds", "/views/index.md"), ("/views/v.md", "uses", "/x.md"),
                                  ("/views/v.md", "uses", "/x.md"), ("/views/v.md", "uses", ""), ("/views/v.md", "uses", None)], "src string, rel string, target string")
    listed = spark.createDataFrame([("tables",)], "catalog string")
    root = spark.createDataFrame([("/index.md", "# no version")], "path string, text string")
    found = sorted(tuple(r) for r in quality.validate(frame, rows, listed=listed, root=root).collect())
    assert found == sorted([
        ("/tables/b.md", "error", "missing_field", "type"), ("/tables/b.md", "error", "missing_field", "title"),
        ("/tables/a.md", "warning", "non_object_link", ""), ("/tables/a.md", "warning", "non_object_link", ""),
        ("/tables/a.md", "error", "broken_href", "/tables/gone.md"), ("/tables/a.md", "error", "broken_href", "/views/index.md"),
        ("/views/v.md", "error", "broken_href", "/log.md"), ("/views/v.md", "error", "broken_link", "/x.md"), ("/views/v.md", "error", "broken_link", "/x.md"),
        ("/", "warning", "missing_structure", "catalog:views"), ("/", "warning", "missing_structure", "catalog:layers"),
        ("/", "warning", "missing_structure", "layer:bronze"), ("/", "warning", "missing_structure", "layer:silver"),
        ("/index.md", "warning", "missing_version", "okf_version"), ("/log.md", "warning", "missing_file", "")])
    bare = root.limit(0)
    assert {tuple(r) for r in quality.root_findings(bare).collect()} == {("/index.md", "error", "missing_file", ""), ("/log.md", "warning", "missing_file", "")}
    # Some assets only: no rule on the whole bundle, and the other assets' paths are known.
    part = quality.validate(frame.limit(0), rows.limit(1), listed=None, root=None, paths=frame)
    assert part.count() == 0


def test_health_reads_the_index_flag_from_the_manifest(spark):
    frame = concepts(spark, dict(path="/tables/gold-a.md", type="Table", title="A", layer="gold"))
    edges = spark.createDataFrame([], "src string, dst string")
    none = spark.createDataFrame([], "src string, rel string, target string")
    root = spark.createDataFrame([("/index.md", "okf_version: 1")], "path string, text string")
    for n in (0, 1):
        row = quality.health(frame, none, edges, listed=spark.createDataFrame([("tables",)], "catalog string"), root=root, manifest=spark.range(n)).first()
        assert row.index_built == (n == 1) and row.error_count == 0 and row.warning_count == 4


def test_write_receipt_counts_what_was_written(spark, tmp_path):
    row = "path string, type string, layer string, fingerprint string, timestamp string"
    current = spark.createDataFrame([("/a", "Table", "gold", "1", "t0"), ("/b", "Table", None, "1", "t0"), ("/z", "Table", "gold", "1", "t0")], row)
    incoming = spark.createDataFrame([("/a", "Table", "gold", "2", "t1"), ("/b", "Table", None, "1", "t1"), ("/c", "View", "gold", "1", "t1"),
                                      ("/d", None, None, "1", "t1")], row)
    errors = spark.createDataFrame([("Table", "gold"), (None, None), (None, None)], "type string, layer string")
    stored, receipt = catalog.write_upsert(catalog.upsert(current, incoming), str(tmp_path / "next"), errors)
    assert {tuple(r)[:2]: tuple(r)[2:] for r in receipt.collect()} == {
        ("Table", "gold"): (0, 1, 0, 1), ("Table", None): (0, 0, 1, 0), ("View", "gold"): (1, 0, 0, 0), (None, None): (1, 0, 0, 2)}
    assert {(r.path, r.action, r.timestamp) for r in stored.collect()} == {
        ("/a", "updated", "t0"), ("/b", "skipped", "t0"), ("/z", "kept", "t0"), ("/c", "created", "t1"), ("/d", "created", "t1")}
    _, nothing = catalog.write_upsert(catalog.upsert(current, incoming.limit(0)), str(tmp_path / "same"))
    assert nothing.count() == 0


def test_focus_by_path_stem_title_or_not_at_all(spark):
    frame = concepts(spark, dict(path="/tables/orders.md", title="Sales"), dict(path="/views/orders.md", title="Sales"),
                     dict(path="/a/sales.md", title="orders"), dict(path="/x.md", catalog="x"))
    names = ["/nowhere.md", "orders", "Sales", "tables/orders", "tables/orders.md", "deep/orders.md", "x", "unknown", None]
    got = {r.name: r.node for r in packs.resolve_focus(spark.createDataFrame([(n,) for n in names], "name string"), frame).collect()}
    assert got == {"/nowhere.md": "/nowhere.md", "orders": "/a/sales.md", "Sales": "/tables/orders.md", "tables/orders": "/tables/orders.md",
                   "tables/orders.md": "/tables/orders.md", "deep/orders.md": "/tables/orders.md", "x": "/x.md", "unknown": "/unknown.md"}


def test_context_packs_count_the_whole_text_and_reject_whole(spark):
    frame = concepts(spark, dict(path="/t/a.md", title="A", type="Table", layer="gold", body="# A\nhello\n"),
                     dict(path="/t/b.md", title="B", type="Table", description="bee"), dict(path="/t/c.md", title="C", type="View"))
    edges = spark.createDataFrame([("/t/a.md", "/t/b.md"), ("/t/b.md", "/t/a.md"), ("/t/b.md", "/t/gone.md"), ("/t/z.md", "/t/y.md")], "src string, dst string")
    names = spark.createDataFrame([("a",), ("nothing",)], "name string")
    parts, receipt = packs.context_packs(names, frame, edges, None, budget=40)
    texts = {}
    everything, _ = packs.context_packs(names, frame, edges, None)
    for r in everything.collect():
        texts.setdefault(r.focus, []).append((r.section, r.text))
    a = dict(Counter(s for s, _ in texts["/t/a.md"]))
    assert a == {"header": 1, "card": 3, "node": 3, "edge": 3} and "# a\n\nNodes: 3\n" in [t for _, t in texts["/t/a.md"]]
    assert "## A (`Table`, gold)\n\n- Path: `/t/a.md`\nhello\n\n" in [t for _, t in texts["/t/a.md"]]
    assert "## gone (`?`)\n\n- Path: `/t/gone.md`\n\n" in [t for _, t in texts["/t/a.md"]]
    assert dict(Counter(s for s, _ in texts["/nothing.md"])) == {"header": 1, "card": 1, "node": 1}
    size = {f: (sum(len(t) for _, t in rows) + 3) // 4 for f, rows in texts.items()}
    assert {r.focus: (r.tokens, r.accepted) for r in receipt.collect()} == {f: (n, n <= 40) for f, n in size.items()}
    assert {r.focus for r in parts.collect()} == {"/nothing.md"}
    assert packs.context_packs(names.limit(0), frame, edges)[1].count() == 0


def test_statements_from_bodies(spark):
    frame = concepts(spark, dict(path="/q/a.md", body="x\n```sql\nSELECT 1\n```\n```sql\nSELECT 2\n```"), dict(path="/q/b.md", body="no block"),
                     dict(path="/q/c.md", body=None), dict(path="/q/d.md", body="```SQL\n```"))
    assert {r.path: r.sql for r in resolve.body_statements(frame).collect()} == {"/q/a.md": "SELECT 1\n", "/q/d.md": ""}


def test_focus_without_broadcasts_over_a_union(spark):
    """Without a small side the filter on the score went into the parts of the union, where planning failed."""
    columns = "path string, type string, title string, description string, layer string, fqn string, tags array<string>, body string"
    part = lambda *rows: spark.createDataFrame(rows, columns).select(
        "path", "type", "title", F.concat(F.lit("about "), "title").alias("description"), "layer", "fqn", "tags", "body")
    concepts = part(("/a.md", "Table", "gold order", "", "gold", "g.o", ["t"], "")).unionByName(
        part(("/m.md", "Metric", "revenue", "", "gold", None, [], ""), ("/n.md", "Metric", "gold", "", "gold", None, [], "order")))
    hits = spark.createDataFrame([("/n.md",)], "path string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = search.intent_scores(concepts, "gold order", "design-report", hits)
        top = scores.orderBy(F.col("score").desc(), "path").limit(12)
        assert [r.path for r in search.focus_of(top, "design-report").select("path", "score").collect()] == ["/n.md"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_searched_once_for_all_findings(spark):
    frame = spark.createDataFrame([
        ("/tables/a.md", "Table", "A", "see [b](/tables/b.md), [x](/x.md#y) and [no](", 1), ("/tables/b.md", None, "B", "a [ ( ] b", 0), ("/tables/c.md", "Table", "C", None, 0),
    ], "path string, type string, title string, body string, bad_links int")
    rows = spark.createDataFrame([("/tables/a.md", "feeds", "/tables/b.md"), ("/tables/b.md", "feeds", "/gone.md")] * 2, "src string, rel string, target string")
    found = quality.validate(frame, rows, listed=None, root=None)
    assert "regexp_extract_all" not in _plan(found)  # three times before
    assert sorted(tuple(r) for r in found.collect()) == sorted([
        ("/tables/a.md", "error", "broken_href", "/x.md"), ("/tables/a.md", "warning", "non_object_link", ""), ("/tables/b.md", "error", "missing_field", "type"),
        ("/tables/b.md", "error", "broken_link", "/gone.md"), ("/tables/b.md", "error", "broken_link", "/gone.md")])


def test_evidence_is_read_once_and_looked_up_unsorted(spark):
    frame = concepts(spark, dict(path="/tables/silver-x.md"), dict(path="/tables/gold-y.md"), dict(path="/tables/gold-w.md"))
    statements = spark.createDataFrame([
        ("a", "CREATE TABLE gold.y AS SELECT * FROM silver.x"), ("b", "INSERT INTO gold.w -- FROM gold.y\nSELECT ' FROM gold.y '"),
        ("c", "INSERT INTO gold.w WITH y AS (SELECT 1) SELECT * FROM y"), ("d", "INSERT INTO gold.w WITH a AS (SELECT 1), y as (SELECT 2) SELECT * FROM y"), ("e", None),
    ], "path string, sql string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        proven = resolve.resolved_statement_edges(statements, frame)
        flow = [("/tables/silver-x.md", "/tables/gold-y.md"), ("/tables/gold-y.md", "/tables/gold-w.md"), (None, "/tables/gold-w.md")]
        bare = quality.edges_without_evidence(spark.createDataFrame(flow, "src string, dst string"), proven)
        plan = _plan(bare)
        assert "regexp" not in plan and "SortMergeJoin" not in plan
        assert [tuple(r) for r in proven.collect()] == flow[:1]
        assert {tuple(r) for r in bare.collect()} == set(flow[1:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges_inside_a_pack_are_listed_by_member_and_looked_up_for_wide_nodes(spark, monkeypatch):
    from lakegraph.operators.edge_store import EdgeStore

    rng = random.Random(4)
    rows = {("hub", f"n{i:02}") for i in range(40)} | {("big", f"n{i:02}") for i in range(30)}
    rows |= {(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(120)} | {("n01", "hub"), ("n01", "n01")}
    members = [(f"f{f}", n) for f in range(12) for n in ["hub", "big", *{f"n{rng.randrange(40):02}" for _ in range(9)}]] + [("f0", "gone")]
    expected = sorted((f, s, d) for f, s in members for g, d in members if f == g and (s, d) in rows)
    frame = spark.createDataFrame(sorted(rows), "src string, dst string")
    taken = spark.createDataFrame(members, "focus string, node string")
    monkeypatch.setattr(packs, "LISTED_EDGES", 10)
    for hub_edges in (1_000_000, 35):
        store = EdgeStore.write(frame, 4, hub_edges)
        found = packs._inner_edges(taken, store)
        assert sorted(map(tuple, found.collect())) == expected == sorted(map(tuple, packs._inner_edges(taken, frame).collect()))
        store.drop()
    monkeypatch.setattr(packs, "LISTED_EDGES", 100)
    store, before = EdgeStore.write(frame, 4), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Members are dealt out once and meet the stored edges where they lie; pairs and edges were dealt out by both ends before.
        plan = packs._inner_edges(taken, store)._jdf.queryExecution().optimizedPlan().toString()
        assert "array_contains" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        store.drop()
