"""Quality gates over concepts, links, edges and statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lakegraph import model
from lakegraph.functions.naming import infer_layer
from lakegraph.functions.text import bundle_hrefs
from lakegraph.operators.graph import flow_edges, nodes
from lakegraph.session import cut, looked_up

WELL_KNOWN = ("/index.md", "/log.md")


def known_paths(concepts: DataFrame) -> DataFrame:
    """``path`` of everything a link may point at: assets, root files, catalog listings."""
    spark = concepts.sparkSession
    fixed = [(p,) for p in (*WELL_KNOWN, *(f"/{c}/index.md" for c in model.CATALOGS))]
    return concepts.select("path").unionByName(spark.createDataFrame(fixed, "path string"))


def broken_links(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """Typed links whose target does not exist.

    Targets are made distinct before the join, so a target that a third of
    all links share is looked up once.
    """
    target = F.concat(F.lit("/"), F.ltrim(F.col("target"), F.lit("/")))
    named = links.filter(F.coalesce("target", F.lit("")) != "").withColumn("target", target)
    missing = named.select("target").distinct().join(
        known_paths(concepts).select(F.col("path").alias("target")), "target", "left_anti"
    )
    return named.join(missing, "target", "left_semi").select("src", "rel", "target")


def broken_hrefs(hrefs: DataFrame, paths: DataFrame) -> DataFrame:
    """``src, href`` rows whose in-bundle href names no known ``path``."""
    targets = hrefs.filter(F.col("href").rlike(r"^/+[^/]"))
    missing = targets.select("href").distinct().join(paths.select(F.col("path").alias("href")), "href", "left_anti")
    return targets.join(missing, "href", "left_semi")


def orphans(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables, views, queries and business objects at neither end of an edge."""
    technical = concepts.filter(F.col("type").isin("Table", "View", "Query", "BusinessObject"))
    return technical.select("path", "type").join(nodes(edges).withColumnRenamed("node", "path"), "path", "left_anti")


def is_gold(layer: Column, path: Column) -> Column:
    return (F.lower(F.coalesce(layer, F.lit(""))) == "gold") | path.contains("gold") | path.contains("/mart")


def gold_without_object(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """Gold tables no business object is derived from; ``status: skip`` is an exemption."""
    gold = concepts.filter(
        (F.col("type") == "Table") & is_gold(F.col("layer"), F.col("path"))
        & (F.coalesce("status", F.lit("")) != "skip")
    )
    served = (
        links.filter(F.col("rel") == "derived_from").select(F.col("target").alias("path"))
        .unionByName(links.filter(F.col("rel") == "businessizes").select(F.col("src").alias("path")))
    )
    return gold.select("path", "title").join(served, "path", "left_anti")


def is_stream_source(kind: Column, tags: Column) -> Column:
    tagged = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t) == "stream")
    return (F.lower(F.coalesce(kind, F.lit(""))) == "stream") | tagged


def stream_sources(concepts: DataFrame) -> DataFrame:
    return concepts.filter(
        (F.col("type") == "SourceSystem") & is_stream_source(F.col("kind"), F.col("tags"))
    ).select("path", "title")


def unlanded_streams(concepts: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """Stream sources with ``in_graph`` and ``lands``; only rows where one is false.

    Ends of edges, which may repeat, and links are kept only where they name a stream source,
    before anything is made distinct or looked up among the tables.
    """
    streams = cut(stream_sources(concepts).select("path"))
    tables = concepts.filter(F.col("type") == "Table").select(F.col("path").alias("target"))
    landing = (
        links.filter(F.col("rel").isin("lands_as", "feeds")).withColumnRenamed("src", "path").join(streams, "path", "left_semi")
        .join(tables, "target", "left_semi").select("path").distinct().withColumn("lands", F.lit(True))
    )
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path"))
    linked = ends.join(streams, "path", "left_semi").distinct().withColumn("in_graph", F.lit(True))
    return (
        streams.join(linked, "path", "left").join(landing, "path", "left")
        .select("path", F.coalesce("in_graph", F.lit(False)).alias("in_graph"),
                F.coalesce("lands", F.lit(False)).alias("lands"))
        .filter(~(F.col("in_graph") & F.col("lands")))
    )


def jobs_without_output(concepts: DataFrame, links: DataFrame) -> DataFrame:
    jobs = concepts.filter(F.col("type").isin(*model.JOB_TYPES)).select("path", "type")
    writers = links.filter(F.col("rel").isin(*model.OUTPUT_RELATIONS)).select(F.col("src").alias("path"))
    return jobs.join(writers, "path", "left_anti")


def fake_streams(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """Stream sources that no streaming, microbatch or cdc job reads."""
    jobs = concepts.filter(
        (F.col("type") == "IngestionJob") & F.col("mode").isin(*model.STREAM_MODES)
    ).select(F.col("path").alias("src"))
    read = (
        links.filter(F.col("rel").isin(*model.STREAM_READ_RELATIONS)).join(jobs, "src", "left_semi")
        .select(F.col("target").alias("path"))
    )
    return stream_sources(concepts).join(read, "path", "left_anti")


def job_edges(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """Flow edges a job, transformation, query or SQL artifact declares itself."""
    declaring = concepts.filter(
        F.col("type").isin(*model.JOB_TYPES, "Query", "View", "SqlArtifact")
    ).select(F.col("path").alias("src"))
    return flow_edges(links.join(declaring, "src", "left_semi"))


def jointly_named_edges(edges: DataFrame, concepts: DataFrame, links: DataFrame) -> DataFrame:
    """Edges both of whose ends a third job, transformation or query links to.

    Each edge is looked up by the end that fewer jobs name, so an asset that very
    many jobs name adds no more rows than the other ends of its edges have jobs.
    """
    jobs = concepts.filter(F.col("type").isin(*model.JOB_TYPES, "Query", "View", "SqlArtifact")).select(F.col("path").alias("src"))
    named = links.join(jobs, "src", "left_semi").select(F.col("src").alias("job"), F.col("target").alias("node")).distinct()
    count = named.groupBy("node").agg(F.count(F.lit(1)).alias("jobs"))
    ends = edges.select("src", "dst").distinct()
    for end in ("src", "dst"):
        ends = ends.join(count.select(F.col("node").alias(end), F.col("jobs").alias(f"{end}_jobs")), end)
    src_first = F.col("src_jobs") <= F.col("dst_jobs")
    rare, other = (F.when(src_first, F.col(a)).otherwise(F.col(b)) for a, b in (("src", "dst"), ("dst", "src")))
    candidates = ends.select("src", "dst", rare.alias("node"), other.alias("other")).join(named, "node")
    both = candidates.join(named.select("job", F.col("node").alias("other")), ["job", "other"], "left_semi")
    return both.filter(~F.col("job").isin(F.col("src"), F.col("dst"))).select("src", "dst").distinct()


def edges_without_evidence(edges: DataFrame, *evidence: DataFrame) -> DataFrame:
    """Edges found in none of the evidence edge sets (statements, jobs, attestations)."""
    proven = reduce(DataFrame.unionByName, [e.select("src", "dst") for e in evidence])
    return edges.select("src", "dst").join(looked_up(proven, "src", "dst"), ["src", "dst"], "left_anti")


def phantom_nodes(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edge ends that are no assets."""
    return nodes(edges).join(concepts.select(F.col("path").alias("node")), "node", "left_anti")


def unsourced_tables(concepts: DataFrame, discovered: DataFrame) -> DataFrame:
    """Tables and views whose ``stem`` the walked source does not contain."""
    return concepts.filter(F.col("type").isin("Table", "View")).select("path", "stem").join(
        discovered.select("stem"), "stem", "left_anti"
    )


def layer_mismatches(assets: DataFrame, declared: str = "declared_layer") -> DataFrame:
    """Assets whose declared layer differs from the one their path implies."""
    return assets.select("path", F.col(declared).alias("declared"), infer_layer(F.col("path")).alias("implied")).filter(
        F.col("declared").isNotNull() & (F.lower("declared") != F.col("implied"))
    )


def unbound_measures(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """Metrics and dashboards none of whose links reaches an existing table, view or metric."""
    asked = concepts.filter(F.col("type").isin("Metric", "Dashboard")).select("path", "type")
    anchors = concepts.filter(F.col("type").isin("Table", "View", "Metric")).select(F.col("path").alias("target"))
    bound = links.join(anchors, "target", "left_semi").select(F.col("src").alias("path"))
    return asked.join(bound, "path", "left_anti")


def missing_structure(spark: SparkSession, present: DataFrame, listed: DataFrame) -> DataFrame:
    """``kind, name`` of catalogs in use without a listing and of absent medallion layers.

    ``present`` has the ``path`` of every asset, ``listed`` the ``catalog`` of
    every listing.
    """
    used = present.select(F.split("path", "/")[1].alias("name")).distinct()
    declared = spark.createDataFrame([(c,) for c in model.CATALOGS], "name string")
    unlisted = (
        declared.join(used, "name", "left_semi").join(listed.select(F.col("catalog").alias("name")), "name", "left_anti")
        .select(F.lit("catalog").alias("kind"), "name")
    )
    layers = spark.createDataFrame([(m, f"/layers/{m}.md") for m in model.MEDALLION], "name string, path string")
    absent = layers.join(present.select("path"), "path", "left_anti").select(F.lit("layer").alias("kind"), "name")
    return unlisted.unionByName(absent)


def schema_drift(captured: DataFrame, actual: DataFrame) -> DataFrame:
    """Captured against actual columns: ``table_name, column_name, drift, pii``.

    Both sides have ``table_name, column_name, data_type, nullable``; the
    captured side also says which columns hold personal data.
    """
    keys = ["table_name", "column_name"]
    c = captured.select(*keys, F.col("data_type").alias("c_type"), F.col("nullable").alias("c_null"), "pii")
    a = actual.select(*keys, F.col("data_type").alias("a_type"), F.col("nullable").alias("a_null"))
    drift = (
        F.when(F.col("a_type").isNull(), F.lit("missing"))
        .when(F.col("c_type").isNull(), F.lit("extra"))
        .when(F.col("c_type") != F.col("a_type"), F.lit("type"))
        .when(F.col("c_null") != F.col("a_null"), F.lit("nullability"))
        .otherwise(F.lit("none"))
    )
    return c.join(a, keys, "full_outer").select(*keys, drift.alias("drift"), F.coalesce("pii", F.lit(False)).alias("pii")).filter(
        (F.col("drift") != "none") | F.col("pii")
    )


# -- whole-catalog reports -------------------------------------------------


def _finding(df: DataFrame, severity: str, rule: str, path: str, detail: Column) -> DataFrame:
    return df.select(F.col(path).alias("path"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                     detail.alias("detail"))


def asset_findings(concepts: DataFrame) -> DataFrame:
    """What a single asset shows: ``path, severity, rule, detail, key``, out of one array per row.

    ``broken_href`` rows are candidates whose ``key`` still has to be looked up; it is null for all others.
    """
    finding = lambda severity, rule, detail, key=F.lit(None).cast("string"): F.struct(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.alias("detail"), key.alias("key"))
    none = F.array().cast("array<struct<severity:string,rule:string,detail:string,key:string>>")
    fields = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in ("type", "title")]))
    hrefs = F.filter(bundle_hrefs(F.coalesce("body", F.lit("")), model.MARKDOWN_LINK, 2), lambda h: F.ltrim(h, F.lit("/")) != "")
    return concepts.select("path", F.inline(F.concat(
        none,
        F.transform(fields, lambda f: finding("error", "missing_field", f)),
        F.transform(F.array_repeat(F.lit(""), F.coalesce("bad_links", F.lit(0)).cast("int")), lambda d: finding("warning", "non_object_link", d)),
        F.transform(hrefs, lambda h: finding("error", "broken_href", h, F.concat(F.lit("/"), F.ltrim(h, F.lit("/"))))),
    )))


def root_findings(root: DataFrame) -> DataFrame:
    """Findings on the bundle's own ``path, text`` files: no index, an index without version, no log."""
    has = root.agg(
        F.coalesce(F.bool_or(F.col("path") == "/index.md"), F.lit(False)).alias("index"),
        F.coalesce(F.bool_or((F.col("path") == "/index.md") & F.contains("text", F.lit(model.VERSION_KEY))), F.lit(False)).alias("version"),
        F.coalesce(F.bool_or(F.col("path") == "/log.md"), F.lit(False)).alias("log"))
    finding = lambda cond, path, severity, rule, detail: F.when(cond, F.struct(
        F.lit(path).alias("path"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(detail).alias("detail")))
    return has.select(F.inline(F.array_compact(F.array(
        finding(~F.col("index"), "/index.md", "error", "missing_file", ""),
        finding(F.col("index") & ~F.col("version"), "/index.md", "warning", "missing_version", model.VERSION_KEY),
        finding(~F.col("log"), "/log.md", "warning", "missing_file", ""),
    ))))


def validate(
    concepts: DataFrame, links: DataFrame, *, listed: DataFrame | None, root: DataFrame | None, paths: DataFrame | None = None,
) -> DataFrame:
    """Findings as ``path, severity, rule, detail``; a catalog is valid without errors.

    Assets are read once for all rules on their own fields, ``bad_links`` and the in-bundle links of their ``body``. Typed
    links and those of bodies are looked up together: targets are made distinct first, and a typed link may point at any
    catalog's listing, one of a body only at files that exist. ``listed`` has the ``catalog`` of every listing and ``root``
    the ``path, text`` of the bundle's own files; None stands for a check of some assets only, without the rules on the whole
    bundle. ``paths`` are those of all assets where ``concepts`` are some of them.
    """
    spark = concepts.sparkSession
    own = cut(asset_findings(concepts))
    every = concepts.select("path") if paths is None else paths.select("path")
    typed = links.filter(F.coalesce("target", F.lit("")) != "").select(
        F.col("src").alias("path"), F.lit("error").alias("severity"), F.lit("broken_link").alias("rule"), F.col("target").alias("detail"),
        F.concat(F.lit("/"), F.ltrim("target", F.lit("/"))).alias("key"))
    asked = typed.unionByName(own.filter(F.col("key").isNotNull()))
    both = F.explode(F.array(F.lit("broken_link"), F.lit("broken_href")))
    fixed = [(p, "broken_link") for p in (*WELL_KNOWN, *(f"/{c}/index.md" for c in model.CATALOGS))]
    known = every.select(F.col("path").alias("key"), both.alias("rule")).unionByName(spark.createDataFrame(fixed, "key string, rule string"))
    if listed is not None:
        known = known.unionByName(listed.select(F.concat(F.lit("/"), "catalog", F.lit("/index.md")).alias("key"), F.lit("broken_href").alias("rule")))
    if root is not None:
        known = known.unionByName(root.select(F.col("path").alias("key"), F.lit("broken_href").alias("rule")))
    missing = cut(asked.select("rule", "key").distinct().join(looked_up(known, "rule", "key"), ["rule", "key"], "left_anti"))
    found = [own.filter(F.col("key").isNull()), asked.join(missing, ["rule", "key"], "left_semi")]
    found = [f.select("path", "severity", "rule", "detail") for f in found]
    if listed is not None:
        found.append(_finding(missing_structure(spark, every, listed).withColumn("path", F.lit("/")), "warning", "missing_structure", "path",
                              F.concat_ws(":", "kind", "name")))
    if root is not None:
        found.append(root_findings(root))
    return reduce(DataFrame.unionByName, found)


def capped_samples(findings: DataFrame, kind: str, order: list[str], n: int) -> DataFrame:
    """First ``n`` findings per kind, each with its kind's true total."""
    totals = findings.groupBy(kind).agg(F.count(F.lit(1)).alias("total"))
    ranked = findings.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n).join(totals, kind)


def header_rules(spark: SparkSession) -> DataFrame:
    """``type, field, check, allowed`` of every header rule."""
    rows = []
    for type_ in model.TYPE_TO_CATALOG:
        if type_ == "WriteEvent":
            continue
        strict = type_ not in model.PLAIN_TYPES
        strings = [*model.COMMON_STRINGS, *model.TYPE_STRINGS.get(type_, ())]
        enums = dict(model.TYPE_ENUMS.get(type_, {}))
        if strict:
            enums |= {"status": model.STATUS_VALUES, "truth_state": model.TRUTH_VALUES, "cloud": model.CLOUD_VALUES}
        rows += [(type_, f, "required", None) for f in ("type", "title")]
        rows += [(type_, f, "string", None) for f in strings]
        rows += [(type_, f, "enum", list(v)) for f, v in enums.items()]
        rows += [(type_, f, "number", None) for f in model.TYPE_NUMBERS.get(type_, ())]
        rows += [(type_, f, "integer", None) for f in model.TYPE_INTEGERS.get(type_, ())]
        rows += [(type_, f, "boolean", None) for f in (*model.COMMON_BOOLEANS, *model.TYPE_BOOLEANS.get(type_, ()))]
        rows += [(type_, f, "array", None) for f in (*model.COMMON_ARRAYS, *model.TYPE_ARRAYS.get(type_, ()))]
        if type_ != "IngestionJob":
            rows.append((type_, "links", "link_target", None))
    return spark.createDataFrame(rows, "type string, field string, check string, allowed array<string>")


def check_headers(concepts: DataFrame, rules: DataFrame, *, strict_unknown: bool = False) -> DataFrame:
    """``path, type, field, check`` of broken header rules.

    ``fields`` maps a key to its value as text and ``kinds`` to the kind it
    was written as (string, number, integer, boolean, array, object);
    ``untargeted_links`` counts links without a target.  Rules are grouped per
    type (some thirty rows) and evaluated inside the asset scan.
    """
    grouped = rules.groupBy("type").agg(
        F.collect_list(F.struct("field", "check", "allowed")).alias("rules")
    )
    value = lambda r: F.col("fields")[r["field"]]
    kind = lambda r: F.col("kinds")[r["field"]]

    def broken(r: Column) -> Column:
        check = r["check"]
        filled = F.coalesce(value(r), F.lit("")) != ""
        present = kind(r).isNotNull()
        wrong = (
            F.when(check == "required", ~filled)
            .when(check == "enum", filled & ~F.array_contains(r["allowed"], value(r)))
            .when(check == "number", present & ~kind(r).isin("number", "integer", "null"))
            .when(check == "link_target", F.col("untargeted_links") > 0)
            .otherwise(present & (kind(r) != check))
        )
        return F.coalesce(wrong, F.lit(False))

    typed = concepts.filter(F.coalesce("type", F.lit("")) != "")
    # One row a type: assets are not dealt out by their few types.
    failures = typed.join(F.broadcast(grouped), "type").select(
        "path", "type", F.explode(F.filter("rules", broken)).alias("r")
    ).select("path", "type", F.col("r.field").alias("field"), F.col("r.check").alias("check"))
    untyped = concepts.filter(F.coalesce("type", F.lit("")) == "").select(
        "path", "type", F.lit("type").alias("field"), F.lit("required").alias("check")
    )
    failures = failures.unionByName(untyped)
    if strict_unknown:
        unknown = typed.join(grouped.select("type"), "type", "left_anti").select(
            "path", "type", F.lit("type").alias("field"), F.lit("unknown_type").alias("check")
        )
        failures = failures.unionByName(unknown)
    return failures


def type_histogram(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy(F.coalesce("type", F.lit("?")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def layer_histogram(concepts: DataFrame) -> DataFrame:
    return concepts.filter(F.col("type").isin("Table", "View")).groupBy(
        F.coalesce("layer", F.lit("—")).alias("layer")
    ).agg(F.count(F.lit(1)).alias("n"))


def tall_metrics(row: DataFrame) -> DataFrame:
    """One-row frame of numbers -> ``metric, value``."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns
    ])))


def pivot_metrics(tall: DataFrame, names: list[str]) -> DataFrame:
    """``metric, value`` rows -> one row, a column per name."""
    return tall.agg(*[
        F.coalesce(F.max(F.when(F.col("metric") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in names
    ])


def business_coverage(objects: Column, tables: Column) -> Column:
    return F.when(tables > 0, F.round(objects / tables, 2)).otherwise(F.lit(0.0))


def health(concepts: DataFrame, links: DataFrame, edges: DataFrame, *, listed: DataFrame, root: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: asset, edge, orphan and error counts, coverage and density.

    ``manifest`` is that of the search index, without a row where none was built.
    """
    is_type = lambda t: F.count_if(F.col("type") == t)
    n = F.count(F.lit(1))
    findings = validate(concepts, links, listed=listed, root=root)
    parts = [
        manifest.agg(n.alias("manifests")),
        concepts.agg(n.alias("concept_count"), is_type("Table").alias("tables"),
                     is_type("BusinessObject").alias("business_objects"), is_type("GlossaryTerm").alias("glossary_terms")),
        edges.agg(n.alias("edge_count")),
        orphans(concepts, edges).agg(n.alias("orphan_count")),
        findings.agg(F.count_if(F.col("severity") == "error").alias("error_count"),
                     F.count_if(F.col("severity") == "warning").alias("warning_count")),
    ]
    names = [c for p in parts for c in p.columns]
    row = pivot_metrics(reduce(DataFrame.unionByName, [tall_metrics(p) for p in parts]), names)
    return row.select(
        *[F.col(c).cast("bigint").alias(c) for c in names if c != "manifests"],
        business_coverage(F.col("business_objects"), F.col("tables")).alias("business_coverage"),
        F.round(F.col("edge_count") / F.greatest("tables", F.lit(1.0)), 6).alias("density"),
        (F.col("manifests") > 0).alias("index_built"),
        (F.col("error_count") == 0).alias("validation_ok"),
    )

