"""Reviewer rules and name resolution as joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegraph import model
from lakegraph.functions import naming, text
from lakegraph.operators import catalog, graph, quality, resolve
from lakegraph.plans.registry import (
    first_seen_sql, last_sql, layer_sql, query, quoted, refs_sql, slug_sql, targets_sql, with_parts,
)
from lakegraph.plans.sources import _harvest, _harvest_sql
from lakegraph.session import cut
from lakegraph.sources import bundle, derive, lake

C = F.col

_KNOWN = "SELECT path FROM concepts UNION ALL SELECT unnest([" + quoted(
    ["/index.md", "/log.md", *(f"/{c}/index.md" for c in model.CATALOGS)]
) + "])"


@query("j01_broken_links", with_parts("concepts links", f"""
SELECT src, rel, target FROM links WHERE target NOT IN ({_KNOWN})
"""))
def j01(spark, sf):
    return quality.broken_links(derive.links(spark, sf), derive.concepts(spark, sf))


@query("j02_broken_hrefs", r"""
WITH hrefs AS (
  SELECT page_id AS src, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '[#?].*$', '') AS href FROM pages
), paths AS (SELECT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT src, href FROM hrefs WHERE regexp_matches(href, '^/[^/]') AND href NOT IN (SELECT path FROM paths)
""")
def j02(spark, sf):
    pages = derive.table(spark, sf, "pages")
    hrefs = bundle.body_links(pages, "page_id", "html", model.HTML_HREF, 1).withColumnRenamed("page_id", "src")
    paths = pages.select(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    return quality.broken_hrefs(hrefs, paths).select("src", "href")


@query("j03_orphans", with_parts("concepts links edges nodes", """
SELECT path, type FROM concepts WHERE type IN ('Table', 'View', 'Query', 'BusinessObject') AND path NOT IN (SELECT node FROM nodes)
"""))
def j03(spark, sf):
    return quality.orphans(derive.concepts(spark, sf), graph.flow_edges(derive.links(spark, sf)))


@query("j04_stub_tables", with_parts("statements", f"""
WITH reads AS (
  SELECT path, {layer_sql('path')} AS layer, unnest({refs_sql('sql')}) AS ref FROM statements
), written AS (SELECT unnest({targets_sql('sql')}) AS name FROM statements),
readers AS (
  SELECT {last_sql('ref')} AS name, path, layer, ref,
         row_number() OVER (PARTITION BY {last_sql('ref')} ORDER BY path, layer, ref) AS n FROM reads
), stubs AS (
  SELECT name, path AS referenced_by,
         CASE WHEN lower(split_part(ref, '.', 1)) IN ('raw', 'bronze', 'silver', 'gold') AND contains(ref, '.') THEN lower(split_part(ref, '.', 1))
              WHEN layer IN ('silver', 'gold') THEN 'bronze' ELSE layer END AS layer
  FROM readers WHERE n = 1 AND name NOT IN (SELECT name FROM written)
)
SELECT name, layer, '/tables/' || {slug_sql("layer || '-' || name")} || '.md' AS path, referenced_by FROM stubs
"""))
def j04(spark, sf):
    placed = derive.statements(spark, sf).withColumn("layer", naming.infer_layer(C("path")))
    return resolve.stub_tables(placed)


_NAMES = f"""
SELECT DISTINCT name FROM (
  SELECT {last_sql('ref')} AS name FROM (SELECT unnest(list_concat({refs_sql('sql')}, {targets_sql('sql')})) AS ref FROM statements) a
) b
"""


def _resolution_sql(match: str) -> str:
    return f"""
WITH names AS ({_NAMES}), keys AS (SELECT name, replace(lower(name), '_', '-') AS key FROM names),
targets AS (SELECT path, stem, CASE catalog WHEN 'tables' THEN 0 WHEN 'views' THEN 1 ELSE 2 END AS cat
            FROM concepts WHERE catalog IN ('tables', 'views', 'queries')),
matches AS (
  SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY cat, loose, path) AS n FROM ({match}) m
)
SELECT name, path FROM matches WHERE n = 1
"""


# All dash suffixes of a stem (at most three words in the derived data).
_SUFFIX_MATCH = """
SELECT name, path, cat, 0 AS loose FROM keys JOIN targets ON stem = key
UNION ALL SELECT name, path, cat, 1 FROM keys JOIN targets ON regexp_replace(stem, '^[^-]*-', '') = key AND contains(stem, '-')
UNION ALL SELECT name, path, cat, 1 FROM keys JOIN targets ON regexp_replace(stem, '^.*-', '') = key AND contains(stem, '-')
"""


def _statement_names(spark, sf):
    statements = derive.statements(spark, sf)
    return statements.select(F.explode(F.array_union(
        resolve.sql_sources(C("sql")), resolve.sql_targets(C("sql"))
    )).alias("name")).distinct()


@query("j05_name_resolution", with_parts("concepts statements", _resolution_sql(_SUFFIX_MATCH)))
def j05(spark, sf):
    return resolve.resolve_names(_statement_names(spark, sf), derive.concepts(spark, sf))


@query("j05_containing_names", with_parts("concepts", """
WITH names AS (SELECT DISTINCT 'er_' || CAST(o_custkey AS VARCHAR) AS name FROM orders),
keys AS (SELECT name, replace(lower(name), '_', '-') AS key FROM names),
targets AS (SELECT path, stem, CASE catalog WHEN 'tables' THEN 0 WHEN 'views' THEN 1 ELSE 2 END AS cat
            FROM concepts WHERE catalog IN ('tables', 'views', 'queries')),
matches AS (
  SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY cat, loose, path) AS n
  FROM (SELECT name, path, cat, CASE WHEN stem = key THEN 0 WHEN ends_with(stem, '-' || key) THEN 1 ELSE 2 END AS loose
        FROM keys JOIN targets ON contains(stem, key)) m
)
SELECT name, path FROM matches WHERE n = 1
"""))
def j05_containing(spark, sf):
    """Abbreviated names (``er_12`` for order 12) that only a contains match finds."""
    names = derive.table(spark, sf, "orders").select(
        F.concat(F.lit("er_"), C("o_custkey").cast("string")).alias("name")
    ).distinct()
    return resolve.resolve_names(names, derive.concepts(spark, sf), contains=True)


@query("w03_best_candidate", with_parts("concepts", """
SELECT name, path FROM (
  SELECT stem AS name, path, row_number() OVER (PARTITION BY stem ORDER BY
    CASE catalog WHEN 'tables' THEN 0 WHEN 'views' THEN 1 ELSE 2 END, loose, path) AS n
  FROM (
    SELECT a.stem, b.path, b.catalog, 0 AS loose FROM concepts a JOIN concepts b ON a.stem = b.stem
    UNION ALL
    SELECT a.stem, b.path, b.catalog, 1 FROM concepts a JOIN concepts b
      ON a.stem = regexp_replace(b.stem, '^[^-]*-', '') AND contains(b.stem, '-')
  ) x WHERE catalog IN ('tables', 'views', 'queries')
) y WHERE n = 1
"""))
def w03(spark, sf):
    concepts = derive.concepts(spark, sf)
    return resolve.resolve_names(concepts.select(C("stem").alias("name")), concepts)


SUBJECTS = ["order_7", "NATION_3", "silver red table", "landing of nothing", "/tables/gold-order-3.md",
            "reports/weekly.md", "region-2.md", "Customer#000000005", "dashboard of asia", "supplier"]


def _subject_rows() -> str:
    rows = []
    for s in SUBJECTS:
        bare = s.removesuffix(".md").rsplit("/", 1)[-1] if s.endswith(".md") else s
        given = "/" + s.lstrip("/") if s.endswith(".md") and "/" in s else None
        words = [t for w, t in model.SUBJECT_TYPE_WORDS.items() if w in s.lower()]
        fallback = next((c for ws, c in model.SUBJECT_CATALOG_WORDS if any(w in s.lower() for w in ws)), "tables")
        rows.append(f"('{s}', '{bare}', {repr(given) if given else 'NULL'}, '{fallback}', [{quoted(words)}]::VARCHAR[])")
    return ", ".join(rows)


@query("j06_subject_resolution", with_parts("concepts", f"""
WITH asked(subject, bare, given, fallback, words) AS (VALUES {_subject_rows()}),
slugs AS (SELECT *, {slug_sql('bare')} AS slug FROM asked),
cards AS (SELECT path, stem, type, {slug_sql("coalesce(title, '')")} AS ts FROM concepts),
scored AS (
  SELECT subject, path, (CASE WHEN contains(stem, slug) THEN 3 ELSE 0 END) + (CASE WHEN ts = slug THEN 4 ELSE 0 END)
         + (CASE WHEN contains(ts, slug) OR contains(slug, ts) THEN 1 ELSE 0 END)
         + 2 * len(list_filter(words, lambda w: w = type)) AS score
  FROM slugs, cards WHERE given IS NULL
), best AS (
  SELECT subject, path, score, row_number() OVER (PARTITION BY subject ORDER BY score DESC, path) AS n FROM scored WHERE score > 0
)
SELECT s.subject, coalesce(s.given, b.path, '/' || s.fallback || '/' || {slug_sql('s.bare')} || '.md') AS path,
       coalesce(b.score, 0) AS score
FROM slugs s LEFT JOIN best b ON b.subject = s.subject AND b.n = 1
"""))
def j06(spark, sf):
    return resolve.resolve_subjects(SUBJECTS, derive.concepts(spark, sf))


@query("j09_gold_without_object", with_parts("concepts links", """
SELECT path, title FROM concepts WHERE type = 'Table' AND status <> 'skip'
  AND (coalesce(layer, '') = 'gold' OR contains(path, 'gold') OR contains(path, '/mart'))
  AND path NOT IN (SELECT target FROM links WHERE rel = 'derived_from')
  AND path NOT IN (SELECT src FROM links WHERE rel = 'businessizes')
"""))
def j09(spark, sf):
    return quality.gold_without_object(derive.concepts(spark, sf), derive.links(spark, sf))


@query("j10_unlanded_streams", with_parts("concepts links edges nodes", """
WITH s AS (
  SELECT path, path IN (SELECT node FROM nodes) AS in_graph,
         path IN (SELECT l.src FROM links l JOIN concepts t ON t.path = l.target
                  WHERE l.rel IN ('lands_as', 'feeds') AND t.type = 'Table') AS lands
  FROM concepts WHERE type = 'SourceSystem' AND kind = 'stream'
)
SELECT path, in_graph, lands FROM s WHERE NOT (in_graph AND lands)
"""))
def j10(spark, sf):
    links = derive.links(spark, sf)
    return quality.unlanded_streams(derive.concepts(spark, sf), links, graph.flow_edges(links, repeated=True))


@query("j11_jobs_without_output", with_parts("concepts links", """
SELECT path, type FROM concepts WHERE type IN ('Workflow', 'Transformation', 'IngestionJob')
  AND path NOT IN (SELECT src FROM links WHERE rel IN ('writes_to', 'lands_as', 'lands_into'))
"""))
def j11(spark, sf):
    return quality.jobs_without_output(derive.concepts(spark, sf), derive.links(spark, sf))


@query("j12_fake_streams", with_parts("concepts links", """
SELECT path, title FROM concepts WHERE type = 'SourceSystem' AND kind = 'stream' AND path NOT IN (
  SELECT l.target FROM links l JOIN concepts j ON j.path = l.src
  WHERE j.type = 'IngestionJob' AND j.mode IN ('streaming', 'microbatch', 'cdc')
    AND l.rel IN ('ingests_from', 'consumes_stream', 'reads_from'))
"""))
def j12(spark, sf):
    return quality.fake_streams(derive.concepts(spark, sf), derive.links(spark, sf))


STATEMENT_EDGES_SQL = f"""
pairs AS (
  SELECT DISTINCT source, target FROM (
    SELECT target, {last_sql('ref')} AS source FROM (
      SELECT target, unnest({refs_sql('sql')}) AS ref FROM (SELECT sql, unnest({targets_sql('sql')}) AS target FROM statements) t
    ) u
  ) v WHERE source <> target
), resolved AS ({_resolution_sql(_SUFFIX_MATCH)}), sql_edges AS (
  SELECT DISTINCT a.path AS src, b.path AS dst FROM pairs
  JOIN resolved a ON a.name = source JOIN resolved b ON b.name = pairs.target WHERE a.path <> b.path
)
"""


@query("j13_edges_without_evidence", with_parts("concepts links edges statements", f"""
WITH {STATEMENT_EDGES_SQL}, declared AS (
  SELECT l.* FROM links l JOIN concepts c ON c.path = l.src
  WHERE c.type IN ('Workflow', 'Transformation', 'IngestionJob', 'Query', 'View', 'SqlArtifact')
), job_edges AS (
  SELECT CASE WHEN rel IN ({quoted(model.REVERSE_FLOW)}) THEN target ELSE src END AS src,
         CASE WHEN rel IN ({quoted(model.REVERSE_FLOW)}) THEN src ELSE target END AS dst
  FROM declared WHERE rel IN ({quoted(model.FORWARD_FLOW + model.REVERSE_FLOW)})
)
SELECT src, dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM sql_edges s WHERE s.src = e.src AND s.dst = e.dst)
  AND NOT EXISTS (SELECT 1 FROM job_edges j WHERE j.src = e.src AND j.dst = e.dst)
"""))
def j13(spark, sf):
    concepts, links = derive.concepts(spark, sf), derive.links(spark, sf)
    proven = resolve.resolved_statement_edges(derive.statements(spark, sf), concepts)
    return quality.edges_without_evidence(graph.flow_edges(links), proven, quality.job_edges(concepts, links))


# Storage zones that suppliers are said to feed; some jobs name both ends, of others only one or none.
_ZONE_EDGES = f"""
SELECT DISTINCT {derive._supplier_path('l_suppkey')} AS src, '/storage/zone-' || CAST(p_size AS STRING) || '.md' AS dst
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE (l_partkey + l_suppkey) % 8 = 0
"""


@query("j13_joint_evidence", with_parts("concepts links", f"""
WITH zone_edges AS ({derive.for_engine(_ZONE_EDGES)}), named AS (
  SELECT DISTINCT l.src AS job, l.target AS node FROM links l JOIN concepts c ON c.path = l.src
  WHERE c.type IN ('Workflow', 'Transformation', 'IngestionJob', 'Query', 'View', 'SqlArtifact')
)
SELECT src, dst, EXISTS (SELECT 1 FROM named a JOIN named b ON a.job = b.job
  WHERE a.node = src AND b.node = dst AND a.job <> src AND a.job <> dst) AS proven FROM zone_edges
"""))
def j13_joint(spark, sf):
    """Edges to storage zones, and whether a third job links to both ends."""
    edges = cut(derive._run(spark, sf, _ZONE_EDGES))
    proven = quality.jointly_named_edges(edges, derive.concepts(spark, sf), derive.links(spark, sf))
    return edges.join(proven.withColumn("proven", F.lit(True)), ["src", "dst"], "left").fillna(False, ["proven"])


@query("j14_phantom_nodes", with_parts("concepts links edges nodes", """
SELECT node FROM nodes WHERE node NOT IN (SELECT path FROM concepts)
"""))
def j14(spark, sf):
    return quality.phantom_nodes(graph.flow_edges(derive.links(spark, sf)), derive.concepts(spark, sf))


@query("j14_unsourced_tables", with_parts("concepts statements", """
SELECT path, stem FROM concepts WHERE type IN ('Table', 'View')
  AND stem NOT IN (SELECT 'gold-' || replace(stem, '_', '-') FROM statements)
"""))
def j14_unsourced(spark, sf):
    found = derive.statements(spark, sf).select(
        F.concat(F.lit("gold-"), F.replace("stem", F.lit("_"), F.lit("-"))).alias("stem")
    )
    return quality.unsourced_tables(derive.concepts(spark, sf), found)


@query("j15_layer_mismatch", with_parts("statements", f"""
SELECT path, declared_layer AS declared, {layer_sql('path')} AS implied FROM statements
WHERE declared_layer IS NOT NULL AND declared_layer <> {layer_sql('path')}
"""))
def j15(spark, sf):
    return quality.layer_mismatches(derive.statements(spark, sf))


@query("j16_unbound_measures", with_parts("concepts links", """
SELECT path, type FROM concepts WHERE type IN ('Metric', 'Dashboard') AND path NOT IN (
  SELECT l.src FROM links l JOIN concepts t ON t.path = l.target WHERE t.type IN ('Table', 'View', 'Metric'))
"""))
def j16(spark, sf):
    return quality.unbound_measures(derive.concepts(spark, sf), derive.links(spark, sf))


@query("j17_promotions", """
WITH t AS (SELECT DISTINCT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'gold' WHEN 'P' THEN 'silver' ELSE
             CASE WHEN o_orderkey % 2 = 0 THEN 'bronze' ELSE 'raw' END END AS layer FROM orders),
o AS (SELECT o_custkey, layer, list_position(['raw', 'bronze', 'silver', 'gold'], layer) AS p FROM t),
l AS (SELECT o_custkey, layer, lead(layer) OVER (PARTITION BY o_custkey ORDER BY p) AS nxt FROM o)
SELECT 'sales-' || CAST(o_custkey AS VARCHAR) AS base, layer AS from_layer, nxt AS to_layer FROM l WHERE nxt IS NOT NULL
""")
def j17(spark, sf):
    layer = (
        F.when(C("o_orderstatus") == "F", "gold").when(C("o_orderstatus") == "P", "silver")
        .when(C("o_orderkey") % 2 == 0, "bronze").otherwise("raw")
    )
    paths = derive.table(spark, sf, "orders").select(F.concat(
        F.lit("/tables/"), layer, F.lit("-sales-"), C("o_custkey").cast("string"), F.lit(".md")
    ).alias("path"))
    layer, base = catalog.layered_name(C("path"))
    return catalog.promotions(paths.select(layer.alias("layer"), base.alias("base")))


@query("j18_missing_structure", with_parts("concepts", """
SELECT 'catalog' AS kind, catalog AS name FROM (SELECT DISTINCT catalog FROM concepts) c WHERE catalog NOT IN ('tables', 'views')
UNION ALL SELECT 'layer', unnest(['bronze', 'silver', 'gold'])
"""))
def j18(spark, sf):
    listed = derive.concepts(spark, sf).filter(C("catalog").isin("tables", "views")).select("catalog").distinct()
    return quality.missing_structure(spark, derive.concepts(spark, sf), listed)


@query("j19_schema_drift", f"""
WITH h AS ({_harvest_sql()}), actual AS (SELECT table_name, column_name, data_type, null_count > 0 AS nullable FROM h),
captured AS (
  SELECT table_name, CASE WHEN column_name = 'o_totalprice' THEN 'o_amount' ELSE column_name END AS column_name,
         CASE WHEN data_type = 'int' THEN 'bigint' ELSE data_type END AS data_type,
         column_name = 'event_type' OR null_count > 0 AS nullable, column_name IN ('text', 'c_name') AS pii FROM h
)
SELECT coalesce(c.table_name, a.table_name) AS table_name, coalesce(c.column_name, a.column_name) AS column_name,
       CASE WHEN a.data_type IS NULL THEN 'missing' WHEN c.data_type IS NULL THEN 'extra'
            WHEN a.data_type <> c.data_type THEN 'type' WHEN a.nullable <> c.nullable THEN 'nullability' ELSE 'none' END AS drift,
       coalesce(c.pii, false) AS pii
FROM captured c FULL OUTER JOIN actual a ON a.table_name = c.table_name AND a.column_name = c.column_name
WHERE a.data_type IS NULL OR c.data_type IS NULL OR a.data_type <> c.data_type OR a.nullable <> c.nullable OR c.pii
""")
def j19(spark, sf):
    """Captured columns that renamed one column, widened integers and misjudged one null rule."""
    actual = cut(_harvest(spark, sf).select(
        "table_name", "column_name", "data_type", (C("null_count") > 0).alias("nullable")
    ))
    captured = actual.select(
        "table_name",
        F.when(C("column_name") == "o_totalprice", "o_amount").otherwise(C("column_name")).alias("column_name"),
        F.when(C("data_type") == "int", "bigint").otherwise(C("data_type")).alias("data_type"),
        ((C("column_name") == "event_type") | C("nullable")).alias("nullable"),
        C("column_name").isin("text", "c_name").alias("pii"),
    )
    return quality.schema_drift(captured, actual)
