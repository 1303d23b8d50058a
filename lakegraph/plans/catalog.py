"""Upserts, audit, listings, link merges and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegraph import model
from lakegraph.operators import catalog
from lakegraph.plans.registry import quoted, query, slug_sql, strip_sql, with_parts
from lakegraph.plans.text import _PROSE, _human_sql
from lakegraph.session import scratch_path
from lakegraph.sources import derive

C = F.col


@query("k06_catalog_listing", with_parts("concepts", f"""
SELECT catalog, path, '- [' || replace(replace(coalesce(title, stem), '[', chr(92) || '['), ']', chr(92) || ']') || '](' || path || ')'
       || CASE WHEN coalesce(layer, '') <> '' AND catalog NOT IN ({quoted(model.UNANNOTATED_CATALOGS)}) THEN ' · ' || layer ELSE '' END AS line
FROM concepts
"""))
def k06(spark, sf):
    return catalog.listing_lines(derive.concepts(spark, sf))


def _snapshots(spark, sf):
    """Documents as written last time, and as found now: some changed, new, gone or only re-stamped."""
    docs = derive.table(spark, sf, "documents")

    def rows(df, key, body, stamp):
        path = F.concat(F.lit("/glossary/document-"), key.cast("string"), F.lit(".md"))
        header = {"title": F.concat(F.lit("Term "), C("lang")), "type": F.lit("GlossaryTerm"), "source": C("source")}
        return df.select(
            path.alias("path"), F.lit("GlossaryTerm").alias("type"), catalog.fingerprint(header, body).alias("fingerprint"),
            F.lit(stamp).alias("timestamp"), C("lang").alias("layer"), "n_chars",
        )

    current = rows(docs.filter(C("doc_id") % 13 != 4), C("doc_id"), C("text"), "2024-01-01T00:00:00Z")
    body = F.when(C("doc_id") % 10 == 3, F.concat("text", F.lit(" revised"))).when(
        C("doc_id") % 10 == 5, F.concat(F.lit("\n"), "text", F.lit("\n\n"))
    ).otherwise(C("text"))
    incoming = rows(docs.filter(C("doc_id") % 17 != 0), C("doc_id"), body, "2024-02-02T00:00:00Z")
    return current, incoming


_UPSERT = """
WITH d AS (
  SELECT '/glossary/document-' || CAST(doc_id AS VARCHAR) || '.md' AS path, doc_id % 13 <> 4 AS had, doc_id % 17 <> 0 AS has,
         doc_id % 10 = 3 AS changed FROM documents
), a AS (
  SELECT path, CASE WHEN NOT has THEN 'kept' WHEN NOT had THEN 'created' WHEN changed THEN 'updated' ELSE 'skipped' END AS action,
         CASE WHEN had THEN '2024-01-01T00:00:00Z' ELSE '2024-02-02T00:00:00Z' END AS timestamp
  FROM d WHERE had OR has
)
"""


@query("k07_upsert", _UPSERT + "SELECT path, action, timestamp FROM a")
def k07(spark, sf):
    return catalog.upsert(*_snapshots(spark, sf)).select("path", "action", "timestamp")


@query("s09_write_receipt", """
WITH d AS (
  SELECT lang AS layer, n_chars < 100 AS bad, doc_id % 13 = 4 AS new, doc_id % 10 = 3 AS changed FROM documents WHERE doc_id % 17 <> 0
)
SELECT 'GlossaryTerm' AS type, layer, count_if(NOT bad AND new) AS created, count_if(NOT bad AND NOT new AND changed) AS updated,
       count_if(NOT bad AND NOT new AND NOT changed) AS skipped, count_if(bad) AS errors
FROM d GROUP BY layer
""")
def s09_receipt(spark, sf):
    """What a batch of documents did, by language as layer; documents of under 100 characters are refused."""
    current, incoming = _snapshots(spark, sf)
    good, bad = incoming.filter(C("n_chars") >= 100), incoming.filter(C("n_chars") < 100)
    _, receipt = catalog.write_upsert(catalog.upsert(current, good), scratch_path(spark, "snapshot"), bad)
    return receipt


@query("k08_audit_events", _UPSERT + """
SELECT left(md5(path || '|batch-7'), 16) AS event_id, '/write-events/' || left(md5(path || '|batch-7'), 16) || '.md' AS path,
       'write GlossaryTerm ' || regexp_replace(path, '^.*/', '') AS title, 'ana' AS author, 'unknown' AS host,
       path AS target, 'documents' AS rel, action
FROM a WHERE action IN ('created', 'updated')
""")
def k08(spark, sf):
    return catalog.audit_events(catalog.upsert(*_snapshots(spark, sf)), "ana", "batch-7")


@query("k09_link_merge", with_parts("concepts links", f"""
WITH pairs(type, rel, back) AS (VALUES {', '.join(str(row) for row in model.INVERSE_RELATIONS)}),
added AS (
  SELECT l.target AS src, p.back AS rel, l.src AS target FROM links l JOIN concepts o ON o.path = l.src
  JOIN pairs p ON p.rel = l.rel AND p.type = o.type WHERE l.target IN (SELECT path FROM concepts)
  UNION SELECT src, rel, target FROM links WHERE rel = 'visualizes'
)
SELECT rel, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT target) AS targets FROM (
  SELECT src, rel, target FROM links UNION SELECT src, rel, target FROM added) m GROUP BY rel
"""))
def k09(spark, sf):
    """All links with their inverses, plus a batch of links that are there already."""
    concepts, links = derive.concepts(spark, sf), derive.links(spark, sf)
    added = catalog.inverse_links(links, concepts).unionByName(links.filter(C("rel") == "visualizes"))
    return catalog.merge_links(links, added).groupBy("rel").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("target").alias("targets")
    )


# Part assets of all types land as order tables; of these only ingestion jobs write back.
_LANDINGS = (
    f"SELECT DISTINCT {derive._part_path('l_partkey')} AS src, 'lands_as' AS rel, {derive._order_path('l_orderkey')} AS target FROM {{lineitem}}"
)


@query("k09_inverse_links", with_parts("concepts links", f"""
SELECT target AS src, 'businessizes' AS rel, src AS target FROM links WHERE rel = 'derived_from' AND target IN (SELECT path FROM concepts)
UNION
SELECT target, b.back, src FROM ({derive.for_engine(_LANDINGS)}) l, (VALUES ('sourced_from'), ('ingested_by')) AS b(back)
WHERE starts_with(src, '/ingestion/') AND target IN (SELECT path FROM concepts) AND src IN (SELECT path FROM concepts)
"""))
def k09_inverse(spark, sf):
    links = derive.links(spark, sf).unionByName(derive._run(spark, sf, _LANDINGS))
    return catalog.inverse_links(links, derive.concepts(spark, sf))


# Fields of assets, one name a row; names are plain or paths.
_FIELDS = f"""
SELECT {derive._order_path('o_orderkey')} AS path, 'Table' AS type, 'layer' AS field, {derive._order_layer('o_orderkey')} AS name FROM {{orders}}
UNION ALL SELECT {derive._order_path('o_orderkey')}, 'Table', 'schema', 'Sales ' || o_orderpriority FROM {{orders}}
UNION ALL SELECT {derive._order_path('l_orderkey')}, 'Table', 'columns', 'order_' || CAST(l_orderkey AS STRING) || '.line ' || CAST(l_linenumber AS STRING) FROM {{lineitem}}
UNION ALL SELECT {derive._part_path('l_partkey')},
    CASE l_partkey % 5 WHEN 0 THEN 'Query' WHEN 1 THEN 'Transformation' WHEN 2 THEN 'Workflow' WHEN 3 THEN 'IngestionJob' ELSE 'View' END,
    CASE l_partkey % 5 WHEN 1 THEN 'inputs' WHEN 3 THEN 'tables' ELSE 'sources' END, {derive._order_path('l_orderkey')}
  FROM (SELECT DISTINCT l_partkey, l_orderkey FROM {{lineitem}}) po
UNION ALL SELECT {derive._customer_path('o_custkey')}, 'BusinessObject', 'sources', {derive._order_path('o_orderkey')} FROM {{orders}}
UNION ALL SELECT '/glossary/document-' || CAST(doc_id AS STRING) || '.md', 'GlossaryTerm', 'objects', 'Customer ' || lang FROM {{documents}}
UNION ALL SELECT '/dashboards/nation-' || CAST(n_nationkey AS STRING) || '.md', 'Dashboard', 'metrics', 'Region ' || CAST(n_regionkey AS STRING) FROM {{nation}}
UNION ALL SELECT '/quality/part-' || CAST(p_partkey AS STRING) || '.md', 'DQRule', 'table', p_brand || ' (' || p_type || ')' FROM {{part}}
"""
_CAPTURED = (
    ("Table", "layer", "layered_as", "layers", None), ("Table", "schema", "defines", "schemas", "contains"),
    ("Table", "columns", "contains", "columns", "defines"), ("Query", "sources", "queries", "tables", None),
    ("Transformation", "inputs", "reads_from", "tables", None), ("View", "sources", "reads_from", "tables", None),
    ("IngestionJob", "tables", "lands_as", "tables", None), ("IngestionJob", "tables", "writes_to", "tables", None),
    ("IngestionJob", "tables", "lands_into", "tables", None), ("BusinessObject", "sources", "derived_from", "tables", None),
    ("GlossaryTerm", "objects", "glosses", "business-objects", None), ("Dashboard", "metrics", "visualizes", "metrics", None),
    ("DQRule", "table", "validates", "tables", None), ("DQRule", "table", "quality_of", "tables", None),
)


@query("k09_captured_links", f"""
WITH fields AS ({derive.for_engine(_FIELDS)}),
rules(type, field, rel, folder, back) AS (VALUES {', '.join(str(r).replace('None', 'NULL') for r in _CAPTURED)}),
named AS (
  SELECT f.path, r.rel, r.back, CASE WHEN starts_with(f.name, '/') THEN f.name ELSE '/' || r.folder || '/' || {slug_sql('f.name')} || '.md' END AS other
  FROM fields f JOIN rules r ON r.type = f.type AND r.field = f.field
)
SELECT path AS src, rel, other AS target FROM named UNION SELECT other, back, path FROM named WHERE back IS NOT NULL
""")
def k09_captured(spark, sf):
    return catalog.captured_links(derive._run(spark, sf, _FIELDS))


_PATH_NODES = f"""
SELECT DISTINCT '/lineage/order-' || CAST(l_orderkey AS STRING) || '.md' AS path,
       CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS pos, {derive._part_path('l_partkey')} AS node FROM {{lineitem}}
"""


@query("k09_lineage_paths", f"""
WITH nodes AS ({derive.for_engine(_PATH_NODES)}), hops AS (
  SELECT a.path, a.node AS before, b.node FROM nodes a JOIN nodes b ON b.path = a.path AND b.pos > a.pos
  WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.path = a.path AND c.pos > a.pos AND c.pos < b.pos)
)
SELECT path AS src, 'contains' AS rel, node AS target FROM nodes UNION SELECT path, 'feeds', node FROM hops
UNION SELECT before, 'feeds', node FROM hops UNION SELECT before, 'transforms_to', node FROM hops
""")
def k09_paths(spark, sf):
    """Each order's lines as a recorded path through its parts."""
    return catalog.lineage_path_links(derive._run(spark, sf, _PATH_NODES))


@query("v09_business_promotion", with_parts("concepts links", f"""
WITH served AS (SELECT DISTINCT target AS path FROM links WHERE rel = 'derived_from'),
named AS (
  SELECT *, {_human_sql('coalesce(title, stem)')} AS name FROM concepts
  WHERE type IN ('Table', 'View') AND layer = 'gold' AND path NOT IN (SELECT path FROM served)
)
SELECT path AS source, name, '/business-objects/' || {slug_sql('name')} || '.md' AS object_path, '/glossary/' || {slug_sql('name')} || '.md' AS term_path,
       sha256(CASE WHEN coalesce(description, '') <> '' AND NOT starts_with(lower(description), 'table ') AND NOT starts_with(lower(description), 'referenced')
         THEN {strip_sql('description')}
         ELSE coalesce({_PROSE}, '**' || name || '**: the business view of `' || coalesce(fqn, title, name) || '`, kept in the ' || coalesce(layer, 'curated') || ' layer.') END) AS definition_hash
FROM named
"""))
def v09(spark, sf):
    """Business objects for gold tables and views, those derived from already left out."""
    concepts, links = derive.concepts(spark, sf), derive.links(spark, sf)
    promoted = catalog.promote_layer(concepts, catalog.inverse_links(links, concepts))
    return promoted.select("source", "name", "object_path", "term_path", F.sha2("definition", 256).alias("definition_hash"))


@query("v09_promotion_links", with_parts("concepts links", f"""
WITH named AS (
  SELECT path, '/business-objects/' || {slug_sql(_human_sql('coalesce(title, stem)'))} || '.md' AS o,
         '/glossary/' || {slug_sql(_human_sql('coalesce(title, stem)'))} || '.md' AS t FROM concepts
  WHERE type IN ('Table', 'View') AND layer = 'gold'
)
SELECT DISTINCT src, rel, target FROM (
  SELECT o AS src, 'derived_from' AS rel, path AS target FROM named UNION ALL SELECT path, 'businessizes', o FROM named
  UNION ALL SELECT o, 'glosses', t FROM named UNION ALL SELECT t, 'glosses', o FROM named) x
"""))
def v09_links(spark, sf):
    concepts, links = derive.concepts(spark, sf), derive.links(spark, sf)
    return catalog.promotion_links(catalog.promote_layer(concepts, links))
