"""Source operators over derived asset files, statements and the real tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegraph import model
from lakegraph.functions import sqltext
from lakegraph.plans.registry import (
    first_seen_sql, last_sql, layer_sql, query, refs_sql, with_parts,
)
from lakegraph.session import cut, scratch_path
from lakegraph.sources import bundle, derive, lake

C = F.col


def asset_text():
    """A concept row as the text of its asset file, with one flow link and one plain link."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    return F.concat_ws(
        "\n", F.lit("---"), line("type", C("type")),
        F.when(C("title").isNotNull(), line("title", q(C("title")))),
        F.when(C("description").isNotNull(), line("description", q(C("description")))),
        F.when(C("layer").isNotNull(), line("layer", C("layer"))), line("status", C("status")),
        line("verified", F.lit("true")), F.when(C("kind").isNotNull(), line("source_kind", C("kind"))),
        F.when(C("mode").isNotNull(), line("ingestion_mode", C("mode"))), F.when(C("fqn").isNotNull(), line("fqn", C("fqn"))),
        F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")),
        F.lit("links:"), F.concat(F.lit("- target: /"), C("catalog"), F.lit("/index.md")), F.lit("  rel: cataloged_in"),
        F.when(C("bad_links") > 0, F.array_join(F.array_repeat(F.lit("- loose"), C("bad_links")), "\n")),
        F.lit("- target: /layers/silver.md"), F.lit("  rel: layered_as"),
        F.lit("---"), F.lit(""), C("body"),
    )


_PARSED_SQL = with_parts("concepts", r"""
SELECT path, catalog, stem, type, coalesce(title, '') AS title, coalesce(description, '') AS description,
       coalesce(layer, '') AS layer, status, true AS verified, coalesce(kind, '') AS source_kind,
       array_to_string(tags, '|') AS tags, CAST(2 AS BIGINT) AS link_count, '/' || catalog || '/index.md' AS first_target,
       'layered_as' AS last_rel, sha256(regexp_replace(body, '^\s+', '')) AS body_hash
FROM concepts""")


def _parsed_columns(concepts):
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return concepts.select(
        "path", "catalog", "stem", "type", blank("title"), blank("description"), blank("layer"), "status", "verified",
        F.coalesce(C("extra")["source_kind"], F.lit("")).alias("source_kind"),
        F.array_join("tags", "|").alias("tags"), F.size("links").cast("bigint").alias("link_count"),
        F.get("links", F.lit(0))["target"].alias("first_target"), F.element_at("links", -1)["rel"].alias("last_rel"),
        F.sha2("body", 256).alias("body_hash"),
    )


def derived_files(assets, root: str) -> None:
    """One file per asset below ``root``."""
    assets.select("catalog", "stem", asset_text().alias("value")).write.partitionBy("catalog", "stem").text(root)


@query("s01_bundle_scan", with_parts("concepts", """
SELECT path, type, title, description, array_to_string(tags, '|') AS tags FROM concepts
"""))
def s01(spark, sf):
    """All derived assets, written many to a file and scanned back."""
    root = scratch_path(spark, "assets")
    bundle.write_packed(derive.concepts(spark, sf).select("path", asset_text().alias("text")), root)
    files = bundle.scan_packed(spark, root).filter(bundle.is_asset_file(C("path")))
    concepts, _ = bundle.parse_concepts(files)
    return concepts.select("path", "type", "title", "description", F.array_join("tags", "|").alias("tags"))


@query("s02_header_fields", _PARSED_SQL)
def s02(spark, sf):
    """Every derived asset rendered as file text and taken apart again."""
    files = derive.concepts(spark, sf).select("path", asset_text().alias("text"))
    concepts, _ = bundle.parse_concepts(files)
    return _parsed_columns(concepts)


@query("s03_link_explode", """
SELECT CAST(l_orderkey AS BIGINT) AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos,
       '/queries/part-' || CAST(l_partkey AS VARCHAR) || '.md' AS target, CASE WHEN l_linenumber % 2 = 1 THEN 'reads_from' ELSE 'depends_on' END AS rel
FROM lineitem
""")
def s03(spark, sf):
    """All lines of every order as links."""
    link = F.struct("l_linenumber", "l_partkey")
    ordered = derive.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(link)).alias("lines"))
    nested = ordered.select(C("l_orderkey").alias("path"), F.transform("lines", lambda l: F.struct(
        F.concat(F.lit("/queries/part-"), l["l_partkey"].cast("string"), F.lit(".md")).alias("target"),
        F.when(l["l_linenumber"] % 2 == 1, "reads_from").otherwise("depends_on").alias("rel"),
    )).alias("links"))
    return bundle.explode_links(nested).select(
        C("src").cast("bigint").alias("order_id"), C("pos").cast("bigint").alias("pos"), "target", "rel"
    )


@query("s04_body_links", """
SELECT page_id, href FROM (
  SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '[#?].*$', '') AS href FROM pages
) x WHERE starts_with(href, '/') AND NOT starts_with(href, '//')
""")
def s04(spark, sf):
    return bundle.body_links(derive.table(spark, sf, "pages"), "page_id", "html", model.HTML_HREF, 1)


@query("s05_sql_block", with_parts("statements", "SELECT path, sql || chr(10) AS block FROM statements"))
def s05(spark, sf):
    body = F.concat(F.lit("# Query\n\n```SQL\n"), C("sql"), F.lit("\n```\n\n```sql\nSELECT 2\n```\n"))
    return derive.statements(spark, sf).select("path", sqltext.first_sql_block(body).alias("block"))


_CLASSIFIED = rf"""
SELECT s.path, s.stem, {layer_sql('s.path')} AS layer,
       (contains(lower(sql), 'create view') OR regexp_matches(lower(sql), 'create\s+or\s+replace\s+view')
        OR contains(lower(s.path), '/views/')) AS is_view,
       (contains(lower(sql), 'create table') OR contains(lower(sql), 'insert into') OR contains(lower(sql), 'merge into')
        OR contains(lower(sql), 'create or replace table')) AS writes_table,
       coalesce(f.names, '') AS refs
FROM statements s LEFT JOIN ({first_seen_sql(
    f"SELECT path, list_transform({refs_sql('sql')}, lambda n: {last_sql('n')}) AS items FROM statements", "path", "name")}) f
  ON f.path = s.path
"""


def _classified(spark, sf):
    return lake.classify_statements(derive.statements(spark, sf).select("path", C("sql").alias("text")))


@query("s06_sql_corpus", with_parts("statements", _CLASSIFIED))
def s06(spark, sf):
    return _classified(spark, sf).select(
        "path", "stem", "layer", "is_view", "writes_table", F.array_join("refs", ",").alias("refs")
    )


# Dataset folders and the table each holds; names that start with an underscore are no datasets.
_DATASETS = {"gold/nation": "nation", "staging/erp/region": "region", "raw/supplier": "supplier", "misc/part": "part", "gold/_tmp": "region"}


@query("s07_parquet_datasets", """
SELECT '/gold/nation' AS folder, 'nation' AS name, 'gold' AS layer, count(*) AS n FROM nation
UNION ALL SELECT '/staging/erp/region', 'region', 'bronze', count(*) FROM region
UNION ALL SELECT '/raw/supplier', 'supplier', 'raw', count(*) FROM supplier
UNION ALL SELECT '/misc/part', 'part', 'silver', count(*) FROM part
""")
def s07(spark, sf):
    """Tables written below a lake folder, listed as datasets and counted from the listed folders."""
    root = scratch_path(spark, "lake")
    for folder, table in _DATASETS.items():
        derive.table(spark, sf, table).write.parquet(f"{root}/{folder}")
    rows = spark.read.option("recursiveFileLookup", True).schema("n int").parquet(root).select(
        F.regexp_replace(bundle.relative_path(C("_metadata.file_path"), root), r"/[^/]*$", "").alias("folder"))
    counted = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    return lake.parquet_datasets(spark, root).join(counted, "folder").select("folder", "name", "layer", "n")


_TABLE_COLUMNS = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double "
                "l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "embeddings": "vec_id:bigint embedding:array<float> label:int",
    "pages": "page_id:bigint url:string html:string",
    "benchmark": "item_id:bigint text:string",
    "labels": "doc_id:bigint quality:int toxic:int",
    "conversations": "conv_id:bigint turn:bigint role:string text:string",
}


def _harvest_sql() -> str:
    arms = []
    for table, columns in _TABLE_COLUMNS.items():
        for i, spec in enumerate(columns.split()):
            name, type_ = spec.split(":")
            arms.append(
                f"SELECT '{table}' AS table_name, CAST({i} AS BIGINT) AS position, '{name}' AS column_name, "
                f"'{type_}' AS data_type, count(*) AS row_count, count(*) - count({name}) AS null_count FROM {table}"
            )
    return " UNION ALL ".join(arms)


def _harvest(spark, sf):
    return lake.harvest_footers(spark, {t: f"{sf.rstrip('/')}/{t}.parquet" for t in _TABLE_COLUMNS})


@query("s08_table_columns", _harvest_sql())
def s08(spark, sf):
    return _harvest(spark, sf).select("table_name", "position", "column_name", "data_type", "row_count", "null_count")


@query("s08_column_links", f"""
WITH cols AS ({_harvest_sql()})
SELECT DISTINCT '/tables/bronze-' || table_name || '.md' AS src, rel, target FROM (
  SELECT table_name, 'contains' AS rel, '/columns/bronze-' || table_name || '-' || replace(column_name, '_', '-') || '.md' AS target FROM cols
  UNION ALL SELECT table_name, 'layered_as', '/layers/bronze.md' FROM cols
  UNION ALL SELECT table_name, 'defines', '/schemas/sales.md' FROM cols
  UNION ALL SELECT table_name, 'sourced_from', '/sources/erp.md' FROM cols
) x
UNION ALL
SELECT '/columns/bronze-' || table_name || '-' || replace(column_name, '_', '-') || '.md', 'defines', '/tables/bronze-' || table_name || '.md' FROM cols
UNION ALL
SELECT DISTINCT '/schemas/sales.md', 'contains', '/tables/bronze-' || table_name || '.md' FROM cols
""")
def s08_links(spark, sf):
    _, links = lake.column_concepts(cut(_harvest(spark, sf)), "bronze", "sales", "erp")
    return links.select("src", "rel", "target")


@query("s09_discovery_receipt", with_parts("statements", f"""
SELECT CASE WHEN is_view THEN 'view' WHEN writes_table THEN 'table_write' ELSE 'query' END AS kind, layer, count(*) AS n
FROM ({_CLASSIFIED}) c GROUP BY ALL
"""))
def s09(spark, sf):
    return lake.discovery_receipt(_classified(spark, sf))
