"""A catalog derived from business tables, so that its size follows the data.

Suppliers are source systems, parts are queries and jobs, orders are tables,
customers are business objects, documents are glossary terms.  The texts are
written in the SQL subset Spark and other engines share; ``{table}`` stands
for an input table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakegraph.session import task_count

_PART_TYPE = (
    "CASE p_partkey % 5 WHEN 0 THEN 'Query' WHEN 1 THEN 'Transformation' WHEN 2 THEN 'Workflow' "
    "WHEN 3 THEN 'IngestionJob' ELSE 'View' END"
)


def _part_path(key: str) -> str:
    return (
        f"CASE {key} % 5 WHEN 0 THEN '/queries/part-' WHEN 1 THEN '/transformations/part-' "
        f"WHEN 2 THEN '/workflows/part-' WHEN 3 THEN '/ingestion/part-' ELSE '/views/part-' END "
        f"|| CAST({key} AS STRING) || '.md'"
    )


def _order_layer(key: str) -> str:
    return f"CASE {key} % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'bronze' END"


def _order_path(key: str) -> str:
    return f"'/tables/' || {_order_layer(key)} || '-order-' || CAST({key} AS STRING) || '.md'"


def _supplier_path(key: str) -> str:
    return f"'/sources/supplier-' || CAST({key} AS STRING) || '.md'"


def _customer_path(key: str) -> str:
    return f"'/business-objects/customer-' || CAST({key} AS STRING) || '.md'"


_NONE = "CAST(NULL AS STRING)"

CONCEPTS_SQL = f"""
SELECT {_supplier_path('s_suppkey')} AS path, 'sources' AS catalog,
       'supplier-' || CAST(s_suppkey AS STRING) AS stem, 'SourceSystem' AS type, s_name AS title,
       'Supplier feed of nation ' || CAST(s_nationkey AS STRING) AS description, {_NONE} AS layer,
       'active' AS status, CASE WHEN s_suppkey % 7 = 0 THEN 'stream' ELSE 'database' END AS kind,
       {_NONE} AS mode, 'source|supplier' AS tag_text, {_NONE} AS fqn, '' AS body
FROM {{supplier}}
UNION ALL
SELECT {_part_path('p_partkey')},
       CASE p_partkey % 5 WHEN 0 THEN 'queries' WHEN 1 THEN 'transformations' WHEN 2 THEN 'workflows'
            WHEN 3 THEN 'ingestion' ELSE 'views' END,
       'part-' || CAST(p_partkey AS STRING), {_PART_TYPE},
       CASE WHEN p_partkey % 83 = 0 THEN NULL ELSE p_name || ' ' || CAST(p_partkey AS STRING) END,
       p_type || ' part of ' || p_brand,
       CASE WHEN p_partkey % 5 = 4 THEN CASE WHEN p_partkey % 2 = 0 THEN 'gold' ELSE 'silver' END END,
       CASE WHEN p_partkey % 71 = 0 THEN 'parked' ELSE 'active' END, {_NONE},
       CASE WHEN p_partkey % 5 = 3 THEN
            CASE (p_partkey - p_partkey % 5) % 4 WHEN 0 THEN 'streaming' WHEN 1 THEN 'batch' WHEN 2 THEN 'cdc' ELSE 'sideways' END
       END,
       p_brand || '|part', {_NONE}, '# ' || p_name || chr(10) || chr(10) || 'Size ' || CAST(p_size AS STRING)
FROM {{part}}
UNION ALL
SELECT {_order_path('o_orderkey')}, 'tables',
       {_order_layer('o_orderkey')} || '-order-' || CAST(o_orderkey AS STRING), 'Table',
       'order_' || CAST(o_orderkey AS STRING),
       CASE WHEN o_orderkey % 5 = 0 THEN 'Table of order lines' WHEN o_orderkey % 5 = 1 THEN {_NONE}
            ELSE 'Lines of one order, priority ' || o_orderpriority END,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'raw' ELSE {_order_layer('o_orderkey')} END,
       CASE WHEN o_orderkey % 101 = 0 THEN 'skip' ELSE 'active' END, {_NONE}, {_NONE},
       'table|' || o_orderpriority, {_order_layer('o_orderkey')} || '.order_' || CAST(o_orderkey AS STRING),
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '# Order' || chr(10) || 'Placed by customer ' || CAST(o_custkey AS STRING)
            || ', see [the buyer](/business-objects/' || CASE WHEN o_orderkey % 37 = 0 THEN 'retired-' ELSE 'customer-' END
            || CAST(o_custkey AS STRING) || '.md#orders), [all tables](/tables/index.md) and [all buyers](/business-objects/index.md)' END
FROM {{orders}}
UNION ALL
SELECT {_customer_path('c_custkey')}, 'business-objects', 'customer-' || CAST(c_custkey AS STRING),
       'BusinessObject', c_name,
       CASE WHEN c_custkey % 11 = 0 THEN 'todo' WHEN c_custkey % 13 = 0 THEN 'Data about one of the customers'
            ELSE 'Buyer in segment ' || c_mktsegment || ' of nation ' || CAST(c_nationkey AS STRING) END,
       {_NONE}, 'active', {_NONE}, {_NONE}, c_mktsegment || '|customer', {_NONE}, ''
FROM {{customer}}
UNION ALL
SELECT '/glossary/document-' || CAST(doc_id AS STRING) || '.md', 'glossary',
       'document-' || CAST(doc_id AS STRING), 'GlossaryTerm', 'Term ' || lang || ' ' || CAST(doc_id AS STRING),
       {_NONE}, {_NONE}, 'active', {_NONE}, {_NONE}, lang || '|' || source, {_NONE}, text
FROM {{documents}}
UNION ALL
SELECT '/dashboards/nation-' || CAST(n_nationkey AS STRING) || '.md', 'dashboards',
       'nation-' || CAST(n_nationkey AS STRING), 'Dashboard', n_name, 'Sales dashboard of ' || n_name,
       {_NONE}, 'active', {_NONE}, {_NONE}, 'dashboard', {_NONE}, ''
FROM {{nation}}
UNION ALL
SELECT '/metrics/region-' || CAST(r_regionkey AS STRING) || '.md', 'metrics',
       'region-' || CAST(r_regionkey AS STRING), 'Metric', r_name, 'Revenue of region [' || r_name || ']',
       'gold', 'active', {_NONE}, {_NONE}, 'metric', {_NONE}, ''
FROM {{region}}
"""

LINKS_SQL = f"""
SELECT {_supplier_path('l_suppkey')} AS src, 'feeds' AS rel, {_part_path('l_partkey')} AS target
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {{lineitem}}) sp
UNION ALL
SELECT {_order_path('l_orderkey')}, 'reads_from',
       CASE WHEN l_orderkey % 53 = 0 THEN '/queries/retired-' || CAST(l_partkey AS STRING) || '.md'
            ELSE {_part_path('l_partkey')} END
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM {{lineitem}}) op
UNION ALL
SELECT {_part_path('l_partkey')}, 'consumes_stream', {_supplier_path('l_suppkey')}
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {{lineitem}} WHERE l_partkey % 5 = 3 AND (l_partkey + l_suppkey) % 40 = 0) ps
UNION ALL
SELECT {_customer_path('o_custkey')}, CASE WHEN o_orderkey % 19 = 0 THEN 'related_to' ELSE 'derived_from' END,
       {_order_path('o_orderkey')}
FROM {{orders}}
UNION ALL
SELECT {_part_path('p_partkey')}, 'writes_to', '/storage/zone-' || CAST(p_size AS STRING) || '.md'
FROM {{part}} WHERE p_partkey % 5 IN (1, 2, 3) AND p_partkey % 4 <> 0
UNION ALL
SELECT '/dashboards/nation-' || CAST(n_nationkey AS STRING) || '.md', 'visualizes',
       CASE WHEN n_nationkey % 6 = 5 THEN '/metrics/retired-' || CAST(n_nationkey AS STRING) || '.md'
            ELSE '/metrics/region-' || CAST(n_regionkey AS STRING) || '.md' END
FROM {{nation}}
"""

#: Entries of an asset's link list that are no objects.
BAD_LINKS_SQL = "CASE WHEN type = 'Workflow' AND length(title) % 5 = 0 THEN 2 WHEN type = 'Query' AND title IS NULL THEN 1 ELSE 0 END"

# Closes the loop customer -> dashboard -> supplier on top of LINKS_SQL.
CYCLE_LINKS_SQL = LINKS_SQL + f"""
UNION ALL
SELECT {_customer_path('c_custkey')}, 'feeds', '/dashboards/nation-' || CAST(c_nationkey AS STRING) || '.md'
FROM {{customer}}
UNION ALL
SELECT '/dashboards/nation-' || CAST(s_nationkey AS STRING) || '.md', 'feeds', {_supplier_path('s_suppkey')}
FROM {{supplier}}
"""

STATEMENTS_SQL = """
WITH used AS (
  SELECT l_orderkey, array_sort(array_agg(DISTINCT 'bronze.part_' || CAST(l_partkey AS STRING))) AS parts
  FROM {lineitem} GROUP BY l_orderkey
), named AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS STRING) AS id, 'silver.cust_' || CAST(o_custkey AS STRING) AS cust,
         {joined}(parts, ' CROSS JOIN ') AS parts
  FROM {orders} JOIN used ON l_orderkey = o_orderkey
)
SELECT CASE k % 5 WHEN 0 THEN 'gold/marts/' WHEN 1 THEN 'silver/sales/' WHEN 2 THEN 'staging/'
            WHEN 3 THEN 'curated/views/' ELSE 'misc/' END || 'order_' || id || '.sql' AS path,
       'order_' || id AS stem,
       CASE k % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' WHEN 2 THEN 'bronze' ELSE NULL END AS declared_layer,
       CASE k % 8
         WHEN 0 THEN 'CREATE OR REPLACE TABLE gold.order_' || id || ' AS SELECT * FROM ' || cust || ' CROSS JOIN ' || parts
         WHEN 1 THEN 'INSERT INTO gold.order_' || id || ' SELECT c.* FROM ' || cust || ' c LEFT JOIN (SELECT * FROM ' || parts || ') p ON c.k = p.k'
         WHEN 2 THEN 'MERGE INTO gold.order_' || id || ' t USING (SELECT * FROM ' || parts || ') s ON t.k = s.k'
         WHEN 3 THEN 'CREATE OR REPLACE VIEW gold.v_order_' || id || ' AS SELECT * FROM gold.order_' || id || ' JOIN ' || cust || ' USING (k)'
         WHEN 4 THEN '-- copied FROM landing.old_' || id || chr(10) || 'CREATE TABLE silver.order_' || id || ' AS SELECT '' from nowhere '' AS note FROM ' || parts
         WHEN 5 THEN 'INSERT INTO gold.order_' || id || ' WITH recent AS (SELECT * FROM ' || cust || ') SELECT * FROM recent CROSS JOIN ' || parts
         WHEN 6 THEN 'SELECT * FROM "silver"."cust_' || id || '" CROSS JOIN ' || parts || ' /* JOIN old.x */'
         ELSE 'CREATE VIEW gold.order_' || id || ' AS SELECT * FROM ' || parts
       END AS sql
FROM named
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("{joined}", "array_join"), **used)


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with ``tags`` as an array; ``uri``, ``source`` and ``name`` are columns of scanned assets and NULL here."""
    rows = _run(spark, sf_dir, CONCEPTS_SQL).withColumn("tags", F.split("tag_text", r"\|")).drop("tag_text")
    rows = rows.withColumn("bad_links", F.expr(BAD_LINKS_SQL))
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("uri", "source", "name")})


def links(spark: SparkSession, sf_dir: str, *, cyclic: bool = False, repeated: bool = False) -> DataFrame:
    """``src, rel, target``.

    Pairs of keys are dealt out to as many tasks as the lines call for before they are made distinct.
    ``repeated`` leaves equal links in, for a reader that makes what it builds of them distinct itself; then nothing is dealt out.
    """
    sql = CYCLE_LINKS_SQL if cyclic else LINKS_SQL
    if repeated:
        return _run(spark, sf_dir, re.sub(r"SELECT DISTINCT (?=\w+, \w+ FROM \{lineitem\})", "SELECT ", sql))
    tasks = task_count(table(spark, sf_dir, "lineitem"))
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        dealt = rf"SELECT DISTINCT \1 FROM (SELECT /*+ REPARTITION({tasks}, \1) */ \1 FROM {{lineitem}}\2) d)"
        sql = re.sub(r"SELECT DISTINCT (\w+, \w+) FROM \{lineitem\}( WHERE [^\n]*)?\)(?= \w+\n)", dealt, sql)
    return _run(spark, sf_dir, sql)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``catalog`` of every listing: only tables and views that are in use have one."""
    return concepts(spark, sf_dir).filter(F.col("catalog").isin("tables", "views")).select("catalog").distinct()


def root_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text`` of the bundle's own files: an index that names the regions and no version, and no log."""
    names = table(spark, sf_dir, "region").agg(F.array_join(F.sort_array(F.collect_set("r_name")), ", ").alias("names"))
    return names.select(F.lit("/index.md").alias("path"), F.concat(F.lit("# Catalog of "), F.col("names")).alias("text"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, stem, declared_layer, sql``."""
    return _run(spark, sf_dir, STATEMENTS_SQL)


def for_engine(sql: str) -> str:
    """The same text over tables of their plain names."""
    return sql.format(joined="array_to_string", **{t: t for t in TABLES})
