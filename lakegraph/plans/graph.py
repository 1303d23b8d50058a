"""Lineage traversals over the derived graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegraph import model
from lakegraph.operators import closure, graph, packs, resolve
from lakegraph.operators.edge_store import EdgeStore
from lakegraph.plans.joins import STATEMENT_EDGES_SQL
from lakegraph.plans.registry import query, quoted, stem_sql, with_parts
from lakegraph.sources import derive

C = F.col
FOCUS = "/sources/supplier-1.md"


def _edges(spark, sf, cyclic=False):
    return graph.flow_edges(derive.links(spark, sf, cyclic=cyclic))


_stores: dict = {}


def _store(spark, sf, cyclic=False):
    """The derived graph as stored edges, written once per session and state of the input files."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(sf)
    state = listed.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("path", "length", "modificationTime"), F.lit(1 << 40)))).first()
    key = spark.sparkContext.applicationId, sf, cyclic, tuple(state)
    if key not in _stores:
        for old in [k for k in _stores if k[:3] == key[:3]]:
            _stores.pop(old).drop()
        _stores[key] = EdgeStore.write(graph.flow_edges(derive.links(spark, sf, cyclic=cyclic, repeated=True), repeated=True))
    return _stores[key]


def _node(spark, path):
    return spark.createDataFrame([(path,)], "node string")


def _long_depth(df):
    return df.withColumn("depth", C("depth").cast("bigint"))


def _reach_sql(starts: str, hops: int, edges: str = "edges", src: str = "src", dst: str = "dst", name: str = "reached") -> str:
    return f"""
{name}_walk AS (
  SELECT node AS start, node, CAST(0 AS BIGINT) AS depth FROM ({starts}) s
  UNION SELECT w.start, e.{dst}, w.depth + 1 FROM {name}_walk w JOIN {edges} e ON e.{src} = w.node WHERE w.depth < {hops}
), {name} AS MATERIALIZED (SELECT start, node, min(depth) AS depth FROM {name}_walk GROUP BY ALL)
"""


@query("g01_lineage_graph", with_parts("concepts links edges statements", f"""
WITH {STATEMENT_EDGES_SQL} SELECT src, dst FROM edges UNION SELECT src, dst FROM sql_edges
"""))
def g01(spark, sf):
    """Edges from typed links, from statement files and, for half of the statements, from SQL blocks in asset bodies."""
    concepts, statements = derive.concepts(spark, sf), derive.statements(spark, sf).select("path", "sql")
    in_body = F.crc32(C("path").cast("binary")) % 2 == 0
    assets = statements.filter(in_body).select("path", F.concat(F.lit("# Job\n\n```sql\n"), "sql", F.lit("\n```\n")).alias("body"))
    blocks = resolve.body_statements(concepts.select("path", "body").unionByName(assets))
    from_sql = resolve.resolved_statement_edges(statements.filter(~in_body).unionByName(blocks), concepts)
    linked = graph.flow_edges(derive.links(spark, sf, repeated=True), repeated=True)
    return graph.union_edges(linked, from_sql)


@query("u01_edge_union", with_parts("concepts links edges statements", f"""
WITH {STATEMENT_EDGES_SQL}, all_edges AS (SELECT src, dst FROM edges UNION SELECT src, dst FROM sql_edges)
SELECT split_part(src, '/', 2) AS from_catalog, split_part(dst, '/', 2) AS to_catalog, count(*) AS n FROM all_edges GROUP BY ALL
"""))
def u01(spark, sf):
    catalog = lambda c, name: F.split(c, "/")[1].alias(name)
    return g01(spark, sf).groupBy(catalog("src", "from_catalog"), catalog("dst", "to_catalog")).agg(
        F.count(F.lit(1)).alias("n")
    )


_STREAMS = "SELECT path AS node FROM concepts WHERE type = 'SourceSystem' AND kind = 'stream'"


def _streams(spark, sf):
    return derive.concepts(spark, sf).filter((C("type") == "SourceSystem") & (C("kind") == "stream")).select(
        C("path").alias("node")
    )


@query("g02_downstream", with_parts("concepts links edges", f"""
WITH {_reach_sql(_STREAMS, 5)} SELECT start, node, depth FROM reached
"""))
def g02(spark, sf):
    """Everything downstream of every stream source."""
    return _long_depth(graph.downstream(_store(spark, sf), _streams(spark, sf)))


@query("g02_downstream_cyclic", with_parts("concepts cycle_links cycle_edges", f"""
WITH {_reach_sql("SELECT path AS node FROM concepts WHERE type = 'Dashboard'", 5, 'cycle_edges')}
SELECT start, depth, count(*) AS n FROM reached GROUP BY ALL
"""))
def g02_cyclic(spark, sf):
    dashboards = derive.concepts(spark, sf).filter(C("type") == "Dashboard").select(C("path").alias("node"))
    reached = graph.downstream(_edges(spark, sf, cyclic=True), dashboards)
    return _long_depth(reached.groupBy("start", "depth").agg(F.count(F.lit(1)).alias("n")))


_ZONES = "SELECT DISTINCT dst AS node FROM edges WHERE starts_with(dst, '/storage/')"


@query("g03_upstream", with_parts("links edges", f"""
WITH {_reach_sql(_ZONES, 5, 'edges', 'dst', 'src')} SELECT start, node, depth FROM reached
"""))
def g03(spark, sf):
    """Everything upstream of every storage zone."""
    edges = _store(spark, sf)
    zones = edges.edges().filter(C("dst").startswith("/storage/")).select(C("dst").alias("node")).distinct()
    return _long_depth(graph.upstream(edges, zones))


@query("g04_shortest_path", with_parts("concepts cycle_links cycle_edges", f"""
WITH pairs AS (
  SELECT '/sources/supplier-' || CAST(s_suppkey AS VARCHAR) || '.md' AS start,
         '/dashboards/nation-' || CAST(s_nationkey AS VARCHAR) || '.md' AS goal FROM supplier WHERE s_suppkey % 7 = 0
), {_reach_sql("SELECT DISTINCT start AS node FROM pairs", 5, 'cycle_edges')},
onward AS MATERIALIZED (
  SELECT p.start, p.node AS parent, e.dst AS node, p.depth + 1 AS depth FROM reached p JOIN cycle_edges e ON e.src = p.node
), parents AS MATERIALIZED (
  SELECT o.start, o.node, o.depth, min(o.parent) AS parent
  FROM onward o JOIN reached r ON r.start = o.start AND r.node = o.node AND r.depth = o.depth GROUP BY ALL
), back AS (
  SELECT p.start, p.goal, r.depth AS position, r.node FROM pairs p JOIN reached r ON r.start = p.start AND r.node = p.goal
  UNION ALL SELECT b.start, b.goal, b.position - 1, q.parent FROM back b JOIN parents q
    ON q.start = b.start AND q.node = b.node AND q.depth = b.position
)
SELECT start, goal, position, node FROM back
"""))
def g04(spark, sf):
    """From every stream supplier to its nation's dashboard, in the graph with loops."""
    pairs = derive.table(spark, sf, "supplier").filter(C("s_suppkey") % 7 == 0).select(
        F.concat(F.lit("/sources/supplier-"), C("s_suppkey").cast("string"), F.lit(".md")).alias("start"),
        F.concat(F.lit("/dashboards/nation-"), C("s_nationkey").cast("string"), F.lit(".md")).alias("goal"),
    )
    steps = graph.shortest_paths(_store(spark, sf, cyclic=True), pairs)
    return steps.withColumn("position", C("position").cast("bigint"))


@query("g05_roots", with_parts("links edges", "SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges)"))
def g05(spark, sf):
    return graph.roots(_edges(spark, sf))


@query("g06_materialized_lineage", with_parts("links edges", f"""
WITH {_reach_sql("SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges)", 6)},
summary AS (
  SELECT start AS root, count(*) AS node_count, max(depth) AS hop_count, max(struct_pack(d := depth, n := node)) AS last
  FROM reached GROUP BY start
)
SELECT root, 'path-' || {stem_sql('root')} || '-to-' || {stem_sql('last.n')} AS name, node_count, hop_count
FROM summary WHERE node_count >= 2
"""))
def g06(spark, sf):
    paths = graph.lineage_paths(*graph.materialized_lineage(_store(spark, sf), listed=True))
    return paths.withColumn("hop_count", C("hop_count").cast("bigint"))


_LOOPED_SQL = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT 'region-' || CAST(n_regionkey AS VARCHAR) AS src, 'nation-' || CAST(n_nationkey AS VARCHAR) AS dst FROM nation WHERE n_nationkey % 2 = 0
  UNION SELECT 'nation-' || CAST(s_nationkey AS VARCHAR), 'supplier-' || CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION SELECT 'supplier-' || CAST(s_suppkey AS VARCHAR), 'nation-' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION SELECT 'nation-' || CAST(c_nationkey AS VARCHAR), 'customer-' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION SELECT 'customer-' || CAST(o_custkey AS VARCHAR), 'order-' || CAST(o_orderkey AS VARCHAR) FROM orders
  UNION SELECT 'order-' || CAST(l_orderkey AS VARCHAR), 'line-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) FROM lineitem
)"""


def _looped(spark, sf):
    """Only even nations hang off a region; the others form loops with their suppliers, from which customers, orders and lines follow."""
    name = lambda kind, *keys: F.concat_ws("-", F.lit(kind), *[C(k).cast("string") for k in keys])
    hops = [
        ("nation", name("region", "n_regionkey"), name("nation", "n_nationkey"), C("n_nationkey") % 2 == 0),
        ("supplier", name("nation", "s_nationkey"), name("supplier", "s_suppkey"), F.lit(True)),
        ("supplier", name("supplier", "s_suppkey"), name("nation", "s_nationkey"), F.lit(True)),
        ("customer", name("nation", "c_nationkey"), name("customer", "c_custkey"), F.lit(True)),
        ("orders", name("customer", "o_custkey"), name("order", "o_orderkey"), F.lit(True)),
        ("lineitem", name("order", "l_orderkey"), name("line", "l_orderkey", "l_linenumber"), F.lit(True)),
    ]
    return graph.union_edges(*[
        derive.table(spark, sf, t).filter(kept).select(src.alias("src"), dst.alias("dst")) for t, src, dst, kept in hops
    ])


@query("g06_unrooted_nodes", _LOOPED_SQL + """, covered(node) AS (
  SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT dst FROM e)
  UNION SELECT e.dst FROM covered JOIN e ON e.src = covered.node
)
SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) n WHERE node NOT IN (SELECT node FROM covered)
""")
def g06_unrooted(spark, sf):
    return graph.unrooted_nodes(_looped(spark, sf))


_REACHED_SQL = _LOOPED_SQL + """, walk(start, node) AS (
  SELECT src, dst FROM e UNION SELECT w.start, e.dst FROM walk w JOIN e ON e.src = w.node
), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
reached AS MATERIALIZED (SELECT start, node FROM walk UNION SELECT node, node FROM n),
component AS MATERIALIZED (
  SELECT a.start AS node, min(a.node) AS component FROM reached a JOIN reached b ON b.start = a.node AND b.node = a.start GROUP BY a.start
)
"""


@query("g06_condensation", _REACHED_SQL + "SELECT node, component FROM component")
def g06_condensation(spark, sf):
    return closure.condense(_looped(spark, sf))


@query("g06_reach_sizes")
def g06_reach_sizes(spark, sf):
    """About how many nodes each component of the looped graph leads to; tests hold the sketches against exact counts."""
    return closure.reach_sizes(_looped(spark, sf)).select("component", "members", "reached")


_AROUND = f"""
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
foci AS (SELECT path AS focus FROM concepts WHERE type = 'BusinessObject'),
hop1 AS (
  SELECT focus, b.dst AS node FROM foci JOIN both_ways b ON b.src = focus
  UNION SELECT focus, l.target FROM foci JOIN links l ON l.src = focus
), hop2 AS (SELECT DISTINCT focus, b.dst AS node FROM hop1 JOIN both_ways b ON b.src = hop1.node),
around AS (
  SELECT focus, node, min(depth) AS depth FROM (
    SELECT focus, focus AS node, CAST(0 AS BIGINT) AS depth FROM foci UNION ALL SELECT focus, node, 1 FROM hop1
    UNION ALL SELECT focus, node, 2 FROM hop2) u GROUP BY ALL
), clipped AS (
  SELECT focus, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY depth, node) AS n FROM around) x WHERE n <= 20
)
"""


def _neighbourhoods(spark, sf):
    concepts, links = derive.concepts(spark, sf), derive.links(spark, sf)
    foci = concepts.filter(C("type") == "BusinessObject").select(C("path").alias("node"))
    return graph.neighbourhoods(_store(spark, sf), foci, links)


@query("g07_context_neighbourhood", with_parts("concepts links edges", f"WITH {_AROUND} SELECT focus, node, depth FROM clipped"))
def g07(spark, sf):
    """The pack members around every business object."""
    return _long_depth(_neighbourhoods(spark, sf))


@query("w04_node_clip", with_parts("concepts links edges", f"""
WITH {_AROUND} SELECT focus, count(*) AS kept, max(depth) AS deepest FROM clipped GROUP BY focus
"""))
def w04(spark, sf):
    return _neighbourhoods(spark, sf).groupBy("focus").agg(
        F.count(F.lit(1)).alias("kept"), F.max("depth").cast("bigint").alias("deepest")
    )


_FOCUS_NODES = _reach_sql(f"SELECT '{FOCUS}' AS node", 2, name="down") + ", " + _reach_sql(
    f"SELECT '{FOCUS}' AS node", 2, "edges", "dst", "src", name="up"
) + ", kept AS (SELECT node FROM down UNION SELECT node FROM up)"


@query("u02_focus_nodes", with_parts("links edges", f"WITH {_FOCUS_NODES} SELECT node FROM kept"))
def u02(spark, sf):
    return graph.focus_nodes(_store(spark, sf), _node(spark, FOCUS))


@query("g08_diagram", with_parts("links edges", f"""
WITH {_FOCUS_NODES}
SELECT 'node' AS section, '  n' || left(md5(node), 12) || '["' || {stem_sql('node')} || '"]' AS line FROM kept
UNION ALL
SELECT 'edge', '  n' || left(md5(src), 12) || ' --> n' || left(md5(dst), 12) FROM edges
WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)
"""))
def g08(spark, sf):
    """The two-hop diagram around one supplier."""
    edges = _store(spark, sf)
    return graph.diagram_lines(edges, graph.focus_nodes(edges, _node(spark, FOCUS)))


@query("g09_impact", with_parts("concepts links edges", f"""
WITH {_reach_sql(f"SELECT '{FOCUS}' AS node", 5)}
SELECT start, depth, coalesce(type, '?') AS type, count(*) AS n FROM reached LEFT JOIN concepts ON path = node
WHERE depth > 0 GROUP BY ALL
"""))
def g09(spark, sf):
    """What a change to one supplier touches."""
    return _long_depth(graph.impact(_store(spark, sf), _node(spark, FOCUS), derive.concepts(spark, sf)))


@query("w05_hop_pairs", """
WITH p AS (
  SELECT l_orderkey * 10 + l_linenumber AS k, l_suppkey AS s, l_partkey AS p, l_orderkey AS o, o_custkey AS c
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT CAST(k AS BIGINT) AS path_id, CAST(3 AS BIGINT) AS hop_count, position, src, dst FROM (
  SELECT k, CAST(1 AS BIGINT) AS position, 'supplier-' || CAST(s AS VARCHAR) AS src, 'part-' || CAST(p AS VARCHAR) AS dst FROM p
  UNION ALL SELECT k, 2, 'part-' || CAST(p AS VARCHAR), 'order-' || CAST(o AS VARCHAR) FROM p
  UNION ALL SELECT k, 3, 'order-' || CAST(o AS VARCHAR), 'customer-' || CAST(c AS VARCHAR) FROM p
) x
""")
def w05(spark, sf):
    """The path supplier, part, order, customer of every order line as hops."""
    lines = derive.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    orders = derive.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    name = lambda kind, c: F.concat(F.lit(f"{kind}-"), C(c).cast("string"))
    paths = lines.join(orders, C("l_orderkey") == C("o_orderkey")).select(
        (C("l_orderkey") * 10 + C("l_linenumber")).cast("bigint").alias("path_id"),
        F.array(name("supplier", "l_suppkey"), name("part", "l_partkey"), name("order", "o_orderkey"), name("customer", "o_custkey")).alias("nodes"),
    )
    return graph.hop_pairs(paths)


@query("a07_edge_dedup", with_parts("links edges", "SELECT src, count(DISTINCT dst) AS targets FROM edges GROUP BY src"))
def a07(spark, sf):
    return _edges(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("targets"))


@query("k03_adjacency", with_parts("links edges", """
WITH deg AS (SELECT src, count(*) AS out_degree FROM edges GROUP BY src),
placed AS (
  SELECT e.src, e.dst, out_degree, CASE WHEN out_degree > 100 THEN
    CAST(('0x' || left(md5(e.dst), 8)) AS BIGINT) % CAST(ceil(out_degree / 100.0) AS BIGINT) ELSE 0 END AS shard
  FROM edges e JOIN deg ON deg.src = e.src
)
SELECT src, out_degree, shard, string_agg(dst, ',' ORDER BY dst) AS targets FROM placed GROUP BY ALL
"""))
def k03(spark, sf):
    """Out-lists, in shards of about a hundred here so that hubs are split."""
    lists = graph.adjacency(_store(spark, sf), shard_size=100)
    return lists.withColumn("targets", F.array_join("targets", ","))


@query("a04_edge_density", with_parts("concepts links edges", """
SELECT count(*) AS edge_count, round(count(*) / greatest((SELECT count(*) FROM concepts WHERE type = 'Table'), 1), 6) AS density FROM edges
"""))
def a04(spark, sf):
    from lakegraph.operators.quality import pivot_metrics, tall_metrics

    edges = _edges(spark, sf).agg(F.count(F.lit(1)).alias("edges"))
    tables = derive.concepts(spark, sf).agg(F.count_if(C("type") == "Table").alias("tables"))
    row = pivot_metrics(tall_metrics(edges).unionByName(tall_metrics(tables)), ["edges", "tables"])
    return row.select(
        C("edges").cast("bigint").alias("edge_count"),
        F.round(C("edges") / F.greatest(C("tables"), F.lit(1.0)), 6).alias("density"),
    )
