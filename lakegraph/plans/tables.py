"""Gold tables, stored metrics and quality rules over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegraph.operators import catalog, marts, rules
from lakegraph.plans.registry import query
from lakegraph.session import cut, scratch_path
from lakegraph.sources import derive

C = F.col
AS_OF = "2024-02-01"


def _daily(spark, sf):
    return marts.daily_totals(derive.table(spark, sf, "orders"), "o_orderdate", "o_orderpriority", "o_totalprice")


_DAILY = """
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS order_date, o_orderpriority, count(*) AS order_count,
         CAST(sum(CAST(o_totalprice AS DECIMAL(28, 2))) AS DOUBLE) AS gross_revenue FROM orders GROUP BY ALL
)
"""


@query("a11_gold_daily", f"WITH {_DAILY} SELECT CAST(order_date AS VARCHAR) AS order_date, o_orderpriority, order_count, gross_revenue FROM daily")
def a11(spark, sf):
    return _daily(spark, sf).withColumn("order_date", C("order_date").cast("string"))


@query("a12_lifetime_value", """
SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(28, 2))) AS DOUBLE) AS lifetime_value, count(*) AS order_count FROM orders GROUP BY o_custkey
""")
def a12(spark, sf):
    return marts.lifetime_value(derive.table(spark, sf, "orders"), "o_custkey", "o_totalprice")


METRICS = [
    {"name": "gross-merchandise-value", "table": "order_daily", "expression": "SUM(CAST(gross_revenue AS DECIMAL(28,2)))"},
    {"name": "orders", "table": "order_daily", "expression": "SUM(order_count)"},
    {"name": "best-day", "table": "order_daily", "expression": "MAX(order_count)"},
    {"name": "returned-quantity", "table": "lineitem", "dialect": "dax",
     "expression": "Returned =\nSUMX(\n  'lineitem',\n  'lineitem'[l_quantity]\n)"},
]


@query("a13_metric_evaluation", f"""
WITH {_DAILY}
SELECT 'order_daily' AS table_name, 'gross-merchandise-value' AS metric, CAST(sum(CAST(gross_revenue AS DECIMAL(28, 2))) AS DOUBLE) AS value FROM daily
UNION ALL SELECT 'order_daily', 'orders', CAST(sum(order_count) AS DOUBLE) FROM daily
UNION ALL SELECT 'order_daily', 'best-day', CAST(max(order_count) AS DOUBLE) FROM daily
UNION ALL SELECT 'lineitem', 'returned-quantity', sum(l_quantity) FROM lineitem
""")
def a13(spark, sf):
    return rules.evaluate_metrics(METRICS, {
        "order_daily": _daily(spark, sf), "lineitem": derive.table(spark, sf, "lineitem"),
    })


RULES = [
    {"name": "orders-fresh", "target": "orders", "expression": "max(o_orderdate) >= current_date - 1"},
    {"name": "orders-priced", "target": "orders", "rule_type": "validity", "expression": "min(o_totalprice) > 0"},
    {"name": "orders-keyed", "target": "orders", "rule_type": "uniqueness",
     "expression": "count(DISTINCT o_orderkey) = count(*)"},
    {"name": "lines-keyed", "target": "lineitem", "rule_type": "uniqueness", "severity": "warning",
     "expression": "count(DISTINCT l_orderkey, l_linenumber) = count(*)"},
    {"name": "events-fresh", "target": "events", "expression": "max(ts) >= current_date - 3"},
    {"name": "events-typed", "target": "events", "rule_type": "completeness", "expression": "count(event_type) = count(*)"},
]


def _verdicts(spark, sf):
    return rules.evaluate_rules(RULES, {t: derive.table(spark, sf, t) for t in ("orders", "lineitem", "events")}, AS_OF)


_VERDICTS = f"""
verdicts AS (
  SELECT 'orders-fresh' AS rule, 'orders' AS target, 'freshness' AS rule_type, 'error' AS severity, max(o_orderdate) >= DATE '{AS_OF}' - 1 AS passed FROM orders
  UNION ALL SELECT 'orders-priced', 'orders', 'validity', 'error', min(o_totalprice) > 0 FROM orders
  UNION ALL SELECT 'orders-keyed', 'orders', 'uniqueness', 'error', count(DISTINCT o_orderkey) = count(*) FROM orders
  UNION ALL SELECT 'lines-keyed', 'lineitem', 'uniqueness', 'warning', count(DISTINCT (l_orderkey, l_linenumber)) = count(*) FROM lineitem
  UNION ALL SELECT 'events-fresh', 'events', 'freshness', 'error', max(ts) >= DATE '{AS_OF}' - 3 FROM events
  UNION ALL SELECT 'events-typed', 'events', 'completeness', 'error', count(event_type) = count(*) FROM events
)
"""


@query("v05_dq_rules", f"WITH {_VERDICTS} SELECT * FROM verdicts")
def v05(spark, sf):
    return _verdicts(spark, sf)


@query("v06_row_quarantine", """
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_totalprice < 1000 THEN 'amount' END) AS reasons
FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 1000
""")
def v06(spark, sf):
    _, rejected = rules.quarantine(derive.table(spark, sf, "orders"), {
        "status": C("o_orderstatus") != "P", "amount": C("o_totalprice") >= 1000,
    })
    return rejected.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


SLAS = [("click", 60), ("view", 1440), ("error", 2880), ("purchase", 100000), ("refund", 15), ("signup", None)]


def _freshness(spark, sf):
    limits = spark.createDataFrame(SLAS, "job string, sla_minutes int")
    return rules.landing_freshness(
        derive.table(spark, sf, "events"), "event_type", "ts", limits, F.lit(AS_OF).cast("timestamp_ntz")
    )


_FRESHNESS = f"""
fresh AS (
  SELECT job, newest, CAST(floor(epoch(TIMESTAMP '{AS_OF}' - newest) / 60) AS BIGINT) AS age_minutes, sla_minutes
  FROM (VALUES ('click', 60), ('view', 1440), ('error', 2880), ('purchase', 100000), ('refund', 15), ('signup', NULL)) AS s(job, sla_minutes)
  LEFT JOIN (SELECT event_type, max(ts) AS newest FROM events GROUP BY event_type) e ON event_type = job
)
"""


@query("v08_landing_sla", f"""
WITH {_FRESHNESS}
SELECT job, coalesce(strftime(newest, '%Y-%m-%d %H:%M:%S'), '') AS newest, age_minutes, sla_minutes,
       coalesce(age_minutes <= sla_minutes, sla_minutes IS NULL) AS in_time FROM fresh
""")
def v08(spark, sf):
    return _freshness(spark, sf).withColumn(
        "newest", F.coalesce(F.date_format("newest", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    )


CONTRACTS = [("sales", ["orders-priced", "orders-keyed"], "purchase"), ("lines", ["lines-keyed"], "view"),
             ("activity", ["events-typed", "events-fresh"], "error"), ("unknown", ["events-typed", "never-written"], "view"),
             ("unlimited", ["orders-keyed"], None), ("ruleless", [], "purchase"), ("bare", None, None)]


@query("v07_contract_check", f"""
WITH {_VERDICTS}, {_FRESHNESS}, contracts(contract, rules, job) AS (
  VALUES ('sales', ['orders-priced', 'orders-keyed'], 'purchase'), ('lines', ['lines-keyed'], 'view'),
         ('activity', ['events-typed', 'events-fresh'], 'error'), ('unknown', ['events-typed', 'never-written'], 'view'),
         ('unlimited', ['orders-keyed'], NULL), ('ruleless', [], 'purchase'), ('bare', NULL, NULL)
), asked AS (SELECT contract, job, unnest(CASE WHEN len(rules) > 0 THEN rules ELSE [NULL] END) AS rule FROM contracts),
judged AS (
  SELECT contract, job, count(rule) AS rules, count(*) FILTER (rule IS NOT NULL AND NOT coalesce(passed, false)) AS failed
  FROM asked LEFT JOIN verdicts USING (rule) GROUP BY ALL
)
SELECT contract, rules, failed, failed = 0 AND coalesce(age_minutes <= sla_minutes, sla_minutes IS NULL) AS passed
FROM judged LEFT JOIN fresh USING (job)
""")
def v07(spark, sf):
    contracts = spark.createDataFrame(CONTRACTS, "contract string, quality_rules array<string>, job string")
    return rules.check_contracts(contracts, _verdicts(spark, sf), _freshness(spark, sf)).select(
        "contract", "rules", "failed", "passed"
    )


@query("t06_full_load", """
WITH old AS (SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 9 <> 0),
new AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey,
       CASE WHEN n.p_partkey IS NULL THEN 'removed' WHEN o.p_partkey IS NULL THEN 'created' WHEN o.p_retailprice = n.p_retailprice THEN 'skipped' ELSE 'updated' END AS action
FROM old o FULL OUTER JOIN new n ON n.p_partkey = o.p_partkey
""")
def t06(spark, sf):
    """A new parts snapshot replaces the last one; what changed between them."""
    part = derive.table(spark, sf, "part")
    target = scratch_path(spark, "parts")
    marts.full_load(part.filter(C("p_partkey") % 9 != 0), target)
    before = cut(spark.read.parquet(target))
    dropped = part.filter(C("p_partkey") % 11 != 0).withColumn(
        "p_retailprice", F.when(C("p_partkey") % 4 == 0, C("p_retailprice") + 1).otherwise(C("p_retailprice"))
    )
    marts.full_load(dropped, target)
    after = spark.read.parquet(target)
    return catalog.diff_snapshots(before, after, "p_partkey", F.xxhash64("p_name", "p_brand", "p_retailprice"))
