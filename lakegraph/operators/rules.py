"""Stored expressions at work: metrics, quality rules, contracts, freshness."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# A DAX row sum and the column it adds up: SUMX('t', 't'[c]) or SUMX(t, t[c]).
_DAX_SUM = re.compile(r"SUMX\s*\(\s*'?\w+'?\s*,\s*'?\w+'?\s*\[(\w+)\]\s*\)", re.IGNORECASE)
_DAX_NAME = re.compile(r"^\s*[\w ]+=\s*")


def dax_to_sql(expression: str) -> str:
    """SQL aggregate for the DAX row sums that measures are stored as."""
    body = _DAX_NAME.sub("", expression.strip(), count=1)
    sql, n = _DAX_SUM.subn(r"sum(\1)", body)
    if n == 0:
        raise ValueError(f"unsupported measure: {expression!r}")
    return sql.strip()


def evaluate_metrics(metrics: list[dict], tables: dict[str, DataFrame], by: list[str] | None = None) -> DataFrame:
    """``table_name, [by], metric, value`` of stored aggregate expressions.

    All metrics of a table are computed in one pass over it.
    """
    per_table = defaultdict(list)
    for m in metrics:
        sql = dax_to_sql(m["expression"]) if m.get("dialect", "sql") == "dax" else m["expression"]
        per_table[m["table"]].append((m["name"], sql))
    results = []
    for name, items in per_table.items():
        keys = by or []
        row = tables[name].groupBy(*keys).agg(*[F.expr(sql).cast("double").alias(f"m{i}") for i, (_, sql) in enumerate(items)])
        tall = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, (n, _) in enumerate(items)])
        results.append(row.select(F.lit(name).alias("table_name"), *keys, F.inline(tall)))
    return reduce(DataFrame.unionByName, results)


def evaluate_rules(rules: list[dict], tables: dict[str, DataFrame], as_of: str | None = None) -> DataFrame:
    """``rule, target, rule_type, severity, passed`` of stored boolean aggregates.

    One pass per table checks all of its rules.  ``as_of`` (a date) stands in
    for ``current_date`` so that a run can be repeated.  A rule without a
    verdict, as over an empty table, fails.
    """
    per_table = defaultdict(list)
    for rule in rules:
        sql = rule["expression"]
        if as_of:
            sql = re.sub(r"\bcurrent_date\b(\(\))?", f"DATE'{as_of}'", sql, flags=re.IGNORECASE)
        per_table[rule["target"]].append((rule, sql))
    results = []
    for target, items in per_table.items():
        row = tables[target].agg(*[F.expr(sql).cast("boolean").alias(f"r{i}") for i, (_, sql) in enumerate(items)])
        verdicts = F.array(*[
            F.struct(
                F.lit(rule["name"]).alias("rule"), F.lit(target).alias("target"),
                F.lit(rule.get("rule_type", "freshness")).alias("rule_type"),
                F.lit(rule.get("severity", "error")).alias("severity"),
                F.coalesce(F.col(f"r{i}"), F.lit(False)).alias("passed"),
            )
            for i, (rule, _) in enumerate(items)
        ])
        results.append(row.select(F.inline(verdicts)))
    return reduce(DataFrame.unionByName, results)


def quarantine(rows: DataFrame, predicates: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``; rejected rows carry the names of the predicates they broke."""
    reasons = F.array_compact(F.array(*[
        F.when(~F.coalesce(p, F.lit(False)), F.lit(name)) for name, p in predicates.items()
    ]))
    judged = rows.withColumn("reasons", reasons)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def check_contracts(contracts: DataFrame, verdicts: DataFrame, freshness: DataFrame | None = None) -> DataFrame:
    """``contract, rules, failed, passed``: every rule of a contract passed and its job is in time.

    A rule nobody evaluated counts as failed, and so does a job without a
    freshness row. A contract without rules has none that fail, one without a
    ``job`` no limit to miss.
    """
    asked = contracts.select("contract", F.explode_outer("quality_rules").alias("rule"))
    judged = asked.join(verdicts.select("rule", "passed"), "rule", "left").groupBy("contract").agg(
        F.count("rule").alias("rules"),
        F.count_if(F.col("rule").isNotNull() & ~F.coalesce("passed", F.lit(False))).alias("failed"),
    )
    result = judged.withColumn("passed", F.col("failed") == 0)
    if freshness is not None:
        timely = contracts.select("contract", "job").join(freshness.select("job", "in_time"), "job", "left").select(
            "contract", F.coalesce("in_time", F.col("job").isNull()).alias("in_time"))
        result = result.join(timely, "contract").withColumn("passed", F.col("passed") & F.col("in_time")).drop("in_time")
    return result


def landing_freshness(rows: DataFrame, job: str, ts: str, slas: DataFrame, as_of: Column) -> DataFrame:
    """``job, newest, age_minutes, sla_minutes, in_time`` per landing job.

    A job that landed nothing is late; one without a limit is in time.
    """
    newest = rows.groupBy(F.col(job).alias("job")).agg(F.max(ts).alias("newest"))
    age = F.timestamp_diff("MINUTE", F.col("newest"), as_of)
    return slas.join(newest, "job", "left").select(
        "job", "newest", age.alias("age_minutes"), "sla_minutes",
        F.coalesce(age <= F.col("sla_minutes"), F.col("sla_minutes").isNull()).alias("in_time"),
    )
