"""Query registry and the shared pieces of check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakegraph import model
from lakegraph.sources import derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a ``(spark, sf_dir) -> DataFrame`` function under ``name``."""
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


EDGES_SQL = f"""
SELECT DISTINCT CASE WHEN rel IN ({quoted(model.REVERSE_FLOW)}) THEN target ELSE src END AS src,
       CASE WHEN rel IN ({quoted(model.REVERSE_FLOW)}) THEN src ELSE target END AS dst
FROM links WHERE rel IN ({quoted(model.FORWARD_FLOW + model.REVERSE_FLOW)})
"""

_PARTS = {
    "concepts": "SELECT * EXCLUDE (tag_text), string_split(tag_text, '|') AS tags FROM ("
                + derive.for_engine(derive.CONCEPTS_SQL) + ") c",
    "links": derive.for_engine(derive.LINKS_SQL),
    "cycle_links": derive.for_engine(derive.CYCLE_LINKS_SQL),
    "edges": EDGES_SQL,
    "cycle_edges": EDGES_SQL.replace("FROM links", "FROM cycle_links"),
    "statements": derive.for_engine(derive.STATEMENTS_SQL),
    "nodes": "SELECT src AS node FROM edges UNION SELECT dst FROM edges",
}


def with_parts(names: str, rest: str) -> str:
    """``rest`` with the named derived tables in front; ``rest`` may start with more of its own."""
    head = ", ".join(f"{n} AS MATERIALIZED ({_PARTS[n]})" for n in names.split())
    rest = rest.strip()
    joiner = ", " + rest[4:].lstrip() if rest[:5].upper() == "WITH " else " " + rest
    return f"WITH RECURSIVE {head}{joiner}"


# -- the column expressions again, in check SQL ---------------------------


def slug_sql(x: str) -> str:
    kept = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s.-]', '', 'g')"
    dashed = rf"trim(regexp_replace({kept}, '[\s._-]+', '-', 'g'), '-')"
    return f"(CASE WHEN {dashed} = '' THEN 'untitled' ELSE rtrim(left({dashed}, 80), '-') END)"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def stem_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^.*/', ''), '^(.+)\.[^.]+$', '\1')"


def tokens_sql(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, '{model.INDEX_TOKEN}'), lambda t: lower(t)), "
        f"lambda t: t NOT IN ({quoted(model.STOP_WORDS)}))"
    )


def scrub_sql(x: str) -> str:
    for pattern, label in model.SECRET_RULES + model.PII_RULES:
        x = f"regexp_replace({x}, {quoted([pattern])}, '{label}', 'g')"
    return x


def layer_sql(path: str) -> str:
    arms = " ".join(
        f"WHEN list_contains(string_split(lower({path}), '/'), '{hint}') THEN '{named}'"
        for hint, named in model.LAYER_HINTS
    )
    return f"(CASE {arms} ELSE '{model.FALLBACK_LAYER}' END)"


def catalog_sql(type_: str) -> str:
    arms = " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in model.TYPE_TO_CATALOG.items())
    return f"(CASE {type_} {arms} ELSE '{model.DEFAULT_CATALOG}' END)"


def clean_sql_sql(x: str) -> str:
    return rf"regexp_replace({x}, '(?s)''[^'']*''|--[^\n]*|/\*.*?\*/', ' ', 'g')"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '[`\"\\[\\]]', '', 'g')"


def refs_sql(x: str) -> str:
    """Qualified names read by a statement."""
    clean = clean_sql_sql(x)
    cte = rf"regexp_extract_all({clean}, '(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)([\p{{L}}\p{{N}}_]+)\s+as\s*\(', 1)"
    return (
        f"list_filter(list_transform(regexp_extract_all({clean}, {quoted([model.SQL_SOURCE])}, 1), lambda n: {_bare('n')}), "
        f"lambda n: lower(n) NOT IN ({quoted(model.SQL_NOT_A_TABLE)}) "
        f"AND NOT list_contains(list_transform({cte}, lambda c: lower(c)), lower(n)))"
    )


def targets_sql(x: str) -> str:
    return (
        f"list_transform(regexp_extract_all({clean_sql_sql(x)}, {quoted([model.SQL_TARGET])}, 1), "
        f"lambda n: regexp_replace({_bare('n')}, '^.*\\.', ''))"
    )


def last_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^.*\.', '')"


def first_seen_sql(rows: str, keys: str, value: str) -> str:
    """``keys, names``: distinct values in first-seen order, joined by commas.

    ``rows`` yields ``keys, items`` with ``items`` a list.
    """
    return f"""
SELECT {keys}, coalesce(string_agg({value}, ',' ORDER BY pos), '') AS names FROM (
  SELECT {keys}, {value}, min(pos) AS pos FROM (
    SELECT {keys}, unnest(items) AS {value}, generate_subscripts(items, 1) AS pos FROM ({rows}) r0
  ) r1 GROUP BY ALL
) r2 GROUP BY {keys}
"""
