"""Reading table names out of SQL text with regular expressions.

Known limits: comma joins, ``EXTRACT(x FROM y)``, ``INSERT OVERWRITE`` and
``TEMP VIEW`` are not understood.  ``compat=True`` works on the raw text, so
comments, literals and CTE names count as tables too.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakegraph import model
from lakegraph.functions.scrub import scrub
from lakegraph.functions.text import let

_NOISE = r"(?s)'[^']*'|--[^\n]*|/\*.*?\*/"
_CTE = r"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)([\p{L}\p{N}_]+)\s+as\s*\("
_QUOTES = "[`\"\\[\\]]"


def clean_sql(sql: Column) -> Column:
    """SQL with literals and comments blanked in one left-to-right pass, where there can be any."""
    noisy = sql.contains("'") | sql.contains("--") | sql.contains("/*")
    return F.when(noisy, F.regexp_replace(sql, _NOISE, " ")).otherwise(sql)


def _names(sql: Column, pattern: str, compat: bool) -> Column:
    raw = F.regexp_extract_all(sql, F.lit(pattern), F.lit(1))
    if compat:
        return F.transform(raw, lambda n: F.regexp_replace(n, f"^{_QUOTES}+|{_QUOTES}+$", ""))
    return F.transform(raw, lambda n: F.regexp_replace(n, _QUOTES, ""))


def _last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def source_refs(sql: Column, *, compat: bool = False, cleaned: bool = False) -> Column:
    """Qualified names read by a statement, distinct, in first-seen order; ``cleaned`` SQL went through ``clean_sql`` before."""
    if compat:
        found = _names(sql, model.SQL_SOURCE, True)
        return F.array_distinct(F.filter(
            found, lambda n: ~F.lower(n).isin(*model.SQL_NOT_A_TABLE) & (n != "")
        ))

    def read(text: Column) -> Column:
        # A CTE has a bracket, and stands behind WITH or a comma.
        may_have = text.contains("(") & (text.contains(",") | F.lower(text).contains("with"))
        named = F.when(may_have, F.regexp_extract_all(text, F.lit(_CTE), F.lit(1))).otherwise(F.array().cast("array<string>"))
        ctes = F.transform(named, F.lower)
        found = _names(text, model.SQL_SOURCE, False)
        return let(ctes, lambda c: F.array_distinct(F.filter(
            found,
            lambda n: (n != "") & ~F.lower(n).isin(*model.SQL_NOT_A_TABLE) & ~F.array_contains(c, F.lower(n)),
        )))

    return let(sql if cleaned else clean_sql(sql), read)


def sql_sources(sql: Column, *, compat: bool = False, cleaned: bool = False) -> Column:
    """Last name part of everything read, distinct, in first-seen order."""
    names = F.transform(source_refs(sql, compat=compat, cleaned=cleaned), _last)
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def sql_targets(sql: Column, *, compat: bool = False, cleaned: bool = False) -> Column:
    """Last name part of everything written, distinct, in first-seen order."""
    if compat:
        found = _names(sql, model.SQL_TARGET_COMPAT, True)
    else:
        found = _names(sql if cleaned else clean_sql(sql), model.SQL_TARGET, False)
    return F.array_distinct(F.filter(F.transform(found, _last), lambda n: n != ""))


def is_view(sql: Column, path: Column, *, compat: bool = False) -> Column:
    text = F.lower(sql)
    says_view = text.contains("create view")
    if not compat:
        says_view = says_view | text.rlike(r"create\s+or\s+replace\s+view")
    return says_view | F.lower(F.concat(F.lit("/"), path)).contains("/views/")


def writes_table(sql: Column) -> Column:
    text = F.lower(sql)
    hit = F.lit(False)
    for marker in model.SQL_WRITE_MARKERS:
        hit = hit | text.contains(marker)
    return hit


def first_sql_block(body: Column) -> Column:
    """Content of the first fenced SQL block, NULL without one."""
    return F.get(F.regexp_extract_all(body, F.lit(model.SQL_BLOCK), F.lit(1)), F.lit(0))


def sql_fingerprint(sql: Column) -> Column:
    return F.sha2(scrub(sql), 256)
