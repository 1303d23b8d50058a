"""Column expressions over documents, parts and derived assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegraph import model
from lakegraph.functions import naming, scrub, sqltext, text
from lakegraph.plans.registry import (
    catalog_sql, first_seen_sql, last_sql, layer_sql, query, quoted, refs_sql, scrub_sql, slug_sql,
    stem_sql, strip_sql, targets_sql, tokens_sql, with_parts,
)
from lakegraph.operators import resolve
from lakegraph.sources import derive, lake

C = F.col


@query("p01_slugify", f"""
SELECT 'part' AS origin, p_partkey AS id, {slug_sql("p_name || '_' || p_brand || '. ' || p_type")} AS slug FROM part
UNION ALL SELECT 'document', doc_id, {slug_sql('text')} FROM documents
""")
def p01(spark, sf):
    part = derive.table(spark, sf, "part")
    docs = derive.table(spark, sf, "documents")
    name = F.concat(C("p_name"), F.lit("_"), C("p_brand"), F.lit(". "), C("p_type"))
    return part.select(F.lit("part").alias("origin"), C("p_partkey").alias("id"), text.slugify(name).alias("slug")).unionByName(
        docs.select(F.lit("document").alias("origin"), C("doc_id").alias("id"), text.slugify(C("text")).alias("slug"))
    )


@query("p02_concept_ref", with_parts("concepts", f"""
SELECT path, '/' || {catalog_sql('type')} || '/' || {slug_sql("coalesce(title, '')")} || '.md' AS by_type,
       '/tables/' || {slug_sql("coalesce(title, '')")} || '.md' AS by_name, path AS by_relative_path,
       path AS by_path, '/tables/' || {slug_sql('stem')} || '.md' AS by_file
FROM concepts
"""))
def p02(spark, sf):
    title = F.coalesce("title", F.lit(""))
    return derive.concepts(spark, sf).select(
        "path",
        naming.path_for_type(C("type"), text.slugify(title)).alias("by_type"),
        naming.concept_ref(title).alias("by_name"),
        naming.concept_ref(F.substr("path", F.lit(2))).alias("by_relative_path"),
        naming.concept_ref(C("path")).alias("by_path"),
        naming.concept_ref(F.concat("stem", F.lit(".md"))).alias("by_file"),
    )


@query("p03_infer_layer", with_parts("statements", f"SELECT path, {layer_sql('path')} AS layer FROM statements"))
def p03(spark, sf):
    return derive.statements(spark, sf).select("path", naming.infer_layer(C("path")).alias("layer"))


def _labels_oracle(x: str) -> str:
    arms = []
    for pattern, label in model.SECRET_RULES + model.PII_RULES:
        arms.append(f"CASE WHEN regexp_matches({x}, {quoted([pattern])}) THEN '{label}' END")
        x = f"regexp_replace({x}, {quoted([pattern])}, '{label}', 'g')"
    return f"concat_ws(',', {', '.join(arms)})"


@query("p04_scrub", f"""
SELECT doc_id, sha256({scrub_sql('text')}) AS scrubbed_hash, length({scrub_sql('text')}) AS scrubbed_length,
       {_labels_oracle('text')} AS labels FROM documents
""")
def p04(spark, sf):
    docs = text.spread(derive.table(spark, sf, "documents").select("doc_id", "text"))
    return text.settle(docs, s=scrub.scrub_with_labels(C("text"))).select(
        "doc_id", F.sha2("s.clean", 256).alias("scrubbed_hash"),
        F.length("s.clean").cast("bigint").alias("scrubbed_length"), F.array_join("s.labels", ",").alias("labels"),
    )


@query("p05_secret_hint", f"SELECT doc_id FROM documents WHERE regexp_matches(text, {quoted([model.SECRET_HINT])})")
def p05(spark, sf):
    return derive.table(spark, sf, "documents").filter(scrub.has_secret_hint(C("text"))).select("doc_id")


_SOURCES = first_seen_sql(
    f"SELECT path, list_transform({refs_sql('sql')}, lambda n: {last_sql('n')}) AS items FROM statements", "path", "name"
)


@query("p06_sql_sources", with_parts("statements", f"""
SELECT s.path, coalesce(f.names, '') AS names FROM statements s LEFT JOIN ({_SOURCES}) f ON f.path = s.path
"""))
def p06(spark, sf):
    return derive.statements(spark, sf).select(
        "path", F.array_join(sqltext.sql_sources(C("sql")), ",").alias("names")
    )


@query("p07_sql_edges", with_parts("statements", f"""
SELECT DISTINCT path, source, target FROM (
  SELECT path, target, unnest(list_transform({refs_sql('sql')}, lambda n: {last_sql('n')})) AS source
  FROM (SELECT path, sql, unnest({targets_sql('sql')}) AS target FROM statements) t
) x WHERE source <> target
"""))
def p07(spark, sf):
    return resolve.statement_edges(derive.statements(spark, sf)).select("path", "source", "target")


@query("p08_statement_kind", with_parts("statements", r"""
SELECT path, (contains(lower(sql), 'create view') OR regexp_matches(lower(sql), 'create\s+or\s+replace\s+view')
              OR contains(lower(path), '/views/')) AS is_view,
       (contains(lower(sql), 'create table') OR contains(lower(sql), 'insert into') OR contains(lower(sql), 'merge into')
              OR contains(lower(sql), 'create or replace table')) AS writes_table
FROM statements
"""))
def p08(spark, sf):
    return derive.statements(spark, sf).select(
        "path", sqltext.is_view(C("sql"), C("path")).alias("is_view"), sqltext.writes_table(C("sql")).alias("writes_table")
    )


@query("p09_tokenize", f"""
SELECT doc_id, len({tokens_sql('text')}) AS token_count, sha256(array_to_string({tokens_sql('text')}, ' ')) AS token_hash
FROM documents
""")
def p09(spark, sf):
    tokens = text.tokenize(C("text"))
    return derive.table(spark, sf, "documents").select("doc_id", tokens.alias("tokens")).select(
        "doc_id", F.size("tokens").cast("bigint").alias("token_count"),
        F.sha2(F.array_join("tokens", " "), 256).alias("token_hash"),
    )


@query("p10_estimate_tokens", "SELECT doc_id, CAST(floor((length(text) + 3) / 4) AS BIGINT) AS tokens FROM documents")
def p10(spark, sf):
    return derive.table(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.length("text")).alias("tokens"))


def _human_sql(x: str) -> str:
    base = f"(CASE WHEN ends_with({x}, '.md') THEN {stem_sql(x)} ELSE {x} END)"
    bare = f"regexp_replace({base}, '(?i)^(raw-|bronze-|silver-|gold-|stg_|dim_|fct_|fact_)', '')"
    kept = (
        rf"list_filter(regexp_split_to_array({bare}, '[_\-\s]+'), lambda p: p <> '' AND lower(p) NOT IN ({quoted(model.NAME_NOISE)}))"
    )
    chosen = f"(CASE WHEN len({kept}) = 0 THEN [{bare}] ELSE {kept} END)"
    return f"array_to_string(list_transform({chosen}, lambda p: upper(left(p, 1)) || lower(substr(p, 2))), ' ')"


@query("p11_humanize", with_parts("concepts", f"""
SELECT path, {_human_sql("coalesce(title, stem)")} AS business_name, {_human_sql("stem || '.md'")} AS from_file FROM concepts
"""))
def p11(spark, sf):
    return derive.concepts(spark, sf).select(
        "path", naming.humanize(F.coalesce("title", "stem")).alias("business_name"),
        naming.humanize(F.concat("stem", F.lit(".md"))).alias("from_file"),
    )


_PROSE = (
    rf"list_filter(list_transform(regexp_split_to_array(body, '\r?\n'), lambda l: {strip_sql('l')}), "
    r"lambda l: l <> '' AND NOT regexp_matches(l, '^(#|\||```|\*\*|-)'))[1]"
)


@query("p12_infer_definition", with_parts("concepts", f"""
SELECT path, sha256(CASE
  WHEN coalesce(description, '') <> '' AND NOT starts_with(lower(description), 'table ') AND NOT starts_with(lower(description), 'referenced')
    THEN {strip_sql('description')}
  ELSE coalesce({_PROSE}, '**' || name || '**: the business view of `' || coalesce(fqn, title, name) || '`, kept in the ' || coalesce(layer, 'curated') || ' layer.')
  END) AS definition_hash
FROM (SELECT *, {_human_sql('coalesce(title, stem)')} AS name FROM concepts) c
"""))
def p12(spark, sf):
    named = derive.concepts(spark, sf).withColumn("name", naming.humanize(F.coalesce("title", "stem")))
    definition = naming.infer_definition(C("name"), C("title"), C("description"), C("layer"), C("fqn"), C("body"))
    return named.select("path", F.sha2(definition, 256).alias("definition_hash"))


@query("p13_synonyms", with_parts("concepts", f"""
SELECT path, array_to_string(list_sort(list_distinct(list_filter(
  [coalesce(title, stem), replace(coalesce(title, stem), '-', '_'), {stem_sql('coalesce(title, stem)')}],
  lambda s: s <> {_human_sql('coalesce(title, stem)')})))[1:6], '|') AS synonyms FROM concepts
"""))
def p13(spark, sf):
    technical = F.coalesce("title", "stem")
    return derive.concepts(spark, sf).select(
        "path", F.array_join(naming.synonyms(technical, naming.humanize(technical)), "|").alias("synonyms")
    )


@query("p14_content_hash", with_parts("concepts", """
SELECT path, left(sha256(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || type || ' '
       || array_to_string(tags, ' ') || ' ' || body), 16) AS hash FROM concepts
"""))
def p14(spark, sf):
    card = text.card_text(C("title"), C("description"), C("type"), C("tags"), C("body"))
    return derive.concepts(spark, sf).select("path", text.short_hash(card).alias("hash"))


@query("p15_layer_mention", with_parts("concepts", """
SELECT path, array_to_string(list_filter(['bronze', 'silver', 'gold'], lambda m: contains(
  lower(concat_ws(' ', title, stem, layer, array_to_string(tags, ' '))), m)), ',') AS layers FROM concepts
"""))
def p15(spark, sf):
    found = naming.layers_mentioned(C("title"), C("stem"), C("layer"), C("tags"))
    return derive.concepts(spark, sf).select("path", F.array_join(found, ",").alias("layers"))


@query("p16_vacuous_definition", with_parts("concepts", f"""
SELECT path, (length(d) < 24 OR starts_with(d, 'data about') OR d IN ('todo', 'tbd', 'n/a')) AS vacuous FROM (
  SELECT path, lower({strip_sql("CASE WHEN coalesce(description, '') <> '' THEN description ELSE body END")}) AS d
  FROM concepts WHERE type IN ('BusinessObject', 'GlossaryTerm')
) x
"""))
def p16(spark, sf):
    said = derive.concepts(spark, sf).filter(C("type").isin("BusinessObject", "GlossaryTerm"))
    return said.select("path", naming.is_vacuous(C("description"), C("body")).alias("vacuous"))


@query("p17_pack_excerpt", rf"""
SELECT doc_id, sha256(array_to_string(list_filter(regexp_split_to_array({strip_sql('text')}, '\r?\n'),
  lambda l: {strip_sql('l')} <> '' AND NOT starts_with(l, '#')), chr(10))) AS excerpt_hash FROM documents
""")
def p17(spark, sf):
    return derive.table(spark, sf, "documents").select(
        "doc_id", F.sha2(text.excerpt(C("text")), 256).alias("excerpt_hash")
    )


@query("p18_sql_fingerprint", with_parts("statements", f"SELECT path, sha256({scrub_sql('sql')}) AS fingerprint FROM statements"))
def p18(spark, sf):
    return derive.statements(spark, sf).select("path", sqltext.sql_fingerprint(C("sql")).alias("fingerprint"))


@query("w06_first_seen", with_parts("statements", first_seen_sql(
    f"SELECT path, list_concat({refs_sql('sql')}, {targets_sql('sql')}, {refs_sql('sql')}) AS items FROM statements", "path", "name"
)))
def w06(spark, sf):
    """Every name a statement mentions, in first-seen order, over a repeated list."""
    mentions = F.concat(
        sqltext.source_refs(C("sql")), sqltext.sql_targets(C("sql")), sqltext.source_refs(C("sql"))
    )
    named = derive.statements(spark, sf).select("path", F.array_distinct(mentions).alias("names"))
    return named.filter(F.size("names") > 0).select("path", F.array_join("names", ",").alias("names"))
