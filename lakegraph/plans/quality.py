"""Histograms, validation, header checks, health and grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegraph import model
from lakegraph.operators import grade, graph, quality
from lakegraph.plans.joins import _KNOWN
from lakegraph.plans.registry import query, quoted, strip_sql, with_parts
from lakegraph.session import cut
from lakegraph.sources import derive

C = F.col


def _catalog(spark, sf):
    """Assets, links and edges; the first two are written once, as many rules read them."""
    concepts, links = cut(derive.concepts(spark, sf)), cut(derive.links(spark, sf))
    return concepts, links, graph.flow_edges(links)


def _bundle(spark, sf):
    """What a check of the whole bundle needs besides its assets and links."""
    return {"listed": derive.listings(spark, sf), "root": derive.root_files(spark, sf)}


def _manifest(concepts):
    """The manifest of an index over the assets, as stored beside it."""
    return cut(concepts.agg(F.count(F.lit(1)).alias("concept_count")))


@query("a01_type_histogram", with_parts("concepts", "SELECT coalesce(type, '?') AS type, count(*) AS n FROM concepts GROUP BY ALL"))
def a01(spark, sf):
    return quality.type_histogram(derive.concepts(spark, sf))


@query("a02_layer_histogram", with_parts("concepts", """
SELECT coalesce(layer, '—') AS layer, count(*) AS n FROM concepts WHERE type IN ('Table', 'View') GROUP BY ALL
"""))
def a02(spark, sf):
    return quality.layer_histogram(derive.concepts(spark, sf))


@query("a03_business_coverage", with_parts("concepts", """
SELECT round(count(*) FILTER (type = 'BusinessObject') / count(*) FILTER (type = 'Table'), 2) AS coverage FROM concepts
"""))
def a03(spark, sf):
    of_type = lambda t: F.count_if(C("type") == t)
    return derive.concepts(spark, sf).agg(
        quality.business_coverage(of_type("BusinessObject"), of_type("Table")).alias("coverage")
    )


@query("u03_layer_coverage", with_parts("concepts", """
SELECT count(DISTINCT layer) AS layers, round(count(DISTINCT layer) / 3.0, 6) AS coverage FROM concepts WHERE layer IN ('bronze', 'silver', 'gold')
"""))
def u03(spark, sf):
    present = derive.concepts(spark, sf).filter(C("layer").isin(*model.MEDALLION)).select("layer").distinct()
    return present.agg(
        F.count(F.lit(1)).alias("layers"), F.round(F.count(F.lit(1)) / len(model.MEDALLION), 6).alias("coverage")
    )


_FINDINGS = f"""
hrefs AS (
  SELECT path, href, regexp_replace(href, '^/+', '/') AS key FROM (
    SELECT path, regexp_replace(unnest(regexp_extract_all(body, {quoted([model.MARKDOWN_LINK])}, 2)), '[#?].*$', '') AS href FROM concepts
  ) h WHERE starts_with(href, '/') AND NOT starts_with(href, '//') AND href <> '/'
), odd AS (SELECT path, unnest(range({derive.BAD_LINKS_SQL})) AS i FROM concepts),
findings AS MATERIALIZED (
  SELECT path, 'error' AS severity, 'missing_field' AS rule, 'title' AS detail FROM concepts WHERE title IS NULL
  UNION ALL SELECT src, 'error', 'broken_link', target FROM links WHERE target NOT IN ({_KNOWN})
  UNION ALL SELECT path, 'error', 'broken_href', href FROM hrefs
    WHERE key NOT IN (SELECT path FROM concepts) AND key NOT IN ('/index.md', '/tables/index.md', '/views/index.md')
  UNION ALL SELECT path, 'warning', 'non_object_link', '' FROM odd
  UNION ALL SELECT '/', 'warning', 'missing_structure', 'catalog:' || catalog FROM (SELECT DISTINCT catalog FROM concepts) c
    WHERE catalog NOT IN ('tables', 'views')
  UNION ALL SELECT '/', 'warning', 'missing_structure', 'layer:' || unnest(['bronze', 'silver', 'gold'])
  UNION ALL SELECT '/index.md', 'warning', 'missing_version', '{model.VERSION_KEY}'
  UNION ALL SELECT '/log.md', 'warning', 'missing_file', ''
)
"""


@query("v01_bundle_validation", with_parts("concepts links", f"WITH {_FINDINGS} SELECT path, severity, rule, detail FROM findings"))
def v01(spark, sf):
    concepts, links, _ = _catalog(spark, sf)
    return quality.validate(concepts, links, **_bundle(spark, sf))


@query("l02_capped_samples", with_parts("concepts links", f"""
WITH {_FINDINGS}
SELECT rule, path, detail, total, n AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY rule ORDER BY path, detail) AS n, count(*) OVER (PARTITION BY rule) AS total FROM findings
) x WHERE n <= 10
"""))
def l02(spark, sf):
    concepts, links, _ = _catalog(spark, sf)
    sampled = quality.capped_samples(cut(quality.validate(concepts, links, **_bundle(spark, sf))), "rule", ["path", "detail"], 10)
    return sampled.select("rule", "path", "detail", "total", C("rank").cast("bigint").alias("rank"))


def _header_fields(concepts):
    """Derived assets with their header as key, text and kind maps."""
    fields = {
        "type": (C("type"), "string"), "title": (C("title"), "string"), "description": (C("description"), "string"),
        "status": (C("status"), "string"), "layer": (C("layer"), "string"), "ingestion_mode": (C("mode"), "string"),
        "tags": (F.array_join("tags", ","), "array"), "verified": (F.lit("true"), "boolean"),
        "wiki_key": (C("stem"), "string"),
        # Written as a bare number on every seventh asset.
        "owner": (F.when(F.length("stem") % 7 == 0, F.lit("7")), "integer"),
    }
    keys = F.array(*[F.lit(k) for k in fields])
    return concepts.withColumn("fields", F.map_from_arrays(keys, F.array(*[v for v, _ in fields.values()]))).withColumn(
        "kinds", F.map_from_arrays(keys, F.array(*[F.when(v.isNotNull(), F.lit(k)) for v, k in fields.values()]))
    ).withColumn("untargeted_links", F.when(C("path").startswith("/metrics/"), 1).otherwise(0))


@query("v02_schema_validation", with_parts("concepts", f"""
SELECT path, type, 'title' AS field, 'required' AS "check" FROM concepts WHERE coalesce(title, '') = ''
UNION ALL SELECT path, type, 'status', 'enum' FROM concepts WHERE status NOT IN ({quoted(model.STATUS_VALUES)})
  AND type NOT IN ({quoted(model.PLAIN_TYPES)})
UNION ALL SELECT path, type, 'layer', 'enum' FROM concepts WHERE type = 'Table' AND layer NOT IN ('bronze', 'silver', 'gold', 'raw', 'sandbox')
UNION ALL SELECT path, type, 'ingestion_mode', 'enum' FROM concepts WHERE type = 'IngestionJob'
  AND mode NOT IN ({quoted(model.TYPE_ENUMS['IngestionJob']['ingestion_mode'])})
UNION ALL SELECT path, type, 'owner', 'string' FROM concepts WHERE length(stem) % 7 = 0
UNION ALL SELECT path, type, 'links', 'link_target' FROM concepts WHERE type = 'Metric'
"""))
def v02(spark, sf):
    return quality.check_headers(_header_fields(derive.concepts(spark, sf)), quality.header_rules(spark))


@query("v03_health_report", with_parts("concepts links edges nodes", f"""
WITH {_FINDINGS}, c AS (
  SELECT count(*) AS concept_count, count(*) FILTER (type = 'Table') AS tables, count(*) FILTER (type = 'BusinessObject') AS business_objects,
         count(*) FILTER (type = 'GlossaryTerm') AS glossary_terms,
         count(*) FILTER (type IN ('Table', 'View', 'Query', 'BusinessObject') AND path NOT IN (SELECT node FROM nodes)) AS orphan_count
  FROM concepts
), e AS (SELECT count(*) AS edge_count FROM edges), f AS (
  SELECT count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count FROM findings)
SELECT concept_count, tables, business_objects, glossary_terms, edge_count, orphan_count, error_count, warning_count,
       round(business_objects / tables, 2) AS business_coverage, round(edge_count / greatest(tables, 1), 6) AS density,
       concept_count > 0 AS index_built, error_count = 0 AS validation_ok FROM c, e, f
"""))
def v03(spark, sf):
    concepts, links, edges = _catalog(spark, sf)
    return quality.health(concepts, links, cut(edges), **_bundle(spark, sf), manifest=_manifest(concepts))


_BLOB = "(coalesce(description, '') || chr(10) || coalesce(body, ''))"
_CITING = quoted(["Table", "View", "Transformation", "Workflow", "SourceSystem", "LineagePath"])
_SAID = f"lower({strip_sql("CASE WHEN coalesce(description, '') <> '' THEN description ELSE body END")})"
_GRADE = f"""
WITH {_FINDINGS}, c AS (
  SELECT count(*) FILTER (type = 'Table') AS tables,
    count(*) FILTER (type = 'Table' AND (layer = 'gold' OR contains(path, 'gold') OR contains(path, '/mart'))) AS gold,
    count(*) FILTER (type = 'Table' AND layer = 'bronze') AS bronze, count(*) FILTER (type = 'Workflow') AS workflows,
    count(*) FILTER (type = 'BusinessObject') AS objects, count(*) FILTER (type = 'GlossaryTerm') AS terms,
    count(*) FILTER (type IN ('Transformation', 'Query', 'SqlArtifact')) AS processors,
    count(*) FILTER (type = 'SourceSystem' AND kind = 'stream') AS streams,
    count(*) FILTER (type = 'SourceSystem' AND kind = 'stream' AND path IN (SELECT node FROM nodes)) AS linked,
    count(*) FILTER (type IN ({_CITING}) AND (length({strip_sql(_BLOB)}) >= 40 OR contains(body, '```'))) AS cited,
    count(*) FILTER (type IN ({_CITING}, 'Query')) AS eligible,
    count(*) FILTER (regexp_matches({_BLOB}, {quoted([model.SECRET_HINT])})) AS secrets,
    count(*) FILTER (type = 'BusinessObject' AND (length({_SAID}) < 24 OR starts_with({_SAID}, 'data about') OR {_SAID} IN ('todo', 'tbd', 'n/a'))) AS vacuous,
    count(*) FILTER (type IN ('Table', 'View', 'Query', 'BusinessObject') AND path NOT IN (SELECT node FROM nodes)) AS orphans
  FROM concepts
), layers AS (
  SELECT count(*) AS n FROM (SELECT unnest(['bronze', 'silver', 'gold']) AS m) x WHERE EXISTS (
    SELECT 1 FROM concepts WHERE contains(lower(concat_ws(' ', title, layer, array_to_string(tags, ' '))), m))
), e AS (SELECT count(*) AS edges FROM edges), f AS (SELECT count(*) FILTER (severity = 'error') AS errors FROM findings),
parts AS (
  SELECT *, errors = 0 AS ok, (gold > 0 AND objects = 0) AS hard_gold FROM c, e, f, layers
), scores AS (
  SELECT *,
    round(0.35 * (tables > 0)::INT + 0.25 * least(1, n / 3.0) + 0.20 * (CASE WHEN ok THEN 1 ELSE 0.35 END)
      + 0.20 * greatest(0, round(1 - orphans / greatest(tables, 1), 3)), 3) AS structural_coverage,
    round(least(1, round(0.45 + least(edges / greatest(tables, 1), 2) * 0.25, 3) + (CASE WHEN ok THEN 0.1 ELSE 0 END)), 3) AS lineage_integrity,
    round(0.4 * (linked / streams) + 0.3 * (CASE WHEN workflows > 0 THEN 1 ELSE 0.6 END) + 0.3 * (CASE WHEN bronze > 0 THEN 1 ELSE 0.4 END), 3) AS stream_job_landing,
    round(round(0.55 * least(1, objects / gold) + 0.25 * least(1, terms / objects) + 0.20 * least(1, round(objects / tables, 2)), 3)
      * (1 - 0.15 * (vacuous / objects)), 3) AS business_fidelity,
    round(0.5 * (cited / eligible) + 0.3 + 0.2 * (CASE WHEN ok THEN 1 ELSE 0.5 END), 3) AS evidence_traceability,
    (secrets > 0)::INT + hard_gold::INT AS hard_fail_count
  FROM parts
), resisted AS (
  SELECT *, least(CASE WHEN hard_fail_count > 0 THEN 0.4 ELSE 1 END,
    greatest(0, round(1 - 0.15 * (hard_fail_count + vacuous + errors), 3))) AS adversarial_resistance FROM scores
), total AS (
  SELECT *, round(0.2 * structural_coverage + 0.25 * lineage_integrity + 0.15 * stream_job_landing + 0.15 * business_fidelity
    + 0.15 * evidence_traceability + 0.1 * adversarial_resistance, 3) AS score FROM resisted
)
"""


def _grades(spark, sf):
    concepts, links, edges = _catalog(spark, sf)
    return grade.grade(grade.grade_inputs(concepts, links, cut(edges), **_bundle(spark, sf), manifest=_manifest(concepts)))


_CRITERIA = list(model.GRADE_WEIGHTS)


@query("a08_grade", with_parts("concepts links edges nodes", _GRADE + f"""
SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _CRITERIA)}, CAST(hard_fail_count AS BIGINT) AS hard_fail_count, CAST(score AS DOUBLE) AS score,
       score >= 0.75 AND hard_fail_count = 0 AS passed,
       CASE WHEN ok THEN 0 ELSE 1 END + (orphans > 0)::INT + (vacuous > 0)::INT + (secrets > 0)::INT AS revision_count FROM total
"""))
def a08(spark, sf):
    return _grades(spark, sf).select(
        *_CRITERIA, "hard_fail_count", "score", "passed", F.size("revisions").cast("bigint").alias("revision_count")
    )


def _source_scores(spark, sf):
    """Scores per document source on the business criteria, from labels."""
    docs = derive.table(spark, sf, "documents").join(derive.table(spark, sf, "labels"), "doc_id", "left")
    share = lambda cond: F.round(F.count_if(cond) / F.count(F.lit(1)), 3)
    per_source = docs.groupBy("source").agg(
        F.round(F.count_if(C("quality") == 1) / F.greatest(F.count("quality"), F.lit(1)), 3).alias("gold_coverage"),
        F.round(1 - F.count_if(C("toxic") == 1) / F.greatest(F.count("toxic"), F.lit(1)), 3).alias("definition_quality"),
        share(C("quality").isNotNull()).alias("glossary_alignment"), share(C("n_chars") >= 1000).alias("metric_binding"),
    )
    names = ["gold_coverage", "definition_quality", "glossary_alignment", "metric_binding"]
    return per_source.select(C("source").alias("subject"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("criterion"), C(n).alias("score")) for n in names
    ])))


_SOURCE_SCORES = """
per_source AS (
  SELECT source, round(count(*) FILTER (quality = 1) / greatest(count(quality), 1), 3) AS gold_coverage,
         round(1 - count(*) FILTER (toxic = 1) / greatest(count(toxic), 1), 3) AS definition_quality,
         round(count(quality) / count(*), 3) AS glossary_alignment, round(count(*) FILTER (n_chars >= 1000) / count(*), 3) AS metric_binding
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
)
"""


@query("a09_rubric_mean", f"""
WITH {_SOURCE_SCORES}, s AS (
  SELECT source AS subject, round(0.3 * gold_coverage + 0.3 * definition_quality + 0.2 * glossary_alignment + 0.2 * metric_binding, 3) AS score FROM per_source
)
SELECT subject, 'business-fidelity' AS rubric, score, CAST(0.72 AS DOUBLE) AS threshold, score >= 0.72 AS passed FROM s
""")
def a09(spark, sf):
    return grade.rubric_scores(_source_scores(spark, sf), grade.rubric_criteria(spark)).select(
        "subject", "rubric", "score", "threshold", "passed"
    )


@query("a10_judgment_merge", f"""
WITH {_SOURCE_SCORES}, n AS (
  SELECT source, count(*) FILTER (toxic = 1) AS open, count(*) FILTER (toxic = 1 AND quality = 1) > 0 AS hard
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
), m AS (
  SELECT source AS subject, round(0.20 * glossary_alignment + 0.25 * least(gold_coverage, definition_quality) + 0.15 * metric_binding + 0.15 * gold_coverage
    + 0.15 * definition_quality + 0.10 * greatest(0, least(1, 1 - 0.15 * open)), 3) AS score, coalesce(hard, false) AS hard_fail
  FROM per_source JOIN n USING (source)
)
SELECT subject, score, score >= 0.75 AND NOT hard_fail AS passed, hard_fail FROM m
""")
def a10(spark, sf):
    """Label scores as a producer's, with a skeptic's word on two criteria."""
    scores = cut(_source_scores(spark, sf))
    roles = {"glossary_alignment": ["structural_coverage"], "gold_coverage": ["lineage_integrity", "business_fidelity"],
             "metric_binding": ["stream_job_landing"], "definition_quality": ["evidence_traceability"]}
    pairs = spark.createDataFrame([(k, v) for k, vs in roles.items() for v in vs], "criterion string, role string")
    producer = scores.join(pairs, "criterion").select("subject", C("role").alias("criterion"), "score")
    skeptic = scores.filter(C("criterion") == "definition_quality").select(
        "subject", F.lit("lineage_integrity").alias("criterion"), "score"
    )
    labelled = derive.table(spark, sf, "documents").join(derive.table(spark, sf, "labels"), "doc_id")
    issues = labelled.filter(C("toxic") == 1).select(C("source").alias("subject"), (C("quality") == 1).alias("hard"))
    return grade.merge_judgments(producer, skeptic, issues)
