"""Operators over assets as the file reader returns them.

Every derived asset is rendered as file text and parsed again; what an operator
finds must be what it finds over the derived rows, so the check SQL is the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegraph import model
from lakegraph.operators import catalog, grade, graph, quality
from lakegraph.plans.quality import _CRITERIA, _bundle, _manifest
from lakegraph.plans.registry import ORACLES, query, quoted, with_parts
from lakegraph.plans.sources import asset_text
from lakegraph.session import cut
from lakegraph.sources import bundle, derive

C = F.col


def _scanned(spark, sf, *columns):
    """Parsed assets, written once; with ``columns`` those that the reader needs."""
    files = derive.concepts(spark, sf).select("path", asset_text().alias("text"))
    assets = bundle.parse_concepts(files)[0]
    return cut(assets.select(*columns) if columns else assets)


@query("j10_scanned_assets", ORACLES["j10_unlanded_streams"])
def j10(spark, sf):
    links = derive.links(spark, sf)
    assets = _scanned(spark, sf, "path", "type", "title", "kind", "tags")
    return quality.unlanded_streams(assets, links, graph.flow_edges(links, repeated=True))


@query("j12_scanned_assets", ORACLES["j12_fake_streams"])
def j12(spark, sf):
    return quality.fake_streams(_scanned(spark, sf, "path", "type", "title", "kind", "mode", "tags"), derive.links(spark, sf))


@query("v02_scanned_assets", with_parts("concepts", f"""
SELECT path, type, 'title' AS field, 'required' AS "check" FROM concepts WHERE coalesce(title, '') = ''
UNION ALL SELECT path, type, 'status', 'enum' FROM concepts WHERE status NOT IN ({quoted(model.STATUS_VALUES)})
  AND type NOT IN ({quoted(model.PLAIN_TYPES)})
UNION ALL SELECT path, type, 'layer', 'enum' FROM concepts WHERE type = 'Table' AND layer NOT IN ('bronze', 'silver', 'gold', 'raw', 'sandbox')
UNION ALL SELECT path, type, 'ingestion_mode', 'enum' FROM concepts WHERE type = 'IngestionJob'
  AND mode NOT IN ({quoted(model.TYPE_ENUMS['IngestionJob']['ingestion_mode'])})
"""))
def v02(spark, sf):
    assets = _scanned(spark, sf, "path", "type", "fields", "kinds", "untargeted_links")
    return quality.check_headers(assets, quality.header_rules(spark))


@query("v09_scanned_assets", ORACLES["v09_business_promotion"])
def v09(spark, sf):
    concepts = _scanned(spark, sf, "path", "type", "title", "stem", "description", "layer", "fqn", "body")
    links = derive.links(spark, sf)
    promoted = catalog.promote_layer(concepts, catalog.inverse_links(links, concepts))
    return promoted.select("source", "name", "object_path", "term_path", F.sha2("definition", 256).alias("definition_hash"))


@query("a08_scanned_assets", ORACLES["a08_grade"])
def a08(spark, sf):
    links = cut(derive.links(spark, sf))
    concepts = _scanned(spark, sf)
    inputs = grade.grade_inputs(concepts, links, cut(graph.flow_edges(links)), **_bundle(spark, sf), manifest=_manifest(concepts))
    return grade.grade(inputs).select(
        *_CRITERIA, "hard_fail_count", "score", "passed", F.size("revisions").cast("bigint").alias("revision_count"))


@query("v01_scanned_assets", ORACLES["v01_bundle_validation"])
def v01(spark, sf):
    return quality.validate(_scanned(spark, sf), cut(derive.links(spark, sf)), **_bundle(spark, sf))
