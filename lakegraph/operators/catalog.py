"""Writing the catalog: upserts, audit events, listings, link merges, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakegraph import model
from lakegraph.functions.naming import catalog_of, concept_ref, humanize, infer_definition, path_for_type, synonyms
from lakegraph.functions.text import slugify, strip


def fingerprint(fields: dict[str, Column], body: Column) -> Column:
    """sha256 over named header fields in name order and the stripped body.

    Give no timestamp and no author: neither makes an asset a different one.
    """
    header = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(header, F.lit("\n"), strip(F.coalesce(body, F.lit("")))), 256)


def upsert(current: DataFrame, incoming: DataFrame, key: str = "path", stable: bool = True) -> DataFrame:
    """Next snapshot with an ``action`` per row.

    Both sides carry ``key, fingerprint, timestamp`` and payload columns.
    ``created`` is new, ``updated`` has another fingerprint, ``skipped`` the
    same one, ``kept`` is not part of this batch.  With ``stable`` an updated
    row keeps its old timestamp.
    """
    payload = [c for c in incoming.columns if c not in (key, "timestamp")]
    old = current.select(key, *[F.col(c).alias(f"_old_{c}") for c in ("timestamp", *payload)], F.lit(True).alias("_had"))
    new = incoming.withColumn("_has", F.lit(True))
    had, has = F.col("_had").isNotNull(), F.col("_has").isNotNull()
    action = (
        F.when(~has, F.lit("kept"))
        .when(~had, F.lit("created"))
        .when(F.col("fingerprint") == F.col("_old_fingerprint"), F.lit("skipped"))
        .otherwise(F.lit("updated"))
    )
    stays = F.col("action").isin("kept", "skipped")
    keeps_time = stays | ((F.col("action") == "updated") & F.lit(stable))
    return (
        old.join(new, key, "full_outer").withColumn("action", action)
        .select(
            key, "action",
            F.when(keeps_time, F.coalesce("_old_timestamp", "timestamp")).otherwise(F.col("timestamp")).alias("timestamp"),
            *[F.when(stays, F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in payload],
        )
    )


def write_upsert(upserted: DataFrame, folder: str, errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes the next snapshot and gives ``(snapshot, receipt)``.

    The receipt counts ``created, updated, skipped, errors`` per ``type, layer``. The
    snapshot lies in a folder per action, so it is counted from two short columns of what
    was written, and the join behind it runs once. Rows ``kept`` from before are no part
    of the batch. ``errors`` (``type, layer``, one row each) never reached the upsert. Null types and layers count as themselves.
    """
    upserted.write.partitionBy("action").parquet(folder)
    stored = upserted.sparkSession.read.schema(upserted.schema).parquet(folder)
    counted = stored.filter(F.col("action") != "kept").select("type", "layer", "action")
    if errors is not None:
        counted = counted.unionByName(errors.select("type", "layer", F.lit("error").alias("action")))
    named = {"created": "created", "updated": "updated", "skipped": "skipped", "errors": "error"}
    receipt = counted.groupBy("type", "layer").agg(*[F.count_if(F.col("action") == a).alias(n) for n, a in named.items()])
    return stored, receipt


def audit_events(upserted: DataFrame, author: str, batch: str, host: str = "") -> DataFrame:
    """One event per created or updated asset; audit events do not audit themselves.

    Without an author the whole batch is refused.  Ids depend on path and
    batch alone, so a retried batch writes the same events.
    """
    author = author.strip()
    if not author:
        raise ValueError("claim an identity first: an author is required")
    ident = F.substring(F.md5(F.concat_ws("|", F.col("path"), F.lit(batch))), 1, 16)
    return upserted.filter(
        F.col("action").isin("created", "updated") & (F.coalesce("type", F.lit("Concept")) != "WriteEvent")
    ).select(
        ident.alias("event_id"),
        F.concat(F.lit("/write-events/"), ident, F.lit(".md")).alias("path"),
        F.concat(F.lit("write "), F.coalesce("type", F.lit("Concept")), F.lit(" "),
                 F.substring_index("path", "/", -1)).alias("title"),
        F.lit(author).alias("author"), F.lit(host or "unknown").alias("host"),
        F.col("path").alias("target"), F.lit("documents").alias("rel"), "action",
    )


def listing_lines(concepts: DataFrame) -> DataFrame:
    """``catalog, path, line``: the entry of each asset in its catalog's listing."""
    label = F.replace(
        F.replace(F.coalesce("title", "stem"), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]")
    )
    annotated = (F.coalesce("layer", F.lit("")) != "") & ~F.col("catalog").isin(*model.UNANNOTATED_CATALOGS)
    suffix = F.when(annotated, F.concat(F.lit(" · "), F.col("layer"))).otherwise(F.lit(""))
    return concepts.filter(F.col("catalog").isin(*model.CATALOGS)).select(
        "catalog", "path",
        F.concat(F.lit("- ["), label, F.lit("]("), F.col("path"), F.lit(")"), suffix).alias("line"),
    )


def write_listings(lines: DataFrame, path: str) -> None:
    """Listing files per catalog, lines in path order across numbered parts.

    Range partitioning spreads a large catalog over many tasks.
    """
    (
        lines.repartitionByRange("catalog", "path").sortWithinPartitions("catalog", "path")
        .select("catalog", F.col("line").alias("value"))
        .write.partitionBy("catalog").mode("overwrite").text(path)
    )


def absolute(target: Column) -> Column:
    return F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))


def merge_links(links: DataFrame, added: DataFrame) -> DataFrame:
    """Links with the added ones that are not there yet."""
    new = added.select("src", "rel", absolute(F.col("target")).alias("target")).distinct()
    return links.select("src", "rel", "target").unionByName(
        new.join(links, ["src", "rel", "target"], "left_anti")
    )


def inverse_links(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """Links to write back on targets, only on assets that exist.

    What is written back depends on the type of the link's owner: a business
    object derived from a table marks the table, a metric derived from it does not.
    """
    back = F.array_compact(F.array(*[
        F.when((F.col("type") == type_) & (F.col("rel") == rel), F.lit(inverse))
        for type_, rel, inverse in model.INVERSE_RELATIONS
    ]))
    owners = concepts.filter(F.col("type").isin(*{t for t, _, _ in model.INVERSE_RELATIONS})).select(
        F.col("path").alias("src"), "type")
    named = links.filter(F.col("rel").isin(*{r for _, r, _ in model.INVERSE_RELATIONS})).join(owners, "src")
    written = named.select(
        F.col("target").alias("src"), F.explode(back).alias("rel"), F.col("src").alias("target")
    ).distinct()
    return written.join(concepts.select(F.col("path").alias("src")), "src", "left_semi").select("src", "rel", "target")


def asset_fields(concepts: DataFrame) -> DataFrame:
    """``path, type, field, name`` of scanned assets: one row per name in a field that some capture rule reads."""
    read = sorted({rule[1] for rule in model.CAPTURE_RULES})
    rows = concepts.select("path", "type", F.explode("fields").alias("field", "value")).filter(F.col("field").isin(read))
    inner = F.regexp_replace(F.regexp_replace("value", r"^\s*\[|\]\s*$", ""), r"(?m)^\s*-\s+", "")
    # Only a bracketed list is cut at commas; a plain name may hold one.
    parts = F.when(F.ltrim("value").startswith("["), F.split(inner, ",")).otherwise(F.split(inner, "\n"))
    unquoted = F.regexp_replace(strip(F.col("name")), r"^([\"'])(.*)\1$", "$2")
    return rows.select("path", "type", "field", F.explode(parts).alias("name")).withColumn("name", unquoted).filter(F.col("name") != "")


def captured_links(fields: DataFrame) -> DataFrame:
    """``src, rel, target`` that assets write for the names in their fields, each link once.

    ``fields`` has one ``path, type, field, name`` per name, so an asset with very
    many names is many rows. A name may be a path. The rules are a fixed list,
    looked up in the row.
    """
    def link(src: Column, rel: Column | str, target: Column) -> Column:
        return F.struct(src.alias("src"), (F.lit(rel) if isinstance(rel, str) else rel).alias("rel"), target.alias("target"))

    key = F.concat_ws(".", "type", "field")
    entry = lambda value: F.element_at(F.create_map(*[x for pair in value for x in pair]), key)
    rels = entry([(F.lit(f"{t}.{f}"), F.array(*map(F.lit, rels))) for t, f, rels, _ in model.CAPTURE_RULES])
    kind = entry([(F.lit(f"{t}.{f}"), F.lit(target)) for t, f, _, target in model.CAPTURE_RULES])
    back = entry([(F.lit(f"{t}.{f}"), F.lit(rel)) for t, f, rel in model.CAPTURE_BACK])
    known = fields.select("path", "name", rels.alias("rels"), kind.alias("kind"), back.alias("back")).filter(F.col("rels").isNotNull())
    named = known.select("path", "rels", "back", concept_ref(F.col("name"), catalog_of(F.col("kind"))).alias("other"))
    written = F.concat(
        F.transform("rels", lambda r: link(F.col("path"), r, F.col("other"))),
        F.when(F.col("back").isNotNull(), F.array(link(F.col("other"), F.col("back"), F.col("path")))).otherwise(F.array()),
    )
    return named.select(F.inline(written)).distinct()


def lineage_path_links(nodes: DataFrame) -> DataFrame:
    """Links of recorded lineage paths, from ``path, pos, node``.

    The path asset contains every node and feeds all but the first; each node
    feeds and transforms to the one after it. A window orders the nodes of one path,
    nodes of equal position by name.
    """
    order = Window.partitionBy("path").orderBy("pos", "node")
    placed = nodes.withColumn("before", F.lag("node").over(order))
    link = lambda src, rel, target: F.struct(F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(target).alias("target"))
    later = F.array(link("path", "feeds", "node"), link("before", "feeds", "node"), link("before", "transforms_to", "node"))
    written = F.concat(F.array(link("path", "contains", "node")), F.when(F.col("before").isNotNull(), later).otherwise(F.array()))
    return placed.select(F.inline(written)).distinct()


def promotions(tables: DataFrame) -> DataFrame:
    """``base, from_layer, to_layer``: adjacent layers in which the same base name exists.

    Layers are collapsed to a set of flags per base, so a base with many
    copies never travels as more than one row per map task.
    """
    flags = tables.groupBy("base").agg(*[
        F.bool_or(F.col("layer") == layer).alias(layer) for layer in model.PROMOTION_ORDER
    ])
    present = F.filter(
        F.array(*[F.when(F.col(layer), F.lit(layer)) for layer in model.PROMOTION_ORDER]), lambda l: l.isNotNull()
    )
    steps = F.transform(
        F.sequence(F.lit(1), F.size("present") - 1),
        lambda i: F.struct(F.element_at("present", i).alias("from_layer"),
                           F.element_at("present", i + 1).alias("to_layer")),
    )
    return flags.select("base", present.alias("present")).filter(F.size("present") > 1).select("base", F.inline(steps))


def layered_name(path: Column) -> tuple[Column, Column]:
    """``(layer, base)`` of a table path such as ``/tables/silver-orders.md``."""
    pattern = r"/(bronze|silver|gold|raw)-(.+)\.md$"
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), F.regexp_extract(path, pattern, 2)


def promote_layer(concepts: DataFrame, links: DataFrame, layer: str = "gold") -> DataFrame:
    """Business objects for the tables and views of a layer that have none yet.

    ``source, name, definition, synonyms, object_path, term_path``, ready to be
    written with their links by ``promotion_links``.
    """
    done = links.filter(F.col("rel") == "businessizes").select(F.col("src").alias("path"))
    open_assets = concepts.filter(
        F.col("type").isin("Table", "View") & (F.lower(F.coalesce("layer", F.lit(""))) == layer.lower())
    ).join(done, "path", "left_anti")
    technical = F.coalesce("title", "stem")
    named = open_assets.withColumn("name", humanize(technical))
    return named.select(
        F.col("path").alias("source"), "name",
        infer_definition(F.col("name"), F.col("title"), F.col("description"), F.col("layer"),
                         F.col("fqn"), F.col("body")).alias("definition"),
        synonyms(technical, F.col("name")).alias("synonyms"),
        path_for_type(F.lit("BusinessObject"), slugify(F.col("name"))).alias("object_path"),
        path_for_type(F.lit("GlossaryTerm"), slugify(F.col("name"))).alias("term_path"),
    )


def promotion_links(promoted: DataFrame) -> DataFrame:
    """Links of promoted assets: derivation, its inverse and the glossary pair."""
    rows = F.array(*[
        F.struct(F.col(a).alias("src"), F.lit(rel).alias("rel"), F.col(b).alias("target"))
        for a, rel, b in (
            ("object_path", "derived_from", "source"), ("source", "businessizes", "object_path"),
            ("object_path", "glosses", "term_path"), ("term_path", "glosses", "object_path"),
        )
    ])
    return promoted.select(F.inline(rows)).distinct()


def diff_snapshots(current: DataFrame, incoming: DataFrame, key: str, value: Column) -> DataFrame:
    """``key, action`` when a full load replaces a table: created, updated, skipped or removed."""
    old = current.select(key, value.alias("_old"), F.lit(True).alias("_had"))
    new = incoming.select(key, value.alias("_new"), F.lit(True).alias("_has"))
    action = (
        F.when(F.col("_has").isNull(), F.lit("removed"))
        .when(F.col("_had").isNull(), F.lit("created"))
        .when(F.col("_old") == F.col("_new"), F.lit("skipped"))
        .otherwise(F.lit("updated"))
    )
    return old.join(new, key, "full_outer").select(key, action.alias("action"))
