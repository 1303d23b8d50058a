"""Finding the asset a name stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakegraph import model
from lakegraph.functions.naming import concept_ref, path_for_type
from lakegraph.functions.sqltext import clean_sql, first_sql_block, source_refs, sql_sources, sql_targets
from lakegraph.functions.text import let, settle, slugify
from lakegraph.session import cut, looked_up

RESOLVABLE = ("tables", "views", "queries")


def _catalog_rank(catalog: Column) -> Column:
    rank = F.lit(len(RESOLVABLE))
    for i, name in enumerate(RESOLVABLE):
        rank = F.when(catalog == name, F.lit(i)).otherwise(rank)
    return rank


def name_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def resolve_names(names: DataFrame, concepts: DataFrame, *, contains: bool = False) -> DataFrame:
    """``name, path``: the asset whose file stem is the name, or ends in ``-name``.

    Tables win over views over queries, equality over a suffix, then the
    smallest path.  Every dash suffix of a stem is a join key and only the
    best asset per key survives the map-side aggregation, so the join is an
    equi-join with one row per key however many assets share a suffix.
    ``contains`` also accepts stems that merely contain the name.
    """
    known = concepts.filter(F.col("catalog").isin(*RESOLVABLE)).select(
        "path", "stem", _catalog_rank(F.col("catalog")).alias("rank")
    )
    keys = let(F.split("stem", "-"), lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(
            F.array_join(F.slice(parts, i, F.size(parts)), "-").alias("key"),
            F.when(i == 1, F.lit(0)).otherwise(F.lit(1)).alias("looseness"),
        ),
    ))
    best = (
        known.select("path", "rank", F.inline(keys))
        .groupBy("key").agg(F.min(F.struct("rank", "looseness", "path")).alias("best"))
    )
    wanted = names.select("name").distinct().withColumn("key", name_key(F.col("name")))
    resolved = wanted.join(best, "key").select("name", "key", "best")
    if contains:
        rest = wanted.join(best.select("key"), "key", "left_anti")
        resolved = resolved.unionByName(_containing(rest, known))
    return resolved.select("name", F.col("best.path").alias("path"))


def _containing(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Best asset whose stem contains the key, by equality with whole pieces of stems.

    Stems are cut at every place into the lengths that occur among the keys, and
    only the best asset of a piece leaves a task, so a piece that a large share of
    all stems holds is still one row per task and the lookup has no pairs to test.
    """
    lengths = wanted.agg(F.collect_set(F.length("key"))).scalar()
    pieces = F.array_distinct(F.flatten(F.transform(
        F.filter("_sizes", lambda n: n.between(1, F.length("stem"))),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.length("stem") - n + 1), lambda i: F.substring(F.col("stem"), i, n)
        ),
    )))
    best = (
        known.withColumn("_sizes", lengths).select("path", "rank", F.explode(pieces).alias("key"))
        .groupBy("key").agg(F.min(F.struct("rank", F.lit(2).alias("looseness"), "path")).alias("best"))
    )
    return wanted.filter(F.length("key") > 0).join(best, "key").select("name", "key", "best")


def body_statements(concepts: DataFrame) -> DataFrame:
    """``path, sql``: the first fenced SQL block of every asset body that has one."""
    found = settle(concepts.select("path", "body"), sql=first_sql_block(F.col("body")))
    return found.filter("sql IS NOT NULL").select("path", "sql")


def statement_edges(statements: DataFrame, sql: str = "sql", *, compat: bool = False) -> DataFrame:
    """``path, source, target`` names: everything a statement reads flows into what it writes."""
    text = settle(statements.select("path", sql), text=F.col(sql) if compat else clean_sql(F.col(sql)))
    named = settle(
        text, targets=sql_targets(F.col("text"), compat=compat, cleaned=True),
        sources=sql_sources(F.col("text"), compat=compat, cleaned=True),
    )
    both = named.select("path", F.explode("targets").alias("target"), "sources")
    return both.select("path", F.explode("sources").alias("source"), "target").filter(
        F.col("source") != F.col("target")
    )


def resolved_statement_edges(statements: DataFrame, concepts: DataFrame, **options) -> DataFrame:
    """Statement edges between assets that exist, as distinct ``src, dst``."""
    pairs = cut(statement_edges(statements, **options).select("source", "target").distinct())
    names = pairs.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    found = cut(resolve_names(names, concepts))
    return (
        pairs.join(looked_up(found.select(F.col("name").alias("source"), F.col("path").alias("src")), "source"), "source")
        .join(looked_up(found.select(F.col("name").alias("target"), F.col("path").alias("dst")), "target"), "target")
        .filter(F.col("src") != F.col("dst"))
        .select("src", "dst").distinct()
    )


def stub_tables(statements: DataFrame, *, compat: bool = False) -> DataFrame:
    """``name, layer, referenced_by`` of tables that are read but written nowhere.

    A layer in the qualified name counts; otherwise a reader in silver or gold
    implies bronze.  The reader with the smallest path speaks for the table.
    """
    named = settle(
        statements.select("path", "layer", "sql"),
        refs=source_refs(F.col("sql"), compat=compat), targets=sql_targets(F.col("sql"), compat=compat),
    )
    reads = named.select("path", "layer", F.explode("refs").alias("ref"))
    written = named.select(F.explode("targets").alias("name")).distinct()
    first = (
        reads.withColumn("name", F.substring_index("ref", ".", -1))
        .groupBy("name").agg(F.min(F.struct("path", "layer", "ref")).alias("reader"))
    )
    qualifier = F.lower(F.regexp_extract(F.col("reader.ref"), r"([^.]+)\.[^.]+$", 1))
    below = F.when(F.col("reader.layer").isin("silver", "gold"), F.lit("bronze")).otherwise(F.col("reader.layer"))
    layer = below if compat else F.when(qualifier.isin(*model.PROMOTION_ORDER), qualifier).otherwise(below)
    stubs = first.join(written, "name", "left_anti").withColumn("layer", layer)
    return stubs.select(
        "name", "layer",
        path_for_type(F.lit("Table"), slugify(F.concat_ws("-", "layer", "name"))).alias("path"),
        F.col("reader.path").alias("referenced_by"),
    )


def resolve_subjects(subjects: list[str], concepts: DataFrame) -> DataFrame:
    """``subject, path, score`` of the best asset for each free-text subject.

    Stem contains the subject: 3.  Title equals it: 4, title and subject
    contain one another: 1.  A type word in the subject: 2 for that type.
    The subjects are a short argument list; they are matched row by row inside
    the asset scan, so there is no pairwise join.  Subjects that score nowhere
    get the default path of the catalog their wording suggests.
    """
    spark = concepts.sparkSession
    asked = []
    for s in dict.fromkeys(subjects):
        name = s.strip()
        # Only a path under a folder stands for itself; a bare file name is searched.
        given = name.endswith(".md") and "/" in name
        words = [t for word, t in model.SUBJECT_TYPE_WORDS.items() if word in name.lower()]
        catalog = next((c for ws, c in model.SUBJECT_CATALOG_WORDS if any(w in name.lower() for w in ws)),
                       model.DEFAULT_CATALOG)
        bare = name.removesuffix(".md").rsplit("/", 1)[-1] if name.endswith(".md") else name
        asked.append((s, bare, "/" + name.lstrip("/") if given else None, name, catalog, words))
    table = spark.createDataFrame(
        asked, "subject string, bare string, given string, name string, catalog string, type_words array<string>"
    ).withColumn("slug", slugify(F.col("bare")))
    open_subjects = [a for a in asked if a[2] is None]
    scored = None
    if open_subjects:
        literal = F.array(*[
            F.struct(F.lit(a[0]).alias("subject"), slugify(F.lit(a[1])).alias("slug"),
                     F.array(*[F.lit(t) for t in a[5]]).cast("array<string>").alias("type_words"))
            for a in open_subjects
        ])
        # One point pair per type word, as some types have two words.
        boost = lambda s, type_: 2 * F.size(F.filter(s["type_words"], lambda t: t == type_))

        def score(s: Column, stem: Column, title_slug: Column, type_: Column) -> Column:
            text = (
                F.when(F.contains(stem, s["slug"]), F.lit(3)).otherwise(F.lit(0))
                + F.when(title_slug == s["slug"], F.lit(4)).otherwise(F.lit(0))
                + F.when(F.contains(title_slug, s["slug"]) | F.contains(s["slug"], title_slug), F.lit(1))
                .otherwise(F.lit(0))
            )
            return F.struct(s["subject"].alias("subject"), (text + boost(s, type_)).alias("score"))

        title_slug = slugify(F.coalesce("title", F.lit("")))
        rows = concepts.select("path", "stem", F.coalesce("type", F.lit("")).alias("type"), title_slug.alias("ts"))
        hits = rows.select("path", F.inline(F.filter(
            F.transform(literal, lambda s: score(s, F.col("stem"), F.col("ts"), F.col("type"))),
            lambda r: r["score"] > 0,
        )))
        # Best score first, then smallest path: one map-side aggregate.
        scored = hits.groupBy("subject").agg(
            F.min(F.struct((-F.col("score")).alias("neg"), F.col("path"))).alias("best")
        ).select("subject", F.col("best.path").alias("found"), (-F.col("best.neg")).alias("points"))
    if scored is None:
        scored = spark.createDataFrame([], "subject string, found string, points int")
    fallback = concept_ref(F.col("name"), F.col("catalog"))
    return table.join(scored, "subject", "left").select(
        "subject",
        F.coalesce("given", "found", fallback).alias("path"),
        F.coalesce("points", F.lit(0)).cast("bigint").alias("score"),
    )
