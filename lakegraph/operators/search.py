"""Token index, ranked search and intent ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lakegraph import model
from lakegraph.functions.text import (
    card_text, query_words, settle, short_hash, spread, term_vector, token_counts, tokenize,
)
from lakegraph.operators import graph
from lakegraph.operators.edge_store import EdgeStore
from lakegraph.session import cut


def index_cards(concepts: DataFrame) -> DataFrame:
    """Assets with their index text, tokens and in-row term counts; no shuffle."""
    text = card_text(F.col("title"), F.col("description"), F.col("type"), F.col("tags"), F.col("body"))
    tokens = settle(settle(spread(concepts), text=text), tokens=tokenize(F.col("text")))
    return settle(tokens, counts=token_counts(F.col("tokens")))


def inventory(cards: DataFrame) -> DataFrame:
    """One row per asset: token count and content hash."""
    return cards.select(
        "path", "type", F.coalesce("title", "stem").alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.size("tokens").cast("bigint").alias("token_count"), short_hash(F.col("text")).alias("hash"),
    )


def postings(cards: DataFrame) -> DataFrame:
    """``token, path`` pairs.  Counts are distinct per row already, so no shuffle is needed."""
    return cards.select(F.explode("counts.token").alias("token"), "path")


def write_postings(pairs: DataFrame, path: str) -> None:
    """Postings clustered by token within first-letter folders, so lookups prune files."""
    (
        pairs.withColumn("prefix", F.substring("token", 1, 1))
        .repartitionByRange("prefix", "token", "path").sortWithinPartitions("prefix", "token", "path")
        .write.partitionBy("prefix").mode("overwrite").parquet(path)
    )


def term_frequencies(cards: DataFrame) -> DataFrame:
    """``path, token, tf``."""
    return cards.select("path", F.inline("counts"))


def vectors(cards: DataFrame, terms: int = model.VECTOR_TERMS) -> DataFrame:
    """``path, type, title, vector`` with the heaviest terms first."""
    return cards.select(
        "path", "type", F.coalesce("title", "stem").alias("title"),
        term_vector(F.col("counts"), terms).alias("vector"),
    )


def document_frequency(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


def manifest(cards: DataFrame, edges: DataFrame) -> DataFrame:
    """``metric, value`` of an index build; an empty edge table is a warning, not an error."""
    one = lambda df, name, value: df.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("metric"), "value")
    n = F.count(F.lit(1))
    vocabulary = document_frequency(postings(cards))
    return (
        one(cards, "concept_count", n)
        .unionByName(one(vocabulary, "token_count", n))
        .unionByName(one(edges, "edge_count", n))
        .unionByName(one(edges, "warnings", F.when(n == 0, 1).otherwise(0)))
    )


def query_tokens(queries: DataFrame) -> DataFrame:
    """``query_id, token, times``; a token repeated in the query counts again."""
    return (
        queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("token"))
        .groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    )


def exact_weights(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", "token", F.col("times").cast("double").alias("weight"))


def prefix_weights(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Longer vocabulary tokens that start with a query token, at a quarter of the weight.

    Vocabulary tokens are cut to the lengths that occur among the query
    tokens and matched by equality, on the vocabulary and never on postings.
    """
    lengths = asked.agg(F.collect_set(F.length("token"))).scalar()
    sized = vocabulary.select("token", lengths.alias("lengths"))
    pieces = F.transform(
        F.filter("lengths", lambda n: n < F.length("token")), lambda n: F.substring(F.col("token"), F.lit(1), n))
    cut_tokens = sized.select("token", F.explode(pieces).alias("asked_token"))
    return (
        cut_tokens.join(asked.withColumnRenamed("token", "asked_token"), "asked_token")
        .groupBy("query_id", "token")
        .agg((F.sum("times") * model.PREFIX_WEIGHT).alias("weight"))
    )


def read_postings(spark: SparkSession, path: str, asked: DataFrame | None = None) -> DataFrame:
    """``token, path`` pairs of a stored index.

    With ``asked`` only the folders of the first letters of its tokens are read;
    the letters are a subquery of at most one short array.
    """
    stored = spark.read.schema("token string, path string, prefix string").parquet(path)
    if asked is not None:
        letters = asked.agg(F.collect_set(F.substring("token", 1, 1))).scalar()
        stored = stored.filter(F.array_contains(letters, F.col("prefix")))
    return stored.select("token", "path")


def _weights(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    both = exact_weights(asked).unionByName(prefix_weights(asked, vocabulary))
    return both.groupBy("query_id", "token").agg(F.sum("weight").alias("weight"))


def _scores(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    # Weights are quarters, so sums are exact in any order.
    return pairs.join(weights, "token").groupBy("query_id", "path").agg(F.sum("weight").alias("score"))


def search_scores(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, path, score`` of every hit of every query.

    Postings are read twice, for their vocabulary and for the hits, so a
    derived table of them is materialised first.
    """
    pairs = cut(pairs)
    return _scores(pairs, _weights(query_tokens(queries), pairs.select("token").distinct()))


def search_stored(spark: SparkSession, path: str, queries: DataFrame, limit: int = 20) -> DataFrame:
    """As ``search``, over the folders of an index written by ``write_postings`` that can hold a hit.

    A prefix match shares its first letter with the query token, so both the
    vocabulary and the hits come from the same few folders.
    """
    asked = query_tokens(queries)
    pairs = read_postings(spark, path, asked)
    return top_hits(_scores(pairs, _weights(asked, pairs.select("token").distinct())), limit)


def top_hits(scores: DataFrame, limit: int = 20) -> DataFrame:
    """Best ``limit`` rows per query, path breaking ties.

    The rank filter is applied before the shuffle as well as after it.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "path")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def search(pairs: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    return top_hits(search_scores(pairs, queries), limit)


def substring_hits(concepts: DataFrame, queries: list[tuple[str, str]], limit: int = 20) -> DataFrame:
    """Assets whose text contains the whole query, score 1.

    The queries are a short argument list matched inside the asset scan.
    """
    blob = F.lower(F.concat_ws(
        " ", *[F.coalesce(c, F.lit("")) for c in ("title", "description", "body")]
    ))
    asked = F.array(*[
        F.struct(F.lit(q).alias("query_id"), F.lower(F.lit(text)).alias("needle")) for q, text in queries
    ])
    found = concepts.select("path", blob.alias("blob")).select(
        "path", F.explode(F.filter(asked, lambda q: F.contains("blob", q["needle"]))["query_id"]).alias("query_id")
    )
    return top_hits(found.select("query_id", "path", F.lit(1.0).alias("score")), limit)


def search_or_scan(
    pairs: DataFrame, concepts: DataFrame, queries: list[tuple[str, str]], limit: int = 20
) -> DataFrame:
    """Index hits; only queries without any fall back to the substring scan, and without such there is no scan.

    What comes to the driver are ids from the given ``queries``.
    """
    asked = concepts.sparkSession.createDataFrame(queries, "query_id string, query string")
    hits = cut(search(pairs, asked, limit))
    answered = {r.query_id for r in hits.select("query_id").distinct().collect()}
    missed = [q for q in queries if q[0] not in answered]
    return hits.unionByName(substring_hits(concepts, missed, limit)) if missed else hits


def intent_types(intent: str, registered: tuple[str, ...] = ()) -> list[str]:
    """Types of an intent: its own first, then registered ones, each once."""
    own = model.INTENTS.get(intent, model.INTENTS["general"])[1]
    return list(dict.fromkeys([*own, *registered]))


def intent_scores(
    concepts: DataFrame, query: str, intent: str, hits: DataFrame | None = None, body_chars: int | None = None
) -> DataFrame:
    """``path, type, title, layer, score`` of the assets that matter for an intent.

    Share of query words found in the asset's text, moved by type, layer and
    index hit.  Whole bodies are searched; ``body_chars`` limits that to the
    start of the body.
    """
    title, _, preferred_layers = model.INTENTS.get(intent, model.INTENTS["general"])
    types = intent_types(intent)
    body = F.coalesce("body", F.lit(""))
    if body_chars is not None:
        body = F.substring(body, 1, body_chars)
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    blob = F.lower(F.concat_ws(
        " ", part("title"), part("description"), part("fqn"), part("layer"),
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), body,
    ))
    words = query_words(F.lit(query))
    found = F.size(F.filter(words, lambda w: F.contains(F.col("blob"), w)))
    base = F.when(F.size(words) == 0, F.lit(0.1)).otherwise(found / F.size(words))
    score = base
    if types:
        score = F.when(F.coalesce(F.col("type").isin(types), F.lit(False)), score + 0.35).otherwise(score * 0.45)
    if preferred_layers:
        score = score + F.when(F.lower(part("layer")).isin(*preferred_layers), 0.15).otherwise(0.0)
    if title.startswith("Design"):
        score = score + F.when(part("type").isin(*model.DESIGN_BONUS_TYPES), 0.05).otherwise(0.0)
    # Settled, as a filter on the score inside the parts of a union fails in Spark once a part's title is not read.
    scored = settle(concepts.withColumn("blob", blob), score=score).select("path", "type", "title", "layer", "score")
    if hits is not None:
        marked = hits.select("path", F.lit(0.25).alias("bonus"))
        scored = scored.join(marked, "path", "left").withColumn(
            "score", F.col("score") + F.coalesce("bonus", F.lit(0.0))
        ).drop("bonus")
    return scored.filter(F.col("score") > 0)


def brain_hits(concepts: DataFrame, pairs: DataFrame, query: str, intent: str, limit: int = 12, **options) -> DataFrame:
    """Top ``limit`` assets for an intent query, index hits included."""
    asked = concepts.sparkSession.createDataFrame([("q", query)], "query_id string, query string")
    hits = search(pairs, asked, max(3 * limit, 20))
    scores = intent_scores(concepts, query, intent, F.broadcast(hits), **options)  # a few dozen rows
    return scores.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "path").limit(limit)


def focus_of(top: DataFrame, intent: str) -> DataFrame:
    """The one asset of a top list to open: the best of a fitting type, else the best."""
    types = intent_types(intent)
    fits = F.col("type").isin(*types, *model.FOCUS_TYPES) if types else F.lit(True)
    return top.orderBy(F.coalesce(fits, F.lit(False)).desc(), F.col("score").desc(), "path").limit(1)


def focus_neighbourhood(
    top: DataFrame, intent: str, edges: DataFrame | EdgeStore, links: DataFrame | None = None, max_nodes: int = 18
) -> DataFrame:
    """``focus, node, depth``: what to open with the focus of a top list."""
    focus = cut(focus_of(top, intent).select(F.col("path").alias("node")))
    return graph.neighbourhoods(edges, focus, links, 2, max_nodes)


def result_types(top: DataFrame) -> DataFrame:
    return top.groupBy(F.coalesce("type", F.lit("?")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def browse(
    concepts: DataFrame, *, type_: str | None = None, layer: str | None = None, text: str | None = None
) -> DataFrame:
    """Filter by type, layer and a word in title, description, path or tags; sorted by title."""
    found = concepts
    if type_:
        found = found.filter(F.col("type") == type_)
    if layer:
        found = found.filter(F.col("layer") == layer)
    if text:
        needle = text.lower()
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle))
        found = found.filter(
            has(F.col("title")) | has(F.col("description")) | has(F.col("path"))
            | F.coalesce(F.exists("tags", has), F.lit(False))
        )
    return found.orderBy("title", "path")


def facets(concepts: DataFrame) -> DataFrame:
    """``facet, value, n``: assets per type and, for tables and views, per layer, in one scan."""
    technical = F.col("type").isin("Table", "View")
    options = F.array(
        F.struct(F.lit("type").alias("facet"), F.coalesce("type", F.lit("?")).alias("value")),
        F.when(technical, F.struct(F.lit("layer").alias("facet"), F.coalesce("layer", F.lit("—")).alias("value"))),
    )
    return concepts.select(F.inline(F.array_compact(options))).groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
