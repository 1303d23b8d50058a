"""Index, search, intent and pack queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegraph import model
from lakegraph.functions import text
from lakegraph.operators import graph, packs, search
from lakegraph.plans.graph import _AROUND, _edges, _store
from lakegraph.plans.registry import ORACLES, query, quoted, stem_sql, strip_sql, tokens_sql, with_parts
from lakegraph.session import scratch_path
from lakegraph.sources import derive

C = F.col


def _documents(spark, sf):
    """Documents as assets: path, type, title, tags, body."""
    none = F.lit(None).cast("string")
    return derive.table(spark, sf, "documents").select(
        F.concat(F.lit("glossary/document-"), C("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("document-"), C("doc_id").cast("string")).alias("stem"),
        F.lit("GlossaryTerm").alias("type"), F.concat(F.lit("Term "), C("lang")).alias("title"),
        none.alias("description"), F.array("lang", "source").alias("tags"), C("text").alias("body"),
    )


def _cards(spark, sf):
    return search.index_cards(_documents(spark, sf))


_DOCS = f"""
docs AS MATERIALIZED (
  SELECT 'glossary/document-' || CAST(doc_id AS VARCHAR) || '.md' AS path, 'Term ' || lang AS title,
         'Term ' || lang || '  GlossaryTerm ' || lang || ' ' || source || ' ' || text AS card, text AS body FROM documents
), words AS MATERIALIZED (SELECT path, unnest({tokens_sql('card')}) AS token FROM docs),
tf AS MATERIALIZED (SELECT path, token, count(*) AS tf FROM words GROUP BY ALL)
"""


def _with_docs(rest: str) -> str:
    rest = rest.strip()
    return f"WITH {_DOCS}" + (", " + rest[4:].lstrip() if rest[:5].upper() == "WITH " else " " + rest)


@query("k01_inventory", _with_docs(f"""
SELECT path, 'GlossaryTerm' AS type, title, '' AS description, len({tokens_sql('card')}) AS token_count, left(sha256(card), 16) AS hash FROM docs
"""))
def k01(spark, sf):
    return search.inventory(_cards(spark, sf))


@query("k02_postings", _with_docs("SELECT token, path FROM tf"))
def k02(spark, sf):
    return search.postings(_cards(spark, sf))


_WEIGHTED = """
WITH norms AS (SELECT path, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY path),
ranked AS (
  SELECT tf.path, token, tf, norm, row_number() OVER (PARTITION BY tf.path ORDER BY tf DESC, token) AS n
  FROM tf JOIN norms ON norms.path = tf.path
)
"""


@query("k04_vectors", _with_docs(_WEIGHTED + """
SELECT path, string_agg(token || ':' || CAST(CAST(round(round(tf / norm, 6) * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY n) AS vector
FROM ranked WHERE n <= 64 GROUP BY path
"""))
def k04(spark, sf):
    """Vectors as text, weights in ten-thousandths."""
    shown = F.transform("vector", lambda v: F.concat(
        v["token"], F.lit(":"), F.round(v["weight"] * 10000).cast("bigint").cast("string")
    ))
    return search.vectors(_cards(spark, sf)).filter(F.size("vector") > 0).select(
        "path", F.array_join(shown, " ").alias("vector")
    )


@query("k05_manifest", with_parts("links edges", _with_docs("""
SELECT 'concept_count' AS metric, count(*) AS value FROM docs UNION ALL SELECT 'token_count', count(DISTINCT token) FROM tf
UNION ALL SELECT 'edge_count', count(*) FROM edges UNION ALL SELECT 'warnings', 0
""")))
def k05(spark, sf):
    return search.manifest(_cards(spark, sf), _edges(spark, sf))


@query("a05_document_frequency", _with_docs("SELECT token, count(*) AS documents FROM tf GROUP BY token"))
def a05(spark, sf):
    return search.document_frequency(search.postings(_cards(spark, sf)))


@query("a06_term_weights", _with_docs(_WEIGHTED + "SELECT path, token, tf, round(tf / norm, 6) AS weight FROM ranked"))
def a06(spark, sf):
    weights = text.let(text.l2_norm(C("counts")), lambda norm: F.transform(
        "counts", lambda c: F.struct(c["token"].alias("token"), c["tf"].alias("tf"), F.round(c["tf"] / norm, 6).alias("weight"))
    ))
    return _cards(spark, sf).select("path", F.inline(weights))


@query("w01_top_terms", _with_docs(_WEIGHTED + "SELECT path, token, n FROM ranked WHERE n <= 64"))
def w01(spark, sf):
    ranked = search.vectors(_cards(spark, sf)).select("path", F.posexplode("vector").alias("pos", "term"))
    return ranked.select("path", "term.token", (C("pos") + 1).cast("bigint").alias("n"))


QUERIES_ASKED = [
    ("q1", "est tion the ther ther"), ("q2", "GlossaryTerm src1"), ("q3", "en re ouon"), ("q4", "zzz qqq"),
    ("q5", "ierenai eaux verlich"),
]
_ASKED = "(VALUES " + ", ".join(f"('{q}', '{t}')" for q, t in QUERIES_ASKED) + ") AS asked(query_id, query)"
_SCORES = f"""
q AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({tokens_sql('query')}) AS token FROM {_ASKED}) a GROUP BY ALL),
vocab AS MATERIALIZED (SELECT DISTINCT token FROM tf),
hits AS (
  SELECT query_id, path, times * 1.0 AS s FROM q JOIN tf ON tf.token = q.token
  UNION ALL SELECT query_id, path, times * 0.25 FROM q JOIN vocab v ON starts_with(v.token, q.token) AND v.token <> q.token JOIN tf ON tf.token = v.token
), scores AS (SELECT query_id, path, CAST(sum(s) AS DOUBLE) AS score FROM hits GROUP BY ALL)
"""


def _asked(spark):
    return spark.createDataFrame(QUERIES_ASKED, "query_id string, query string")


@query("j07_exact_postings", f"""
WITH {_DOCS}, bench AS (
  SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({tokens_sql('text')}) AS token FROM benchmark) a GROUP BY ALL
)
SELECT item_id AS query_id, path, CAST(sum(times) AS DOUBLE) AS score FROM bench JOIN tf ON tf.token = bench.token GROUP BY ALL
""")
def j07(spark, sf):
    """Every benchmark text as a query, exact token hits only."""
    asked = search.query_tokens(derive.table(spark, sf, "benchmark").select(C("item_id").alias("query_id"), C("text").alias("query")))
    pairs = search.postings(_cards(spark, sf))
    return pairs.join(search.exact_weights(asked), "token").groupBy("query_id", "path").agg(F.sum("weight").alias("score"))


@query("j08_prefix_postings", _with_docs(f"""
WITH q AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({tokens_sql('query')}) AS token FROM {_ASKED}) a GROUP BY ALL)
SELECT query_id, v.token, CAST(sum(times) * 0.25 AS DOUBLE) AS weight FROM q JOIN (SELECT DISTINCT token FROM tf) v
  ON starts_with(v.token, q.token) AND v.token <> q.token GROUP BY ALL
"""))
def j08(spark, sf):
    vocabulary = search.postings(_cards(spark, sf)).select("token").distinct()
    return search.prefix_weights(search.query_tokens(_asked(spark)), vocabulary)


_TOP = """
SELECT query_id, path, score, n AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS n FROM scores) r WHERE n <= 20
"""


@query("r01_indexed_search", _with_docs(f"WITH {_SCORES} {_TOP}"))
def r01(spark, sf):
    hits = search.search(search.postings(_cards(spark, sf)), _asked(spark))
    return hits.withColumn("rank", C("rank").cast("bigint"))


@query("r01_stored_search", ORACLES["r01_indexed_search"])
def r01_stored(spark, sf):
    """The index is written once; the search reads only folders of the asked first letters."""
    path = scratch_path(spark, "postings")
    search.write_postings(search.postings(_cards(spark, sf)), path)
    return search.search_stored(spark, path, _asked(spark)).withColumn("rank", C("rank").cast("bigint"))


@query("w02_ranked_hits", f"""
WITH {_DOCS}, bench AS (
  SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({tokens_sql('text')}) AS token FROM benchmark) a GROUP BY ALL
), scores AS (SELECT item_id AS query_id, path, CAST(sum(times) AS DOUBLE) AS score FROM bench JOIN tf ON tf.token = bench.token GROUP BY ALL)
{_TOP}
""")
def w02(spark, sf):
    """The twenty best documents for every benchmark text."""
    return search.top_hits(j07(spark, sf)).withColumn("rank", C("rank").cast("bigint"))


_FALLBACK = [("q1", "Hent thon"), ("q2", "ouon. "), ("q3", "q3 never there")]
_FALLBACK_SQL = "(VALUES " + ", ".join(f"('{q}', '{t}')" for q, t in _FALLBACK) + ") AS asked(query_id, query)"


@query("r02_substring_fallback", with_parts("concepts", f"""
SELECT query_id, path, 1.0::DOUBLE AS score, n AS rank FROM (
  SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY path) AS n FROM {_FALLBACK_SQL} JOIN concepts
  ON contains(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || body), lower(query))
) x WHERE n <= 20
"""))
def r02(spark, sf):
    hits = search.substring_hits(derive.concepts(spark, sf), _FALLBACK)
    return hits.withColumn("rank", C("rank").cast("bigint"))


@query("r02_search_or_scan", _with_docs(f"""
WITH {_SCORES}, ranked AS ({_TOP})
SELECT query_id, path, score, rank FROM ranked
UNION ALL
SELECT query_id, path, 1.0, n FROM (
  SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY path) AS n FROM {_ASKED} JOIN docs
  ON contains(lower(title || '  ' || body), lower(query))
) x WHERE n <= 20 AND query_id NOT IN (SELECT query_id FROM ranked)
"""))
def r02_both(spark, sf):
    docs = _documents(spark, sf)
    hits = search.search_or_scan(search.postings(search.index_cards(docs)), docs, QUERIES_ASKED)
    return hits.withColumn("rank", C("rank").cast("bigint"))


INTENT_QUERY = "gold order 5-LOW th customer"


def _intent_sql(intent: str) -> str:
    title, types, layers = model.INTENTS[intent]
    words = [w for w in ["gold", "order", "low", "th", "customer"]]
    hits = " + ".join(f"(CASE WHEN contains(blob, '{w}') THEN 1 ELSE 0 END)" for w in words)
    return f"""
blobs AS (
  SELECT path, type, title, layer, lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(fqn, '') || ' '
         || coalesce(layer, '') || ' ' || array_to_string(tags, ' ') || ' ' || body) AS blob FROM concepts
), intent_scores AS (
  SELECT path, type, title, layer,
    (CASE WHEN type IN ({quoted(types)}) THEN ({hits}) / {len(words)}.0 + 0.35 ELSE ({hits}) / {len(words)}.0 * 0.45 END)
    + (CASE WHEN coalesce(layer, '') IN ({quoted(layers)}) THEN 0.15 ELSE 0 END)
    + (CASE WHEN type IN ('BusinessObject', 'GlossaryTerm', 'Metric') THEN 0.05 ELSE 0 END) AS score FROM blobs
)
"""


@query("r03_intent_scores", with_parts("concepts", f"""
WITH {_intent_sql('design-report')}
SELECT path, type, coalesce(title, '') AS title, round(score, 6) AS score FROM intent_scores WHERE score > 0
"""))
def r03(spark, sf):
    scores = search.intent_scores(derive.concepts(spark, sf), INTENT_QUERY, "design-report")
    return scores.select("path", "type", F.coalesce("title", F.lit("")).alias("title"), F.round("score", 6).alias("score"))


_CARD_TOKENS = tokens_sql(
    "coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || type || ' ' || array_to_string(tags, ' ') || ' ' || body"
)
_BRAIN = f"""
WITH {_intent_sql('design-report')},
ctf AS MATERIALIZED (SELECT DISTINCT path, unnest({_CARD_TOKENS}) AS token FROM concepts),
q AS (SELECT token, count(*) AS times FROM (SELECT unnest({tokens_sql("'" + INTENT_QUERY + "'")}) AS token) a GROUP BY token),
vocab AS MATERIALIZED (SELECT DISTINCT token FROM ctf),
hits AS (
  SELECT path, times * 1.0 AS s FROM q JOIN ctf ON ctf.token = q.token
  UNION ALL SELECT path, times * 0.25 FROM q JOIN vocab v ON starts_with(v.token, q.token) AND v.token <> q.token JOIN ctf ON ctf.token = v.token
), indexed AS (SELECT path FROM (SELECT path, sum(s) AS s FROM hits GROUP BY path ORDER BY s DESC, path LIMIT 36) h),
top AS (
  SELECT path, type, title, layer, round(score + CASE WHEN path IN (SELECT path FROM indexed) THEN 0.25 ELSE 0 END, 6) AS score
  FROM intent_scores ORDER BY 5 DESC, path LIMIT 12
)
"""


def _top(spark, sf):
    concepts = derive.concepts(spark, sf)
    return search.brain_hits(concepts, search.postings(search.index_cards(concepts)), INTENT_QUERY, "design-report")


@query("l01_top_concepts", with_parts("concepts", _BRAIN + "SELECT path, type, title, score FROM top"))
def l01(spark, sf):
    """The twelve best assets for an intent, index hits counted in."""
    return _top(spark, sf).select("path", "type", "title", "score")


@query("r04_intent_focus", with_parts("concepts", _BRAIN + f"""
SELECT path, type, score FROM top
ORDER BY type IN ({quoted(model.INTENTS['design-report'][1] + model.FOCUS_TYPES)}) DESC, score DESC, path LIMIT 1
"""))
def r04(spark, sf):
    return search.focus_of(_top(spark, sf), "design-report").select("path", "type", "score")


_BUSINESS_FOCI = "foci AS (SELECT path AS focus FROM concepts WHERE type = 'BusinessObject')"


@query("r04_focus_neighbourhood", with_parts("concepts links edges", _BRAIN + ", " + _AROUND.replace(_BUSINESS_FOCI, f"""
foci AS (
  SELECT path AS focus FROM top ORDER BY type IN ({quoted(model.INTENTS['design-report'][1] + model.FOCUS_TYPES)}) DESC, score DESC, path LIMIT 1
)""").replace("n <= 20", "n <= 18") + "SELECT focus, node, depth FROM clipped"))
def r04_around(spark, sf):
    """The focus of an intent with its eighteen nearest nodes."""
    around = search.focus_neighbourhood(_top(spark, sf), "design-report", _store(spark, sf), derive.links(spark, sf))
    return around.withColumn("depth", C("depth").cast("bigint"))


@query("a15_result_types", with_parts("concepts", _BRAIN + "SELECT type, count(*) AS n FROM top GROUP BY type"))
def a15(spark, sf):
    return search.result_types(_top(spark, sf))


@query("u04_intent_types", with_parts("concepts", f"""
SELECT p AS position, t AS type, (SELECT count(*) FROM concepts c WHERE c.type = t) AS assets FROM (
  SELECT unnest(range(1, {len(search.intent_types('land-data')) + 1})) AS p,
         unnest([{quoted(search.intent_types('land-data'))}]) AS t) x
"""))
def u04(spark, sf):
    """The ordered type set of an intent, with how many assets of each type there are."""
    types = search.intent_types("land-data", ("Table", "Stream"))
    listed = spark.createDataFrame(
        [(i + 1, t) for i, t in enumerate(types)], "position bigint, type string"
    )
    counts = derive.concepts(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, "type", "left").select("position", "type", F.coalesce("n", F.lit(0)).alias("assets"))


@query("l03_browse", with_parts("concepts", """
SELECT path, coalesce(title, '') AS title FROM concepts WHERE type = 'View' AND layer = 'gold'
  AND (contains(lower(coalesce(title, '')), 'red') OR contains(lower(coalesce(description, '')), 'red') OR contains(lower(path), 'red')
       OR len(list_filter(tags, lambda t: contains(lower(t), 'red'))) > 0)
"""))
def l03(spark, sf):
    found = search.browse(derive.concepts(spark, sf), type_="View", layer="gold", text="Red")
    return found.select("path", F.coalesce("title", F.lit("")).alias("title"))


@query("a14_facets", with_parts("concepts", """
SELECT 'type' AS facet, type AS value, count(*) AS n FROM concepts GROUP BY ALL
UNION ALL SELECT 'layer', coalesce(layer, '—'), count(*) FROM concepts WHERE type IN ('Table', 'View') GROUP BY ALL
"""))
def a14(spark, sf):
    return search.facets(derive.concepts(spark, sf))


def _conversation_members(spark, sf):
    """Conversations as packs: the first turn is the focus, the others its neighbours."""
    turns = derive.table(spark, sf, "conversations")
    node = F.concat(F.lit("/packs/"), C("conv_id").cast("string"), F.lit("-"), C("turn").cast("string"), F.lit(".md"))
    focus = F.concat(F.lit("/packs/"), C("conv_id").cast("string"), F.lit("-0.md"))
    members = turns.select(focus.alias("focus"), node.alias("node"), C("turn").alias("depth"))
    known = turns.filter((C("turn") != 3)).select(
        node.alias("path"), F.concat(F.lit("Turn "), C("turn").cast("string")).alias("title"), C("role").alias("type"),
        F.lit(None).cast("string").alias("layer"), C("text").alias("description"), C("text").alias("body"),
    )
    return members, known


_PACK_CARDS = """
WITH c AS (
  SELECT '/packs/' || CAST(conv_id AS VARCHAR) || '-0.md' AS focus, '/packs/' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '.md' AS node,
         turn AS depth, CASE WHEN turn = 3 THEN CAST(conv_id AS VARCHAR) || '-3' ELSE 'Turn ' || CAST(turn AS VARCHAR) END AS title,
         CASE WHEN turn = 3 THEN '?' ELSE role END AS type, CASE WHEN turn = 3 THEN '' ELSE text END AS description,
         CASE WHEN turn = 0 THEN text ELSE '' END AS body
  FROM conversations
)
"""


@query("r05_pack_cards", _PACK_CARDS + "SELECT focus, node, depth, title, type, description, body FROM c")
def r05(spark, sf):
    members, known = _conversation_members(spark, sf)
    return packs.pack_cards(members, known).select("focus", "node", "depth", "title", "type", "description", "body")


@query("r06_pack_budget", """
SELECT conv_id, count(*) AS parts, CAST(floor((sum(length(text)) + 3) / 4) AS BIGINT) AS tokens,
       floor((sum(length(text)) + 3) / 4) <= 400 AS accepted FROM conversations GROUP BY conv_id
""")
def r06(spark, sf):
    return packs.gate_packs(derive.table(spark, sf, "conversations"), "conv_id", "text", packs.pack_budget(budget=400))


@query("r06_rendered_budget", _PACK_CARDS + rf"""
SELECT focus, count(*) AS parts, CAST(floor((sum(length(block)) + 3) / 4) AS BIGINT) AS tokens,
       floor((sum(length(block)) + 3) / 4) <= 32000 AS accepted
FROM (SELECT focus, '## ' || title || ' (`' || type || '`)' || chr(10) || chr(10) || '- Path: `' || node || '`' || chr(10) ||
  CASE WHEN node = focus THEN (CASE WHEN prose <> '' THEN prose || chr(10) ELSE '' END)
       WHEN description <> '' THEN '- ' || description || chr(10) ELSE '' END AS block
  FROM (SELECT *, array_to_string(list_filter(regexp_split_to_array({strip_sql('body')}, '\r?\n'),
        lambda l: {strip_sql('l')} <> '' AND NOT starts_with(l, '#')), chr(10)) AS prose FROM c) d) e
GROUP BY focus
""")
def r06_rendered(spark, sf):
    members, known = _conversation_members(spark, sf)
    blocks = packs.card_block(packs.pack_cards(members, known))
    return packs.gate_packs(blocks, "focus", "block", packs.pack_budget())


@query("r06_context_packs", with_parts("concepts links edges", "WITH " + _AROUND.replace(_BUSINESS_FOCI, """
foci AS (
  SELECT DISTINCT (SELECT min(c.path) FROM concepts c WHERE c.stem = b.stem OR c.title = b.stem) AS focus
  FROM concepts b WHERE type = 'BusinessObject'
)""") + rf""", facts AS (
  SELECT c.focus, c.node, coalesce(k.title, {stem_sql('c.node')}) AS title, coalesce(k.type, '?') AS type, coalesce(k.layer, '') AS layer,
         coalesce(k.description, '') AS description, coalesce(k.body, '') AS body
  FROM clipped c LEFT JOIN concepts k ON k.path = c.node
), cards AS (
  SELECT focus, '## ' || title || ' (`' || type || '`' || CASE WHEN layer <> '' THEN ', ' || layer ELSE '' END || ')' || chr(10) || chr(10)
         || '- Path: `' || node || '`' || chr(10)
         || CASE WHEN node = focus THEN (CASE WHEN prose <> '' THEN prose || chr(10) ELSE '' END)
                 WHEN description <> '' THEN '- ' || description || chr(10) ELSE '' END || chr(10) AS text
  FROM (SELECT *, array_to_string(list_filter(regexp_split_to_array({strip_sql('body')}, '?
'),
        lambda l: {strip_sql('l')} <> '' AND NOT starts_with(l, '#')), chr(10)) AS prose FROM facts) f
), parts AS (
  SELECT * FROM cards
  UNION ALL SELECT focus, '# ' || {stem_sql('focus')} || chr(10) || chr(10) || 'Nodes: ' || CAST(count(*) AS VARCHAR) || chr(10) FROM clipped GROUP BY focus
  UNION ALL SELECT focus, '  n' || left(md5(node), 12) || '["' || {stem_sql('node')} || '"]' || chr(10) FROM clipped
  UNION ALL SELECT a.focus, '  n' || left(md5(e.src), 12) || ' --> n' || left(md5(e.dst), 12) || chr(10)
  FROM clipped a JOIN edges e ON e.src = a.node JOIN clipped b ON b.focus = a.focus AND b.node = e.dst
)
SELECT focus, count(*) AS parts, CAST(floor((sum(length(text)) + 3) / 4) AS BIGINT) AS tokens,
       floor((sum(length(text)) + 3) / 4) <= 800 AS accepted, CASE WHEN tokens <= 800 THEN count(*) ELSE 0 END AS written
FROM parts GROUP BY focus
"""))
def r06_packs(spark, sf):
    """Whole packs of all business objects, named by file stem; packs over 800 tokens write nothing."""
    concepts = derive.concepts(spark, sf)
    names = concepts.filter(C("type") == "BusinessObject").select(C("stem").alias("name"))
    parts, receipt = packs.context_packs(names, concepts, _store(spark, sf), derive.links(spark, sf), budget=800)
    written = parts.groupBy("focus").agg(F.count(F.lit(1)).alias("written"))
    return receipt.join(written, "focus", "left").withColumn("written", F.coalesce("written", F.lit(0)))
