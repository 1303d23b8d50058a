"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakegraph.llm import boilerplate, bpe, dac, merkle, minhash, mixing, multi_index, prefix_tree, quality, ring, simhash, toxicity, whitening
from lakegraph.llm.common import prepare, read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SHARDS = 24


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


_CONTROL = r"(<|\[)\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])"
_PREFIX_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(24 + length(text) + len(regexp_extract_all(text, '{_CONTROL}'))
           + length(role) + len(regexp_extract_all(role, '[\\\\\n]')) + len(regexp_extract_all(role, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
FROM given GROUP BY conv_id
"""


@query("op1_prefix_tree", _PREFIX_SQL)
def op1(spark, sf_dir):
    extra = spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id bigint, turn bigint, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    stream, ends = prefix_tree.prefix_tree(rows, vocabulary, public_tokenizers.PATTERN)
    back = prefix_tree.read_back(stream, ends, vocabulary, public_tokenizers.PATTERN)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op2_suffix_repeats")
def op2(spark, sf_dir):
    judged = quality.repetition(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.drop("spans")


@query("op3_multi_index")
def op3(spark, sf_dir):
    return multi_index.nearest(read_table(spark, sf_dir, "embeddings"))


@query("op4_direct_codes")
def op4(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    segments = dac.write_codes(docs, public_tokenizers.path("word_bpe_49k.json"), dac.scratch(docs))
    return dac.read_documents(segments).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_bounded_ring")
def op5(spark, sf_dir):
    placed = ring.shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_matrix_bpe")
def op6(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(read_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, keep=["doc_id"])
    return bpe.decode(encoded, vocabulary).select("doc_id", *bpe.digests(encoded))


@query("op7_entropy_mix")
def op7(spark, sf_dir):
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op8_lexicon_toxicity")
def op8(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op9_block_labels")
def op9(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    found = boilerplate.main_text(pages, boilerplate.learn(pages), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op10_pivot_simhash")
def op10(spark, sf_dir):
    near = simhash.near_copies(read_table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query("op11_polynomial_whitening")
def op11(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), keep=["vec_id"]).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def _merkle_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


#: The table of the unsigned crc32, byte by byte, and the remainder of a number's decimal digits.
_CRC_TABLE = """(SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(
    CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS v
  FROM range(256) t(i)))"""
_CRC = """xor(list_reduce([CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
    lambda crc, b: xor(crc >> 8, crc_table[CAST(xor(crc, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"""


def _merkle_rounds(name: str, given: str, key: str) -> str:
    """A tree of runs of three per key, level by level, and each node's siblings."""
    return f"""
 {name} AS (
  SELECT {key}, 0 AS level, pos, digest, n FROM {given}
  UNION ALL
  SELECT {key}, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY {key}, level, pos // 3),
 {name}_siblings AS (
  SELECT a.{key}, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.{key} = b.{key} AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1
  GROUP BY a.{key}, a.level, a.pos)"""


_MERKLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc_table),
 given AS (
  SELECT row_number() OVER () AS i, doc_id, source, coalesce('=' || source, '') AS tree, {_merkle_leaf("text")} AS digest,
         CASE WHEN {_CRC} % 2 = 0 THEN {_merkle_leaf("replace(text, chr(10), '')")} END AS bad
  FROM documents, crc),
 leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM given),
 {_merkle_rounds("low", "leaves", "tree")},
 subroots AS (
  SELECT tree, '' AS whole, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
 {_merkle_rounds("high", "subroots", "whole")},
 climb AS (
  SELECT i, tree, 0 AS level, pos, coalesce(bad, digest) AS h, '' AS proof, n FROM leaves
  UNION ALL
  SELECT c.i, c.tree, c.level + 1, c.pos // 3, sha256(s.l || c.h || s.r), c.proof || s.l || s.r, (c.n + 2) // 3
  FROM climb c JOIN low_siblings s ON c.tree = s.tree AND c.level = s.level AND c.pos = s.pos WHERE c.n > 1),
 top AS (
  SELECT c.i, 0 AS level, s.pos, c.h, c.proof, s.n FROM climb c JOIN subroots s ON c.tree = s.tree WHERE c.n = 1
  UNION ALL
  SELECT c.i, c.level + 1, c.pos // 3, sha256(s.l || c.h || s.r), c.proof || s.l || s.r, (c.n + 2) // 3
  FROM top c JOIN high_siblings s ON c.level = s.level AND c.pos = s.pos WHERE c.n > 1)
SELECT v.doc_id, v.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(t.proof) AS proof_sha256, t.h AS folded_root, t.h = r.digest AS verified
FROM leaves v JOIN subroots s ON v.tree = s.tree JOIN top t ON v.i = t.i AND t.n = 1, (SELECT digest FROM high WHERE n = 1) r
"""


@query("op12_path_copying_merkle", _MERKLE_SQL)
def op12(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.manifest(docs, tampered=tampered, changed={"text": F.replace("text", F.lit("\n"), F.lit(""))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_MINHASH_SQL = r"""
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS i, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
 words AS (SELECT i, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM given),
 fives AS (
  SELECT i, concat_ws(' ', word, lead(word, 1) OVER here, lead(word, 2) OVER here, lead(word, 3) OVER here, lead(word, 4) OVER here) AS g,
         k, count(*) OVER (PARTITION BY i) AS n
  FROM words WINDOW here AS (PARTITION BY i ORDER BY k)),
 items AS (SELECT DISTINCT i, g FROM fives WHERE k <= greatest(1, n - 4)),
 sizes AS (SELECT i, count(*) AS n FROM items GROUP BY i),
 shared AS (SELECT a.i AS a, b.i AS b, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.i < b.i GROUP BY a.i, b.i),
 linked AS (
  SELECT p.a, p.b FROM shared p JOIN sizes x ON x.i = p.a JOIN sizes y ON y.i = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
 both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
 reach AS (SELECT i AS a, i AS b FROM given UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
 least AS (SELECT r.a AS i, min(o.doc_id) AS component_id FROM reach r JOIN given o ON o.i = r.b GROUP BY r.a)
SELECT s.doc_id, coalesce(z.n, 0) AS n_shingles, l.component_id, s.doc_id IS NOT DISTINCT FROM l.component_id AS kept
FROM given s JOIN least l ON s.i = l.i LEFT JOIN sizes z ON z.i = s.i
"""


@query("op13_tensored_minhash", _MINHASH_SQL)
def op13(spark, sf_dir):
    return minhash.near_copies(read_table(spark, sf_dir, "documents"))
