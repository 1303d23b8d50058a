"""From raw documents to token ids, in five stages.

Every stage works on the rows the one before it kept and returns the columns of
its input, whatever their names, except for the last one. Nulls, empty texts and
repeated rows are handled as the operators say; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakegraph.llm import bpe, mixing, quality, simhash, toxicity
from lakegraph.llm.common import prepare, read_table
from lakegraph.session import cut


def _set_aside(docs: DataFrame) -> DataFrame:
    """The same rows under column names that no operator uses, but for the four it reads."""
    own = ("doc_id", "text", "source")
    return docs.select(*(F.col(f"`{c}`").alias(f"_{own.index(c)}" if c in own else f"_x{i}") for i, c in enumerate(docs.columns)))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(n).alias(c) for n, c in zip(_set_aside(docs).columns, docs.columns)))


def _key():
    """A row's identity: equal only for rows of equal id, source and text. Never null, and in the order of ids."""
    return F.struct(
        F.col("_0").isNull().alias("missing"), F.coalesce(F.col("_0").cast("bigint"), F.lit(0)).alias("id"),
        F.xxhash64("_1").alias("text"), F.xxhash64("_2").alias("source"))


def _once(rows: DataFrame) -> DataFrame:
    """One row per key. Texts are moved only if a key repeats."""
    if rows.groupBy("_key").count().where("count > 1").isEmpty():
        return rows
    return rows.dropDuplicates(["_key"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are too short or repeat themselves go."""
    prepare(spark)
    return _back(quality.repetition(_set_aside(docs), "_1").where("kept"), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts predicted to be toxic go. The model is learned from the labelled rows among ``docs``."""
    prepare(spark)
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return _back(toxicity.score(_set_aside(docs), model, "_1").where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash over three-word shingles, two bits) the document of smallest id stays; a null id comes last."""
    prepare(spark)
    rows = _set_aside(docs).withColumn("_key", _key())
    groups = simhash.near_copies(rows, "_1", "_key", shingle=3, radius=2)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    return _back(_once(rows.join(stay, "_key", "left_semi")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; those it takes zero times go."""
    prepare(spark)
    rows = _set_aside(docs).withColumn("_key", _key())
    taken = cut(mixing.mix(rows, "_key", "_2", "_1").groupBy("doc_id").agg(F.sum("copies").alias("_copies")).where("_copies > 0"))
    kept = _once(rows).join(taken.withColumnRenamed("doc_id", "_key"), "_key")
    return _back(kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))), docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and what identifies the token ids and the text they decode to."""
    prepare(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, keep=["doc_id"])
    return bpe.decode(encoded, vocabulary).select("doc_id", *bpe.digests(encoded))


STAGES = [
    ("quality", quality_rules),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]

#: Fingerprints, learned models and merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
