"""Merkle manifest of a table, with a version of the tree for every tampered row.

Rows of one tree (a source) lie in a fixed order; runs of ``FANOUT`` neighbours
become the digest of their digests until one is left. Aligned blocks of
``FANOUT ** BLOCK_LEVELS`` rows are built in tasks of their own as persistent
trees: a tampered row adds copies of its ancestors inside the block and shares
every other node with the untouched tree. The roots of the blocks are the rows of
the next round, which is smaller by the size of a block; each version goes on as
a row of its own, folded with the untouched siblings above its block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lakegraph.session import cut

FANOUT = 3
#: Levels inside a block, which so has 243 rows at most. Changes the work only, never a digest.
BLOCK_LEVELS = 5

_STEPS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
_STEPS_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest_of(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


class PathTree:
    """A tree whose nodes are only ever added, so that all versions share what they don't change.

    ``digest`` and ``children`` hold the nodes; a version is the place of its root.
    """

    def __init__(self, leaves: list[str], height: int):
        self.digest, self.children, self.height = list(leaves), [()] * len(leaves), height
        level = list(range(len(leaves)))
        for _ in range(height):
            level = [self._add(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)]
        (self.root,) = level

    def _add(self, children: list[int]) -> int:
        self.digest.append(digest_of([self.digest[c] for c in children]))
        self.children.append(tuple(children))
        return len(self.digest) - 1

    def way(self, leaf: int, root: int | None = None) -> list[tuple[int, int]]:
        """Nodes above a leaf, root first, each with the place of the child to go to."""
        at, found = self.root if root is None else root, []
        for level in range(self.height - 1, -1, -1):
            turn = leaf // FANOUT ** level % FANOUT
            found.append((at, turn))
            at = self.children[at][turn]
        return found

    def siblings(self, leaf: int) -> list[tuple[str, str]]:
        """Digests left and right of a leaf's ancestors in their runs, from the leaf up."""
        steps = []
        for node, turn in reversed(self.way(leaf)):
            run = [self.digest[c] for c in self.children[node]]
            steps.append(("".join(run[:turn]), "".join(run[turn + 1:])))
        return steps

    def with_leaf(self, leaf: int, digest: str, root: int | None = None) -> int:
        """The version where ``leaf`` has another digest. Adds the leaf and one copy of each of its ancestors."""
        way = self.way(leaf, root)
        self.digest.append(digest)
        self.children.append(())
        at = len(self.digest) - 1
        for node, turn in reversed(way):
            run = list(self.children[node])
            run[turn] = at
            at = self._add(run)
        return at


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        digest = digest_of([left, digest, right])
    return digest


def height_of(rows: int) -> int:
    height = 0
    while FANOUT ** height < rows:
        height += 1
    return height


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 over the fields: ``-`` for a null, else the number of its UTF-8 bytes, ``:`` and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def place(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``pos`` (from 0, by ``order`` inside a tree) and ``total`` (rows of the tree).

    Rows are dealt by ranges over tree and order, so a tree of any share of all rows lies
    in many tasks; rows that tie in everything are split by where they were read. Only
    counts per tree and task are gathered.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_tie")
    numbered = cut(dealt.sortWithinPartitions("tree", *order).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_at", 33))
    runs = numbered.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.select(
        "tree", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
        F.sum("_rows").over(whole).alias("total")))
    return numbered.join(runs, ["tree", "_part"]).withColumn("pos", F.col("_base") + F.col("_at") - F.col("_first")).drop(
        "_part", "_first", "_base", "_at")


def _blocks(nodes: DataFrame) -> DataFrame:
    """``tree, pos, total, key, digest, bad`` get ``steps`` inside the block, its root ``top`` and the version's ``folded``.

    ``bad`` is the digest of a tampered row, else null: such a row is folded with its siblings.
    """
    size = FANOUT ** BLOCK_LEVELS

    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        height = min(BLOCK_LEVELS, height_of(block.column("total")[0].as_py()))
        leaves = block.column("digest").to_pylist()
        tree = PathTree(leaves, height)
        steps = [tree.siblings(i) for i in range(len(leaves))]
        folded = [
            fold(leaf, way) if bad is None else tree.digest[tree.with_leaf(i, bad)]
            for i, (leaf, bad, way) in enumerate(zip(leaves, block.column("bad").to_pylist(), steps))]
        return block.select(["tree", "block", "pos", "total", "key", "digest"]).append_column(
            "steps", pa.array([[{"left": a, "right": b} for a, b in way] for way in steps], _STEPS_ARROW)
        ).append_column("top", pa.array([tree.digest[tree.root]] * len(leaves), pa.string())).append_column(
            "folded", pa.array(folded, pa.string()))

    schema = T.StructType([
        T.StructField("tree", T.StringType()), T.StructField("block", T.LongType()), T.StructField("pos", T.LongType()),
        T.StructField("total", T.LongType()), T.StructField("key", T.LongType()), T.StructField("digest", T.StringType()),
        T.StructField("steps", _STEPS), T.StructField("top", T.StringType()),
        T.StructField("folded", T.StringType())])
    cast = nodes.select(
        "tree", F.floor(F.col("pos") / size).cast("bigint").alias("block"), F.col("pos").cast("bigint").alias("pos"),
        F.col("total").cast("bigint").alias("total"), "key", "digest", "bad")
    return cast.groupBy("tree", "block").applyInArrow(build, schema)


def _above(blocks: DataFrame) -> DataFrame:
    """``tree, block, up, top``: the siblings from each block's root to the tree's, and the tree's root."""
    size = FANOUT ** BLOCK_LEVELS
    tops = blocks.groupBy("tree", "block").agg(F.first("top").alias("top"), F.first("total").alias("total"))
    tops = cut(tops)
    most = tops.agg(F.max("total")).first()[0]
    if most is None or most <= size:
        return tops.select("tree", "block", F.array().cast(_STEPS).alias("up"), "top")
    nodes = tops.select(
        "tree", F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"),
        F.lit(None).cast("bigint").alias("key"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("bad"))
    lifted = cut(_blocks(nodes))
    return cut(lifted.join(_above(lifted).withColumnRenamed("top", "_root"), ["tree", "block"]).select(
        "tree", F.col("pos").alias("block"), F.concat("steps", "up").alias("up"), F.col("_root").alias("top")))


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree: str = "source",
    order: str = "doc_id",
    tampered: Column | None = None,
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row ``order, tree, leaf, subroot, root, proof_sha256, folded_root, verified, steps``.

    ``leaf`` digests the ``fields``. The leaves of each ``tree`` value ascend by ``order`` (nulls
    first, equal ones by digest) and give its ``subroot``; the subroots, by tree value
    (null first, then bytewise), give ``root``. ``steps`` are the siblings from the leaf to
    the root and ``proof_sha256`` digests them. Where ``tampered`` holds, the fields in ``changed`` are
    replaced and ``folded_root`` is the root of that version; elsewhere it is folded from the row's own leaf.

    Repeated rows are leaves of their own; a null or empty text is a field like any other; a row whose
    ``tampered`` is null is untouched. Other columns are not read. An empty table gives no rows.
    """
    changed = changed or {}
    was = leaf_digest([F.col(f) for f in fields])
    now = leaf_digest([changed.get(f, F.col(f)) for f in fields])
    hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    # A null tree sorts first and is a key like any other.
    rows = docs.select(
        F.concat(F.lit("="), F.col(tree)).alias("_tree"), F.col(order).cast("bigint").alias("key"), was.alias("digest"),
        F.when(hit, now).alias("bad")).select(F.coalesce("_tree", F.lit("")).alias("tree"), "key", "digest", "bad")
    blocks = cut(_blocks(place(rows, "key", "digest")))
    above = _above(blocks)
    # The subroots are the leaves of one more tree.
    subroots = above.select("tree", "top").distinct().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    subroots = cut(place(subroots, "name"))
    joined = cut(_blocks(subroots.withColumn("key", F.lit(None).cast("bigint")).withColumn("bad", F.lit(None).cast("string"))))
    summit = joined.join(_above(joined).withColumnRenamed("top", "root"), ["tree", "block"]).select(
        "pos", F.concat("steps", "up").alias("last"), "root")
    named = subroots.select("pos", F.col("name").alias("tree"), F.col("digest").alias("subroot")).join(summit, "pos").drop("pos")
    up = cut(above.join(named, "tree").select("tree", "block", F.concat("up", "last").alias("up"), "subroot", "root"))
    climbed = F.aggregate("up", F.col("folded"), lambda at, s: F.sha2(F.concat(s.left, at, s.right), 256))
    steps = F.concat("steps", "up")
    found = blocks.join(up, ["tree", "block"]).select(
        "tree", "key", F.col("digest").alias("leaf"), "subroot", "root", steps.alias("steps"), climbed.alias("folded_root"))
    return found.select(
        F.col("key").alias(order), F.when(F.col("tree") != "", F.substring("tree", 2, 2 ** 31 - 1)).alias(tree), "leaf", "subroot", "root",
        F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s.left, s.right)), ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "steps")
