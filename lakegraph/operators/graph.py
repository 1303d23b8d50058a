"""Lineage graph: edges, bounded traversals, paths, neighbourhoods.

Traversals run level by level for many start nodes at once.  Every level is
written to the shared folder, so plans stay flat and a lost executor costs one
re-read.
Written levels have real sizes, so the optimizer broadcasts a small one by the
session's own limit. ``edges`` may be a frame or an ``EdgeStore``: a stored graph is not
shuffled again, and a small level reads only its own buckets.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakegraph import model
from lakegraph.functions.naming import stem_of
from lakegraph.functions.text import settle
from lakegraph.operators.edge_store import EdgeStore
from lakegraph.session import cut, distinct


def flow_edges(links: DataFrame, *, repeated: bool = False) -> DataFrame:
    """Distinct ``src, dst`` in data-flow direction; other relations make no edge.

    ``repeated`` leaves equal edges in, for a reader that makes them distinct itself.
    """
    backwards = F.col("rel").isin(*model.REVERSE_FLOW)
    found = (
        links.filter(F.col("rel").isin(*model.FORWARD_FLOW, *model.REVERSE_FLOW))
        .filter(F.coalesce(F.col("target"), F.lit("")) != "")
        .select(
            F.when(backwards, F.col("target")).otherwise(F.col("src")).alias("src"),
            F.when(backwards, F.col("src")).otherwise(F.col("target")).alias("dst"),
        )
    )
    return found if repeated else distinct(found)


def union_edges(*edges: DataFrame) -> DataFrame:
    """Edges of several origins as one distinct set."""
    return reduce(DataFrame.unionByName, [e.select("src", "dst") for e in edges]).distinct()


def reverse(edges: DataFrame | EdgeStore) -> DataFrame | EdgeStore:
    if isinstance(edges, EdgeStore):
        return edges.reverse()
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes with outgoing and without incoming edges."""
    return (
        edges.select(F.col("src").alias("node")).distinct()
        .join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    )


def _step(frontier: DataFrame, edges: DataFrame | EdgeStore, rows: int | None = None) -> DataFrame:
    if isinstance(edges, EdgeStore):
        return edges.hop(frontier, rows)
    return edges.join(frontier.withColumnRenamed("node", "src"), "src")


def _kept(edges: DataFrame | EdgeStore) -> DataFrame | EdgeStore:
    """Edges that several steps read: a store as it is, a frame written once."""
    return edges if isinstance(edges, EdgeStore) else cut(edges.select("src", "dst"))


def _frame(edges: DataFrame | EdgeStore) -> DataFrame:
    return edges.edges() if isinstance(edges, EdgeStore) else edges


def _levels(edges: DataFrame | EdgeStore, starts: DataFrame, hops: int | None, parents: bool, wanted: DataFrame | None = None):
    """Materialised frames ``start, node, depth[, parent]``, one per depth; without ``hops`` until nothing new is reached.

    ``edges`` are read once per level, so callers materialise them first.
    """
    if "start" not in starts.columns:
        starts = starts.select(F.col("node").alias("start"), "node")
    level = starts.select("start", "node").distinct().withColumn("depth", F.lit(0))
    if parents:
        level = level.withColumn("parent", F.lit(None).cast("string"))
    level = cut(level)
    levels = [level]
    open_pairs = wanted
    for depth in count(1) if hops is None else range(1, hops + 1):
        rows = level.count()  # from the footers of what was just written
        if not rows:
            break
        if open_pairs is not None:
            open_pairs = cut(open_pairs.join(level.select("start", "node"), ["start", "node"], "left_anti"))
            if open_pairs.isEmpty():
                break
            level_in = level.join(open_pairs.select("start").distinct(), "start", "left_semi")
        else:
            level_in = level
        reached = _step(level_in.select("start", "node"), edges, rows).groupBy("start", F.col("dst").alias("node"))
        found = reached.agg(F.min("src").alias("parent")) if parents else reached.agg(F.lit(0).alias("_")).drop("_")
        seen = reduce(DataFrame.unionByName, [l.select("start", "node") for l in levels])
        level = found.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth))
        columns = ["start", "node", "depth"] + (["parent"] if parents else [])
        level = cut(level.select(*columns))
        levels.append(level)
    return levels


def _packed_levels(
    edges: DataFrame | EdgeStore, starts: DataFrame, hops: int | None, wanted: DataFrame | None = None
) -> tuple[list[DataFrame], DataFrame]:
    """``(levels, names)`` of a traversal whose rows stand for up to 64 starts.

    Starts are numbered in their order; a row ``block, node, mask, depth`` has a bit for each start of the
    block that reaches the node at that depth, and a row ``start, block, bit`` of ``names`` tells which start a bit is.
    A start all of whose ``wanted`` (``start, node``) are reached goes no further.
    """
    if "start" not in starts.columns:
        starts = starts.select(F.col("node").alias("start"), "node")
    starts = cut(starts.select("start", "node").distinct())
    numbers = cut(starts.select("start").distinct().orderBy("start").select("start", F.monotonically_increasing_id().alias("number")))
    names = numbers.select(
        "start", F.shiftright("number", 6).alias("block"),
        F.expr("shiftleft(1L, CAST(number & 63 AS INT))").alias("bit"),
    )
    # A missing start is a start too.
    first = starts.join(names.withColumnRenamed("start", "name"), F.col("start").eqNullSafe(F.col("name")))
    level = cut(first.groupBy("block", "node").agg(F.bit_or("bit").alias("mask")).withColumn("depth", F.lit(0)))
    levels = [level]
    open_pairs = None if wanted is None else wanted.join(names, "start").select("block", "bit", "node")
    for depth in count(1) if hops is None else range(1, hops + 1):
        rows = level.count()  # from the footers of what was just written
        if not rows:
            break
        if open_pairs is not None:
            here = level.select(F.col("block").alias("b"), F.col("node").alias("n"), "mask")
            met = (F.col("block") == F.col("b")) & (F.col("node") == F.col("n")) & (F.col("mask").bitwiseAND(F.col("bit")) != 0)
            open_pairs = cut(open_pairs.join(here, met, "left_anti"))
            still = open_pairs.groupBy("block").agg(F.bit_or("bit").alias("still"))
            level = level.join(still, "block").withColumn("mask", F.col("mask").bitwiseAND(F.col("still"))).filter(F.col("mask") != 0)
            if open_pairs.isEmpty():
                break
        none = F.lit(0).cast("bigint")
        reached = _step(level.select("block", "node", "mask"), edges, rows).select(
            "block", F.col("dst").alias("node"), F.col("mask").alias("new"), none.alias("old"))
        seen = reduce(DataFrame.unionByName, [l.select("block", "node", none.alias("new"), F.col("mask").alias("old")) for l in levels])
        met = reached.unionByName(seen).groupBy("block", "node").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        # A missing node equals none that was seen.
        mask = F.when(F.col("node").isNull(), F.col("new")).otherwise(F.col("new").bitwiseAND(F.bitwise_not("old")))
        level = cut(met.select("block", "node", mask.alias("mask")).filter(F.col("mask") != 0).withColumn("depth", F.lit(depth)))
        levels.append(level)
    return levels, names


#: About so many pairs of a start and a node that one task of a level unpacks, the starts of a block, and
#: the edges into a node beyond which its lists are not gathered in one row.
LEVEL_PAIRS, BLOCK_STARTS, GATHERED_EDGES = 2_000_000, 1 << 15, 20_000


def _first_parents(told: DataFrame) -> DataFrame:
    """``block, node, parents, starts, by`` of starts not seen before, from rows ``block, node, parent, starts`` that lie by node.

    A row without a parent has starts that are seen. The parent of ``starts[i]``, its smallest, is ``parents[by[i]]``.
    A start and the place of its row are one number here, so that numbers are sorted and not rows.
    """
    low = F.lit((1 << 32) - 1)
    lists = told.groupBy("block", "node").agg(F.sort_array(F.collect_list(F.struct("parent", "starts"))).alias("told"))
    coded = settle(lists, codes=F.flatten(F.transform("told", lambda row, place: F.transform(
        row["starts"], lambda at: F.coalesce(at.cast("bigint"), F.lit(0).cast("bigint")) * F.lit(1 << 32) + place))),
        known=F.size(F.filter("told", lambda row: row["parent"].isNull())))
    coded = settle(coded, ordered=F.sort_array("codes"))
    at = lambda code: F.shiftright(code, 32)
    first = settle(coded, first=F.filter("ordered", lambda code, i: (
        at(code) != at(F.coalesce(F.get("ordered", i - 1), F.lit(-1).cast("bigint")))) & (code.bitwiseAND(low) >= F.col("known"))))
    return first.filter(F.size("first") > 0).select(
        "block", "node", F.col("told.parent").alias("parents"), F.transform("first", lambda c: at(c).cast("smallint")).alias("starts"),
        F.transform("first", lambda c: c.bitwiseAND(low).cast("int")).alias("by"))


def _first_parents_of_crowded(told: DataFrame) -> DataFrame:
    """The same for nodes with many edges into them: pairs of a start and a node meet wherever a hash sends them, and combine map-side."""
    pairs = told.select("block", "node", "parent", F.explode("starts").alias("at")).groupBy("block", "node", "at").agg(
        F.min("parent").alias("parent"), F.bool_or(F.col("parent").isNull()).alias("old"))
    lists = pairs.filter("NOT old").groupBy("block", "node").agg(F.collect_list(F.struct("at", "parent")).alias("pairs"))
    return lists.select("block", "node", F.col("pairs.parent").alias("parents"), F.col("pairs.at").alias("starts"),
                        F.sequence(F.lit(0), F.size("pairs") - 1).alias("by"))


def _lists_of_starts(edges: DataFrame | EdgeStore, tops: DataFrame, into: DataFrame, hops: int | None) -> tuple[DataFrame, DataFrame]:
    """``(lists, names)`` of what is below each ``node`` of ``tops``; ``into`` has the number ``n`` of edges into each ``node``.

    A row ``block, node, depth, parents, starts, by`` has the numbers of all starts of a block that reach a node at a depth, the smallest parent of
    ``starts[i]`` being ``parents[by[i]]``; a row ``block, at, start`` of ``names`` tells which start a number is.
    Lists are merged in the row, by node; pairs of a start and a node are unpacked by the reader, and before for nodes with very many edges into them.
    """
    numbers = cut(tops.select("node").distinct().orderBy("node").select("node", F.monotonically_increasing_id().alias("number")))
    names = numbers.select(
        F.col("node").alias("start"), F.floor(F.col("number") / BLOCK_STARTS).alias("block"),
        F.pmod("number", F.lit(BLOCK_STARTS)).cast("smallint").alias("at"))
    none = F.lit(None).cast("string")
    level = cut(names.select(
        "block", F.col("start").alias("node"), F.array(none).alias("parents"), F.array("at").alias("starts"), F.array(F.lit(0)).alias("by")))
    levels = [level.withColumn("depth", F.lit(0))]
    spark = level.sparkSession
    onward = cut(_frame(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    crowded = cut(into.filter(F.col("n") > GATHERED_EDGES).select("node"))
    any_crowded = not crowded.isEmpty()
    for depth in count(1) if hops is None else range(1, hops + 1):
        pairs = level.select("node", F.size("starts").alias("pairs")).join(onward, "node").agg(F.sum(F.col("pairs") * F.col("n"))).first()[0]
        if not pairs:
            break
        rows = level.count()  # from the footers of what was just written
        told = _step(level.select("block", "node", "starts"), edges, rows).select(
            "block", F.col("dst").alias("node"), F.col("src").alias("parent"), "starts")
        # A missing node equals none that was seen.
        seen = [l.filter("node IS NOT NULL").select("block", "node", none.alias("parent"), "starts") for l in levels]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // LEVEL_PAIRS))
        met = reduce(DataFrame.unionByName, [told, *seen])
        few = met.join(crowded, "node", "left_anti") if any_crowded else met
        level = _first_parents(few.repartition(tasks, "block", "node"))
        if any_crowded:
            level = level.unionByName(_first_parents_of_crowded(met.join(crowded, "node", "left_semi")))
        level = cut(level.select("block", "node", "parents", "starts", "by"))
        levels.append(level.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, levels), names


def reach(
    edges: DataFrame | EdgeStore, starts: DataFrame, hops: int | None = 5, *, parents: bool = False, common: bool = True
) -> DataFrame:
    """``start, node, depth`` of everything downstream of each start, the start included.

    ``depth`` is the smallest hop count.  ``parents`` adds the smallest node
    one hop nearer, which makes the traversal tree deterministic.  Without ``common``,
    for starts that share no nodes, every row of the traversal is of one start.
    """
    return _reach(_kept(edges), starts, hops, parents, common)


def _reach(edges: DataFrame | EdgeStore, starts: DataFrame, hops: int | None, parents: bool = False, common: bool = True) -> DataFrame:
    if parents or not common:
        return reduce(DataFrame.unionByName, _levels(edges, starts, hops, parents))
    levels, names = _packed_levels(edges, starts, hops)
    return (
        reduce(DataFrame.unionByName, levels).join(names, "block")
        .filter(F.col("mask").bitwiseAND(F.col("bit")) != 0).select("start", "node", "depth")
    )


def downstream(edges: DataFrame | EdgeStore, starts: DataFrame, hops: int | None = 5) -> DataFrame:
    return reach(edges, starts, hops)


def upstream(edges: DataFrame | EdgeStore, starts: DataFrame, hops: int | None = 5) -> DataFrame:
    return reach(reverse(edges), starts, hops)


def shortest_paths(edges: DataFrame | EdgeStore, pairs: DataFrame, max_hops: int | None = 8) -> DataFrame:
    """``start, goal, position, node`` of one shortest path per connected ``start, goal`` pair.

    Among equally short paths the one with the smallest predecessors wins.
    Pairs further apart than ``max_hops`` give no rows.
    """
    pairs = cut(pairs.select("start", "goal").distinct())
    edges = _kept(edges)
    ends = pairs.agg(F.count_distinct("start").alias("starts"), F.count_distinct("goal").alias("goals")).first()
    if ends.goals <= ends.starts:
        return _paths_to_few(edges, pairs, max_hops)
    return _paths_to_many(edges, pairs, max_hops)


def _paths_to_few(edges: DataFrame | EdgeStore, pairs: DataFrame, max_hops: int | None) -> DataFrame:
    """Distances to the goals first, packed; then every pair walks nodes on its shortest paths alone."""
    back = reverse(edges)
    goals = pairs.select(F.col("goal").alias("node")).filter("node IS NOT NULL")
    levels, names = _packed_levels(back, goals, max_hops, pairs.select(F.col("goal").alias("start"), F.col("start").alias("node")))
    on = F.col("mask").bitwiseAND(F.col("bit")) != 0
    named = cut(pairs.join(names.withColumnRenamed("start", "goal"), "goal").withColumn("node", F.col("start")))
    keys = ["start", "goal", "block", "bit", "node"]
    begun = cut(
        named.join(reduce(DataFrame.unionByName, levels), ["block", "node"]).filter(on)
        .groupBy(*keys).agg(F.min("depth").alias("hops"))
    )
    empty = F.lit(None).cast("string")
    ahead, layers = None, {}
    for left in range(len(levels) - 1, -1, -1):
        layer = begun.filter(F.col("hops") == left).withColumn("parent", empty)
        if ahead is not None:
            nearer = levels[left].select("block", "node", "mask")
            into = _step(nearer, back, nearer.count()).select("block", F.col("dst").alias("node"), F.col("src").alias("next"), "mask")
            onward = ahead.join(into, ["block", "node"]).filter(on).groupBy(
                "start", "goal", "block", "bit", F.col("next").alias("node"), "hops"
            ).agg(F.min(F.col("node")).alias("parent"))
            layer = layer.unionByName(onward)
        layers[left] = ahead = cut(layer.select(*keys, "hops", "parent"))
    walk = layers[0].select("start", "goal", F.col("hops").alias("position"), "node", "parent")
    steps = [walk]
    for left in range(1, len(levels)):
        told = steps[-1].filter("parent IS NOT NULL").select("start", "goal", F.col("parent").alias("node"))
        steps.append(cut(
            layers[left].select("start", "goal", "node", (F.col("hops") - left).alias("position"), "parent")
            .join(told, ["start", "goal", "node"], "left_semi").select("start", "goal", "position", "node", "parent")
        ))
    return reduce(DataFrame.unionByName, steps).drop("parent")


def _paths_to_many(edges: DataFrame | EdgeStore, pairs: DataFrame, max_hops: int | None) -> DataFrame:
    """All starts at once with parents, each until its goals are met; then back from the goals."""
    levels = _levels(
        edges, pairs.select(F.col("start").alias("node")), max_hops, True,
        wanted=pairs.select("start", F.col("goal").alias("node")),
    )
    at = reduce(DataFrame.unionByName, levels)
    walk = cut(
        pairs.join(at, (pairs["start"] == at["start"]) & (pairs["goal"] == at["node"]))
        .select(pairs["start"], "goal", F.col("depth").alias("position"), "node", "parent")
    )
    steps = [walk]
    for depth in range(len(levels) - 1, 0, -1):
        here = reduce(DataFrame.unionByName, steps).filter(F.col("position") == depth)
        back = here.select("start", "goal", F.col("parent").alias("node")).join(
            levels[depth - 1].select("start", "node", "parent"), ["start", "node"]
        )
        steps.append(cut(back.select("start", "goal", F.lit(depth - 1).alias("position"), "node", "parent")))
    return reduce(DataFrame.unionByName, steps).drop("parent")


def materialized_lineage(
    edges: DataFrame | EdgeStore, hops: int | None = 6, asked: DataFrame | None = None, *, listed: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``root, node, depth, parent`` below every root; only edges that exist.

    The rows are as many as roots times what they reach; what is written is a list of roots per node. ``asked`` (``node``) limits
    them to some roots; sizes for all come from ``closure.reach_sizes``. ``listed`` gives the written lists and the
    names of the roots in them instead, with the same roots, nodes, depths and parents.
    """
    edges = _kept(edges)
    into = cut(_frame(edges).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    tops = _frame(edges).select(F.col("src").alias("node")).distinct().join(into, "node", "left_anti")
    if asked is not None:
        tops = tops.join(asked.select("node").distinct(), "node", "left_semi")
    lists, names = _lists_of_starts(edges, tops, into, hops)
    if listed:
        return lists, names.withColumnRenamed("start", "root")
    rows = lists.select("block", "node", "depth", "parents", "by", F.posexplode("starts").alias("i", "at"))
    return rows.join(names, ["block", "at"]).select(
        F.col("start").alias("root"), "node", "depth", F.get("parents", F.get("by", F.col("i"))).alias("parent"))


def lineage_paths(lineage: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per root: path name, node count, hop count; roots that reach nothing are left out.

    ``lineage`` has a row for every root and node, or, with ``names``, lists of roots as ``materialized_lineage`` gives them.
    """
    if names is None:
        summary = lineage.groupBy("root").agg(F.count(F.lit(1)).alias("node_count"), F.max(F.struct("depth", "node")).alias("last"))
    else:
        summary = _summary_of_lists(lineage, names)
    stem = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"^(.+)\.[^.]+$", "$1")
    return summary.filter(F.col("node_count") >= 2).select(
        "root",
        F.concat(F.lit("path-"), stem(F.col("root")), F.lit("-to-"), stem(F.col("last.node"))).alias("name"),
        "node_count", F.col("last.depth").alias("hop_count"),
    )


def _summary_of_lists(lists: DataFrame, names: DataFrame) -> DataFrame:
    """``root, node_count, last``. Nodes are numbered in their order, so that every pair of a root and a node is met by numbers alone."""
    ordered = cut(lists.select("node").distinct().orderBy("node").select("node", F.monotonically_increasing_id().alias("number")))
    # A missing node is the first in order.
    numbered = lists.select("block", "node", "depth", "starts").join(ordered.hint("shuffle_hash"), "node", "left").select(
        "block", "depth", F.coalesce("number", F.lit(-1).cast("bigint")).alias("number"), F.explode("starts").alias("at"))
    by_depth = numbered.groupBy("block", "at", "depth").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("number"))
    total = by_depth.groupBy("block", "at").agg(F.sum("n").alias("node_count"), F.max(F.struct("depth", "number")).alias("last"))
    found = total.join(names, ["block", "at"]).select("root", "node_count", F.col("last.depth").alias("depth"), F.col("last.number").alias("number"))
    return found.join(ordered, "number", "left").select("root", "node_count", F.struct("depth", "node").alias("last"))


def unrooted_nodes(edges: DataFrame) -> DataFrame:
    """Nodes no root reaches, however far: members of pure cycles and what only they reach."""
    edges = cut(edges.select("src", "dst").distinct())
    tops = roots(edges)
    # All roots share one start, so the state is one row per node.
    shared = tops.select(F.lit("").alias("start"), "node")
    covered = _reach(edges, shared, None).select("node")
    return nodes(edges).join(covered, "node", "left_anti")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def neighbourhoods(
    edges: DataFrame | EdgeStore, foci: DataFrame, focus_links: DataFrame | None = None, hops: int = 2, max_nodes: int = 20
) -> DataFrame:
    """``focus, node, depth``: the nearest ``max_nodes`` nodes around each focus, in either direction.

    Nodes are kept in (depth, path) order.  ``focus_links`` adds every link of
    a focus, lineage or not.  A node's neighbours beyond the first
    ``2 * max_nodes`` can never be kept -- at most ``max_nodes`` of them are
    already taken and at most ``max_nodes`` are still open -- so hubs are
    trimmed to that before any join, with the same result.
    """
    keep = 2 * max_nodes

    def clipped(pairs: DataFrame) -> DataFrame:
        order = Window.partitionBy("src").orderBy("dst")
        return pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")

    def nearest(pairs: DataFrame) -> DataFrame:
        return clipped(pairs.filter(F.col("src") != F.col("dst")).distinct())

    if isinstance(edges, EdgeStore):
        # Stored edges are distinct and lie by source, so a hop looks its nodes up where they are and trims each direction there.
        def beside(frontier: DataFrame) -> DataFrame:
            asked = cut(frontier.select(F.col("node").alias("src")).distinct())
            met = [e for way in (edges, edges.reverse()) for e in way.leading(asked, asked.count())]
            return reduce(DataFrame.unionByName, [_step(frontier, clipped(m.filter(F.col("src") != F.col("dst")))) for m in met])
    else:
        near = cut(nearest(edges.select("src", "dst").unionByName(reverse(edges))))

        def beside(frontier: DataFrame) -> DataFrame:
            return _step(frontier, near)

    taken = cut(foci.select(F.col("node").alias("focus"), "node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        frontier = taken.filter(F.col("depth") == depth - 1).select("focus", "node")
        if frontier.isEmpty():
            break
        found = beside(frontier).select("focus", F.col("dst").alias("node"))
        if depth == 1 and focus_links is not None:
            own = nearest(
                focus_links.select("src", F.col("target").alias("dst"))
                .join(foci.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
            )
            found = found.unionByName(own.select(F.col("src").alias("focus"), F.col("dst").alias("node")))
        # A focus has a bounded number of rows here, so they are dealt out by focus once, for both the repeated nodes and the order.
        merged = taken.unionByName(found.withColumn("depth", F.lit(depth))).repartition("focus").groupBy("focus", "node").agg(
            F.min("depth").alias("depth")
        )
        order = Window.partitionBy("focus").orderBy("depth", "node")
        taken = cut(
            merged.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_nodes).drop("_n")
        )
    return taken


def focus_nodes(edges: DataFrame | EdgeStore, focus: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes up- or downstream of the focus, the focus included."""
    edges = _kept(edges)
    down, up = _reach(edges, focus, hops), _reach(reverse(edges), focus, hops)
    return down.select("node").union(up.select("node")).distinct()


def subgraph(edges: DataFrame | EdgeStore, kept: DataFrame) -> DataFrame:
    """Edges with both ends among ``kept``."""
    kept = cut(kept.select("node"))
    return (
        _step(kept, edges, kept.count())
        .join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
        .select("src", "dst").distinct()
    )


def diagram_lines(edges: DataFrame | EdgeStore, kept: DataFrame) -> DataFrame:
    """``section, line`` of a flowchart over the kept nodes.

    Node ids are hashes of the path, so lines can be written in parallel.
    """
    node_lines = kept.select(F.lit("node").alias("section"), node_line(F.col("node")).alias("line"))
    edge_lines = subgraph(edges, kept).select(F.lit("edge").alias("section"), edge_line(F.col("src"), F.col("dst")).alias("line"))
    return node_lines.unionByName(edge_lines)


def _ident(node: Column) -> Column:
    return F.concat(F.lit("n"), F.substring(F.md5(node), 1, 12))


def node_line(node: Column) -> Column:
    return F.concat(F.lit("  "), _ident(node), F.lit('["'), stem_of(node), F.lit('"]'))


def edge_line(src: Column, dst: Column) -> Column:
    return F.concat(F.lit("  "), _ident(src), F.lit(" --> "), _ident(dst))


def impact(edges: DataFrame | EdgeStore, changed: DataFrame, concepts: DataFrame, hops: int = 5) -> DataFrame:
    """What a change touches: ``start, depth, type, n`` over everything downstream."""
    touched = downstream(edges, changed, hops).filter(F.col("depth") > 0)
    types = concepts.select(F.col("path").alias("node"), "type")
    return (
        touched.join(types, "node", "left")
        .groupBy("start", "depth", F.coalesce("type", F.lit("?")).alias("type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def hop_pairs(paths: DataFrame) -> DataFrame:
    """``path_id, nodes`` -> consecutive ``path_id, position, src, dst, hop_count``."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("nodes") - 1),
        lambda i: F.struct(i.cast("bigint").alias("position"), F.element_at("nodes", i).alias("src"),
                           F.element_at("nodes", i + 1).alias("dst")),
    )
    return paths.filter(F.size("nodes") >= 2).select(
        "path_id", (F.size("nodes") - 1).cast("bigint").alias("hop_count"), F.inline(pairs)
    )


def adjacency(edges: DataFrame | EdgeStore, shard_size: int = 10_000) -> DataFrame:
    """``src, out_degree, shard, targets``: out-lists in pieces of about ``shard_size``.

    A hub's list is spread over several rows by a hash of the target, so no
    task ever gathers all of it.
    """
    edges = _frame(edges).select("src", "dst") if isinstance(edges, EdgeStore) else edges.select("src", "dst").distinct()
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))
    big = degree.filter(F.col("out_degree") > shard_size)
    shards = F.ceil(F.coalesce("out_degree", F.lit(1)) / shard_size)
    spread = F.conv(F.substring(F.md5("dst"), 1, 8), 16, 10).cast("bigint")
    lists = (
        edges.join(big, "src", "left").withColumn("shard", F.pmod(spread, shards))
        .groupBy("src", "shard").agg(F.sort_array(F.collect_list("dst")).alias("targets"))
    )
    return lists.join(degree, "src").select("src", "out_degree", "shard", "targets")
