"""Closure of a graph in linear state: cycles condensed, reach sizes as sketches.

What every node reaches is quadratic in general. Strongly connected components
are found by colouring; the condensed graph has no cycles, so a node's sketch is
the union of its successors' and its own members. Exact rows are for asked roots
(``graph.reach``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lakegraph.operators import graph
from lakegraph.session import cut

#: Nodes off all cycles are peeled as long as a round removes this share of the edges; colouring does the rest.
PEEL_SHARE = 0.05


def _peel(edges: DataFrame) -> DataFrame:
    """Edges without those that start at a node nothing leads to or end at one that leads nowhere."""
    edges, left = cut(edges), None
    rows = edges.count()
    while rows and (left is None or left - rows >= PEEL_SHARE * left):
        # Edges on cycles stay in both steps, so the second asks what the first left only.
        led = cut(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        edges = cut(led.join(led.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        left, rows = rows, edges.count()
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """``node, colour``: the smallest of a node and all that lead to it; only changed colours travel on."""
    colours = cut(graph.nodes(edges).withColumn("colour", F.col("node")))
    changed = colours
    while not changed.isEmpty():
        told = edges.join(changed.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.min("colour").alias("told")
        )
        changed = cut(colours.join(told, "node").filter(F.col("told") < F.col("colour")).select("node", F.col("told").alias("colour")))
        colours = cut(
            colours.join(changed.withColumnRenamed("colour", "told"), "node", "left")
            .select("node", F.coalesce("told", "colour").alias("colour"))
        )
    return colours


def _clean(edges: DataFrame) -> DataFrame:
    return cut(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())


def _on_cycles(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes on cycles of clean edges, and of some others; a node left out is its own component."""
    found = []
    rest = _peel(edges.filter(F.col("src") != F.col("dst")))
    while not rest.isEmpty():
        colours = _colours(rest)
        tinted = rest.join(colours.withColumnRenamed("node", "src"), "src").join(
            colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst"
        )
        inner = cut(tinted.filter(F.col("colour") == F.col("other")).select("src", "dst"))
        tops = colours.filter(F.col("node") == F.col("colour")).select("node")
        members = cut(graph.reach(graph.reverse(inner), tops, None, common=False).select("node", F.col("start").alias("component")))
        found.append(members)
        open_ends = inner.join(members.select(F.col("node").alias("src")), "src", "left_anti")
        rest = _peel(open_ends.join(members.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if not found:
        return graph.nodes(edges).limit(0).withColumn("component", F.col("node"))
    return reduce(DataFrame.unionByName, found)


def condense(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node on a common cycle, or the node itself where there is none.

    Each round colours every node by the smallest one upstream. The nodes of a
    colour that lead back to it form a component; edges between two colours lie on
    no cycle and drop out, so all components of a round are found at once. Nulls
    are no nodes; loops and repeated edges change nothing.
    """
    edges = _clean(edges)
    return graph.nodes(edges).join(_on_cycles(edges), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def condensed_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` between different components."""
    return (
        edges.select("src", "dst")
        .join(components.select(F.col("node").alias("src"), F.col("component").alias("above")), "src")
        .join(components.select(F.col("node").alias("dst"), F.col("component").alias("below")), "dst")
        .filter(F.col("above") != F.col("below"))
        .select(F.col("above").alias("src"), F.col("below").alias("dst")).distinct()
    )


def reach_sizes(edges: DataFrame, components: DataFrame | None = None, lg_k: int = 12) -> DataFrame:
    """``component, members, reached, sketch``: about how many nodes each component leads to, its members included.

    Components are taken from the ends upwards, each once all it leads to are
    done. ``sketch`` is a HyperLogLog sketch of ``2 ** lg_k`` buckets (standard error
    about ``0.8 / sqrt(2 ** lg_k)``, small sets nearly exact), so the state is one
    sketch a component however much it reaches, and sketches can be united further.
    """
    own = [F.count(F.lit(1)).alias("members"), F.hll_sketch_agg("node", F.lit(lg_k)).alias("sketch")]
    if components is None:
        edges = _clean(edges)
        cycles = cut(_on_cycles(edges))
        # A node outside is its own component and its edges are distinct already: neither is looked up or dealt out again.
        alone = graph.nodes(edges).join(cycles, "node", "left_anti").groupBy("node").agg(*own).withColumnRenamed("node", "component")
        parts = [alone, cycles.groupBy("component").agg(*own)]
        named = edges.filter(F.col("src") != F.col("dst"))
        for end in ("src", "dst"):
            named = named.join(cycles.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component")), end, "left")
        plain = F.col("src_component").isNull() & F.col("dst_component").isNull()
        moved = named.filter(~plain).select(F.coalesce("src_component", "src").alias("src"), F.coalesce("dst_component", "dst").alias("dst"))
        links = cut(named.filter(plain).select("src", "dst").unionByName(moved.filter(F.col("src") != F.col("dst")).distinct()))
    else:
        components = cut(components)
        parts = [components.groupBy("component").agg(*own)]
        links = cut(condensed_edges(edges, components))
    after = links.groupBy(F.col("src").alias("component")).agg(F.count(F.lit(1)).alias("open"))
    state = cut(reduce(DataFrame.unionByName, [p.join(after, "component", "left") for p in parts]))
    last, waiting = state.filter("open IS NULL"), state.filter("open IS NOT NULL")
    done = [last]
    while True:
        # Links to what is done are used now and not read again.
        later = cut(links.join(waiting.select(F.col("component").alias("dst")), "dst", "left_semi").select("src", "dst"))
        sent = links.join(last.select(F.col("component").alias("dst"), "sketch"), "dst").select(
            F.col("src").alias("component"), F.lit(0).cast("bigint").alias("members"), F.lit(-1).cast("bigint").alias("open"), "sketch"
        )
        now = cut(waiting.unionByName(sent).groupBy("component").agg(
            F.sum("members").alias("members"), F.sum("open").alias("open"), F.hll_union_agg("sketch").alias("sketch")
        ))
        last, waiting, links = now.filter("open = 0"), now.filter("open > 0"), later
        if last.isEmpty():
            break
        done.append(last)
    sizes = reduce(DataFrame.unionByName, done)
    return sizes.select("component", "members", F.hll_sketch_estimate("sketch").alias("reached"), "sketch")
