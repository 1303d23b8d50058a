import random
import re

import pytest
from pyspark.sql import functions as F

from lakegraph import session
from lakegraph.operators import closure, edge_store, graph
from lakegraph.operators.edge_store import EdgeStore

# a -> b -> d, a -> c -> d (two equal paths), d -> e -> d (cycle), e -> e, x -> y -> x (pure cycle), e -> gone
EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "e"), ("a", "b"),
         ("x", "y"), ("y", "x"), ("e", "gone")]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src string, dst string")


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def brute_reach(rows, start, hops):
    depth, frontier = {start: 0}, [start]
    for d in range(1, hops + 1):
        frontier = sorted({t for s, t in rows if s in frontier and t not in depth})
        depth.update({n: d for n in frontier})
    return depth


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_reach_with_broadcast_and_shuffle(spark, limit):
    got, before = {}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        for r in graph.downstream(edges(spark), starts(spark, "a", "x", "nowhere"), 3).collect():
            got.setdefault(r.start, {})[r.node] = r.depth
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {s: brute_reach(EDGES, s, 3) for s in ("a", "x", "nowhere")}


def test_upstream(spark):
    got = {r.node: r.depth for r in graph.upstream(edges(spark), starts(spark, "d"), 5).collect()}
    assert got == {"d": 0, "b": 1, "c": 1, "e": 1, "a": 2}


def test_no_edges(spark):
    empty = edges(spark, EDGES).limit(0)
    assert [tuple(r) for r in graph.downstream(empty, starts(spark, "a")).collect()] == [("a", "a", 0)]
    assert graph.roots(empty).count() == 0


def test_shortest_path_takes_smallest_predecessor(spark):
    pairs = spark.createDataFrame([("a", "e"), ("a", "a"), ("a", "x"), ("b", "gone")], "start string, goal string")
    got = {}
    for r in graph.shortest_paths(edges(spark), pairs).orderBy("start", "goal", "position").collect():
        got.setdefault((r.start, r.goal), []).append(r.node)
    assert got == {("a", "e"): ["a", "b", "d", "e"], ("a", "a"): ["a"], ("b", "gone"): ["b", "d", "e", "gone"]}
    assert graph.shortest_paths(edges(spark), pairs, max_hops=2).filter("start <> goal").count() == 0


def test_roots_lineage_and_pure_cycles(spark):
    assert [r.node for r in graph.roots(edges(spark)).collect()] == ["a"]
    lineage = graph.materialized_lineage(edges(spark))
    parents = {r.node: r.parent for r in lineage.collect()}
    assert parents == {"a": None, "b": "a", "c": "a", "d": "b", "e": "d", "gone": "e"}
    assert [tuple(r) for r in graph.lineage_paths(lineage).collect()] == [("a", "path-a-to-gone", 6, 4)]
    assert {r.node for r in graph.unrooted_nodes(edges(spark)).collect()} == {"x", "y"}
    chain = [(f"n{i}", f"n{i + 1}") for i in range(9)]
    assert graph.unrooted_nodes(edges(spark, chain)).count() == 0
    assert graph.downstream(edges(spark, chain), starts(spark, "n0"), None).agg(F.max("depth")).first()[0] == 9


def test_flow_direction(spark):
    links = spark.createDataFrame(
        [("t", "feeds", "u"), ("q", "reads_from", "t"), ("q", "related_to", "u"), ("q", "queries", ""), ("q", "queries", None)],
        "src string, rel string, target string",
    )
    assert {tuple(r) for r in graph.flow_edges(links).collect()} == {("t", "u"), ("t", "q")}


def brute_neighbourhood(rows, focus, own, hops, max_nodes):
    around = {}
    for s, t in rows:
        around.setdefault(s, set()).add(t)
        around.setdefault(t, set()).add(s)
    depth, frontier = {focus: 0}, {focus}
    for d in range(1, hops + 1):
        found = set().union(*[around.get(n, set()) for n in frontier]) | (own if d == 1 else set())
        frontier = found - set(depth)
        depth.update({n: d for n in frontier})
    return dict(sorted(depth.items(), key=lambda kv: (kv[1], kv[0]))[:max_nodes])


def test_neighbourhoods_with_a_hub_match_brute_force(spark):
    rng = random.Random(3)
    rows = [("hub", f"n{i:03}") for i in range(300)] + [
        (f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(200)
    ] + [(f"m{i}", "hub") for i in range(5)]
    foci = ["hub", "m0", "n007", "n100"]
    links = spark.createDataFrame([("m0", "contains", "zz"), ("n007", "uses", "aa")], "src string, rel string, target string")
    got = {}
    for r in graph.neighbourhoods(edges(spark, rows), starts(spark, *foci), links, 2, 6).collect():
        got.setdefault(r.focus, {})[r.node] = r.depth
    for f in foci:
        own = {"zz"} if f == "m0" else {"aa"} if f == "n007" else set()
        assert got[f] == brute_neighbourhood(rows, f, own, 2, 6), f


def test_adjacency_shards_a_hub(spark):
    rows = [("hub", f"n{i}") for i in range(500)] + [("a", "b"), ("a", "b"), ("a", "c")]
    lists = graph.adjacency(edges(spark, rows), shard_size=50).collect()
    hub = [r for r in lists if r.src == "hub"]
    assert len(hub) == 10 and sorted(t for r in hub for t in r.targets) == sorted({f"n{i}" for i in range(500)})
    assert all(r.out_degree == 500 for r in hub)
    assert [(r.targets, r.out_degree, r.shard) for r in lists if r.src == "a"] == [(["b", "c"], 2, 0)]


def test_diagram_and_impact(spark):
    kept = starts(spark, "a", "b")
    lines = graph.diagram_lines(edges(spark), kept).collect()
    assert sorted(r.section for r in lines) == ["edge", "node", "node"]
    concepts = spark.createDataFrame([("b", "Table"), ("c", "View")], "path string, type string")
    rows = {(r.depth, r.type): r.n for r in graph.impact(edges(spark), starts(spark, "a"), concepts, 2).collect()}
    assert rows == {(1, "Table"): 1, (1, "View"): 1, (2, "?"): 1}


def test_hop_pairs(spark):
    paths = spark.createDataFrame([("p", ["a", "b", "c"]), ("q", ["a"])], "path_id string, nodes array<string>")
    assert [(r.path_id, r.position, r.src, r.dst, r.hop_count) for r in graph.hop_pairs(paths).orderBy("position").collect()] == [
        ("p", 1, "a", "b", 2), ("p", 2, "b", "c", 2)]


@pytest.mark.parametrize("hub_edges", [1_000_000, 3])
def test_stored_edges_give_what_a_frame_gives(spark, hub_edges):
    rng = random.Random(7)
    rows = EDGES + [("hub", f"n{i:03}") for i in range(60)] + [(f"n{rng.randrange(60):03}", f"n{rng.randrange(60):03}") for _ in range(90)]
    frame, store = edges(spark, rows), EdgeStore.write(edges(spark, rows), 4, hub_edges)
    some = starts(spark, "a", "hub", "x", "nowhere", "n003")
    same = lambda f: sorted(map(str, f(frame).collect())) == sorted(map(str, f(store).collect()))
    assert same(lambda e: graph.downstream(e, some, 4)) and same(lambda e: graph.upstream(e, some, 4))
    assert same(lambda e: graph.reach(e, some, None, parents=True)) and same(lambda e: graph.materialized_lineage(e))
    assert same(lambda e: graph.neighbourhoods(e, some, None, 2, 6)) and same(lambda e: graph.focus_nodes(e, some))
    assert same(lambda e: graph.subgraph(e, some)) and same(lambda e: graph.adjacency(e, 20))
    pairs = spark.createDataFrame([("a", "e"), ("hub", "n001"), ("a", "x")], "start string, goal string")
    assert same(lambda e: graph.shortest_paths(e, pairs))
    store.drop()


def test_a_hop_neither_shuffles_stored_edges_nor_opens_all_buckets(spark):
    store = EdgeStore.write(edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(500)]), 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.hop(starts(spark, *(f"n{i}" for i in range(300))))._jdf.queryExecution().executedPlan().toString()
        scan = plan.index("FileScan")
        # On the way from the scan up to the join there is a sort at most; the one exchange is the frontier's.
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert plan.index("Exchange hashpartitioning") > scan or "Exchange" not in plan[plan.index("SortMergeJoin"):scan]
        few = store.hop(starts(spark, "n7"), 1)._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 8" in few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        store.drop()


def brute_closure(rows):
    after = {}
    for s, d in rows:
        after.setdefault(s, set()).add(d)
        after.setdefault(d, set())
    seen = {}
    for n in after:
        todo, seen[n] = [n], {n}
        while todo:
            for d in after[todo.pop()] - seen[n]:
                seen[n].add(d)
                todo.append(d)
    return seen, {n: min(m for m in seen[n] if n in seen[m]) for n in seen}


CHAIN = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)]
TWO_RINGS = [("b", "c"), ("c", "b"), ("c", "d"), ("d", "a"), ("a", "e"), ("e", "d"), ("e", "z"), ("y", "b")]


def test_condensation_and_reach_sizes(spark):
    """Several graphs side by side: loops, equal paths, a chain, a long ring, rings in a row, random ones."""
    some = [[(f"v{r.randrange(40)}", f"v{r.randrange(40)}") for _ in range(n)] for r, n in
            [(random.Random(1), 30), (random.Random(2), 50), (random.Random(3), 70)]]
    graphs = [EDGES, CHAIN, CHAIN + [("n12", "n00")], TWO_RINGS, *some]
    rows = [(f"{i}-{s}", f"{i}-{d}") for i, g in enumerate(graphs) for s, d in g]
    seen, component = brute_closure(rows)
    parts = closure.condense(edges(spark, rows)).collect()
    assert {r.node: r.component for r in parts} == component and len(parts) == len(component)
    sizes = {r.component: (r.members, r.reached) for r in closure.reach_sizes(edges(spark, rows)).collect()}
    members = list(component.values())
    assert sizes == {c: (members.count(c), len(seen[c])) for c in set(members)}


def test_reach_sizes_of_many_nodes(spark):
    rows = [(f"top{i % 3}", f"mid{i % 40}") for i in range(120)] + [(f"mid{i % 40}", f"low{i}") for i in range(8000)]
    sizes = {r.component: r.reached for r in closure.reach_sizes(edges(spark, rows)).collect()}
    seen, _ = brute_closure(rows)
    assert len(sizes) == len(seen) and all(abs(n - len(seen[c])) <= max(1, 0.07 * len(seen[c])) for c, n in sizes.items())


def test_condensation_of_nothing_and_nulls(spark):
    assert closure.condense(edges(spark, EDGES).limit(0)).count() == 0
    assert closure.reach_sizes(edges(spark, EDGES).limit(0)).count() == 0
    got = closure.condense(edges(spark, [("a", None), (None, "b"), ("c", "c")])).collect()
    assert [tuple(r) for r in got] == [("c", "c")]


def test_lineage_of_asked_roots(spark):
    rows = [("a", "b"), ("b", "c"), ("x", "c"), ("y", "x")]
    got = graph.materialized_lineage(edges(spark, rows), None, asked=starts(spark, "y", "b"))
    assert sorted((r.root, r.node, r.depth) for r in got.collect()) == [("y", "c", 2), ("y", "x", 1), ("y", "y", 0)]


def test_a_store_takes_repeated_edges_in_buckets_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(edge_store, "BUCKET_EDGES", 50)
    rows = [(f"n{i}", f"n{i + 1}") for i in range(300)] + [("hub", f"n{i % 5}") for i in range(90)] + [(None, "n1"), ("n1", None)]
    store = EdgeStore.write(edges(spark, rows * 2), hub_edges=100)
    try:
        assert sorted(map(str, store.edges().collect())) == sorted(map(str, edges(spark, rows).distinct().collect()))
        back = store.reverse()
        assert back.edges().count() == len(set(rows)) and [p.count() for p in store.parts()][1:] == [5]
        assert len(store.parts()[0].inputFiles()) > 4  # more than the session's shuffle partitions
    finally:
        store.drop()


def test_distinct_edges_are_dealt_out_by_the_size_of_the_input(spark, monkeypatch, tmp_path):
    rows = [(f"n{i % 40}", "feeds", f"n{i % 7}") for i in range(400)]
    spark.createDataFrame(rows, "src string, rel string, target string").write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    plain = graph.flow_edges(links)
    monkeypatch.setattr(session, "TASK_BYTES", 200)
    dealt = graph.flow_edges(links)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect())) == sorted({(s, t) for s, _, t in rows})
    assert dealt.rdd.getNumPartitions() > 4


def test_packed_traversal_gives_the_rows_of_a_plain_one(spark):
    """Over 64 starts, loops, several nodes a start, missing starts and nodes."""
    rng = random.Random(3)
    rows = EDGES + [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(260)] + [("n1", None), (None, "n2")]
    frame = edges(spark, rows)
    some = starts(spark, *(f"n{i}" for i in range(150)), "a", "nowhere", None)
    shared = some.select(F.when(F.col("node") < "n5", F.lit("low")).otherwise(F.lit("rest")).alias("start"), "node")
    for s, hops in ((some, 4), (some.limit(1), 5), (shared, 3), (some.limit(0), 2)):
        plain = graph.reach(frame, s, hops, common=False).collect()
        assert sorted(map(str, plain)) == sorted(map(str, graph.reach(frame, s, hops).collect()))
    plain = graph.reach(edges(spark, EDGES), starts(spark, "a", "x"), None, common=False).collect()
    assert sorted(map(str, plain)) == sorted(map(str, graph.reach(edges(spark, EDGES), starts(spark, "a", "x"), None).collect()))


def test_a_level_has_a_row_for_sixty_four_starts(spark):
    rows = [(f"s{i:02}", f"m{j}") for i in range(64) for j in range(5)]
    levels, _ = graph._packed_levels(edges(spark, rows), starts(spark, *(f"s{i:02}" for i in range(64))), 3)
    assert [level.count() for level in levels][1:] == [5, 0] and levels[1].select("mask").distinct().count() <= 4


def test_paths_to_few_goals_are_those_to_many(spark):
    rng = random.Random(5)
    rows = EDGES + [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(200)] + [("n1", None), (None, "n2")]
    frame = edges(spark, rows)
    asked = [(f"n{i}", f"n{g}") for i in range(70) for g in (3, i % 6, i)] + [("a", "e"), (None, "n3"), ("n1", None), ("a", "gone")]
    pairs = spark.createDataFrame(asked, "start string, goal string").distinct()
    for hops in (None, 3, 8):
        few, many = graph._paths_to_few(frame, pairs, hops), graph._paths_to_many(frame, pairs, hops)
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_lineage_lists_roots_by_node_and_gives_the_rows_of_a_plain_traversal(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"r{i}", f"n{rng.randint(0, 9)}") for i in range(70) for _ in range(2)]
    rows += [(f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 30)}") for _ in range(60)] + [("n1", None), ("n2", None), (None, "n3"), ("r1", "r1x")]
    monkeypatch.setattr(graph, "BLOCK_STARTS", 16)
    monkeypatch.setattr(graph, "LEVEL_PAIRS", 100)
    frame = edges(spark, rows)
    plain = graph._reach(graph._kept(frame), graph.roots(frame), 6, True)
    expected = sorted(map(str, plain.select("start", "node", "depth", "parent").collect()))
    written, taken = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(taken(df)) or written[-1])
    got = graph.materialized_lineage(frame).select(F.col("root").alias("start"), "node", "depth", "parent")
    assert sorted(map(str, got.collect())) == expected
    assert sum(w.count() for w in written[1:]) < len(expected) / 2


def written(monkeypatch, module):
    """Columns and rows of what ``module`` writes from here on."""
    seen, cut = [], module.cut

    def counted(df):
        kept = cut(df)
        seen.append((kept.columns, kept.count()))
        return kept

    monkeypatch.setattr(module, "cut", counted)
    return seen


def test_reach_sizes_write_a_sketch_once_while_nothing_is_told_to_it(spark, monkeypatch):
    rows = [(f"top{i % 3}", f"mid{i % 40}") for i in range(120)] + [(f"mid{i % 40}", f"low{i}") for i in range(2000)] + [("a", "b"), ("b", "a"), ("b", "top0")]
    seen = written(monkeypatch, closure)
    sizes = {r.component: (r.members, r.reached) for r in closure.reach_sizes(edges(spark, rows)).collect()}
    assert len(sizes) == 2044 and sizes["a"][0] == 2 and sizes["low7"] == (1, 1) and sizes["mid3"] == (1, 51)
    # A round wrote the sketches of all ends again.
    assert sum(n for columns, n in seen if "sketch" in columns) < 1.1 * len(sizes)
    parts = closure.condense(edges(spark, rows))
    assert {r.component: (r.members, r.reached) for r in closure.reach_sizes(edges(spark, rows), parts).collect()} == sizes


def test_stored_neighbourhoods_trim_the_nodes_they_meet_only(spark, monkeypatch):
    rows = [("f", "g"), ("g", "h"), ("h", "far")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(300)] + [("g", f"n{i:03}") for i in range(90)]
    store = EdgeStore.write(edges(spark, rows * 2), 4)
    seen = written(monkeypatch, graph)
    got = {r.node: r.depth for r in graph.neighbourhoods(store, starts(spark, "f"), None, 2, 6).collect()}
    assert got == brute_neighbourhood(rows, "f", set(), 2, 6)
    assert sum(n for _, n in seen) < 20  # all 600 directed edges before
    assert store.edges().count() == store.reverse().edges().count() == len(set(rows))
    store.drop()


def test_a_store_writes_no_raw_edges_and_the_second_direction_when_walked(spark, monkeypatch):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(300)] + [("n0", f"m{i}") for i in range(40)]
    seen = written(monkeypatch, edge_store)
    store = EdgeStore.write(edges(spark, rows * 3), 4)
    try:
        assert {tuple(columns) for columns, _ in seen} == {("bin", "n")}  # all 1,020 edges before
        assert graph.downstream(store, starts(spark, "n290"), 5).count() == 6
        got = {r.node: r.depth for r in graph.neighbourhoods(store, starts(spark, "m7"), None, 2, 6).collect()}
        assert got == brute_neighbourhood(rows, "m7", set(), 2, 6)
        assert not store.reverse().written()  # written with the first before
        assert {r.node for r in graph.upstream(store, starts(spark, "n3"), 2).collect()} == {"n3", "n2", "n1"}
        assert store.reverse().written() and store.reverse().edges().count() == len(set(rows))
    finally:
        store.drop()


def test_lists_of_roots_are_merged_in_the_row_and_crowded_nodes_by_pair(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(f"r{i}", f"n{rng.randint(0, 9)}") for i in range(60) for _ in range(2)] + [("n1", None), (None, "n3"), ("r1", "r1x")]
    rows += [(f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 30)}") for _ in range(60)] + [(f"n{i}", "hub") for i in range(31)] + [("hub", "n2")]
    frame = edges(spark, rows)
    plain = graph._reach(graph._kept(frame), graph.roots(frame), 6, True).withColumnRenamed("start", "root")
    expected = sorted(map(str, plain.select("root", "node", "depth", "parent").collect()))
    paths = sorted(map(str, graph.lineage_paths(plain).collect()))
    for limit in (1_000, 5):
        monkeypatch.setattr(graph, "GATHERED_EDGES", limit)
        assert sorted(map(str, graph.materialized_lineage(frame).collect())) == expected
        listed = graph.materialized_lineage(frame, listed=True)
        got = graph.lineage_paths(*listed)
        assert sorted(map(str, got.collect())) == paths
    # Pairs of a root and a node are aggregated by numbers: rows were sorted by root before.
    plan = graph._summary_of_lists(*listed)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[block#\d+L, at#\d+, depth", plan) and not re.search(r"SortAggregate\(key=\[block#\d+L, at#\d+, depth", plan)
    told = spark.createDataFrame([(0, "x", "p", [1]), (0, "x", "o", [1, 2]), (0, "x", None, [2]), (0, "x", "q", [5])],
                                 "block bigint, node string, parent string, starts array<smallint>")
    first = graph._first_parents(told)
    row = first.first()
    assert {(a, row.parents[b]) for a, b in zip(row.starts, row.by)} == {(1, "o"), (5, "q")} and first.count() == 1
    assert "explode" not in first._jdf.queryExecution().optimizedPlan().toString().lower()  # pairs were exploded and sorted before


def test_lineage_edges_are_made_distinct_once(spark):
    from lakegraph.plans import QUERIES
    from lakegraph.sources import derive

    sf = "/root/testdata/sf0.001"
    repeated = derive.links(spark, sf, repeated=True)
    assert set(repeated.collect()) == set(derive.links(spark, sf).collect())
    plan = QUERIES["g01_lineage_graph"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" in plan and "Aggregate [l_suppkey" not in plan  # pairs of keys and flow edges were made distinct before the union
