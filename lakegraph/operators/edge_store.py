"""Edges written once, in each direction that is walked, for many traversals.

Each direction is a table bucketed and sorted by the end a hop starts from. A hop
brings the frontier to the buckets, so stored edges are never shuffled, and a small
frontier opens its own buckets only. Edges of hubs lie in a plain table beside the
buckets: a bucket is read by one task, while adaptive execution splits a hub's rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakegraph.session import cut, scratch_path

#: A node with more edges in a direction than this is a hub there.
HUB_EDGES = 1_000_000
#: A frontier of at most so many rows names its nodes in the scan, which prunes buckets.
FEW_NODES = 500
#: About so many edges a bucket, as its task holds them all.
BUCKET_EDGES = 500_000
#: Nodes are counted by so many hashes first; only those in a crowded one can be hubs.
HUB_BINS = 1 << 16


def _bins(rows: DataFrame) -> DataFrame:
    """``bin, n``: rows by a hash of ``src``, of a fixed number, so they combine map-side."""
    return cut(rows.groupBy(_bin()).agg(F.count(F.lit(1)).alias("n")))


def _bin() -> Column:
    return F.pmod(F.xxhash64("src"), F.lit(HUB_BINS)).alias("bin")


def _hubs(rows: DataFrame, bins: DataFrame, hub_edges: int) -> DataFrame | None:
    """``src`` with more than ``hub_edges`` rows, or nothing where there is none.

    Nodes are shuffled only from bins that hold more rows than that.
    """
    crowded = bins.filter(F.col("n") > hub_edges).select("bin")
    if crowded.isEmpty():
        return None
    hubs = cut(
        rows.select("src", _bin()).join(F.broadcast(crowded), "bin", "left_semi")
        .groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub_edges).select("src")
    )
    return None if hubs.isEmpty() else hubs


class EdgeStore:
    """Distinct ``src, dst`` of a graph; ``reverse()`` is the same store walked the other way.

    ``ways`` has the table and the hubs' edges of each direction that is written. The second direction is written
    from the first when a walk first needs it.
    """

    def __init__(self, spark: SparkSession, ways: dict[str, tuple[str, DataFrame | None]], buckets: int, hub_edges: int, way: str = "out"):
        self.spark, self._ways, self._buckets, self._hub_edges, self._way = spark, ways, buckets, hub_edges, way

    @classmethod
    def write(cls, edges: DataFrame, buckets: int | None = None, hub_edges: int = HUB_EDGES) -> EdgeStore:
        """Stores the edges in the shared folder, in ``buckets`` per direction (by default the session's shuffle
        partitions, and more if a bucket would hold over ``BUCKET_EDGES``).

        Edges may repeat: a bucket holds all edges of its nodes, so it makes them distinct without a shuffle of its own.
        They are read twice, to be counted and to be written.
        """
        spark = edges.sparkSession
        edges = edges.select("src", "dst")
        bins = _bins(edges)
        if buckets is None:
            rows = bins.agg(F.sum("n")).first()[0] or 0
            buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_EDGES))
        store = cls(spark, {}, buckets, hub_edges)
        store._write("out", edges, bins)
        return store

    def _write(self, way: str, rows: DataFrame, bins: DataFrame) -> None:
        hubs = _hubs(rows, bins, self._hub_edges)
        crowded = None
        if hubs is not None:
            crowded = rows.join(hubs, "src", "left_semi")
            crowded = cut(crowded.distinct() if way == "out" else crowded)
            rows = rows.join(hubs, "src", "left_anti")
        name = f"edges_{way}_{uuid.uuid4().hex}"
        dealt = rows.repartition(self._buckets, "src")
        # The same hash deals rows to tasks and to buckets, so a task writes the one file of its bucket.
        ((dealt.distinct() if way == "out" else dealt).write.bucketBy(self._buckets, "src").sortBy("src", "dst")
         .option("path", scratch_path(self.spark, name)).option("compression", "zstd").format("parquet").saveAsTable(name))
        self._ways[way] = name, crowded

    def reverse(self) -> EdgeStore:
        return EdgeStore(self.spark, self._ways, self._buckets, self._hub_edges, "in" if self._way == "out" else "out")

    def written(self) -> bool:
        """Whether the edges lie by the end that a hop of this direction starts from."""
        return self._way in self._ways

    def _plain(self) -> list[DataFrame]:
        name, crowded = self._ways[self._way]
        return [self.spark.table(name)] + ([] if crowded is None else [crowded])

    def _turned(self) -> list[DataFrame]:
        """What the other direction has written, where no edge repeats, with its ends exchanged."""
        return [p.select(F.col("dst").alias("src"), F.col("src").alias("dst")) for p in self.reverse()._plain()]

    def edges(self) -> DataFrame:
        """All edges as ``src, dst``; those outside hubs keep their buckets."""
        return reduce(DataFrame.unionByName, self._plain() if self.written() else self._turned())

    def parts(self) -> list[DataFrame]:
        """The bucketed edges and, where there are hubs, theirs."""
        if not self.written():
            rows = reduce(DataFrame.unionByName, self._turned())
            self._write(self._way, rows, _bins(rows))
        return self._plain()

    def leading(self, asked: DataFrame, rows: int) -> list[DataFrame]:
        """Edges from the distinct nodes ``src`` of ``asked``, ``rows`` of them.

        For a few nodes a direction that is not written is read from the other one.
        """
        if rows <= FEW_NODES:
            named = [r.src for r in asked.collect()]
            return [p.filter(F.col("src").isin(named)) for p in (self.parts() if self.written() else self._turned())]
        return [p.join(asked, "src", "left_semi") for p in self.parts()]

    def hop(self, frontier: DataFrame, rows: int | None = None) -> DataFrame:
        """Edges from the ``node`` of every frontier row, with the frontier's other columns.

        ``rows`` is the frontier's size where it is known.
        """
        named = frontier.withColumnRenamed("node", "src")
        parts = self.parts()
        if rows is not None and rows <= FEW_NODES:
            asked = [r.node for r in frontier.select("node").distinct().collect()]
            parts = [p.filter(F.col("src").isin(asked)) for p in parts]
        found = [p.join(named, "src") for p in parts]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def drop(self) -> None:
        """Forgets the tables; their files lie in the shared scratch folder."""
        for name, _ in self._ways.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._ways.clear()
