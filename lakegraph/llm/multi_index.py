"""Nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised on their own; a cell is a pair of
centroids. A query visits cells by the sum of its two half products, best first,
with a heap, until they hold enough vectors, and ranks what they hold exactly.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lakegraph.llm.common import arrow_types, lowest, map_columns
from lakegraph.session import cut

#: Vectors, and queries, that one packed block holds.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
#: Partial results of one query block that are merged at once.
MERGE = 32

FOUND = "query_id bigint, rank int, vec_id bigint, score double"


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``row, vec_id, v`` (doubles): every row with an id and a vector that is not null or zero and holds finite numbers only.

    ``row`` tells rows of one id apart; it is written once, with the rows.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = rows.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return cut(rows.where(good).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))


def k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(3)
    centroids = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        nearest = (rows @ centroids.T - (centroids ** 2).sum(1) / 2).argmax(1)
        for j in np.unique(nearest):
            centroids[j] = rows[nearest == j].mean(0)
    return centroids


def fit(vectors: DataFrame, k: int = 32, sample: int = 20_000) -> list[np.ndarray]:
    """Centroids of both halves, from the ``sample`` vectors of smallest row hash."""
    some = lowest(vectors, "row", sample, vectors.count()).select("v").toPandas()
    if some.empty:
        return []
    rows = np.array(some["v"].tolist())
    half = (rows.shape[1] + 1) // 2
    return [k_means(rows[:, :half], k), k_means(rows[:, half:], k)]


def visit(scores: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, enough: int) -> list[int]:
    """Cells by falling sum of the two half scores, until they hold ``enough`` vectors."""
    by = [np.argsort(-s, kind="stable") for s in scores]
    first, second = ([float(s[i]) for i in order] for s, order in zip(scores, by))
    heap, cells, held = [(-(first[0] + second[0]), 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(by[0][i]) * len(second) + int(by[1][j])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        # Each pair is reached once: down from the pair above, right only along the first row.
        if i + 1 < len(first):
            heapq.heappush(heap, (-(first[i + 1] + second[j]), i + 1, j))
        if i == 0 and j + 1 < len(second):
            heapq.heappush(heap, (-(first[0] + second[j + 1]), 0, j + 1))
    return cells


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, component by component, so that equal vectors have equal scores."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * rows[:, d]
    return total


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def nearest(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20,
    centroids: int = 32, sample: int = 20_000, fraction: float = 0.65,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` of largest inner product found for each query.

    Queries are the rows of ids divisible by ``every``; a query's own row is no candidate,
    another row of its id is one, and is a query of its own. Every vector is indexed; only the centroids come from a sample (``sample``
    rows). A query stops once its cells hold ``fraction`` of all vectors, and more than ``k``; the share that
    near-random vectors need for a recall of 0.9 does not fall with their number. Vectors and queries are packed into blocks, so the search is
    a matrix product per pair of blocks; the number of rows that Spark joins is
    that of block pairs. Ties go to the smaller id, see :func:`usable` for nulls.
    Vectors have an inner product only with those of their own length, so every length is an
    index of its own, one after the other. Without usable vectors there are no rows.
    """
    vectors = usable(rows, key, vector)
    lengths = sorted(r.n for r in vectors.select(F.size("v").alias("n")).distinct().collect())
    if not lengths:
        return rows.sparkSession.createDataFrame([], FOUND)
    parts = [vectors if len(lengths) == 1 else vectors.where(F.size("v") == n) for n in lengths]
    return reduce(DataFrame.unionByName, [_search(part, every, k, centroids, sample, fraction) for part in parts])


def _search(vectors: DataFrame, every: int, k: int, centroids: int, sample: int, fraction: float) -> DataFrame:
    """:func:`nearest` among vectors of one length."""
    spark = vectors.sparkSession
    coarse = fit(vectors, centroids, sample)
    half, width = coarse[0].shape[1], coarse[0].shape[1] + coarse[1].shape[1]
    n_second = len(coarse[1])

    def quantise():
        def work(column):
            x = np.array(column)
            a, b = ((x[:, s] @ c.T - (c ** 2).sum(1) / 2).argmax(1) for s, c in ((slice(None, half), coarse[0]), (slice(half, None), coarse[1])))
            return {"cell": a * n_second + b}

        return work

    indexed = cut(map_columns(vectors, ["v"], quantise, [T.StructField("cell", T.LongType())]))
    # At most centroids ** 2 counts.
    sizes = np.zeros(len(coarse[0]) * n_second, np.int64)
    for cell, n in indexed.groupBy("cell").count().collect():
        sizes[cell] = n
    total = int(sizes.sum())
    enough = max(k, int(np.ceil(fraction * total))) + 1

    # Cells side by side, each cut where a block is full: a hot cell fills several blocks.
    n_blocks = max(1, -(-total // BLOCK_VECTORS))
    ends = np.cumsum(sizes)
    block_of = (ends - sizes) * n_blocks // max(1, total)
    wide = np.maximum(1, -(-sizes * n_blocks // max(1, total)))
    layout = spark.createDataFrame(pd.DataFrame({"c": np.arange(len(sizes)), "first_block": block_of, "wide": wide}))
    blocked = indexed.join(F.broadcast(layout), F.col("cell") == F.col("c")).select(
        "row", "vec_id", "v", "cell", (F.col("first_block") + F.pmod(F.xxhash64("row"), "wide")).alias("block"))
    packed = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("own", T.BinaryType()),
        T.StructField("rows", T.BinaryType()), T.StructField("cells", T.BinaryType())])

    def pack(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        ids, own, cells = (table.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "row", "cell"))
        x = np.array(table.column("v").to_pylist(), np.float64)
        row = [[block], [ids], [own], [x.tobytes()], [cells]]
        return pa.table(row, names=packed.names)

    blocks = cut(blocked.groupBy("block").applyInArrow(pack, packed))
    asked = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("qids", T.BinaryType()), T.StructField("qown", T.BinaryType()),
        T.StructField("qrows", T.BinaryType()), T.StructField("seen", T.BinaryType()), T.StructField("block", T.LongType())])
    reach = block_of + wide

    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        ids, own = (table.column(c).to_numpy() for c in ("vec_id", "row"))
        x = np.array(table.column("v").to_pylist(), np.float64)
        seen = np.zeros((len(ids), len(sizes)), bool)
        for i, scores in enumerate(zip(x[:, :half] @ coarse[0].T, x[:, half:] @ coarse[1].T)):
            seen[i, visit(scores, sizes, enough)] = True
        needed = sorted({b for c in np.flatnonzero(seen.any(0)) for b in range(block_of[c], reach[c])})
        common = [chunk, ids.astype("<i8").tobytes(), own.astype("<i8").tobytes(), x.tobytes(), np.packbits(seen, axis=1).tobytes()]
        return pa.table([*([v] * len(needed) for v in common), needed], names=asked.names)

    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    n_chunks = max(1, -(-queries.count() // BLOCK_QUERIES))
    chunked = queries.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(n_chunks)))
    pairs = chunked.groupBy("chunk").applyInArrow(ask, asked).join(blocks, "block")
    partial = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("part", T.LongType()), T.StructField("qids", T.BinaryType()),
        T.StructField("ids", T.BinaryType()), T.StructField("scores", T.BinaryType()), T.StructField("n", T.BinaryType())])

    _types = arrow_types(partial.fields)

    def row_of(chunk, part, qids, found):
        n = np.array([len(i) for i, _ in found], "<i8")
        ids = np.concatenate([i for i, _ in found]).astype("<i8") if found else np.zeros(0, "<i8")
        scores = np.concatenate([s for _, s in found]) if found else np.zeros(0)
        return [[chunk], [part], [qids], [ids.tobytes()], [scores.tobytes()], [n.tobytes()]]

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                qids, qown, ids, own, cells = (np.frombuffer(row[c], "<i8") for c in ("qids", "qown", "ids", "own", "cells"))
                q, x = (np.frombuffer(row[c]).reshape(-1, width) for c in ("qrows", "rows"))
                seen = np.unpackbits(np.frombuffer(row["seen"], np.uint8).reshape(len(qids), -1), axis=1)[:, :len(sizes)].astype(bool)
                scores = q @ x.T
                scores[~seen[:, cells] | (qown[:, None] == own[None, :])] = -np.inf
                found = []
                for i, line in enumerate(scores):
                    # The product may round; all within a hair of the k-th are scored again.
                    edge = np.partition(line, -k)[-k] if len(line) > k else -np.inf
                    near = np.flatnonzero((line > -np.inf) & (line >= (edge - 1e-9 * max(1.0, abs(edge)) if edge > -np.inf else -np.inf)))
                    found.append(_best(ids[near], _exact(np.broadcast_to(q[i], (len(near), width)), x[near]), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(row_of(row["chunk"], row["block"], row["qids"], found), _types)], names=partial.names)


    def merge(table: pa.Table) -> pa.Table:
        chunk, part = table.column("chunk")[0].as_py(), table.column("part")[0].as_py()
        lists = None
        for row in table.to_pylist():
            ids, scores, n = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["scores"]), np.frombuffer(row["n"], "<i8")
            cuts = np.cumsum(n)[:-1]
            pairs_ = list(zip(np.split(ids, cuts), np.split(scores, cuts)))
            lists = pairs_ if lists is None else [
                _best(np.concatenate([a, c]), np.concatenate([b, d]), k) for (a, b), (c, d) in zip(lists, pairs_)]
        return pa.table([pa.array(c, t) for c, t in zip(row_of(chunk, part, table.column("qids")[0].as_py(), lists), _types)], names=partial.names)

    found = cut(pairs.repartition("chunk", "block").mapInArrow(search, partial))
    while n_blocks > 1:
        n_blocks = -(-n_blocks // MERGE)
        found = cut(found.withColumn("part", F.floor(F.col("part") / MERGE)).groupBy("chunk", "part").applyInArrow(merge, partial))

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["n"], "<i8")
                rank = np.concatenate([np.arange(1, m + 1) for m in n]).astype(np.int32) if len(n) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.frombuffer(row["qids"], "<i8"), n)), pa.array(rank), pa.array(np.frombuffer(row["ids"], "<i8")),
                     pa.array(np.frombuffer(row["scores"]))], names=["query_id", "rank", "vec_id", "score"])

    return found.mapInArrow(unpack, FOUND)
