"""Near copies by SimHash fingerprints, found with pivot distance tables.

Two fingerprints within ``radius`` bits agree in at least two of ``radius + 2``
bit blocks, so each pair of blocks is a key that brings them together. Among the
fingerprints of a key, distances to fixed pivots are compared first: by the
triangle inequality no coordinate of two linked fingerprints differs by more than
the radius. What is left is verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lakegraph.llm.common import map_columns, words_of
from lakegraph.llm.components import components
from lakegraph.session import cut

#: Seed of the hash of a shingle, which is also that of Spark's ``xxhash64``.
HASH_SEED = 42
#: Rows of a key that are compared at once.
BLOCK = 2048


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Majority of the bits of all shingle hashes, repeats included; 0 without words."""
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], HASH_SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)
    count = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        some = hashes[begin:begin + (1 << 16)]
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * count > len(hashes)))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Adds ``fingerprint`` (64 bits as a signed long) to every row. No shuffle.

    A-Z become lower case; words are cut at ASCII white space. A text of fewer words
    than a shingle is one shingle; a null or empty text has fingerprint 0.
    """
    def make():
        def work(texts):
            prints = [fingerprint([w.lower() for w in words_of(t)], shingle) for t in texts]
            return {"fingerprint": np.array(prints, np.uint64).view(np.int64)}

        return work

    return map_columns(docs, [text], make, [T.StructField("fingerprint", T.LongType())], keep)


def pivot_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot, one row per pivot."""
    return np.bitwise_count(prints[None, :] ^ pivots[:, None])


def star_links(prints: np.ndarray, pivots: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs that connect distinct fingerprints just as all pairs within ``radius`` do, at most one per fingerprint."""
    table = pivot_table(prints, pivots)
    order = np.argsort(table[0], kind="stable")
    prints, table = prints[order], table[:, order].astype(np.int16)
    parent = list(range(len(prints)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for begin in range(0, len(prints), BLOCK):
        end = min(begin + BLOCK, len(prints))
        # The first coordinate is sorted: only rows up to its last value plus the radius can follow.
        last = np.searchsorted(table[0], table[0, end - 1] + radius, side="right")
        for other in range(begin, last, BLOCK):
            stop = min(other + BLOCK, last)
            near = np.ones((end - begin, stop - other), bool)
            for row in table:
                near &= np.abs(row[begin:end, None] - row[None, other:stop]) <= radius
            i, j = np.nonzero(near)
            i, j = i + begin, j + other
            i, j = i[i < j], j[i < j]
            real = np.bitwise_count(prints[i] ^ prints[j]) <= radius
            for a, b in zip(i[real].tolist(), j[real].tolist()):
                a, b = top(a), top(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(int(prints[i]), int(prints[r])) for i in range(len(prints)) if (r := top(i)) != i]


def _blocks(bits, width: int, parts: int) -> list:
    """The low ``width`` bits of ``bits`` cut into ``parts`` runs."""
    bounds = [round(width * i / parts) for i in range(parts + 1)]
    return [F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << high - low) - 1)) for low, high in zip(bounds, bounds[1:])]


def _pair_keys(blocks: list, *front):
    """One hash per pair of blocks, over the pair and ``front``."""
    return F.array(*(F.xxhash64(*front, F.lit(k), x, y) for k, (x, y) in enumerate(combinations(blocks, 2))))


def block_keys(distinct: DataFrame, radius: int, key_rows: int) -> DataFrame:
    """``key, fingerprint``: fingerprints within ``radius`` bits share a key.

    A key fixes two of ``radius + 2`` blocks. One of more than ``key_rows`` rows is
    replaced by finer ones: what differs lies in the other bits, so two of ``radius + 2``
    blocks of those agree as well. At radius 2 a finer key fixes 48 bits, and no more
    than 65,536 fingerprints have one.
    """
    n = radius + 2
    blocks = _blocks(F.col("fingerprint"), 64, n)
    width = [round(64 * (i + 1) / n) - round(64 * i / n) for i in range(n)]
    kinds = []
    for pair in combinations(range(n), 2):
        rest, bits = F.lit(0).cast("bigint"), 0
        for i in sorted(set(range(n)) - set(pair)):
            rest, bits = F.shiftleft(rest, width[i]).bitwiseOR(blocks[i]), bits + width[i]
        kinds.append((rest, bits))
    coarse = distinct.select("fingerprint", F.posexplode(_pair_keys(blocks)).alias("kind", "key"))
    # Rows are aggregated before the shuffle, so a crowded key travels as one count a task.
    crowded = cut(coarse.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > key_rows).select("kind", "key"))
    if crowded.isEmpty():
        return coarse.select("key", "fingerprint")
    finer = F.coalesce(*(
        F.when(F.col("kind") == k, _pair_keys(_blocks(rest, bits, n), F.col("key"))) for k, (rest, bits) in enumerate(kinds)))
    split = coarse.join(crowded, ["kind", "key"], "left_semi").select(F.explode(finer).alias("key"), "fingerprint")
    return coarse.join(crowded, ["kind", "key"], "left_anti").select("key", "fingerprint").unionByName(split)


def links(distinct: DataFrame, radius: int = 2, pivots: int = 16, key_rows: int = 20_000) -> DataFrame:
    """``a, b``: pairs of fingerprints that span the same components as all pairs within ``radius`` bits.

    ``distinct`` has one row per ``fingerprint``. Every fingerprint goes to the keys
    of its block pairs; a key's rows lie side by side after one shuffle, and a key
    gives fewer pairs than it has rows, so groups of near copies stay linear.
    Keys of more than ``key_rows`` rows are split first, with no link lost.
    """
    keyed = block_keys(distinct, radius, key_rows)
    chosen = np.random.default_rng(7).integers(0, 1 << 63, pivots, dtype=np.uint64) << np.uint64(1)

    def run(batches):
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(key, prints):
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for at in np.flatnonzero(np.diff(edges) > 1):
                yield from star_links(np.unique(prints[edges[at]:edges[at + 1]]).view(np.uint64), chosen, radius)

        def batch_of(pairs):
            a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*pairs) if pairs else ([], [])))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            prints = np.concatenate([held, batch.column(1).to_numpy()])
            # The last key of a batch may go on in the next one.
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            held_key, held = key[whole:], prints[whole:]
            yield batch_of(list(found(key[:whole], prints[:whole])) if whole else [])
        yield batch_of(list(found(held_key, held)) if len(held) else [])

    dealt = keyed.repartition(F.col("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``.

    Rows link if their fingerprints differ in ``radius`` bits or fewer;
    ``component_id`` is the smallest ``doc_id`` that links reach, null ids left out
    (null if a component has no other). Equal fingerprints are one node, so exact
    copies cost one row each. Repeated rows stay; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = cut(fingerprints(rows, "text", shingle, ["doc_id"]))
    distinct = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = cut(components(cut(links(distinct, radius))))
    rooted = cut(distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fingerprint", "component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_digits(column: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
