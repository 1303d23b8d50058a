"""Near copies by MinHash with tensored banding, every link confirmed on the full shingle sets.

Two collections of ``bands`` small bands of ``rows`` minhashes each are computed per
set. A table key is one band of the first collection with one of the second, so
``bands ** 2`` tables of ``2 * rows`` hashes come from ``2 * bands * rows`` of them instead of
``2 * rows * bands ** 2``. Sets of similarity s share a key with probability
``(1 - (1 - s ** rows) ** bands) ** 2``: 0.99993 at s = 0.85 with the defaults, more above it.

A key of few sets gives all its pairs. A crowded key first holds each set against
one of them; if that leaves it in several components, its sets are brought
together and compared exactly, so that only links leave the task.

Before full sets move for a pair, small sketches do: the least shingle of each of
``BINS`` bins, which two sets share with probability s per bin. A pair whose shared
bins lie ``SIGMAS`` standard deviations below what the wanted similarity gives goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lakegraph.llm.common import map_columns, words_of
from lakegraph.llm.components import components
from lakegraph.llm.simhash import HASH_SEED
from lakegraph.session import cut

#: A key of more sets than this is crowded. Up to it a set stands in so many pairs of a key at most.
FEW = 32
#: Shingles and sets that are brought together at once; a key with more is cut into pieces that meet pairwise.
PIECE_SHINGLES, PIECE_SETS = 1_000_000, 2_000
#: Shingles whose minhashes are computed at once.
CHUNK = 1 << 15
#: Sets a task remembers so as to send each of them once.
SEEN = 200_000
#: Bins of a sketch, one byte each, and how far below its mean a linked pair's count of shared bins may lie (5: 3 in 10 million lie lower).
BINS, SIGMAS = 128, 5
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 2048


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a text of fewer words is one shingle, one without words has none."""
    words = [w.lower() for w in words_of(text)]
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, HASH_SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    return np.unique(np.array([digest(line[a:b], HASH_SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64))


def packed(shingles: np.ndarray) -> bytes:
    """Six bytes of each shingle: of two sets of a thousand, one pair in 300 million has two different shingles that agree in them."""
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers that spreads their bits."""
    values = values ^ values >> np.uint64(32)
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ values >> np.uint64(29)


class Bands:
    """The two collections of bands of a shingle set."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(13)
        n = 2 * bands * rows
        self.factor = draw.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.term = draw.integers(0, 1 << 63, n, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), np.uint64(2 ** 64 - 1))
        for begin in range(0, len(shingles), CHUNK):
            some = shingles[begin:begin + CHUNK, None] * self.factor + self.term
            least = np.minimum(least, mixed(some).min(axis=0))
        return least

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """One number per band: those of the first collection, then those of the second."""
        least = self.minima(shingles).reshape(2 * self.bands, self.rows)
        out = np.zeros(2 * self.bands, np.uint64)
        for column in least.T:
            out = mixed(out ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        return out


def sketch(shingles: np.ndarray) -> bytes:
    """A byte of the least shingle in each bin, 0 for none. ``shingles`` are sorted, so a bin's first one is its least."""
    bins, first = np.unique(shingles & np.uint64(BINS - 1), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[bins] = (shingles[first] >> np.uint64(20)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def sets(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, node`` (hash of the set, null if it is empty), ``n`` (its size), its ``bands``, its ``sketch`` and the set itself.

    All but node and size are null where the task has sent the same set before. No shuffle.
    """
    def make():
        all_bands, seen = Bands(bands, rows), set()

        def work(texts):
            out = {"node": [], "n": [], "bands": [], "sketch": [], "shingles": []}
            for text in texts:
                s = shingle_set(text, shingle)
                node = xxhash.xxh64_intdigest(s.tobytes(), HASH_SEED) - (1 << 63) if len(s) else None
                fresh = len(s) > 0 and node not in seen
                if fresh:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                out["node"].append(node)
                out["n"].append(len(s))
                out["bands"].append(all_bands.of(s).view(np.int64) if fresh else None)
                out["sketch"].append(sketch(s) if fresh else None)
                out["shingles"].append(packed(s) if fresh else None)
            return out

        return work

    fields = [
        T.StructField("node", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("shingles", T.BinaryType())]
    return map_columns(docs, ["text"], make, fields, ["doc_id"])


def table_keys(distinct: DataFrame, bands: int) -> DataFrame:
    """``key, node, n``: a row per table of every set. A key is a band of each collection."""
    keys = [F.xxhash64(F.lit(i * bands + j), F.col("bands")[i], F.col("bands")[bands + j]) for i in range(bands) for j in range(bands)]
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "node", F.col("n").cast("int").alias("n"))


def _runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[int, list[np.ndarray], bool, bool]]:
    """Runs of two rows or more of equal first column as ``value, other columns, begins, ends``.

    With ``most`` a longer run may come in pieces; the last row of a piece is the first of the next one.
    """
    held: list | None = None
    begins = True
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        key = columns[0]
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        several = np.diff(edges[:-1]) > 1
        several[:1] |= not begins
        for a, b in zip(edges[:-2][several], edges[1:-1][several]):
            yield key[a], [c[a:b] for c in columns[1:]], begins, True
            begins = True
        last = edges[-2]
        if most is not None and len(key) - last > most:
            yield key[last], [c[last:] for c in columns[1:]], begins, False
            begins, last = False, len(key) - 1  # one row stays, so that the end of the run is seen
        held = [c[last:] for c in columns]
    if held is not None and (len(held[0]) > 1 or not begins):
        yield held[0][0], held[1:], begins, True


def first_pairs(keyed: DataFrame, least: tuple[int, int]) -> DataFrame:
    """``a, b, rows``: pairs of sets that a key brings together and whose sizes allow a link.

    All pairs of a key of up to ``FEW`` sets; of a crowded key each set with its first one, and a row of
    null ``a``, the key as ``b`` and its number of ``rows``.
    """
    p, q = least

    def run(batches):
        a, b, rows = [], [], []
        first = first_n = None
        count = 0

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(rows, pa.int64())], names=["a", "b", "rows"])
            a.clear(), b.clear(), rows.clear()
            return made

        for key, (node, n), begins, ends in _runs(batches, FEW):
            n = n.astype(np.int64)
            if begins and ends and len(node) <= FEW:
                x, y = np.triu_indices(len(node), 1)
                fits = np.minimum(n[x], n[y]) * q >= np.maximum(n[x], n[y]) * p
                x, y = node[x[fits]], node[y[fits]]
                a += np.minimum(x, y).tolist()
                b += np.maximum(x, y).tolist()
                rows += [None] * len(x)
            else:
                if begins:
                    first, first_n, count = node[0], n[0], 0
                else:
                    node, n = node[1:], n[1:]  # the row that was held over
                count += len(node)
                fits = (node != first) & (np.minimum(n, first_n) * q >= np.maximum(n, first_n) * p)
                a += np.minimum(node[fits], first).tolist()
                b += np.maximum(node[fits], first).tolist()
                rows += [None] * int(fits.sum())
                if ends:
                    a.append(None)
                    b.append(int(key))
                    rows.append(count)
            if len(a) > 50_000:
                yield out()
        yield out()

    dealt = keyed.select("key", "node", "n").repartition(F.col("key")).sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint, rows bigint").distinct()


def likely(pairs: DataFrame, distinct: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs whose sketches agree as often as those of linked sets do."""
    share = least[0] / least[1]
    sketches = distinct.select("node", "sketch")
    both = pairs.join(sketches.toDF("a", "_a"), "a").join(sketches.toDF("b", "_b"), "b")

    def make():
        def work(left, right):
            x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, BINS) for v in (left, right))
            filled = ((x > 0) | (y > 0)).sum(axis=1)
            equal = ((x == y) & (x > 0)).sum(axis=1)
            return {"likely": equal >= share * filled - SIGMAS * np.sqrt(share * (1 - share) * filled) - 1}

        return work

    return map_columns(both, ["_a", "_b"], make, [T.StructField("likely", T.BooleanType())], ["a", "b"]).where("likely").select("a", "b")


def wanted_sets(prints: DataFrame, distinct: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` of the given nodes, once each.

    The rows to read are written first: their size is then known, so that few of them are sent to the sets instead of
    moving all sets.
    """
    rows = cut(distinct.select("node", "row").join(nodes.distinct(), "node", "left_semi").select("row"))
    return prints.where("shingles IS NOT NULL").select("row", "node", "shingles").join(rows, "row", "left_semi").drop("row")


def confirmed(pairs: DataFrame, prints: DataFrame, distinct: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets have the similarity ``least`` or more."""
    p, q = least
    both = pairs
    for end in ("b", "a"):
        both = both.join(wanted_sets(prints, distinct, pairs.select(F.col(end).alias("node"))).toDF(end, f"_{end}"), end)

    def make():
        def work(left, right):
            ok = []
            for x, y in zip(left, right):
                x, y = unpacked(x), unpacked(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared * q >= p * (len(x) + len(y) - shared))
            return {"linked": ok}

        return work

    return map_columns(both, ["_a", "_b"], make, [T.StructField("linked", T.BooleanType())], ["a", "b"]).where("linked").select("a", "b")


def spanning_links(node: np.ndarray, root: np.ndarray, shingles: list[bytes], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between sets of different ``root`` that join them just as all links among the given sets do.

    Sizes of all intersections come from the product of the incidence matrix with itself.
    """
    p, q = least
    given = [unpacked(s) for s in shingles]
    n = np.array([len(s) for s in given], np.int64)
    values, column, many = np.unique(np.concatenate(given), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(given)), n)
    several = many[column] > 1  # a shingle of one set is in no intersection
    row, column = row[several], np.cumsum(many > 1)[column[several]] - 1
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    shared = np.zeros((len(given), len(given)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        part = np.zeros((len(given), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - begin] = 1
        shared += part @ part.T
    _, root = np.unique(root, return_inverse=True)
    parent = list(range(int(root.max()) + 1))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(given)):
        both = shared[i, i + 1:].astype(np.int64)
        near = np.flatnonzero((both * q >= p * (n[i] + n[i + 1:] - both)) & (root[i + 1:] != root[i])) + i + 1
        for j in near.tolist():
            x, y = top(root[i]), top(root[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(node[i]), int(node[j])))
    return links


def crowded_links(
    keyed: DataFrame, crowded: DataFrame, roots: DataFrame, prints: DataFrame, distinct: DataFrame, least: tuple[int, int],
) -> DataFrame:
    """``a, b``: links among the sets of crowded keys that known ``roots`` leave apart.

    A key of more than a piece is cut by hash into pieces, and each two of them meet in a place of their own.
    """
    rows = keyed.join(crowded, "key").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    rows = cut(rows)
    size = rows.groupBy("key").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high"),
        F.greatest(F.ceil(F.sum("n") / PIECE_SHINGLES), F.ceil(F.count("*") / PIECE_SETS)).cast("int").alias("pieces"))
    rows = rows.join(cut(size.where("_low < _high").select("key", "pieces")), "key")
    mine = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("pieces")).cast("int")
    rows = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select(
        F.xxhash64("key", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("place"), "node", "root").distinct()
    rows = cut(rows)
    found = wanted_sets(prints, distinct, rows.select("node"))

    def run(batches):
        for _, (node, root, shingles), _, _ in _runs(batches):
            links = spanning_links(node, root, shingles.tolist(), least) if len(node) > 1 and (root != root[0]).any() else []
            a, b = zip(*links) if links else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.join(found, "node").select("place", "node", "root", "shingles").repartition(F.col("place")).sortWithinPartitions("place")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, least: tuple[int, int] = (85, 100),
    bands: int = 8, rows: int = 2,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    A-Z become lower case, words are cut at ASCII white space, and a text's set holds its distinct shingles of
    ``shingle`` words; a text of fewer words is one shingle, and a null text or one without words has an empty set and
    no links. Rows link if the similarity (Jaccard) of their sets is the fraction ``least`` or more.
    ``component_id`` is the smallest ``doc_id`` that links reach, null ids left out (null if there is no other);
    ``kept`` says that it is the row's own, nulls being equal. Equal sets are one node, so exact copies cost one row each.
    Repeated rows stay; an empty table gives no rows.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = cut(sets(given, shingle, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    distinct = cut(prints.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bands", ignorenulls=True).alias("bands"),
        F.first("sketch", ignorenulls=True).alias("sketch"), F.min(F.when(F.col("bands").isNotNull(), F.col("row"))).alias("row")))
    keyed = table_keys(distinct, bands)
    first = cut(first_pairs(keyed, least))
    near = cut(likely(first.where("a IS NOT NULL").select("a", "b"), distinct, least))
    # One pair of each set first; pairs that those links already join need no sets.
    some = cut(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = cut(confirmed(some, prints, distinct, least))
    roots = cut(components(links))
    rest = near.join(some, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left")
    rest = cut(rest.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b"))
    links = links.unionByName(cut(confirmed(rest, prints, distinct, least)))
    roots = cut(components(links))
    crowded = cut(first.where("a IS NULL").select(F.col("b").alias("key")))
    if not crowded.isEmpty():
        links = links.unionByName(cut(crowded_links(keyed, crowded, roots, prints, distinct, least)))
        roots = cut(components(links))
    rooted = distinct.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    rooted = cut(rooted)
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(rooted.join(smallest, "root").select("node", "component_id"))
    # A row without words has no node: its component is itself.
    found = prints.select("doc_id", "node", "n").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
