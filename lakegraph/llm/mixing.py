"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all document rates between 0 and ``most`` that give every source its target
number of words, the ones closest to 1 in relative entropy are exponentially
tilted: ``rate = least(most, exp(tilt * size / mean size))``, with one ``tilt`` per
source. Newton steps on the convex dual find the tilts; each step is one sum per
source over counts per (source, size). Rates are then rounded into copies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from lakegraph.llm.common import WORD
from lakegraph.session import cut

#: Weights of the sources in order, again from the start when used up.
WEIGHTS = (3, 1, 2)
#: Documents of one size and source that are ranked in one task.
RANK_ROWS = 20_000
#: Ranges of sizes per doubling, and units of one copy in running sums.
RANGES, UNIT = 8, 1 << 16


def targets(classes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, n_docs, target`` from ``source, size, n``.

    ``share`` of all words is dealt by weight. No source gets more than ``most``
    times its words; what it leaves is dealt again by weight. Sorted by how much
    one unit of weight may take, the sources that are full form a prefix, so
    running sums give the level of the rest. The windows are over sources, of
    which there must be a number that fits one task.
    """
    sources = cut(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    named = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int")))
    cap = F.col("source_size") * most
    filling = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = named.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= cap)
    # The first source that is not filled sets the level of all that follow.
    settled = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(everything)
    return leveled.withColumn("settled", settled).select(
        "source", "source_size", "n_docs",
        F.least(cap, F.coalesce(F.col("settled") * F.col("weight"), cap)).alias("target"))


def balance(classes: DataFrame, wanted: DataFrame, most: float = 2.0, steps: int = 40, precision: float = 1e-7) -> DataFrame:
    """``source, tilt, mean``: tilts whose rates meet the targets.

    Newton steps run for all sources at once; a step that leaves the interval known
    to hold the answer is replaced by its middle. Each step's result is written,
    so the plan stays flat. A source without words keeps tilt 0.
    """
    least_size = classes.where("size > 0").groupBy("source").agg(F.min("size").alias("least_size"))
    state = wanted.join(least_size, wanted.source.eqNullSafe(least_size.source)).select(
        wanted.source, "target", (F.col("source_size") / F.col("n_docs")).alias("mean"),
        # At the upper end every document has the highest rate; at the lower end all are next to 0.
        (math.log(most) * F.col("source_size") / F.col("n_docs") / F.col("least_size")).alias("high"),
        (-60.0 * F.col("source_size") / F.col("n_docs") / F.col("least_size")).alias("low"),
        (F.col("target") >= most * F.col("source_size")).alias("full"))
    state = cut(state.withColumn("tilt", F.when(F.col("full"), F.col("high")).otherwise(F.lit(0.0))).drop("full"))
    for _ in range(steps):
        rows = classes.where("size > 0").join(state, classes.source.eqNullSafe(state.source)).select(
            state.source, "size", "n", "tilt", (F.col("size") / F.col("mean")).alias("x"))
        raw = F.exp(F.least(F.col("tilt") * F.col("x"), F.lit(math.log(most))))
        sums = rows.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * raw).alias("reached"),
            F.sum(F.when(F.col("tilt") * F.col("x") < math.log(most), F.col("n") * F.col("size") * F.col("x") * raw).otherwise(0.0)).alias("slope"))
        joined = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        off = F.col("reached") - F.col("target")
        joined = joined.withColumn("high", F.when(off >= 0, F.col("tilt")).otherwise(F.col("high"))).withColumn(
            "low", F.when(off <= 0, F.col("tilt")).otherwise(F.col("low")))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - off / F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        done = F.abs(off) <= precision * F.col("target")
        state = cut(joined.select(
            "source", "target", "mean", "high", "low",
            F.when(done, F.col("tilt")).when(F.coalesce(inside, F.lit(False)), newton).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"),
            done.alias("done")))
        if state.where("NOT done").isEmpty():
            break
        state = state.drop("done")
    return state.select("source", "tilt", "mean")


def class_copies(classes: DataFrame, tilts: DataFrame, wanted: DataFrame, most: float = 2.0) -> DataFrame:
    """``source, size, n, copies``: how often the documents of one source and size are taken in all.

    From large sizes to small, copies are the steps of the rounded running sum of
    rates, so a source misses its target by less than its largest size, however
    many sizes it has. Sums run within ranges of sizes and over the ranges, in whole
    units of ``1 / UNIT`` copies, so they are exact in any order. What is left goes, large
    sizes first, to the size of each range that can give or take most: a source then
    misses by about its smallest size, if its documents allow. Per source, one
    row per range is folded, some ``RANGES * log2(largest size)``.
    """
    rated = classes.where("size > 0").join(tilts, classes.source.eqNullSafe(tilts.source)).select(
        classes.source, "size", "n", F.floor(F.col("n") * most).alias("limit"),
        F.floor(F.log2(F.col("size").cast("double")) * RANGES).cast("int").alias("range"),
        F.least(F.lit(most), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(most))))).alias("rate"))
    rated = cut(rated.withColumn("units", F.round(F.col("n") * F.col("rate") * UNIT).cast("bigint")))
    larger = Window.partitionBy("source").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rated.groupBy("source", "range").agg(F.sum("units").alias("units")).select(
        F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("units").over(larger), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    summed = rated.withColumn("earlier", F.coalesce(F.sum("units").over(inside), F.lit(0))).join(
        ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn("earlier", F.col("earlier") + F.col("before"))
    rounded = lambda units: F.floor((units + F.lit(UNIT // 2)) / F.lit(UNIT))
    copies = F.least(rounded(F.col("earlier") + F.col("units")) - rounded(F.col("earlier")), F.col("limit"))
    made = cut(summed.select("source", "size", "n", "limit", "range", copies.alias("copies")))

    reached = made.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("reached"))
    left = wanted.join(reached.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "s", (F.col("target") - F.col("reached")).alias("left"))
    room = F.when(F.col("left") > 0, F.col("limit") - F.col("copies")).otherwise(F.col("copies"))
    best = made.join(left, F.col("source").eqNullSafe(F.col("s"))).groupBy("source", "range").agg(
        F.max_by(F.struct("size", room.alias("room")), F.struct(room, "size")).alias("one"), F.first("left").alias("left"))
    folds = best.groupBy("source").agg(F.sort_array(F.collect_list("one"), asc=False).alias("ones"), F.first("left").alias("left"))
    start = F.struct(F.col("left"), F.array().cast("array<struct<size:bigint,change:bigint>>").alias("made"))

    def step(held, row):
        size = row["size"]
        # Rounded towards 0, so that what is left keeps its sign.
        change = F.signum(held.left) * F.least(F.floor(F.abs(held.left) / size), row.room)
        one = F.struct(size.alias("size"), change.cast("bigint").alias("change"))
        return F.struct((held.left - change * size).alias("left"), F.concat(held.made, F.array(one)).alias("made"))

    changes = folds.select("source", F.explode(F.aggregate("ones", start, step).made).alias("c")).select(
        F.col("source").alias("s"), F.col("c.size").alias("z"), F.col("c.change").alias("change")).where("change <> 0")
    final = made.join(changes, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").select(
        "source", "size", "n", (F.col("copies") + F.coalesce(F.col("change"), F.lit(0))).cast("bigint").alias("copies"))
    empty = classes.where("size <= 0").select("source", "size", "n", F.lit(0).cast("bigint").alias("copies"))
    return final.unionByName(empty)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``size``, the words of the text (0 for a null)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, **rules) -> DataFrame:
    """``doc_id, source, size, source_size, target, tilt rate`` and ``copies, taken`` per row of ``docs``.

    ``rules``: ``weights, share, most`` of :func:`targets`. The documents of one
    source and size share its copies as evenly as whole numbers allow; who gets one
    more is decided by the order of a hash of (seed, doc_id), in buckets of about
    ``RANK_ROWS``, so a hot size is never ranked in one task. The same input gives
    the same copies. Repeated rows count one by one (equal ids tie, either may get
    the copy). Documents without words are taken zero times; a null source is a
    source; other columns are not read.
    """
    most = rules.get("most", 2.0)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = cut(sized(rows).select("doc_id", "source", "size"))
    classes = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    wanted = cut(targets(classes, **rules))
    copies = cut(class_copies(classes, balance(classes, wanted, most), wanted, most).join(
        wanted.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named", "n_docs"))
    keyed = rows.join(copies.withColumnsRenamed({"source": "s", "size": "z"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    order = F.xxhash64(F.lit(seed), "doc_id")
    buckets = F.ceil(F.col("n") / RANK_ROWS)
    # Equal shares of the hash range, so that buckets are in the order of the hash.
    bucket = F.floor(F.shiftrightunsigned(order, 33) / F.lit(float(1 << 31)) * buckets)
    keyed = cut(keyed.withColumn("order", F.shiftrightunsigned(order, 33)).withColumn("bucket", bucket))
    counts = keyed.groupBy("source", "size", "bucket").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "size", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    counts = counts.withColumnsRenamed({"source": "s", "size": "z", "bucket": "b"})
    within = Window.partitionBy("source", "size", "bucket").orderBy("order", "doc_id")
    ranked = keyed.withColumn("place", F.row_number().over(within)).join(
        counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    whole = F.floor(F.col("copies") / F.col("n"))
    more = (F.col("before") + F.col("place") <= F.col("copies") - whole * F.col("n")).cast("bigint")
    return ranked.withColumn("copies", whole + more).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
