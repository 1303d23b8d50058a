"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at just these bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of the first input column that one call of a mapping function gets; a longer value comes alone.
CALL_BYTES = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let_workers_import(spark: SparkSession) -> None:
    """Python workers that do not have this package on their path yet find it where the driver does."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def prepare(spark: SparkSession) -> None:
    """What the corpus jobs need of a session: workers that import this package, and small batches, as texts can be long."""
    let_workers_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def lowest(rows: DataFrame, key: str, sample: int, keys: int, *ties: Column | str) -> DataFrame:
    """At most ``sample`` rows: those of smallest hash of ``key``, equal ones by ``ties``.

    Hashes are spread evenly, so of ``keys`` distinct keys about two samples lie below
    a bound known in advance. Only rows below it are ordered: all tasks together
    offer some two samples, where a bare limit lets each task offer a whole one.
    """
    hashed = F.xxhash64(key)
    share = (2 * sample + 100) / max(1, keys)
    if share < 1:
        rows = rows.where(hashed < F.lit(min(2 ** 63 - 1, int(share * 2 ** 64) - 2 ** 63)))
    return rows.orderBy(hashed, *ties).limit(sample)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def carried(df: DataFrame, keep: Iterable[str] | None, fields: list[T.StructField]) -> list[str]:
    """Input columns that go along: all or ``keep``, but none whose name a result column takes."""
    taken = {f.name.lower() for f in fields}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]


def map_columns(
    df: DataFrame,
    inputs: list[str],
    make: Callable[[], Callable[..., dict[str, object]]],
    fields: list[T.StructField],
    keep: Iterable[str] | None = None,
    call_bytes: int = CALL_BYTES,
) -> DataFrame:
    """Adds columns computed in Python, one Arrow batch at a time and without a shuffle.

    ``make()`` runs once per task and returns a function from the lists of the
    ``inputs`` to ``{name: values}``. Carried columns never leave Arrow.
    """
    along = carried(df, keep, fields)
    named = {f"_c{i}": c for i, c in enumerate(along)}
    given = {f"_i{i}": c for i, c in enumerate(inputs)}
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    source = df.selectExpr(*(f"{quoted(c)} AS {n}" for n, c in (named | given).items()))
    schema = T.StructType([T.StructField(n, source.schema[n].dataType) for n in named] + fields)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        types = None
        for batch in (part for whole in batches for part in _cut(whole, list(given)[0], call_bytes)):
            if types is None:
                types = arrow_types(fields)
            out = work(*(batch.column(n).to_pylist() for n in given))
            arrays = [batch.column(n) for n in named] + [
                v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip((out[n] for n in names), types)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*named, *names])
            del out, arrays
            pa.default_memory_pool().release_unused()

    made = source.mapInArrow(run, schema)
    return made.selectExpr(*(f"{n} AS {quoted(c)}" for n, c in named.items()), *(quoted(n) for n in names))


def _cut(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``most`` bytes of a column, so that long texts don't add up in a worker."""
    column = batch.column(name)
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)) or column.nbytes <= most:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for begin, end in in_parts(sizes, most):
        yield batch.slice(begin, end - begin)


def arrow_types(fields: list[T.StructField]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in fields]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``[start, start + length)``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class RaggedCache:
    """Remembers the ids of pieces seen before; new ones are encoded together.

    ``encode(keys)`` returns ``(ids, lengths)`` of the keys. The cache starts
    anew when it holds ``limit`` keys, so its memory has a bound.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 250_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.code: dict = {}
        self.ids = np.zeros(0, np.int32)
        self.lengths = self.starts = np.zeros(0, np.int64)

    def renew(self) -> None:
        """Starts anew if the cache is full; codes given before are void then."""
        if len(self.code) > self.limit:
            self.clear()

    def codes(self, keys: list) -> np.ndarray:
        """A number per key, for :meth:`expand`."""
        code = self.code
        codes = np.fromiter(map(code.get, keys, repeat(-1)), np.int64, len(keys))
        unknown = np.flatnonzero(codes < 0).tolist()
        if unknown:
            missed = [keys[i] for i in unknown]
            fresh = list(dict.fromkeys(missed))
            code.update(zip(fresh, range(len(code), len(code) + len(fresh))))
            codes[unknown] = list(map(code.__getitem__, missed))
            ids, lengths = self.encode(fresh)
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, lengths.astype(np.int64)])
            self.starts = np.cumsum(self.lengths) - self.lengths
        return codes

    def expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``codes`` one after the other, and how many each has."""
        lengths = self.lengths[codes]
        return self.ids[gather(self.starts[codes], lengths)], lengths

    def flat(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``keys`` one after the other, and how many each has."""
        self.renew()
        return self.expand(self.codes(keys))


def in_parts(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``most`` units together; a larger row is a run of its own."""
    begin = held = 0
    i = -1
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if i >= begin:
        yield begin, i + 1


def sums_by(values: np.ndarray, lengths: list[int] | np.ndarray) -> np.ndarray:
    """Sum of each of the consecutive runs of ``values``; an empty run sums to 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(lengths, dtype=np.int64)
    return total[ends] - total[ends - np.asarray(lengths, np.int64)]
