"""Byte-level BPE over length-bucketed, padded numpy matrices.

Every row of a matrix is one piece of text. In each round every row merges its
leftmost pair of least rank; a hash table finds the ranks, finished rows leave
and merged rows close up.
"""

from __future__ import annotations

import base64
import gc
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from lakegraph.llm.common import RaggedCache, in_parts, map_columns, sums_by

#: Pieces of more bytes are merged one by one with a heap, in the same order.
WIDEST = 256
#: Characters of text that are encoded together.
BLOCK_CHARS = 1_000_000
#: Chunks, and pieces of chunks, that a worker remembers.
CACHE = 120_000
_NO_RANK = np.iinfo(np.int32).max

# The characters with Unicode's White_Space property.
_SPACE = "\t-\r \x85\xa0  -     　"
#: White space and the run that follows it. No match of the split pattern goes beyond either end.
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """Open-addressing hash table from two neighbouring ids to the id of their merge."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens) if t}
        pairs = [
            (a, b, merged)
            for token, merged in rank.items()
            for cut in range(1, len(token))
            if (a := rank.get(token[:cut])) is not None and (b := rank.get(token[cut:])) is not None
        ]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        bits = max(4, int(4 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.merged = np.full(1 << bits, _NO_RANK, np.int32)
        keys = (left << 32) | right
        slot = self._slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            free = waiting[self.keys[slot[waiting]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at] = keys[free[first]]
            self.merged[at] = merged[free[first]]
            waiting = waiting[self.keys[slot[waiting]] != keys[waiting]]
            slot[waiting] = (slot[waiting] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, or the largest int32 if it has none. Negative ids have none."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(len(keys), _NO_RANK, np.int32)
        waiting = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(keys[waiting])
        while len(waiting):
            there = self.keys[slot]
            hit = there == keys[waiting]
            out[waiting[hit]] = self.merged[slot[hit]]
            on = ~hit & (there >= 0)
            waiting, slot = waiting[on], (slot[on] + 1) & self.mask
        return out


class Bpe:
    """Encodes pieces by the ranks of a vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(tokens)
        self.split = regex.compile(pattern).findall
        self.chunks, self.pieces = RaggedCache(self._chunks, CACHE), RaggedCache(self._pieces, CACHE)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > WIDEST:
                out[i] = self._one_by_one(piece)
            else:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            for i, ids in zip(rows, self._merge([pieces[i] for i in rows], 1 << width)):
                out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """All rows at once; a row's ids stand at its left, -1 fills the rest."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        column = np.arange(width)
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[column < length[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), _NO_RANK, np.int32)
        rank[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        result: list = [None] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            at = rank.argmin(axis=1)
            merged = rank[np.arange(len(row)), at]
            done = merged == _NO_RANK
            for i in np.flatnonzero(done):
                result[row[i]] = ids[i, :length[row[i]]].copy()
            ids, rank, row, at, merged = (x[~done] for x in (ids, rank, row, at, merged))
            if not len(row):
                break
            n = np.arange(len(row))
            ids[n, at] = merged
            # Compaction: what stands right of the merged pair moves one place left.
            source = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            rank = np.take_along_axis(rank, source, axis=1)
            ids[:, -1], rank[:, -1] = -1, _NO_RANK
            length[row] -= 1
            before = np.maximum(at - 1, 0)
            after = np.minimum(at + 1, width - 1)
            rank[n, at] = self.pairs.find(merged, np.where(at + 1 < width, ids[n, after], -1))
            rank[n, before] = np.where(at > 0, self.pairs.find(ids[n, before], merged), rank[n, before])
        return result

    def _one_by_one(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        array = np.array(ids, np.int32)
        ranks = self.pairs.find(array[:-1], array[1:]).tolist()
        heap = [(r, i) for i, r in enumerate(ranks) if r != _NO_RANK]
        heapq.heapify(heap)
        ranks.append(_NO_RANK)
        token, rank = self.tokens, self.rank

        def renew(i: int) -> None:
            j = after[i]
            ranks[i] = rank.get(token[ids[i]] + token[ids[j]], _NO_RANK) if j < n else _NO_RANK
            if ranks[i] != _NO_RANK:
                heapq.heappush(heap, (ranks[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or ranks[i] != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            ranks[j] = _NO_RANK
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.split(c) for c in chunks]
        ids, lengths = self.pieces.flat([p for pieces in cut for p in pieces])
        return ids, sums_by(lengths, list(map(len, cut)))

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = self.encode_pieces([p.encode() for p in pieces])
        return np.concatenate(encoded), np.fromiter(map(len, encoded), np.int64, len(encoded))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Chunks that were met before come from the cache."""
        out = []
        for begin, end in in_parts(map(len, texts), BLOCK_CHARS):
            cut = [_CHUNK.findall(t) for t in texts[begin:end]]
            ids, lengths = self.chunks.flat([c for chunks in cut for c in chunks])
            totals = sums_by(lengths, [len(c) for c in cut])
            out += np.split(ids, np.cumsum(totals)[:-1])
        return out


_loaded: dict[int, Bpe] = {}


def _load(key, tokens, pattern: str) -> Bpe:
    """One encoder per worker process and vocabulary."""
    gc.collect()
    gc.disable()  # the caches hold many objects and no cycles
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(tokens.value, pattern)
    return _loaded[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` to every row: little-endian unsigned 32-bit token ids, as binary.

    ``vocabulary`` is a file of base64 tokens and ranks, read on the driver and sent
    to the executors (its size is that of the file). Each match of ``pattern`` is
    encoded alone; bytes outside all matches are left out, as the pattern says.
    No shuffle; null and empty texts give no ids; a column named ``ids`` is replaced.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    key = (vocabulary, pattern)

    def make():
        bpe = _load(key, tokens, pattern)
        return lambda texts: {"ids": [x.astype("<u4").tobytes() for x in bpe.encode([t or "" for t in texts])]}

    return map_columns(docs, [text], make, [T.StructField("ids", T.BinaryType())], keep)


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes of each row's ids. Null ids give null; ids outside the vocabulary fail the job."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def make():
        token = tokens.value

        def text_of(raw):
            return None if raw is None else b"".join(map(token.__getitem__, np.frombuffer(raw, "<u4").tolist()))

        return lambda column: {"decoded": pa.array(map(text_of, column), pa.binary())}

    return map_columns(docs, [ids], make, [T.StructField("decoded", T.BinaryType())], keep)


def digests(encoded: DataFrame) -> list:
    """Columns that tell two encodings apart."""
    return [
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]
