"""Token ids as directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every
id, level 1 the next chunk of the ids that need one, and so on. A bitmap per
level says which ids go on; a rank directory over the bitmap gives an id's place
in the next level, so that any id is read without its neighbours.

One segment is one binary value::

    magic "DAC1", uint32 number of levels, uint64 number of ids
    per level: uint64 number of chunks, the chunks, the bitmap, the directory

A bitmap has one bit per chunk, lowest bit first. The directory has, as uint32,
the number of set bits before each block of 512. The last level has neither.
"""

from __future__ import annotations

import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from lakegraph import session
from lakegraph.llm.common import RaggedCache, arrow_types, gather, in_parts, sums_by

MAGIC = b"DAC1"
BLOCK = 512
#: Characters of text that are encoded together; a segment holds what they give.
SEGMENT_CHARS = 2_000_000

SEGMENT = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("segment", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("n_ids", T.LongType()),
    T.StructField("codes", T.BinaryType()),
])


def pack(ids: np.ndarray) -> bytes:
    rest = np.asarray(ids, np.uint64)
    levels = []
    while True:
        chunks, rest = (rest & np.uint64(255)).astype(np.uint8), rest >> np.uint64(8)
        more = rest > 0
        if not more.any():
            levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes())
            break
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)
        directory = (np.cumsum(counts) - counts).astype("<u4")
        levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[more]
    return MAGIC + struct.pack("<IQ", len(levels), len(ids)) + b"".join(levels)


class Codes:
    """Reads ids out of a packed segment."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n_levels, self.n = struct.unpack_from("<IQ", raw, 4)
        self.levels, at = [], 16
        for level in range(n_levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8
            chunks = np.frombuffer(raw, np.uint8, n, at)
            at += n
            bits = directory = None
            if level < n_levels - 1:
                bits = np.frombuffer(raw, np.uint8, -(-n // 8), at)
                at += len(bits)
                directory = np.frombuffer(raw, "<u4", -(-n // BLOCK), at)
                at += 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    def _rank(self, level: int, place: int) -> int:
        """Set bits of a level before ``place``."""
        _, bits, directory = self.levels[level]
        if place >= len(self.levels[level][0]):
            return len(self.levels[level + 1][0])
        start = place // BLOCK * BLOCK
        inside = np.unpackbits(bits[start // 8:place // 8 + 1], bitorder="little")
        return int(directory[place // BLOCK]) + int(inside[:place - start].sum())

    def get(self, place: int) -> int:
        """One id: a chunk of each level it reaches."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[place]) << shift
            if bits is None or not bits[place // 8] >> (place % 8) & 1:
                break
            place, shift = self._rank(level, place), shift + 8
        return value

    def slice(self, begin: int, end: int, level: int = 0) -> np.ndarray:
        """Ids at ``[begin, end)``; those that go on lie side by side in the next level too."""
        chunks, bits, _ = self.levels[level]
        values = chunks[begin:end].astype(np.uint64)
        if bits is not None and end > begin:
            more = np.unpackbits(bits[begin // 8:-(-end // 8)], bitorder="little")[begin % 8:][:end - begin].astype(bool)
            first = self._rank(level, begin)
            values[more] |= self.slice(first, first + int(more.sum()), level + 1) << np.uint64(8)
        return values


# How the vocabulary normalizes texts and cuts them before its merges.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ("NFC", "Replace", "Lowercase")
#: The same cut for words whose case is still their own.
_PIECES = regex.compile(r"'[sStTmMdD]|'[rR][eE]|'[vV][eE]|'[lL][lL]|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The one letter whose lower case is two characters, of which one is no letter.
_SPLIT_LETTER = "\u0130"
#: Letters and punctuation after them: two pieces at most, found by Arrow.
_PLAIN_WORD, _LETTERS = r"^\p{L}+[[:punct:]]*$", r"^\p{L}+"


def check_rules(definition: str) -> None:
    """Refuses a vocabulary that cuts texts by other rules than this module does."""
    rules = json.loads(definition)
    normalizers = tuple(n["type"] for n in (rules["normalizer"] or {}).get("normalizers", ()))
    cutters = (rules["pre_tokenizer"] or {}).get("pretokenizers", ())
    cut = cutters[0].get("pattern", {}).get("Regex") if cutters else None
    specials = all(t["content"].startswith("<|") and not t["normalized"] for t in rules["added_tokens"])
    if normalizers != _NORMALIZERS or cut != _CUT or not specials:
        raise ValueError("the vocabulary cuts texts by rules that are not known here")


class WordIds:
    """Ids of words by the tokenizers library, which sees each distinct piece of a word once.

    The vocabulary drops white space and never merges across a letter run's ends,
    so words, and pieces of composed words, can be encoded apart. Words are split
    and made distinct by Arrow; only distinct ones meet Python.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.pieces = RaggedCache(self._encode, 1_000_000)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after the other, and how many each text has."""
        cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        coded = cut.flatten().dictionary_encode()
        codes, n_words = coded.indices.to_numpy(), pc.list_value_length(cut).to_numpy()
        ids, lengths = self._distinct(coded.dictionary)
        starts, of_words = np.cumsum(lengths) - lengths, lengths[codes]
        return ids[gather(starts[codes], of_words)], sums_by(of_words, n_words)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has; an empty word has none."""
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN_WORD), pc.or_(
            pc.match_substring(words, _SPLIT_LETTER), pc.match_substring(words, "<|")))
        whole = words.filter(plain)
        whole = pc.if_else(pc.string_is_ascii(whole), pc.ascii_lower(whole), whole)
        tails = pc.replace_substring_regex(whole, _LETTERS, "", max_replacements=1)
        tailed = pc.not_equal(tails, "")
        letters = pc.if_else(tailed, pc.replace_substring_regex(whole, r"[[:punct:]]+$", "", max_replacements=1), whole).dictionary_encode()
        tails = tails.filter(tailed).dictionary_encode()
        others = [_pieces_of(w) for w in words.filter(pc.invert(plain)).to_pylist()]
        self.pieces.renew()
        letter, tail = (self.pieces.codes(x.dictionary.to_pylist())[x.indices.to_numpy()] for x in (letters, tails))
        other = self.pieces.codes([p for pieces in others for p in pieces])
        plain, tailed = (x.to_numpy(zero_copy_only=False) for x in (plain, tailed))
        n = np.empty(len(words), np.int64)
        n[plain], n[~plain] = 1 + tailed, np.fromiter(map(len, others), np.int64, len(others))
        starts = np.cumsum(n) - n
        codes = np.empty(int(n.sum()), np.int64)
        codes[starts[plain]] = letter
        codes[starts[plain][tailed] + 1] = tail
        codes[gather(starts[~plain], n[~plain])] = other
        ids, lengths = self.pieces.expand(codes)
        return ids, sums_by(lengths, n)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for begin in range(0, len(pieces), 500):
            some = pieces[begin:begin + 500]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            of = found.word_ids
            if None in of or not of or of[-1] != len(some) - 1:  # one of them is cut further
                found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
                of = found.word_ids
            ids += found.ids
            lengths.append(np.bincount(np.array(of, np.int64), minlength=len(some)))
        return np.array(ids, np.int32), np.concatenate(lengths)


def _pieces_of(word: str) -> tuple[str, ...] | list[str]:
    """Pieces of a word that is more than letters and punctuation; an empty one has none."""
    if "<|" in word or _SPLIT_LETTER in word:
        return (word,)  # may hold a special token, or change before it is cut
    if word.isascii():
        word = word.lower()
    elif not unicodedata.is_normalized("NFC", word):
        return (word,)
    return _PIECES.findall(word)


_loaded: dict[str, WordIds] = {}


def _word_ids(definition: str) -> WordIds:
    """One encoder per worker process and vocabulary."""
    if definition not in _loaded:
        _loaded.clear()
        _loaded[definition] = WordIds(definition)
    return _loaded[definition]


def write_codes(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all texts, in ascending ``doc_id`` order, as segments to a table at ``path``.

    ``vocabulary`` is a tokenizers file; one that cuts texts by rules unknown here is
    refused. It is read on the driver and sent along, so its size is that of the file. Every text
    is encoded whole, without special tokens, and ends in ``end_id``.

    Rows are dealt by ranges of (doc_id, text), so equal ids have a fixed order and
    a hot id is cut by its texts; null ids come first. Null and empty texts give the
    end id alone. Other columns are not read. Returns the written table.
    """
    with open(vocabulary, encoding="utf-8") as f:
        rules = f.read()
    check_rules(rules)
    definition = docs.sparkSession.sparkContext.broadcast(rules)
    types = arrow_types(SEGMENT.fields)

    def run(batches):
        words = _word_ids(definition.value)
        part, segment = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            for begin, end in in_parts(pc.utf8_length(texts).to_pylist(), SEGMENT_CHARS):
                found, totals = words.flat(texts.slice(begin, end - begin))
                ids = np.full(len(found) + len(totals), end_id, found.dtype)
                own = np.ones(len(ids), bool)
                own[np.cumsum(totals + 1) - 1] = False
                ids[own] = found
                row = [part, segment, keys.slice(begin, end - begin).to_pylist(), totals + 1, len(ids), pack(ids)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=SEGMENT.names)
                segment += 1

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, SEGMENT).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(SEGMENT).parquet(path)


def segment_starts(segments: DataFrame) -> DataFrame:
    """``part, segment, base``: ids in all segments before. Parts are summed first, so no task sees all segments."""
    sizes = segments.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return sizes.join(parts, "part").select("part", "segment", (F.col("part_base") + F.col("inside")).alias("base"))


def read_documents(segments: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, start`` (ids before it), ``n_tokens`` and ``ids`` (uint32, little-endian)."""
    fields = [
        T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()),
        T.StructField("doc_id", T.LongType()), T.StructField("inside", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ]
    types = arrow_types(fields)

    def run(batches):
        for batch in batches:
            for part, segment, doc_ids, lengths, raw in zip(*(batch.column(n).to_pylist() for n in ("part", "segment", "doc_ids", "lengths", "codes"))):
                codes = Codes(raw)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                ids = [codes.slice(a, b).astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [[part] * len(ids), [segment] * len(ids), doc_ids, starts, lengths, ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.name for f in fields])

    found = segments.select("part", "segment", "doc_ids", "lengths", "codes").mapInArrow(run, T.StructType(fields))
    # Written first: its size is then known, so that a small one is sent along and the ids stay where they are.
    return found.join(session.cut(segment_starts(segments)), ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids")


def scratch(docs: DataFrame) -> str:
    return session.scratch_path(docs.sparkSession, "dac")
