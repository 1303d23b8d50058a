"""Repetition inside a text, from a suffix array over its words.

Neighbouring suffixes with a longest common prefix of ``least`` words or more
form the intervals whose words repeat. Their spans are joined; a text is
rejected if they cover too much of it or if one repeat is too long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, types as T

from lakegraph.llm.common import in_parts, map_columns, sums_by

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"

#: Words of several texts are sorted together, up to this many.
SORT_WORDS = 200_000

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("covered_fraction", T.DoubleType()),
    T.StructField("longest_repeat", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))),
]


def suffix_order(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``key``, and per doubling step the rank of each prefix of 1, 2, 4, ... symbols.

    Only suffixes that still tie are sorted again, so ordinary text costs little
    more than one sort.
    """
    n = len(key)
    order = np.argsort(key)
    starts, sizes = _runs(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    levels, step = [rank.copy()], 1
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(slots):
        position = order[slots]
        after = position + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[position] * (n + 1) + second
        by = np.argsort(pair)
        position = position[by]
        order[slots] = position
        starts, sizes = _runs(pair[by])
        rank[position] = np.repeat(slots[starts], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        levels.append(rank.copy())
        step *= 2
    return order, levels


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return starts, np.diff(np.append(starts, len(ordered)))


def repeat_lengths(key: np.ndarray, least: int) -> np.ndarray:
    """For each position, the most symbols that begin here and occur elsewhere too; 0 if under ``least``."""
    n = len(key)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order, levels = suffix_order(key)
    least_level = int(least).bit_length() - 1
    if len(levels) <= least_level:
        return longest
    a, b = order[:-1], order[1:]
    near = levels[least_level][a] == levels[least_level][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = np.maximum(x, y) < n
        same = inside & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)])
        common[same] += 1 << level
    longest[a] = common
    longest[b] = np.maximum(longest[b], common)
    longest[longest < least] = 0
    return longest


def repeats(words: list[list], least: int = 8) -> list[tuple[np.ndarray, int]]:
    """Per text: covered flag of each word, and the length of its longest repeat."""
    number: dict = {}
    flat = [number.setdefault(w, len(number)) for ws in words for w in ws]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    text = np.repeat(np.arange(len(words)), lengths)
    # Every text has an alphabet of its own, so suffixes of two texts never share a prefix.
    found = repeat_lengths(text * (len(number) + 1) + np.array(flat, np.int64), least)
    edges = np.zeros(len(found) + 1, np.int64)
    at = np.flatnonzero(found)
    left_maximal = at[(at == 0) | (found[at - 1] <= found[at])]
    np.add.at(edges, left_maximal, 1)
    np.add.at(edges, left_maximal + found[left_maximal], -1)
    covered = np.cumsum(edges[:-1]) > 0
    ends = np.cumsum(lengths)
    return [(covered[e - n:e], int(found[e - n:e].max(initial=0))) for e, n in zip(ends, lengths)]


def _base(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    seen, duplicate = set(), 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            if line in seen:
                duplicate += 1
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        duplicate,
    )


def repetition(
    docs: DataFrame,
    text: str = "text",
    least: int = 8,
    max_covered: float = 0.3,
    max_longest: int = 400,
    min_words: int = 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds counts, the repetition verdict and the repeated word spans to every row.

    ``least``: words that a repeat has at least. ``max_covered``: most of a text's
    word characters that repeats may cover. ``max_longest``: most words of one
    repeat. ``min_words``: fewest words of a text. ``base_failed`` compares the
    covered words with 30 % of all words; ``kept`` adds the two limits.

    No shuffle: each text is judged alone, and repeated rows get equal results.
    A null or empty text has no words, zero counts and fails. A column of the
    input that is named like a result column is replaced.
    """
    def make():
        def work(texts):
            out = {f.name: [] for f in FIELDS}
            cut = [(t or "").encode().split() for t in texts]
            for begin, end in in_parts(map(len, cut), SORT_WORDS):
                for t, words, (covered, longest) in zip(texts[begin:end], cut[begin:end], repeats(cut[begin:end], least)):
                    n, chars, symbols, lines = _base(t or "", words)
                    repeated = int(covered.sum())
                    fraction, spans = 0.0, []
                    if repeated:
                        size = np.fromiter((len(w.decode()) for w in words), np.int64, n)
                        fraction = float(size[covered].sum() / chars)
                        turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                        spans = [{"first_word": int(a), "end_word": int(b)} for a, b in zip(turns[::2], turns[1::2])]
                    failed = n < min_words or 100 * repeated > 30 * n
                    row = (n, chars, symbols, lines, repeated, failed,
                           not failed and fraction <= max_covered and longest <= max_longest, fraction, longest, spans)
                    for name, value in zip(out, row):
                        out[name].append(value)
            return out

        return work

    return map_columns(docs, [text], make, FIELDS, keep)
