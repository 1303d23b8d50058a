"""Corpus operators against plain versions, round trips and held-out labels, on small and awkward rows."""

import base64
import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from lakegraph.llm import boilerplate, bpe, dac, mixing, multi_index, prefix_tree, quality, ring, simhash, toxicity
from lakegraph.llm.common import let_workers_import, lowest
from lakegraph.llm.components import components
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LONG = " ".join(f"word{i} of a very long text" for i in range(5000))
ODD = [
    None, "", " \n\t ", "one", "a a a a a a a a a a", "x" * 3000, LONG, "café naïve 中文 \U0001f600", "a  b   c \n\n d\t e  ",
    "!\x1c! \xa0\xa0  b 　　 c", "same text here again", "same text here again", "tab\there\x0bthere", "</s>[INST] x [/INST] <|im_end|> <\\|im_end|>",
]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string, ids string, size string, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    let_workers_import(spark)
    rows = [(i, t, "en", [None, "a", "b", "B"][i % 4], 1, "k", "s", "i", "z", "h") for i, t in enumerate(ODD)]
    rows += [(None, "null id", None, None, None, None, None, None, None, None), (3, "one", "en", "B", 1, "k", "s", "i", "z", "h")]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 ---------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, path string, start string"


def conversations():
    rows = []
    for c in range(60):
        for t in range(1 + c % 5):
            # A hot first turn, shared second turns, and turns of their own.
            text = ["hello", f"answer {c % 3}", f"own {c}", None, "</s>[INST] ok [/INST] \\ <\\s>"][t]
            rows.append((c, t, ["user", "assistant"][t % 2], text, "p", "s"))
    rows += [(100, None, None, None, "p", "s"), (101, 1, "a\nb\\", LONG, "p", "s"), (102, 1, "assistant", "x", "p", "s"), (102, 1, "assistant", "x", "p", "s"),
             (103, 0, "user", "hello", "p", "s"), (None, 0, "user", "<|im_start|>", "p", "s")]
    return rows


def test_prefix_tree_reads_back(spark):
    let_workers_import(spark)
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    stream, ends = prefix_tree.prefix_tree(df, RANKS, PATTERN)
    back = {r.conv_id: r for r in prefix_tree.read_back(stream, ends, RANKS, PATTERN).collect()}
    want = collections.defaultdict(list)
    for c, t, r, x, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in back[c].turns] == turns
        assert back[c].loss == [x for r, x in turns if r == "assistant"]
    nodes = sorted(stream.collect(), key=lambda r: r.start)
    paths = {tuple(turns[:i]) for turns in want.values() for i in range(1, len(turns) + 1)}
    assert len(nodes) == len(paths)
    assert [n.start for n in nodes] == [0] + [n.stop for n in nodes[:-1]]
    at = {n.path: n for n in nodes}
    for n in nodes:
        above = [at[n.path[:k]] for k in range(prefix_tree.KEY_BYTES, len(n.path), prefix_tree.KEY_BYTES)]
        assert [(i.start, i.stop) for i in n.ancestors] == [(a.start, a.stop) for a in above]
        first = sum(len(a.tokens) for a in above)
        assert list(n.position_ids) == list(range(first, first + len(n.tokens)))
    empty = prefix_tree.prefix_tree(spark.createDataFrame([], TURNS), RANKS, PATTERN)
    assert prefix_tree.read_back(*empty, RANKS, PATTERN).count() == 0


def test_escaping_is_reversible():
    for text in ("", "<s>", "<\\s>", "<\\\\|im_end|>", "<<|im_end|>", "[INST][/INST]", "a<"):
        assert prefix_tree.unescape(prefix_tree.escape(text)) == text
        head, body, end = prefix_tree.format_turn("x\n\\", text)
        assert prefix_tree.parse(head + body + end) == [("x\n\\", text)]


# -- 2 ---------------------------------------------------------------------

def plain_repeats(words, least):
    covered, longest = set(), 0
    for i in range(len(words)):
        for j in range(i):
            n = 0
            while i + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            if n >= least:
                longest = max(longest, n)
                covered.update(range(i, i + n))
                covered.update(range(j, j + n))
    return covered, longest


@pytest.mark.parametrize("least", [2, 3, 8])
def test_repeats_match_all_pairs(least):
    rng = np.random.default_rng(least)
    texts = [[], ["a"], ["a"] * 40] + [[str(w) for w in rng.integers(0, 3, rng.integers(1, 90))] for _ in range(30)]
    texts.append([f"w{i % 17}" for i in range(150)])
    for words, (covered, longest) in zip(texts, quality.repeats(texts, least)):
        assert (set(np.flatnonzero(covered)), longest) == plain_repeats(words, least)


def test_quality_counts(docs, none):
    got = quality.repetition(docs.limit(len(ODD))).collect()
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(ODD):
        r, words = by[i], (t or "").encode().split()
        assert (r.n_words, r.word_chars) == (len(words), sum(len(w.decode()) for w in words))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
    assert by[6].kept and not by[1].kept and by[5].source == "a"
    assert quality.repetition(none).count() == 0


def test_longest_repeat_and_cover_are_limits(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rest = " ".join(f"r{i}" for i in range(600))
    df = spark.createDataFrame([(1, f"{passage} {rest} {passage}")], "doc_id int, text string")
    assert quality.repetition(df).first().kept
    assert not quality.repetition(df, max_longest=50).first().kept
    assert not quality.repetition(df, max_covered=0.1).first().kept
    assert [tuple(s) for s in quality.repetition(df).first().spans] == [(0, 60), (660, 720)]


# -- 3 ---------------------------------------------------------------------

@pytest.mark.parametrize("keys", [0, 3000, 6000])
def test_lowest_is_the_whole_order_by(spark, keys):
    rows = spark.range(3000).selectExpr("IF(id = 7, NULL, id) AS id", "id % 3 AS tie")
    whole = rows.orderBy(F.xxhash64("id"), "tie").limit(40).collect()
    assert lowest(rows, "id", 40, keys, "tie").collect() == whole
    assert lowest(rows.limit(0), "id", 40, 0, "tie").count() == 0


def test_multi_index_recall_and_order(spark):
    let_workers_import(spark)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    x[500:1400] = x[500]  # a hot vector
    rows = [(i, [float(v) for v in row], "e") for i, row in enumerate(x)]
    rows += [(20000, None, "e"), (20020, [0.0] * 16, "e"), (20040, [float("nan")] * 16, "e"), (20060, [None] * 16, "e")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cell string")
    for fraction, low in ((0.65, 0.9), (1.0, 1.0)):
        found = collections.defaultdict(list)
        for r in multi_index.nearest(df, fraction=fraction).collect():
            found[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert set(found) == set(range(0, 3000, 20))
        hits = 0
        for q, got in found.items():
            total = np.zeros(len(x))
            for d in range(16):
                total += x[q, d] * x[:, d]
            total[q] = -np.inf
            best = np.lexsort((np.arange(len(x)), -total))[:20]
            got.sort()
            assert [g[0] for g in got] == list(range(1, 21)) and q not in [g[1] for g in got]
            assert all(g[2] == total[g[1]] for g in got)
            assert got == [(i + 1, v, s) for i, (s, v) in enumerate(sorted(((g[2], g[1]) for g in got), key=lambda p: (-p[0], p[1])))]
            hits += len({g[1] for g in got} & set(best.tolist()))
            if fraction == 1.0:
                assert [g[1] for g in got] == best.tolist()
        assert hits / (20 * len(found)) >= low
    assert multi_index.nearest(spark.createDataFrame([], df.schema)).count() == 0
    few = multi_index.nearest(df.where("vec_id < 3 OR vec_id = 20000")).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_multi_index_takes_every_row_of_an_id_and_every_length(spark):
    """Rows of one id are candidates, and queries, of their own; a third of all rows has one id."""
    let_workers_import(spark)
    rng = np.random.default_rng(5)
    vectors = [(int(i), [float(v) for v in rng.normal(size=n)]) for i, n in [*[(i, 6) for i in range(60)], *[(20, 6)] * 40, *[(i, 3) for i in range(15, 45)]]]
    vectors += [(7, vectors[0][1]), (0, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = collections.Counter(tuple(r) for r in multi_index.nearest(df, fraction=1.0, centroids=4).collect())
    want = collections.Counter()
    for i, (q, a) in enumerate(vectors):
        if q % 20 == 0:
            scored = []
            for j, (v, b) in enumerate(vectors):
                if j != i and len(a) == len(b):
                    total = 0.0
                    for p, r in zip(a, b):
                        total += p * r
                    scored.append((-total, v))
            want.update((q, rank, v, -s) for rank, (s, v) in enumerate(sorted(scored)[:20], 1))
    assert got == want


# -- 4 ---------------------------------------------------------------------

def test_codes_give_any_id():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(700), rng.integers(0, 1 << 20, 3000), rng.integers(0, 300, 2000), np.array([2 ** 40, 0, 255, 256])):
        codes = dac.Codes(dac.pack(ids))
        assert [codes.get(i) for i in range(len(ids))] == ids.tolist()
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (0, 0)):
            assert codes.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        dac.Codes(dac.pack(np.zeros(3))).get(3)


def test_word_ids_match_the_library_on_odd_strings():
    """Case, letters of two cases, unnormalized marks, punctuation, digits, special tokens and white space of all kinds."""
    name = public_tokenizers.path("word_bpe_49k.json")
    parts = list("abzABZ09 .,!?'`^$+<=>~|\n\t\x0b_-*\"") + [
        "'S", "'Re", "'ll", "\u0130", "\u0131", "\u00df", "e\u0301", "A\u030a", "\u212b", "\u1112\u1161\u11ab", "\u4e2d", "\u00bd", "\u0663",
        "\u03a3", "\u03c2", "\u00a0", "\u3000", "\u200b", "\x1f", "\x85", "\u2028", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "Hello",
        "\U0001f600", "\u0301", "\u2260", "\u0338", "\u01c5", "\ufb01", "\ufeff", "\x00", "\u02bc", "\u212a"]
    rng = np.random.default_rng(5)
    odd = ["".join(rng.choice(parts, rng.integers(0, 15))) for _ in range(6000)] + ["", " ", "word " * 3000]
    definition = open(name, encoding="utf-8").read()
    ids, lengths = dac.WordIds(definition).flat(pa.array(odd))
    want = Tokenizer.from_file(name).encode_batch(odd, add_special_tokens=False)
    for text, own, other in zip(odd, np.split(ids, np.cumsum(lengths)[:-1]), want):
        assert own.tolist() == other.ids, text
    with pytest.raises(ValueError):
        dac.check_rules(definition.replace("Lowercase", "StripAccents"))


def test_written_codes_match_the_library(docs, none):
    name = public_tokenizers.path("word_bpe_49k.json")
    got = dac.read_documents(dac.write_codes(docs, name, dac.scratch(docs))).orderBy("start").collect()
    library = Tokenizer.from_file(name)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (start, len(want), want)
        start += len(want)
    assert dac.read_documents(dac.write_codes(none, name, dac.scratch(none))).count() == 0


# -- 5 ---------------------------------------------------------------------

def plain_fill(counts, owner, room):
    """One row at a time, round by round."""
    room, at = list(room), {(a, r): a for a, n in enumerate(counts) for r in range(n)}
    got, waiting = {}, sorted(at)
    while waiting:
        left = []
        for row in waiting:
            shard = owner[at[row]]
            if room[shard]:
                room[shard] -= 1
                got[row] = shard
            else:
                left.append(row)
        for row in left:
            while not room[owner[at[row]]]:
                at[row] = (at[row] + 1) % len(owner)
        waiting = left
    return got


def test_ring_fill_matches_rows_one_by_one():
    rng = np.random.default_rng(2)
    for shards in (1, 3, 5):
        _, owner = ring.ring_points(shards, 4)
        counts = rng.integers(0, 30, len(owner))
        counts[0] += 200
        room = ring.shares(int(counts.sum()), shards)
        got = {}
        for arc, a, b, shard in ring.fill(counts, owner, room):
            got.update({(arc, r): shard for r in range(a, b)})
        assert got == plain_fill(counts.tolist(), owner.tolist(), room)


def test_shards_are_even_and_move_little(docs, none, spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    for df in (docs, many):
        got = ring.shard_documents(df, 24, rank_rows=1).collect()
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[s]) for s in range(24)]
        assert sum(sizes) == df.count() and max(sizes) - min(sizes) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    first = {r.doc_id: r.shard for r in ring.shard_documents(many, 24).collect()}
    again = {r.doc_id: r.shard for r in ring.shard_documents(many.repartition(7), 24).collect()}
    grown = {r.doc_id: r.shard for r in ring.shard_documents(many, 25).collect()}
    assert first == again
    assert sum(first[d] != grown[d] for d in first) < 0.2 * len(first)
    assert ring.shard_documents(none, 24).count() == 0
    sizes = {r.doc_id: (r["size"], r.text_crc32) for r in ring.shard_documents(docs, 24).collect()}
    assert all(sizes[i] == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(ODD))


# -- 6 ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library_and_decodes(docs, none, library):
    got = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS).collect()
    assert len(got) == docs.count()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "").encode()
    assert bpe.encode(none, RANKS, PATTERN).count() == 0


def test_bpe_on_random_pieces(library):
    own = bpe.Bpe(bpe.read_ranks(RANKS), PATTERN)
    rng = np.random.default_rng(4)
    letters = list("abehnorst é中\U0001f600.,'\n\t ")
    for n in [*range(1, 60), 255, 256, 257, 900]:
        text = "".join(rng.choice(letters, n))
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)
        solid = text.replace(" ", "").replace("\n", "").replace("\t", "").encode() or b"x"
        assert own.encode_pieces([solid])[0].tolist() == library._encode_single_piece(solid)


# -- 7 ---------------------------------------------------------------------

def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix_meets_targets(spark, docs, none):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(n)), [None, "é", "Z", "a", "b"][i % 5] if i % 3 else "hot") for i, n in enumerate(rng.lognormal(4, 1, 900))]
    rows += [(1000 + i, "", "nothing") for i in range(5)] + [(2000, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes, taken = collections.Counter(), collections.Counter()
    got = mixing.mix(df).collect()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.01 * t + 1
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(none).count() == 0


def test_mix_rates_are_tilted(spark):
    """Under its target every size is taken, and the larger the size the rarer when words are to go."""
    classes = spark.createDataFrame([("s", 10, 100), ("s", 100, 100), ("s", 1000, 100)], "source string, size bigint, n bigint")
    wanted = spark.createDataFrame([("s", 111000, 300, 30000.0)], "source string, source_size bigint, n_docs bigint, target double")
    tilt, mean = mixing.balance(classes, wanted).select("tilt", "mean").first()
    rates = {n: np.exp(tilt * n / mean) for n in (10, 100, 1000)}
    assert sum(100 * n * r for n, r in rates.items()) == pytest.approx(30000, rel=1e-5)
    copies = {r["size"]: r.copies for r in mixing.class_copies(classes, mixing.balance(classes, wanted), wanted).collect()}
    assert all(abs(copies[n] - 100 * rates[n]) <= 6 for n in rates)


def test_copies_of_many_sizes_meet_the_target(spark):
    """Every size once, and few very large ones: what rounding leaves is at most the smallest size, and no size is over its limit."""
    rows = [("a", s, 1) for s in range(3, 4000)] + [("b", s, n) for s, n in ((7, 3), (90, 2), (5000, 1), (70000, 2))] + [(None, 11, 40), ("z", 0, 5)]
    classes = spark.createDataFrame(rows, "source string, size bigint, n bigint")
    wanted = mixing.targets(classes, share=1.1).cache()
    got = mixing.class_copies(classes, mixing.balance(classes, wanted), wanted).collect()
    assert sorted((str(r.source), r["size"], r.n) for r in got) == sorted((str(s), z, n) for s, z, n in rows)
    assert all(0 <= r.copies <= 2 * r.n for r in got)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r["size"] * r.copies
    for r in wanted.collect():
        least = min((z for s, z, _ in rows if s == r.source and z), default=0)
        assert abs(taken[r.source] - r.target) <= least + 1e-6 * r.target, r


def test_mix_plan_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


# -- 8 ---------------------------------------------------------------------

def edits(a, b):
    """Letters changed, added or left out, or neighbours swapped."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            best = min(rows[i][-1] + 1, rows[i - 1][j] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i].append(best)
    return rows[-1][-1]


def test_automaton_is_edit_distance():
    terms = ["idiot", "clown", "worthless", "scum"]
    lexicon = toxicity.Lexicon(terms, ["lowei"], set(terms), {"clowns"})
    rng = np.random.default_rng(3)
    words = set(terms) | {"id1ot", "idiots", "diot", "iidiot", "clwon", "clowns", "scun", "worthles", "loweichen", "lowei", "lowe", "", "x", "sucm", "scmu", "worthelss", "wrothless"}
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.integers(1, 3)):
                k = rng.integers(0, len(w) + 1)
                w[k:k + rng.integers(0, 2)] = rng.choice(list("abcdeilnostw"), rng.integers(0, 2)).tolist()
            words.add("".join(w))
    for w in words:
        if w in terms:
            want = "exact"
        elif w.startswith("lowei"):
            want = "stem"
        else:
            want = "fuzzy" if w not in {"clowns"} and any(len(t) >= 4 and edits(w, t) <= 1 for t in terms) else ""
        assert lexicon.match(w) == want, w


def test_quotes_are_told_apart():
    quoted = lambda text, at: toxicity.is_quoted(toxicity.quotations(text.encode().split()), at)
    assert quoted('they said "you idiot" to him', 3) and quoted("er rief „du idiot“, dann", 3) and quoted("il dit «idiot».", 2)
    assert not quoted("you idiot go away", 1)
    assert not quoted('"hello there" you idiot "bye now"', 3)  # between two quotations
    assert not quoted("'tis you idiot an' he knows 'em", 2)  # apostrophes
    assert not quoted('a 5" screen you idiot "so', 4) and quoted('a 5" screen "you idiot" so', 4)
    assert not quoted('"you idiot ' + "and so on " * 5 + 'it goes"', 1)  # ends beyond the window
    lexicon = toxicity.Lexicon(["idiot"], [], {"idiot"})
    assert toxicity.features('he wrote "idiot" there', lexicon)[3] > 0 and toxicity.features("idiot", lexicon)[0] > 0
    assert toxicity.features('"so" idiot "well"', lexicon)[0] > 0


def test_misspelt_words_are_one_edit_away():
    rng = random.Random(1)
    for word in ("idiot", "scum", "worthless,", '"moron!"'):
        for _ in range(200):
            new = toxicity.misspelt(word.encode(), rng).decode()
            assert edits(new, word) <= 1 and toxicity.bare(new.encode())[:1] == toxicity.bare(word.encode())[:1]


def test_method_decides_scores(spark):
    """Misspelt and swapped terms stay toxic, quoted ones weigh less than the same used, also between two quotations."""
    let_workers_import(spark)
    sf = "/root/testdata/sf0.1"
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    weights = dict(zip(toxicity.FEATURES, model.weights))
    assert weights["fuzzy"] > 0 > weights["quoted"]
    plain = "that was the plan we all had for the day and you {} it is all we know of them by now"
    cases = {
        "clean": plain.format("friend"), "exact": plain.format("idiot"), "changed": plain.format("idiof"), "swapped": plain.format("idoit"),
        "short": plain.format("scvm"), "quoted": plain.format('"idiot"'), "between": '"so be it" ' + plain.format("idiot") + ' "well then"'}
    got = toxicity.score(spark.createDataFrame(list(cases.items()), "name string, text string"), model, keep=["name"])
    score = {r["name"]: r["score"] for r in got.collect()}
    assert all(score[n] >= 0.3 for n in ("exact", "changed", "swapped", "short", "between"))
    assert score["clean"] < 0.1 and score["quoted"] < 0.1


def test_training_rows_do_not_depend_on_order(spark):
    rows = [(i % 7, f"text {i}") for i in range(60)] + [(3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int")
    once, again = (sorted(map(str, toxicity.training_rows(d, labels, "doc_id", "text", 9, 9).collect())) for d in (docs, docs.repartition(5, "text")))
    assert once == again and once


def test_toxicity_on_held_out_labels(spark, docs, none):
    let_workers_import(spark)
    sf = "/root/testdata/sf0.1"
    own, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(own, labels)
    scored = toxicity.score(own, model, keep=["doc_id"])
    held = scored.join(labels, "doc_id").where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2").collect()
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    found = sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held)
    assert right > 0.97 and found > 0.85
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.learn(docs, labels.limit(0))
    assert all(r.predicted == 0 and r.score == 0.5 for r in toxicity.score(docs, blank).collect())


# -- 9 ---------------------------------------------------------------------

def test_blocks_of_broken_pages():
    texts = lambda page: [b.text for b in boilerplate.blocks_of(page)]
    assert texts("") == [] and texts("plain  text") == ["plain text"]
    assert texts("<p>a<p>b &amp; <b>c</b><br>d<script>var x='<p>no</p>';</script>") == ["a", "b & c", "d"]
    assert texts("<title>t</title><!-- <p>c --><p>x<style>p{}") == ["x"]
    assert texts("1 < 2 <p title='a>b'>ok") == ["1 < 2", "ok"]
    blocks = boilerplate.blocks_of('<nav class="Menu top"><ul><li><a href=x>go</a></ul></nav><article><p>it</article>')
    assert blocks[0].path == ("nav", "menu", "top", "ul", "li") and blocks[0].linked == 2 and blocks[1].path == ("article", "p")


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    net = boilerplate.Labeller()
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    x, mask, y = boilerplate.padded([(rng.normal(size=(n, boilerplate.INPUTS)), rng.integers(0, 2, n)) for n in (4, 2)])
    x, mask, y = (a.astype(np.float64) for a in (x, mask, y))

    def loss():
        p = net.forward(x, mask)[0]
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    found = net.gradients(x, mask, y)
    for name, w in net.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape)
            kept = w[at]
            w[at] = kept + 1e-3
            up = loss()
            w[at] = kept - 1e-3
            down = loss()
            w[at] = kept
            assert found[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4)


def test_main_text_on_pages_and_new_settings(spark, none):
    let_workers_import(spark)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labeller = boilerplate.learn(pages)
    got = boilerplate.main_text(pages, labeller).collect()
    same = sum(r.text == " ".join(b.text for b in boilerplate.blocks_of(r.html) if "article" in b.path) for r in got)
    assert same >= 0.98 * len(got)
    prose = " ".join(next(r.text for r in got if len(r.text) > 3000).split()[20:60])
    page = (f"<html><body><div class=navbar><a href=a>Home</a> <a href=b>News</a></div><div class='cookie-notice'>We use cookies <button>ok</button></div>"
            f"<main><div id=content><h1>{prose[:40]}</h1><p>{prose}</p><p>{prose}.</p><p>{prose}!</p></div></main>"
            f"<aside class=sidebar><ul><li><a href=x>Read more</a></li></ul></aside><form><label>Search</label><input></form><footer>&copy; me</footer>")
    odd = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>"), (5, "<nav><a href=x>y</a></nav>" * 3000)], "page_id int, html string")
    texts = {r.page_id: r.text for r in boilerplate.main_text(odd, labeller).collect()}
    assert f"{prose} {prose}. {prose}!" in texts[1] and "cookies" not in texts[1] and "Home" not in texts[1] and "Read more" not in texts[1]
    assert texts[2] == texts[3] == texts[4] == ""
    assert boilerplate.main_text(odd.limit(0), labeller).count() == 0


# -- 10 --------------------------------------------------------------------

def plain_print(text, n=3):
    words = [w.lower() for w in (text or "").encode().split()]
    shingles = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, prints, radius):
    best = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius and best[j] < best[i]:
                    best[i], changed = best[j], True
    least = {}
    for i, root in enumerate(best):
        if ids[i] is not None:
            least[root] = min(least.get(root, ids[i]), ids[i])
    return [least.get(r) for r in best]


def test_near_copies_match_all_pairs(docs, none):
    rows = docs.select("doc_id", "text").collect()
    want = plain_components([r.doc_id for r in rows], [plain_print(r.text) for r in rows], 2)
    got = simhash.near_copies(docs).collect()
    expected = collections.Counter((r.doc_id, plain_print(r.text), c) for r, c in zip(rows, want))
    assert collections.Counter((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in got) == expected
    assert simhash.near_copies(none).count() == 0


@pytest.mark.parametrize("key_rows", [20_000, 3])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_span_chains_and_clusters(spark, radius, key_rows):
    let_workers_import(spark)
    rng = np.random.default_rng(radius)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 40)} | {0, (1 << 64) - 1}
    for base in list(prints)[:6]:
        x = base
        for _ in range(25):  # a chain, each link within the radius
            for b in rng.choice(64, radius, replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint bigint")
    found = {r.node & (1 << 64) - 1: r.root for r in components(simhash.links(df, radius, key_rows=key_rows)).collect()}
    want = plain_components(list(range(len(prints))), prints, radius)
    groups = collections.defaultdict(set)
    for p, c in zip(prints, want):
        groups[c].add(p)
    for members in groups.values():
        roots = {found.get(p, p) for p in members}
        assert len(roots) == 1 or len(members) == 1
    assert sum(len(m) > 1 for m in groups.values()) == len(set(found.values()))


def test_crowded_keys_are_split(spark):
    # All prints agree in the upper 32 bits, so one key would hold them all.
    prints = sorted({int(x) for x in np.random.default_rng(5).integers(0, 1 << 32, 4000)})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")
    keyed = simhash.block_keys(df, 2, 500)
    largest = keyed.groupBy("key").count().agg(F.max("count")).first()[0]
    assert largest < 500 and len(prints) > 500
    whole = simhash.block_keys(df, 2, 10_000)
    assert whole.groupBy("key").count().agg(F.max("count")).first()[0] == len(prints)


def test_components_of_a_long_chain_and_a_hub(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, j) for j in range(1001, 1400)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{j: 1000 for j in range(1000, 1400)}}


# -- registered queries and the pipeline ------------------------------------

@pytest.mark.parametrize("name", sorted(n for n in queries() if n.startswith("op") and n[2:3].isdigit()))
def test_query_runs_whole(spark, name):
    df = queries()[name](spark, SF)
    got = df.collect()
    sql = oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for view in ("conversations", "documents", "embeddings"):
            con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
        cur = con.execute(sql)
        assert rows_of(df.columns, got) == rows_of([d[0] for d in cur.description], cur.fetchall())
    table = {"op1": "conversations", "op3": "embeddings", "op9": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    source = spark.read.parquet(f"{SF}/{table}.parquet")
    if name.startswith("op1_"):
        assert len(got) == source.select("conv_id").distinct().count() + 1
    elif name.startswith("op3_"):
        assert len(got) == 20 * source.where("vec_id % 20 = 0").count()
    elif name.startswith("op11_"):
        assert len(got) == 4 * source.count()
    else:
        assert len(got) == source.count()



def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("own")).withColumn("copies", F.lit(7))
    text = {r.doc_id: r.text for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, SF)
        if name == "tokens":
            break
        assert at.columns == docs.columns and at.dtypes == docs.dtypes
        at = at.cache()
        ids = [r.doc_id for r in at.collect()]
        given = [r.doc_id for r in before.collect()]
        assert set(ids) <= set(given)
        if name == "quality":
            assert set(ids) == {r.doc_id for r in quality.repetition(docs, keep=["doc_id"]).where("kept").collect()}
        if name == "near_copies":
            want = plain_components(given, [plain_print(text[d]) for d in given], 2)
            assert sorted(ids) == sorted(set(want))
        if name == "mixing":
            wanted = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            assert collections.Counter(ids) == collections.Counter({d: c for d, c in wanted.items() if c})
    got = at.collect()
    assert len(got) == len(ids)
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_pipeline_stages_take_odd_and_empty_tables(spark, docs, none):
    extra = docs.unionByName(docs.where("doc_id = 6")).withColumn("_key", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, extra, SF).collect()
        assert stage(spark, none, SF).count() == 0
    assert corpus_pipeline.drop_near_copies(spark, extra, SF).where("doc_id = 6").count() == 1
