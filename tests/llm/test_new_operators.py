"""Whitening, Merkle versions and tensored MinHash against plain versions, on small and awkward rows."""

import collections
import hashlib
import itertools
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakegraph.llm import merkle, minhash, whitening
from lakegraph.llm.common import let_workers_import


@pytest.fixture(autouse=True)
def _workers(spark):
    let_workers_import(spark)


# -- 11 --------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, x string, whitened string, component string, kept string"


def plain_polynomial(matrix):
    """Faddeev and LeVerrier's recurrence in fractions, lowest power first."""
    d = len(matrix)
    a = [[Fraction(int(v)) for v in row] for row in matrix]
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][l] * m[l][j] for l in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(a[i][l] * m[l][i] for i in range(d) for l in range(d)) / k)
    return [int(c) for c in reversed(out)]


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_polynomial_is_exact(spark, d):
    rng = np.random.default_rng(d)
    x = rng.integers(-10 ** 6, 10 ** 6, (5, d)).astype(object)
    x[:, -1] = x[:, 0]  # a root at 0 for d > 1, and zeros below the diagonal on the way
    scatter = x.T @ x
    assert whitening.characteristic_polynomial(spark, scatter) == plain_polynomial(scatter)


def test_polynomial_needs_row_swaps(spark):
    scatter = np.array([[2, 0, 0, 1], [0, 3, 1, 0], [0, 1, 3, 0], [1, 0, 0, 2]], object)
    assert whitening.characteristic_polynomial(spark, scatter) == plain_polynomial(scatter)
    diagonal = np.diag(np.array([5, 5, 1, 0], object))
    assert whitening.characteristic_polynomial(spark, diagonal) == plain_polynomial(diagonal)


def test_roots_with_ties_at_whole_numbers_and_close_ones():
    def poly(roots):
        c = [1]
        for r in roots:
            c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
        return c

    assert whitening.largest_roots(poly([7, 7, 3, 1, 0, 0]), 5, 10) == [7 << 10, 7 << 10, 3 << 10, 1 << 10]
    assert whitening.largest_roots(poly([10 ** 12 + 1, 10 ** 12]), 2, 4) == [(10 ** 12 + 1) << 4, 10 ** 12 << 4]
    # x^2 - 3 x + 1 has both roots irrational, and times itself each of them twice.
    for many, c in ((1, [1, -3, 1]), (2, [1, -6, 11, -6, 1])):
        found = whitening.largest_roots(c, 2 * many, 60)
        want = [(3 + 5 ** 0.5) / 2] * many + [(3 - 5 ** 0.5) / 2] * many
        assert [f / 2 ** 60 for f in found] == pytest.approx(want, rel=1e-15) and len(set(found)) == 2


def plain_whitening(vectors):
    x = np.floor(256 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    v = np.cov(fit.T, bias=True).reshape(x.shape[1], -1)
    e, w = np.linalg.eigh(v)
    return x, fit, e[::-1], w[:, ::-1]


def test_whitening_matches_eigh(spark):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(300, 12)) * np.linspace(0.2, 3, 12)).astype(np.float32)
    rows = [(i, v.tolist(), "a", "b", "c", "d") for i, v in enumerate(good)]
    rows += [(i, v, "a", "b", "c", "d") for i, v, *_ in rows[:40]]  # repeated vectors, and ids
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [None] * 12, [nan] * 12, [1.0] * 11 + [inf], [1.0] * 11, [1e30] * 12]
    df = spark.createDataFrame(rows + [(1000 + i, v, "a", "b", "c", "d") for i, v in enumerate(odd)], VECTORS).repartition(4)
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "embedding", "x", "kept", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    x, fit, e, w = plain_whitening([r[1] for r in rows])
    sums = fit.sum(axis=0).astype(object)
    assert collections.Counter((r.vec_id, r.component) for r in got) == collections.Counter((r[0], k) for r in rows for k in range(1, 5))
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(4):
        want = (x - fit.mean(axis=0)) @ w[:, k] / e[k] ** 0.5
        found = np.array([by[i, k + 1].whitened for i in range(300)])
        sign = np.sign(found @ want[:300])
        assert np.abs(found * sign - want[:300]).max() < 1e-9
        assert by[0, k + 1].explained == pytest.approx(e[k] / e.sum(), rel=1e-10)
    for i in range(300):
        assert by[i, 1].deviation == sum((len(fit) * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
    assert {r.n for r in got} == {len(fit)} and max(r.identity_error for r in got) < 1e-9


def test_whitening_of_ties_few_and_equal_vectors(spark):
    make = lambda vs: spark.createDataFrame([(i, [float(x) for x in v], "", "", "", "") for i, v in enumerate(vs)], VECTORS)
    cube = list(itertools.product([0, 1], repeat=5))  # every direction has the same variance
    got = whitening.whiten(make(cube), keep=["vec_id"]).collect()
    assert len(got) == 4 * len(cube) and max(r.identity_error for r in got) < 1e-12
    assert {round(r.explained, 12) for r in got} == {0.2}
    line = whitening.whiten(make([(1, 2, 3), (2, 4, 6), (3, 6, 9)]), keep=["vec_id"]).collect()
    assert sorted((r.vec_id, r.component) for r in line) == [(0, 1), (1, 1), (2, 1)] and line[0].explained == 1.0
    assert whitening.whiten(make([(1, 2)] * 3)).count() == 0
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1,), (3,)])).count() == 2
    large = whitening.whiten(make([(1e9, 0), (-1e9, 5), (3e9, 7)]), keep=["vec_id"]).collect()
    assert len(large) == 6 and all(r.deviation is None or r.deviation > 0 for r in large)


# -- 12 --------------------------------------------------------------------

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string, steps string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r[3]].append((-1 if r[0] is None else r[0], plain_leaf(*r[:5]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for _, leaf, _ in sorted(sources[s], key=lambda x: x[:2])]) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for pos, (_, leaf, r) in enumerate(sorted(sources[s], key=lambda x: x[:2])):
            now, proof = leaf, ""
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                now = plain_leaf(r[0], r[1].replace("\n", ""), *r[2:5])
            for levels, place in ((trees[s], pos), (top, at)):
                for level in levels[:-1]:
                    begin = place // 3 * 3
                    left, right = "".join(level[begin:place]), "".join(level[place + 1:begin + 3])
                    now, proof, place = h(left, now, right), proof + left + right, place // 3
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], h(proof), now, now == top[-1][0]))
    return out


def manifest(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    made = merkle.manifest(docs, tampered=tampered, changed={"text": F.replace("text", F.lit("\n"), F.lit(""))})
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_matches_plain_trees(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rows = [(i, f"text {i}\nand é {'x' * (i % 7)}", "en", ["hot", "hot", "b", "é", f"own{i}"][i % 5], i, "k", "t", "s") for i in range(120)]
    rows += [(7, None, None, None, None, "k", "t", "s"), (8, "", None, None, 0, "k", "t", "s"), (None, "a\nb", "en", "hot", 1, "k", "t", "s")]
    rows += [rows[0]] * 5 + [(0, "other text\n", "en", "hot", 1, "k", "t", "s"), (4, "= \n", "en", "", 3, "k", "t", "s")]
    got = manifest(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain_manifest(rows))
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    one = [(1, "a\nb", "en", "s", 3, "k", "t", "s")]
    (row,) = manifest(spark.createDataFrame(one, DOCS)).collect()
    assert tuple(row) == plain_manifest(one)[0] and row.root == row.leaf and row.proof_sha256 == h("")
    assert manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_versions_share_untouched_nodes():
    leaves = [h(str(i)) for i in range(25)]
    tree = merkle.PathTree(leaves, merkle.height_of(25))
    before = (list(tree.digest), list(tree.children))
    roots = [tree.with_leaf(i, "changed") for i in range(25)]
    assert tree.digest[:len(before[0])] == before[0] and tree.children[:len(before[1])] == before[1]
    assert len(tree.digest) == len(before[0]) + 25 * (tree.height + 1)  # a leaf and its ancestors each
    for i, root in enumerate(roots):
        plain = plain_tree(leaves[:i] + ["changed"] + leaves[i + 1:])
        assert tree.digest[root] == plain[-1][0] == merkle.fold("changed", tree.siblings(i))
    # A version of a version keeps both changes.
    both = tree.with_leaf(3, "more", roots[20])
    assert tree.digest[both] == plain_tree(leaves[:3] + ["more"] + leaves[4:20] + ["changed"] + leaves[21:])[-1][0]


# -- 13 --------------------------------------------------------------------

def plain_shingles(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_near(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, len(s), least.get(r), i == least.get(r)) for (i, _), s, r in zip(rows, sets, root)]


def edited(rng, words, share):
    words = list(words)
    for i in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


ODD = [None, "", " \n\t ", "one", "one", "One", "a b c d", "A b c d", "a b c d e", "a b c d e f g h", "x" * 3000, "same text here again now", "same text here again now"]


@pytest.mark.parametrize("few, sets, shingles", [(32, 2000, 1_000_000), (2, 2000, 1_000_000), (3, 4, 1_000_000), (2, 50, 2000)])
def test_near_copies_match_all_pairs(spark, monkeypatch, few, sets, shingles):
    """Crowded keys, and keys cut into pieces, lose no link."""
    for name, value in (("FEW", few), ("PIECE_SETS", sets), ("PIECE_SHINGLES", shingles)):
        monkeypatch.setattr(minhash, name, value)
    rng = np.random.default_rng(5)
    line = [f"common{i}" for i in range(60)]
    texts = list(ODD) + [" ".join(f"long{i}" for i in range(40_000))]
    for size in (9, 30, 100, 400):
        base = line[:size // 2] + [f"w{rng.integers(1 << 30)}" for _ in range(size - min(size // 2, 60))]
        texts += [" ".join(base).upper(), *(edited(rng, base, share) for share in (0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(5))]
        at = base
        for _ in range(6):  # a chain: neighbours link, its ends do not
            at = edited(rng, at, 0.01).split()
            texts.append(" ".join(at))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (None, "no other like this one at all"), (3, "five other words in a row")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("x")).withColumn("bands", F.lit(1)).repartition(3)
    got = minhash.near_copies(df).collect()
    want = [(i, n, c, k if i is not None else c is None) for i, n, c, k in plain_near(rows)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    groups = collections.Counter(r.component_id for r in got)
    assert groups.most_common(1)[0][1] > 5


def test_near_copies_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_copies(empty).count() == 0
    none = spark.createDataFrame([(1, None), (1, ""), (2, " ")], "doc_id bigint, text string")
    assert sorted(map(tuple, minhash.near_copies(none).collect())) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True)]


def test_spanning_links_join_what_all_links_do():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    given = []
    for _ in range(60):
        drop = rng.integers(0, 60)
        given.append(np.unique(np.concatenate([rng.permutation(base)[drop:], rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64)])))
    node = np.arange(60)
    root = np.where(node % 7 == 0, 0, node)
    links = minhash.spanning_links(node, root, [minhash.packed(s) for s in given], (85, 100))
    sizes = {(i, j): len(np.intersect1d(given[i], given[j])) for i in range(60) for j in range(i)}
    near = [(i, j) for (i, j), c in sizes.items() if 100 * c >= 85 * (len(given[i]) + len(given[j]) - c)]
    assert {tuple(sorted(l, reverse=True)) for l in links} <= set(near) and len(links) < 60

    def groups(pairs):
        at = root.tolist()
        for i, j in pairs:
            low, high = sorted((at[i], at[j]))
            at = [low if r == high else r for r in at]
        return [sorted(k for k in range(60) if at[k] == at[i]) for i in range(60)]

    assert groups(links) == groups(near)


def test_tensored_bands_find_what_they_promise():
    """Of pairs at similarity 0.85 nearly all share a band of each collection; bands depend on the set alone."""
    rng, bands = np.random.default_rng(3), minhash.Bands(8, 2)
    found = 0
    for _ in range(300):
        shared, own = rng.integers(0, 1 << 63, 340, dtype=np.uint64), rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a, b = (bands.of(np.unique(np.concatenate([shared, own[:30] if k else own[30:]]))) for k in (0, 1))
        same = a == b
        found += bool(same[:8].any() and same[8:].any())
    assert found >= 299


def test_sketches_pass_linked_pairs_and_few_others(spark):
    rng = np.random.default_rng(4)
    rows, pairs = [], []
    for k in range(600):
        n, share = int(rng.integers(1, 500)), 0.85 if k % 2 else 0.4
        shared = rng.integers(0, 1 << 63, max(1, round(n * share)), dtype=np.uint64)
        own = rng.integers(0, 1 << 63, max(0, round(n * (1 - share))), dtype=np.uint64)
        for side, part in ((0, own[::2]), (1, own[1::2])):
            rows.append((2 * k + side, bytearray(minhash.sketch(np.unique(np.concatenate([shared, part]))))))
        pairs.append((2 * k, 2 * k + 1, n))
    distinct = spark.createDataFrame(rows, "node bigint, sketch binary")
    found = {r.a // 2 for r in minhash.likely(spark.createDataFrame([p[:2] for p in pairs], "a bigint, b bigint"), distinct, (85, 100)).collect()}
    assert found >= set(range(1, 600, 2))
    assert not found & {k for k in range(0, 600, 2) if pairs[k][2] > 150}
