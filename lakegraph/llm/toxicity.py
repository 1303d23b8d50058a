"""Toxicity from a lexicon trie read with Levenshtein automata, and the context of each hit.

Terms and word stems that mark toxic texts are learned from labels. The automaton
of all words within one edit (a swap of neighbours is one) of the trie is built
state by state as texts need it. Every hit is weighed by its window: a quoted term
counts in another feature than one that is used. A logistic model turns the counts
into a score; it is fitted on the labelled rows and on re-settings of the toxic
ones, with their terms misspelt (still toxic) and put in quotation marks (not toxic).
"""

from __future__ import annotations

import bisect
import random
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lakegraph.llm.common import lowest, map_columns, words_of
from lakegraph.session import cut

#: Quotation marks. Apostrophes are none.
_MARKS = frozenset("\"“”„«»‹›")
_EDGE = string.punctuation + "“”„‘’‚«»‹›…¿¡–—"
#: Words on either side of a hit that decide whether it is quoted.
WINDOW = 6
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Shorter terms must be spelled exactly.
FUZZY_LENGTH = 4
FEATURES = ("exact", "stem", "fuzzy", "quoted", "any", "density")
#: Different contexts in toxic texts that a term has at least.
CONTEXTS = 5
#: What a re-setting of a toxic row weighs in the fit, as a share of the row itself.
RESET_SHARE = 0.25


def bare(word: bytes) -> str:
    """A word in lower case without the punctuation around it."""
    return word.decode().lower().strip(_EDGE)


#: The state after a stem.
_STEM_READ = frozenset({(-1, 0, "")})


class Lexicon:
    """Trie of terms with a lazily built automaton of what lies within one edit.

    A state is a set of (trie node, edits so far, letter that a swap still waits for).
    Finding a term exactly beats a stem, which beats a term with one edit. ``known`` are words of clean texts that no
    edit may turn into a term.
    """

    def __init__(self, terms: list[str], stems: list[str], fuzzy: set[str], known: set[str] = frozenset(), edits: int = 1):
        self.edits, self.known = edits, known
        self.children: list[dict[str, int]] = [{}]
        self.word, self.stem, self.longest = [False], [False], [0]
        for text, ends in [(t, self.word) for t in terms] + [(s, self.stem) for s in stems]:
            node, path = 0, [0]
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(False)
                    self.stem.append(False)
                    self.longest.append(0)
                node = self.children[node][c]
                path.append(node)
            ends[node] = True
            if ends is self.word and text in fuzzy:
                for n in path:
                    self.longest[n] = max(self.longest[n], len(text))
        self.start = self._close({(0, 0, "")})
        self.steps: dict = {}
        self.kinds: dict = {}
        self.seen: dict[bytes, str] = {}

    def _close(self, state: set) -> frozenset:
        """With all characters that the text may leave out; edits are spent only towards long terms."""
        todo = list(state)
        while todo:
            node, e, due = todo.pop()
            if not due and e < self.edits and self.longest[node] >= FUZZY_LENGTH:
                for child in self.children[node].values():
                    following = (child, e + 1, "")
                    if following not in state and self.longest[child] >= FUZZY_LENGTH:
                        state.add(following)
                        todo.append(following)
        return frozenset(state)

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e, due in state:
            if due:
                if c == due:
                    out.add((node, e, ""))
                continue
            if e == 0 and self.stem[node]:
                return _STEM_READ  # any ending will do
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, e, ""))
            if e < self.edits and self.longest[node] >= FUZZY_LENGTH:
                out.add((node, e + 1, ""))
                for other, n in self.children[node].items():
                    if self.longest[n] >= FUZZY_LENGTH:
                        out.add((n, e + 1, ""))
                        swapped = self.children[n].get(c)
                        if swapped is not None and self.longest[swapped] >= FUZZY_LENGTH:
                            out.add((swapped, e + 1, other))
        return self._close(out)

    def match(self, word: str) -> str:
        """``exact``, ``stem``, ``fuzzy`` or empty."""
        state, steps = self.start, self.steps
        for c in word:
            following = steps.get((state, c))
            if following is None:
                following = steps[state, c] = self._step(state, c)
            state = following
            if not state:
                return ""
            if state == _STEM_READ:
                return "stem"
        if any(e == 0 and self.word[n] for n, e, _ in state):
            return "exact"
        if any(e == 0 and self.stem[n] for n, e, _ in state):
            return "stem"
        fuzzy = any(not due and self.word[n] and self.longest[n] >= FUZZY_LENGTH for n, _, due in state)
        return "fuzzy" if fuzzy and word not in self.known else ""

    def kind(self, raw: bytes) -> str:
        """As :meth:`match`, for a word as it stands in a text; remembered for many words."""
        found = self.seen.get(raw)
        if found is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            if len(self.steps) > 200_000:
                self.steps.clear()
            found = self.seen[raw] = self.match(bare(raw))
        return found


def quotations(words: list[bytes]) -> list[tuple[int, int]]:
    """First and last word of each quotation, in order.

    A mark before a word opens one, anew if one is open; a mark after a word closes
    the one that is open. Other marks (inches, marks inside words) are none.
    """
    spans, begin = [], None
    for i, raw in enumerate(words):
        word = raw.decode()
        core = word.strip(_EDGE)
        at = word.find(core) if core else len(word)
        if not _MARKS.isdisjoint(word[:at]):
            begin = i
        if begin is not None and not _MARKS.isdisjoint(word[at + len(core):]):
            spans.append((begin, i))
            begin = None
    return spans


def is_quoted(spans: list[tuple[int, int]], at: int) -> bool:
    """The word stands in a quotation that begins and ends within the window."""
    k = bisect.bisect_right(spans, (at, float("inf"))) - 1
    return k >= 0 and at - WINDOW <= spans[k][0] and at <= spans[k][1] <= at + WINDOW


def features_of(words: list[bytes], lexicon: Lexicon) -> list[float]:
    counts = dict.fromkeys(("exact", "stem", "fuzzy", "quoted"), 0)
    spans = None
    kinds = list(map(lexicon.seen.get, words))
    for at, kind in enumerate(kinds):
        if kind is None:
            kind = lexicon.kind(words[at])
        if kind:
            if spans is None:
                spans = quotations(words)
            counts["quoted" if is_quoted(spans, at) else kind] += 1
    used = counts["exact"] + counts["stem"] + counts["fuzzy"]
    return [*(float(np.log1p(c)) for c in counts.values()), float(used > 0), 100.0 * used / (len(words) + 20)]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    return features_of(words_of(text), lexicon)


def misspelt(word: bytes, rng: random.Random) -> bytes:
    """A word with one edit behind its first letter: a letter changed, doubled or left out, or two swapped."""
    text = word.decode()
    core = text.strip(_EDGE)
    at = text.find(core)
    k = rng.randrange(1, len(core))
    before, c, after = core[:k], core[k], core[k + 1:]
    new = rng.choice([rng.choice(string.ascii_lowercase), c + c, "", after[:1] + c])
    rest = after[1:] if len(new) == 2 and new != c + c else after
    return (text[:at] + before + new + rest + text[at + len(core):]).encode()


def resettings(text: str | None, lexicon: Lexicon) -> tuple[list[float] | None, list[float] | None]:
    """Features of a toxic text with its terms misspelt, and with them quoted; None where there is nothing to change or to find."""
    words = words_of(text)
    hits = [i for i, w in enumerate(words) if lexicon.kind(w) == "exact" and len(bare(w)) >= FUZZY_LENGTH]
    if not hits:
        return None, None
    rng = random.Random(zlib.crc32(b" ".join(words)))
    wrong, quoted = list(words), list(words)
    for i in hits:
        wrong[i] = misspelt(words[i], rng)
        quoted[i] = b'"' + words[i].replace(b'"', b"") + b'"'
    x = features_of(wrong, lexicon)
    return (x if x[FEATURES.index("fuzzy")] else None), features_of(quoted, lexicon)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last one is the constant) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, terms: list[str], stems: list[str], fuzzy: list[str], known: list[str], weights: np.ndarray):
        self.terms, self.stems, self.fuzzy, self.known, self.weights = terms, stems, fuzzy, known, weights

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.stems, set(self.fuzzy), set(self.known))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: int, clean: int) -> DataFrame:
    """``text, toxic, weight``: at most ``toxic`` and ``clean`` labelled rows, those of smallest id hash.

    Rows whose crc32 of the id leaves 2 modulo 4 are held out. An id with labels of
    both kinds counts as toxic; null ids and labels are left out. Of the texts of one
    id that of smallest hash is taken.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(
        F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = cut(own)
    chosen, sizes = [], dict(own.groupBy("toxic").count().collect())
    for label, most in ((1, toxic), (0, clean)):
        n = sizes.get(label, 0)
        if n:
            picked = lowest(own.where(F.col("toxic") == label), "doc_id", most, n, "doc_id")
            chosen.append(picked.withColumn("weight", F.lit(n / min(n, most))))
    if not chosen:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, text string, toxic int, weight double")
    few = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])
    # At most toxic + clean ids.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(few), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    return rows.groupBy("doc_id", "toxic", "weight").agg(first).select("doc_id", "first.text", "toxic", "weight")


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    toxic: int = 3000, clean: int = 6000, max_terms: int = 4000,
) -> Model:
    """Lexicon and weights from a bounded sample of labelled rows.

    A word or stem is a term if it stands in at least five different contexts (the
    words around it) of toxic texts and hardly in clean ones. Contexts, not texts,
    are counted, so that copies of one text do not make its words terms. Only
    ``max_terms`` terms, most contexts first, words of the sample's clean texts that lie
    within an edit of one, and the sample's features come to the driver.

    No edit may turn a word of clean texts into a term. In the fit, a word that has only
    one clean context is not protected, as the text it stands in would not have
    protected it: what edits find in clean texts not seen so far weighs against them.
    """
    sample = cut(training_rows(docs, labels, doc_id, text, toxic, clean))

    def contexts():
        def work(texts):
            terms, around, ends = [], [], [0]
            for t in texts:
                names = [bare(w) for w in words_of(t)]
                padded = ["", *names, ""]
                found = set()
                for i, w in enumerate(names):
                    if 3 <= len(w) <= 24 and w.isalpha():
                        context = zlib.crc32(f"{padded[i]} {padded[i + 2]}".encode())
                        found.add((w, context))
                        found.update((w[:n] + "*", context) for n in STEM_LENGTHS if len(w) > n)
                terms += [a for a, _ in found]
                around += [b for _, b in found]
                ends.append(len(terms))
            items = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(around, pa.int64())], names=["term", "context"])
            return {"found": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)}

        return work

    item = T.StructType([T.StructField("term", T.StringType()), T.StructField("context", T.LongType())])
    found = map_columns(sample, ["text"], contexts, [T.StructField("found", T.ArrayType(item))], ["toxic"], call_bytes=400_000)
    single = found.select("toxic", F.explode("found").alias("f")).select("f.term", "f.context", "toxic").distinct()
    counts = single.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    counts = cut(counts)
    marks = (F.col("bad") >= CONTEXTS) & (F.col("bad") >= 20 * F.col("good"))
    rows = counts.where(marks).orderBy(F.desc("bad"), "term").limit(max_terms).collect()
    words = {r.term for r in rows if not r.term.endswith("*")}
    stems: list[str] = []
    for stem in sorted((r.term[:-1] for r in rows if r.term.endswith("*")), key=len):
        # A stem that only one word has is no better than the word.
        if not any(stem.startswith(s) for s in stems) and sum(w.startswith(stem) for w in words) > 2:
            stems.append(stem)
    terms = sorted(w for w in words if not any(w.startswith(s) for s in stems))
    fuzzy = [w for w in terms if len(w) >= FUZZY_LENGTH]
    probe = Lexicon(terms, stems, set(fuzzy))
    clean_words = counts.where("good > 0 AND NOT endswith(term, '*')").select("term", "good")
    kind = map_columns(clean_words, ["term"], lambda: lambda column: {"kind": [probe.match(t) for t in column]}, [T.StructField("kind", T.StringType())])
    near = kind.where("kind = 'fuzzy'").select("term", "good").collect()
    model = Model(terms, stems, fuzzy, sorted(r.term for r in near), np.zeros(len(FEATURES) + 1))
    seen = Model(terms, stems, fuzzy, sorted(r.term for r in near if r.good > 1), model.weights)

    def fitted():
        lexicon = seen.lexicon()

        def work(texts, toxic):
            others = [resettings(t, lexicon) if y else (None, None) for t, y in zip(texts, toxic)]
            return {"x": [features(t, lexicon) for t in texts], "misspelt": [a for a, _ in others], "quoted": [b for _, b in others]}

        return work

    fields = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("x", "misspelt", "quoted")]
    scored = map_columns(sample, ["text", "toxic"], fitted, fields, ["toxic", "weight"]).collect()
    if scored:
        cases = [(r.x, r.toxic, r.weight) for r in scored]
        cases += [(r.misspelt, 1, RESET_SHARE * r.weight) for r in scored if r.misspelt is not None]
        cases += [(r.quoted, 0, RESET_SHARE * r.weight) for r in scored if r.quoted is not None]
        x, y, weight = (np.array(c, float) for c in zip(*cases))
        model.weights = logistic(x, y, weight)
    return model


def feature_maker(model: Model):
    def make():
        lexicon = model.lexicon()
        return lambda texts: {"x": [features(t, lexicon) for t in texts]}

    return make


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row, without a shuffle.

    A null or empty text has no hits and gets the score of a text without any;
    without labels to learn from every score is 0.5 and nothing is predicted.
    """
    made = feature_maker(model)
    weights, learned = model.weights, bool(np.any(model.weights))

    def make():
        x_of = made()

        def work(texts):
            x = np.array(x_of(texts)["x"]).reshape(len(texts), len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            return {"score": p, "predicted": (p >= threshold).astype(np.int32) if learned else np.zeros(len(texts), np.int32)}

        return work

    return map_columns(docs, [text], make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep)
