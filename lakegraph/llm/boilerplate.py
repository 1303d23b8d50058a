"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks in page order. Each block has hashed features of its
tag path and of its words; a bidirectional LSTM in numpy reads the whole
sequence and says for every block whether it belongs to the article.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from lakegraph.llm.common import in_parts, lowest, map_columns

# Elements that end a block, that never hold text, and that have no end tag.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_ITSELF = frozenset("p li dt dd tr td th option".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe|object|math|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")

PATH_BUCKETS, WORD_BUCKETS, PLAIN = 96, 32, 10
INPUTS = PATH_BUCKETS + WORD_BUCKETS + PLAIN
HIDDEN = 16


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text: where they stand, their text, and how many of its characters are links."""
    out: list[Block] = []
    open_tags: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = in_link = 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Block(tuple(n for _, names in open_tags for n in names), text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        name = m[3]
        if name is None:
            raw = m[0]
            if m[1] is None and not raw.startswith(("<!", "<?")):
                pieces.append(raw)
                if in_link:
                    linked += len(raw)
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if m[2] else 1
        if name not in BLOCK_TAGS:
            continue
        flush()
        if m[2]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    del open_tags[i:]
                    in_link = 0
                    break
        elif name not in VOID_TAGS:
            if open_tags and (open_tags[-1][0] == "p" or open_tags[-1][0] == name and name in CLOSED_BY_ITSELF):
                open_tags.pop()
            if not m[0].endswith("/>"):
                said = " ".join(filter(None, (v for g in _NAMES.findall(m[4]) for v in g))).lower() if m[4] else ""
                open_tags.append((name, (name, *_PART.findall(said))))
    flush()
    return out


_bucket: dict[str, int] = {}


def _hash(token: str) -> int:
    h = _bucket.get(token)
    if h is None:
        if len(_bucket) > 300_000:
            _bucket.clear()
        h = _bucket[token] = zlib.crc32(token.encode())
    return h


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row of features per block."""
    x = np.zeros((len(blocks), INPUTS), np.float32)
    for i, b in enumerate(blocks):
        row = x[i]
        for name in set(b.path):
            row[_hash(name) % PATH_BUCKETS] = 1
        if b.path:
            row[_hash("leaf " + b.path[-1]) % PATH_BUCKETS] += 1
        words = b.text.split(" ")
        n = len(words)
        counts = np.bincount([_hash(w) % WORD_BUCKETS for w in words], minlength=WORD_BUCKETS)
        row[PATH_BUCKETS:PATH_BUCKETS + WORD_BUCKETS] = np.sqrt(counts / n)
        size = len(b.text)
        row[-PLAIN:] = (
            min(np.log1p(n) / 5, 2), b.linked / size, n <= 3, b.text[-1] in ".!?…\"", b.text.count(".") / n,
            b.text.count(",") / n, b.text[0].isupper(), i / len(blocks), 1 / (1 + len(blocks) - i), min(len(b.path), 12) / 12)
    return x


class Labeller:
    """Bidirectional LSTM with a logistic output, for padded batches of sequences."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w["w" + d] = rng.normal(0, 0.15, (INPUTS + HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1  # remember at first
            self.w["c" + d] = bias
        self.w["out"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.w["const"] = np.zeros(1, np.float32)

    def _one_way(self, x, mask, d):
        """Hidden states of all steps (time first), and what training needs."""
        steps, rows = x.shape[:2]
        w, c = self.w["w" + d], self.w["c" + d]
        given = x @ w[:INPUTS] + c
        h = np.zeros((rows, HIDDEN), np.float32)
        cell = np.zeros_like(h)
        states, saved = np.zeros((steps, rows, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ w[INPUTS:]
            gates = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            new = np.tanh(z[:, 3 * HIDDEN:])
            i, f, o = np.split(gates, 3, axis=1)
            m = mask[t][:, None]
            before, h_before = cell, h
            cell = m * (f * cell + i * new) + (1 - m) * cell
            th = np.tanh(cell)
            h = m * (o * th) + (1 - m) * h
            states[t] = h
            saved.append((t, i, f, o, new, before, th, h_before))
        return states, saved

    def forward(self, x, mask):
        runs = [self._one_way(x, mask, d) for d in "fb"]
        both = np.concatenate([r[0] for r in runs], axis=2)
        return 1 / (1 + np.exp(-(both @ self.w["out"] + self.w["const"]))), both, runs

    def gradients(self, x, mask, y):
        p, both, runs = self.forward(x, mask)
        error = (p - y) * mask / mask.sum()
        g = {"out": np.einsum("tr,trh->h", error, both), "const": np.array([error.sum()], np.float32)}
        for k, d in enumerate("fb"):
            w, saved = self.w["w" + d], runs[k][1]
            to_h = error[:, :, None] * self.w["out"][k * HIDDEN:(k + 1) * HIDDEN]
            gw, gc = np.zeros_like(w), np.zeros_like(self.w["c" + d])
            dh = np.zeros_like(to_h[0])
            dcell = np.zeros_like(dh)
            for t, i, f, o, new, before, th, h_before in reversed(saved):
                m = mask[t][:, None]
                dh = dh + to_h[t]
                dc = dcell + m * dh * o * (1 - th ** 2)
                dz = m * np.concatenate([
                    dc * new * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - new ** 2)], axis=1)
                gw[:INPUTS] += x[t].T @ dz
                gw[INPUTS:] += h_before.T @ dz
                gc += dz.sum(0)
                dcell = m * dc * f + (1 - m) * dcell
                dh = dz @ w[INPUTS:].T + (1 - m) * dh
            g["w" + d], g["c" + d] = gw, gc
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int, rows: int = 24, rate: float = 0.01, seed: int = 9) -> None:
        """Adam steps over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        batches = [order[i:i + rows] for i in range(0, len(order), rows)]
        for _ in range(rounds):
            for b in rng.permutation(len(batches)):
                x, mask, y = padded([pages[i] for i in batches[b]])
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.w[k] -= rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of every block of every page."""
        x, mask, _ = padded([(p, np.zeros(len(p))) for p in pages])
        p = self.forward(x, mask)[0]
        return [p[:len(page), i] for i, page in enumerate(pages)]


def padded(pages):
    steps = max(len(y) for _, y in pages)
    x = np.zeros((steps, len(pages), INPUTS), np.float32)
    mask, y = np.zeros((2, steps, len(pages)), np.float32)
    for i, (vector, label) in enumerate(pages):
        x[:len(label), i], mask[:len(label), i], y[:len(label), i] = vector, 1, label
    return x, mask, y


# -- training pages --------------------------------------------------------

# Names that page parts go by.
MAIN_NAMES = ("content", "main-content", "post", "post-body", "entry-content", "article-body", "story", "text", "page-content", "article")
MENU_NAMES = ("menu", "nav", "navigation", "navbar", "topnav", "breadcrumb", "links", "toc", "tabs")
HEAD_NAMES = ("header", "masthead", "site-header", "top", "banner", "branding", "logo")
SIDE_NAMES = ("sidebar", "aside", "related", "widget", "recommended", "popular", "trending", "more-stories", "tags", "author-box")
NOTICE_NAMES = ("cookie", "cookie-banner", "notice", "consent", "alert", "gdpr", "newsletter", "popup", "modal", "subscribe")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner-ad")
COMMENT_NAMES = ("comments", "comment", "comment-list", "replies", "discussion", "responses", "reader-comments", "user-comments")
FOOT_NAMES = ("footer", "site-footer", "bottom", "copyright", "legal")


def weak_labels(blocks: list[Block]) -> list[int]:
    """1 for blocks of an article element, or without one for long blocks with few links."""
    if any("article" in b.path for b in blocks):
        return [int("article" in b.path) for b in blocks]
    return [int(len(b.text) > 120 and b.linked * 3 < len(b.text)) for b in blocks]


def _element(rng, tags: str, names: tuple[str, ...], inside: str) -> str:
    tag = rng.choice(tags.split())
    style = rng.random()
    said = f' class="{rng.choice(names)}"' if style < 0.6 else f' id="{rng.choice(names)}"' if style < 0.8 else ""
    if tag == "div" and not said:
        said = f' class="{rng.choice(names)}"'
    return f"<{tag}{said}>{inside}</{tag}>"


def varied_page(rng: np.random.Generator, body: list[Block], words: np.ndarray, prose: np.ndarray) -> tuple[str, set[str]]:
    """The article set into another page: other elements, other parts around it. Returns the page and the article's texts."""
    escape = entities.escape
    phrase = lambda a, b: escape(" ".join(rng.choice(words, rng.integers(a, b))))
    sentence = lambda: escape(str(rng.choice(prose)))
    links = lambda n: "<ul>" + "".join(f'<li><a href="/x">{phrase(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def bare_links(n):
        return "".join(f'<a href="/x">{phrase(1, 3)}</a> ' for _ in range(n))

    def advert():
        return _element(rng, "div div aside section", AD_NAMES, f"<p>{sentence()}</p>" if rng.random() < 0.5 else sentence())

    def notice():
        return _element(rng, "div div section aside p", NOTICE_NAMES, f"{sentence()} <button>{phrase(1, 3)}</button>")

    def form():
        inner = f"<label>{phrase(1, 3)}</label><input name=q><button>{phrase(1, 3)}</button>"
        return f"<form>{'<p>' + sentence() + '</p>' if rng.random() < 0.4 else ''}{inner}</form>"

    def side():
        inner = f"<h3>{phrase(1, 4)}</h3>" + (links(rng.integers(2, 6)) if rng.random() < 0.6 else f"<p>{sentence()}</p>" * int(rng.integers(1, 3)))
        return _element(rng, "aside aside div section", SIDE_NAMES, inner)

    def comments():
        one = lambda: _element(rng, "div li article section", ("comment", "reply", "comment-body"), f"<b>{phrase(1, 3)}</b><p>{sentence()}</p>")
        return _element(rng, "section div ol", COMMENT_NAMES, f"<h3>{phrase(1, 3)}</h3>" + "".join(one() for _ in range(rng.integers(1, 5))))

    inner = []
    for i, b in enumerate(body):
        tag = b.path[-1] if b.path and b.path[-1] in ("h1", "h2", "h3", "p", "li", "blockquote") else "p"
        inner.append(f"<{tag}>{escape(b.text)}</{tag}>")
        if rng.random() < 0.06:
            inner.append(rng.choice([advert, notice, side])())
    if rng.random() < 0.3 and inner:
        inner[0] = f"<header>{inner[0]}</header>"
    comment = comments() if rng.random() < 0.5 else ""
    within = rng.random() < 0.3
    main = _element(rng, "article article main div div div section", MAIN_NAMES, "".join(inner) + (comment if within else ""))
    head = _element(rng, "header header div", HEAD_NAMES, f"<h2>{phrase(1, 4)}</h2>" + (f"<p>{phrase(3, 8)}</p>" if rng.random() < 0.4 else ""))
    menu = _element(rng, "nav nav div ul", MENU_NAMES, links(rng.integers(3, 9)) if rng.random() < 0.7 else bare_links(rng.integers(3, 9)))
    parts = [p for p, share in ((head, 0.6), (menu, 0.8), (notice(), 0.4), (advert(), 0.5), (form(), 0.3), (side(), 0.3)) if rng.random() < share]
    rest = [p for p, share in ((side(), 0.5), (advert(), 0.3), (form(), 0.3), (notice(), 0.2)) if rng.random() < share]
    rng.shuffle(rest)
    foot = _element(rng, "footer footer div", FOOT_NAMES, f"&copy; {phrase(1, 4)} {sentence() if rng.random() < 0.6 else ''} {bare_links(rng.integers(0, 4))}")
    after = [] if within else [comment]
    if rng.random() < 0.5:
        after = after + rest
    else:
        after = rest + after
    page = "".join([*parts, main, *after, foot if rng.random() < 0.85 else ""])
    return f"<html><body>{'<div class=wrap>' + page + '</div>' if rng.random() < 0.3 else page}</body></html>", {b.text for b in body}


def learn(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample: int = 200, variants: int = 3, rounds: int = 7) -> Labeller:
    """A labeller trained on at most ``sample`` pages, those of smallest id hash, and ``variants`` new settings of each.

    Labels are weak: the article element tells, where a page has one. Settings put the
    article between parts of other kinds under many names, so that the labeller
    does not depend on that element.
    """
    given = pages.select(F.col(page_id).alias("i"), F.col(html).alias("h")).where("h IS NOT NULL")
    ids = given.agg(F.approx_count_distinct(F.xxhash64("i"))).first()[0]
    rows = lowest(given, "i", sample, ids, F.xxhash64("h")).collect()
    known = [(b, weak_labels(b)) for b in (blocks_of(r.h) for r in rows) if b]
    labeller = Labeller()
    if not known:
        return labeller
    rng = np.random.default_rng(11)
    texts = [b.text for b, _ in known for b in b]
    words = np.array(sorted({w for t in texts[:4000] for w in t.split()[:30]}), object)
    prose = {" ".join(t.split()[:int(n)]) for t, n in zip(texts, rng.integers(4, 45, len(texts))) if len(t) > 40}
    prose = np.array(sorted(prose or texts), object)
    # Of a long page both ends are enough to learn from.
    cases = [(np.delete(vectors(b), slice(30, max(30, len(b) - 30)), 0), np.delete(np.array(y), slice(30, max(30, len(y) - 30)))) for b, y in known]
    for blocks, labels in known:
        body = [b for b, y in zip(blocks, labels) if y]
        for _ in range(variants if body else 0):
            page, own = varied_page(rng, body[:int(rng.integers(1, 25))], words, prose)
            found = blocks_of(page)
            cases.append((vectors(found), np.array([int(b.text in own) for b in found])))
    labeller.train(cases, rounds)
    return labeller


def main_text(pages: DataFrame, labeller: Labeller, html: str = "html", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Adds ``text``, the article's blocks joined by a space, to every row, without a shuffle.

    Character references are decoded and white space in a block is one space. A null
    or empty page, and one without article blocks, has an empty text. Pages are
    read whole, however long; a page of very many blocks is labelled alone.
    """
    def make():
        def work(column):
            out = [""] * len(column)
            cut = [blocks_of(p or "") for p in column]
            order = sorted((i for i in range(len(cut)) if cut[i]), key=lambda i: len(cut[i]))
            # Like lengths together, so little is padded; at most so many padded blocks at once.
            for begin, end in in_parts((len(cut[i]) for i in order), 4000):
                some = order[begin:end]
                for i, p in zip(some, labeller.label([vectors(cut[i]) for i in some])):
                    out[i] = " ".join(b.text for b, y in zip(cut[i], p) if y >= threshold)
            return {"text": out}

        return work

    return map_columns(pages, [html], make, [T.StructField("text", T.StringType())], keep)
