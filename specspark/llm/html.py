"""HTML extraction with a recurrent block labeller.

A page becomes its sequence of text blocks. Each block is a vector of hashed tag-path tokens (element
names, classes, ids of all open elements), hashed words and a few measures. A bidirectional LSTM reads the
whole sequence and labels every block as article or not; the article's blocks are the page's text.

The labeller is trained here, on ``TRAINING_PAGES`` pages laid out by rule in many ways, whose blocks are
labelled as they are made. Training takes seconds and is done once for a driver process.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lstm import Labeller

PATH_DIM, LAST_DIM, WORD_DIM, HIDDEN = 96, 48, 48, 24
TRAINING_PAGES, EPOCHS, SEED = 800, 10, 5
#: Elements whose text is none of the page's.
SKIPPED = frozenset("script style head template noscript svg iframe object canvas".split())
RAW = frozenset("script style".split())
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
#: Elements that a head may hold; any other one closes it.
IN_HEAD = frozenset("title base link meta style script noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: An opening tag of the key closes open elements of these names first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that end the search for one to close.
FENCES = frozenset("ul ol dl table div section article aside nav main body header footer form blockquote td select".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'<>])*+)(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block:
    """Text of one block: pieces, open elements at its first character, characters inside links, training label."""

    __slots__ = ("pieces", "path", "linked", "label", "text")

    def __init__(self, path, label):
        self.pieces, self.path, self.linked, self.label, self.text = [], path, 0, label, ""


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page in order. Broken markup is read as far as it can be."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], str | None]] = []
    current: Block | None = None
    skipping = links = 0
    at, size = 0, len(page)

    def add(raw: str) -> None:
        nonlocal current
        if skipping or not raw:
            return
        if current is None:
            if raw.isspace():
                return
            label = next((x[2] for x in reversed(stack) if x[2] is not None), None)
            current = Block([x[1] for x in stack], label)
            out.append(current)
        text = entities.unescape(raw) if "&" in raw else raw
        current.pieces.append(text)
        if links:
            current.linked += len(text.strip())

    def pop(to: int) -> None:
        nonlocal skipping, links
        while len(stack) > to:
            name = stack.pop()[0]
            skipping -= name in SKIPPED
            links -= name == "a"

    while at < size:
        m = TOKEN.search(page, at)
        add(page[at : m.start() if m else size])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name not in INLINE:
            current = None
        elif name == "br" and current is not None:
            current.pieces.append(" ")
        if closing:
            to = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if to is not None:
                pop(to)
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            close = CLOSES.get(name, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in close:
                    pop(i)
                elif stack[i][0] in FENCES:
                    break
        if name == "body" and any(x[0] == "head" for x in stack) or stack and stack[-1][0] == "head" and name not in IN_HEAD:
            pop(next(i for i, x in enumerate(stack) if x[0] == "head"))
        names, label = [name], None
        for a in ATTRIBUTE.finditer(attributes):
            value = a[2] or a[3] or a[4] or ""
            if a[1].lower() == "data-label":
                label = value
            else:
                names += [f"{name}.{x.lower()}" for x in value.split()]
                names += [f".{x.lower()}" for x in NAME_PART.findall(value)]
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.start() if end else size
            continue
        if attributes.rstrip().endswith("/") and name in SKIPPED:
            continue
        stack.append((name, tuple(names), label))
        skipping += name in SKIPPED
        links += name == "a"
    for b in out:
        b.text = " ".join("".join(b.pieces).split())
    return [b for b in out if b.text]


@lru_cache(maxsize=1 << 14)
def _places(names: tuple[str, ...], kind: str, dim: int) -> np.ndarray:
    """The hashed sum of an element's tokens."""
    return _hashed([f"{kind}:{t}".encode("utf-8", "replace") for t in names], dim)


def _hashed(tokens: list[bytes], dim: int) -> np.ndarray:
    """Signed counts of the tokens in ``dim`` places."""
    h = np.fromiter(map(zlib.crc32, tokens), dtype=np.uint32, count=len(tokens))
    return np.bincount(h % dim, weights=np.where(h & 0x10000, 1.0, -1.0), minlength=dim)


@lru_cache(maxsize=1 << 12)
def _path(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """The hashed tokens of all open elements, then of the last two."""
    out = np.zeros(PATH_DIM + LAST_DIM)
    for names in path:
        out[:PATH_DIM] += _places(names, "path", PATH_DIM)
    for names in path[-2:]:
        out[PATH_DIM:] += _places(names, "last", LAST_DIM)
    return out


def vectors(found: list[Block]) -> np.ndarray:
    """One row a block: hashed path, hashed last elements, hashed words, measures."""
    out = np.zeros((len(found), PATH_DIM + LAST_DIM + WORD_DIM + 10))
    for i, b in enumerate(found):
        row, text = out[i], b.text
        row[: PATH_DIM + LAST_DIM] = _path(tuple(b.path))
        words = text.lower().encode("utf-8", "replace").split()
        row[PATH_DIM + LAST_DIM : -10] = _hashed(words, WORD_DIM) / np.sqrt(len(words) + 1)
        n = len(text)
        row[-10:] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, min(1.0, b.linked / n),
            10 * sum(map(text.count, ".,;")) / n, sum(map(text.count, "0123456789")) / n,
            i / max(1, len(found) - 1), float(text[-1] in ".!?…"), float(len(words) < 4),
            float(i == 0), float(i == len(found) - 1),
        )
    return np.clip(out, -4, 4)


# Training pages -------------------------------------------------------------------------------------------

CHROME_WORDS = (
    "home about contact login register subscribe share tweet follow reply comments comment posted by privacy terms cookies accept "
    "copyright reserved search menu news sports world business next previous read more related popular tags archive category newsletter email"
).split()


class PageMaker:
    """Pages by rule: every block's element carries data-label 1 (article) or 0."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = self.r.choice(["aeiourstlnmdcpbh", "aeéèàiouürstlnmdqgfz", "aeiouäößrnhgkwbv", "абвгдеиклмнопрст"])
        parts = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 4))) for _ in range(60)]
        self.vocabulary = ["".join(self.r.choices(parts, k=self.r.randint(1, 3))) for _ in range(400)]
        self.noise = self.r.random()

    def name(self, *options: str) -> str:
        """A class or id attribute, at times with a suffix, at times with words that say nothing."""
        r, n = self.r, self.r.choice(options)
        if r.random() < 0.3:
            n = r.choice([f"{n}-{r.choice(['box', 'wrap', 'area', 'inner', '1', '2'])}", f"site-{n}", f"{n} {r.choice(['clearfix', 'col', 'row'])}", f"main-{n}"])
        return f' {r.choice(["class", "class", "class", "id"])}="{n}"'

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(self.vocabulary, k=self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(2, 16).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self, most: int = 5) -> str:
        r = self.r
        if r.random() < 0.06:  # a word again and again, or numbers
            return " ".join([self.words(1, 1)] * r.randint(2, 40) if r.random() < 0.7 else [str(r.getrandbits(50)) for _ in range(r.randint(1, 6))])
        text = " ".join(self.sentence() for _ in range(r.randint(1, most)))
        if r.random() < 0.3:
            t = r.choice(["b", "i", "em", "strong", "a href='#'", "span", "code"])
            words = text.split()
            k = r.randrange(len(words))
            words[k] = f"<{t}>{words[k]}</{t.split()[0]}>"
            text = " ".join(words)
        if r.random() < 0.1:
            text = text.replace(" ", "<br>", 1)
        if r.random() < 0.15:
            words = text.split()
            text = " ".join(w + r.choice(["###", "$$$", "&amp;", " |", "!!"]) for w in words)
        return text

    def chrome(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.35:
            return " ".join(r.choices(CHROME_WORDS, k=r.randint(1, 5))).capitalize()
        return self.sentence() if kind < 0.75 else self.words(1, 6)

    def el(self, tag: str, inner: str, label: int | None = None, attrs: str = "") -> str:
        mark = "" if label is None else f' data-label="{label}"'
        return f"<{tag}{attrs}{mark}>{inner}</{tag}>"

    def links(self) -> str:
        r = self.r
        items = "".join(self.el("li", f'<a href="/{i}">{self.words(1, 3)}</a>') for i in range(r.randint(2, 9)))
        return self.el("ul", items, None, self.name("menu", "nav", "links") if r.random() < 0.4 else "")

    def outside(self) -> str:
        """One part of a page that isn't article."""
        r, k = self.r, self.r.randrange(12)
        if k == 0:
            return self.el("nav", self.links() if r.random() < 0.8 else self.chrome(), 0, self.name("nav", "navbar", "menu") if r.random() < 0.4 else "")
        if k == 1:
            return self.el("div", self.links(), 0, self.name("menu", "nav", "breadcrumbs", "navigation", "topbar"))
        if k == 2:
            return self.el("header", self.el(r.choice(["h1", "div", "p", "span"]), self.chrome()) + r.choice(["", self.el("p", self.chrome())]), 0, self.name("header", "masthead") if r.random() < 0.5 else "")
        if k == 3:
            return self.el("div", self.el(r.choice(["p", "span", "h1", "div"]), self.chrome()), 0, self.name("header", "masthead", "banner", "logo"))
        if k == 4:
            return self.el(r.choice(["div", "div", "section"]), r.choice([self.prose(2), self.el("p", self.prose(2)) + self.el("button", self.chrome())]), 0, self.name("cookie", "notice", "consent", "alert", "popup", "newsletter", "gdpr", "modal"))
        if k in (5, 6):
            return self.el(r.choice(["div", "div", "aside", "ins"]), r.choice([self.prose(2), self.el("p", self.prose(2)), f'<a href="#">{self.chrome()}</a>']), 0, self.name("ad", "ads", "advert", "sponsored", "promo", "advertisement", "adsbygoogle"))
        if k == 7:
            inner = self.el("h3", self.chrome()) + r.choice([self.links(), self.el("p", self.prose(3)), self.el("p", self.prose(2)) * 2])
            return self.el("aside", inner, 0, self.name("sidebar", "widget") if r.random() < 0.5 else "")
        if k == 8:
            return self.el("div", self.el("h3", self.chrome()) + r.choice([self.links(), self.el("p", self.prose(3))]), 0, self.name("sidebar", "widget", "related", "recent", "popular", "side"))
        if k == 9:
            return self.el("form", self.el("label", self.chrome()) + '<input name="q">' + self.el("button", self.chrome()) + r.choice(["", self.el("p", self.prose(1)), "<select><option>" + self.words(1, 2) + "<option>" + self.words(1, 2) + "</select>"]), 0)
        if k == 10:
            return self.el("div", self.chrome() + f' <a href="#">{self.chrome()}</a>', 0, self.name("share", "social", "tags", "meta", "byline-links", "pagination"))
        return self.el("div", self.chrome(), 0, self.name("toolbar", "skip", "login", "search"))

    def comments(self) -> str:
        r = self.r
        item, holder = r.choice([("li", "ol"), ("div", "div"), ("article", "section"), ("div", "section")])
        body = "".join(
            self.el(item, r.choice(["", self.el(r.choice(["h4", "cite", "span", "b", "div"]), self.words(1, 2))]) + self.el(r.choice(["p", "div"]), self.prose(3)) + r.choice(["", f'<a href="#">{r.choice(["Reply", "reply", self.words(1, 1)])}</a>']), None, self.name("comment", "reply", "comment-body") if r.random() < 0.7 else "")
            for _ in range(r.randint(1, 6))
        )
        head = r.choice(["", self.el(r.choice(["h2", "h3"]), r.choice(["Comments", "3 comments", self.words(1, 3)]))])
        return self.el(holder, head + body, 0, self.name("comments", "comment-list", "responses", "discussion", "disqus", "replies"))

    def foot(self) -> str:
        r = self.r
        text = r.choice(["&copy; ", "Copyright ", ""]) + self.words(1, 3) + r.choice([" &middot; ", " | ", " "]) + self.chrome()
        if r.random() < 0.6:
            return self.el("footer", r.choice([text, self.el("p", text), self.links() + text]), 0, self.name("footer") if r.random() < 0.4 else "")
        return self.el("div", r.choice([text, self.el("p", text)]), 0, self.name("footer", "bottom", "copyright", "colophon"))

    def article(self) -> str:
        r = self.r
        parts = [self.el(r.choice(["h1", "h1", "h2"]), self.words(2, 10).capitalize() + r.choice(["", "."]))] if r.random() < 0.85 else []
        for _ in range(max(1, int(r.expovariate(1 / 6)))):
            k = r.random()
            if k < 0.7:
                parts.append(r.choice(["<p>", "<p>", f"<p>{self.prose(8)}</p><p>"]) + self.prose(8) + "</p>")
            elif k < 0.76:
                parts.append(self.el(r.choice(["h2", "h3", "h4"]), self.words(1, 6).capitalize()))
            elif k < 0.82:
                parts.append(self.el(r.choice(["ul", "ol"]), "".join(self.el("li", self.words(1, 12)) for _ in range(r.randint(1, 5)))))
            elif k < 0.86:
                parts.append(self.el("blockquote", self.el("p", self.prose(3))))
            elif k < 0.88:
                parts.append(self.el("table", "".join(self.el("tr", "".join(self.el("td", self.words(1, 4)) for _ in range(3))) for _ in range(r.randint(1, 4)))))
            elif k < 0.9:
                parts.append(self.el("figure", "<img src=x>" + self.el("figcaption", self.sentence())))
            elif k < 0.92:
                parts.append(self.el("pre", self.words(3, 12)))
            elif k < 0.95:
                parts.append(f"<p><b>{self.prose(2)}<br><p>{self.prose(4)}</p>")
            else:
                parts.append(self.el("div", self.prose(4)))
        if r.random() < 0.3:
            parts.insert(r.randrange(1, len(parts) + 1), self.outside())
        if r.random() < 0.12:
            parts.append(self.comments())
        inner = "".join(parts)
        shape = r.randrange(6)
        if shape <= 1:
            return self.el("article", inner, 1, self.name("post", "article", "entry", "story") if r.random() < 0.4 else "")
        if shape == 2:
            return self.el("main", r.choice([inner, self.el("article", inner)]), 1)
        if shape == 3:
            return self.el("div", inner, 1, self.name("content", "post", "entry", "article", "story", "text", "body", "article-body", "main"))
        if shape == 4:
            return self.el("section", inner, 1, self.name("content", "post", "article") if r.random() < 0.7 else "")
        return self.el("div", self.el("div", inner, None, self.name("post-content", "entry-content", "article-text")), 1, self.name("container", "wrapper", "page", "primary"))

    def page(self) -> str:
        r = self.r
        before = [self.outside() for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4]))]
        after = [self.outside() for _ in range(r.choice([0, 0, 1, 1, 2, 3]))]
        if r.random() < 0.35:
            after.insert(0, self.comments())
        if r.random() < 0.85:
            after.append(self.foot())
        middle = self.article() if r.random() < 0.97 else ""
        body = "".join(before) + middle + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = self.el("div", body, None, self.name("page", "wrapper", "container", "site", "layout"))
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>{body}</body></html>"


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, fitted on ``pages`` made pages."""
    sequences, labels = [], []
    for i in range(pages):
        found = blocks(PageMaker(seed * 100_003 + i).page())
        if found:
            sequences.append(vectors(found))
            labels.append([b.label == "1" for b in found])
    model = Labeller(sequences[0].shape[1], HIDDEN, seed)
    model.fit(sequences, labels, epochs, seed=seed)
    return model


def main_texts(pages: list[str | None], model: Labeller, together: int = 64) -> list[str]:
    """The article of each page; pages of like length go through the model together."""
    found = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    for k in range(0, len(order), together):
        part = order[k : k + together]
        for i, p in zip(part, model.predict([vectors(found[i]) for i in part])):
            out[i] = " ".join(b.text for b, x in zip(found[i], p) if x >= 0.5)
    return out


def extract_pages(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """``pages`` (html and any others) with ``text``, the whole main text of each row, and ``n_chars``.

    Null and empty pages, and pages without an article, give an empty text. Whole pages are read, however
    long. Every row gives one row; columns called text or n_chars are replaced.
    """
    model = model or trained()

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = batch.tolist()
            yield pd.Series([t for k in range(0, len(rows), 512) for t in main_texts(rows[k : k + 512], model)], dtype=object)

    return pages.withColumn("text", extract(F.col("html"))).withColumn("n_chars", F.char_length("text").cast("bigint"))
