"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, with the open elements above
them.  Features of a block are its ancestors' tags and class words, and the shape of its text (length,
share of link text, marks, place on the page).  A chain over the blocks scores each block and each
pair of neighbours; the weights maximise the conditional likelihood of labelled pages, and Viterbi
decoding gives the best labelling of a page.

The labelled pages are built here: page layouts in many variants are filled with words of a bounded
sample of the given pages (``SAMPLE_PAGES`` of at most ``SAMPLE_BYTES``, picked by hash of id), so the label of every block is
known.  The layouts are ordinary HTML idioms; no page is labelled by hand.

Definitions for odd input: NULL or empty html gives the empty text; unclosed and stray tags are
tolerated; text outside any element is a block of its own; pages are read one by one, so repeated
rows give repeated results; an empty table gives an empty table and is not trained on.
"""

from __future__ import annotations

import bisect
import html as entities
import random
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import per_process, slices, table

SAMPLE_PAGES = 200  # pages whose words fill the layouts
SAMPLE_BYTES = 64 << 10  # only pages up to this size lend words
LABELLED_PAGES = 400
EPOCHS, RATE, DECAY = 6, 0.3, 1e-4
SEED = 7
MAX_PATHS = 50_000  # ancestor paths whose score a worker remembers

# fixed values: element kinds of HTML
RAW = {"script", "style", "title", "iframe"}  # hold text only, up to their first end tag or the end of the page
SKIPPED = {"script", "style", "template", "noscript", "svg", "math", "head", "title", "iframe", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
OWN_KIND = {"li", "dt", "dd", "tr", "td", "th", "option"}  # closed by the next of their kind

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>\x00]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?",
    re.S,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("path", "text", "link")

    def __init__(self, path: tuple[str, ...], text: str, link: int):
        self.path, self.text, self.link = path, text, link


def _names(attributes: str) -> str:
    if "=" not in attributes:
        return ""
    words = [w for m in NAMES.finditer(attributes) for w in PART.findall((m[1] or m[2] or m[3] or "").lower())]
    return "".join("." + w for w in sorted(set(words)))


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each element ``tag``, which may hold its like, ends, by where its start tag ends; an open one is not there."""
    found: dict[int, int] = {}
    opened: list[int] = []
    name = rf"{re.escape(tag)}(?=[\s/>]|\Z)"
    for m in re.compile(rf"</{name}[^>]*>|<{name}((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.I).finditer(page):
        if m[1] is None:
            if opened:
                found[opened.pop()] = m.end()
        elif not (tag in ("svg", "math") and m[1].endswith("/")):
            opened.append(m.end())
    return found


def _end(page: str, at: int, tag: str, known: dict) -> int:
    """Where the element opened before ``at`` ends, 0 if never; each page is searched once per tag."""
    if tag not in RAW:
        if tag not in known:
            known[tag] = _ends(page, tag)
        return known[tag].get(at, 0)
    if tag not in known:
        closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
        known[tag] = [(m.start(), m.end()) for m in closing.finditer(page)]
    found = bisect.bisect_left(known[tag], (at, 0))
    return known[tag][found][1] if found < len(known[tag]) else 0


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; an element of a path is ``tag.word.word`` (class, id and role words)."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    ends: dict = {}
    link, in_link, at, size = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal link
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                out.append(Block(tuple(e for t, e in stack if t not in INLINE), words, link))
            text.clear()
        link = 0

    def pop_to(tag: str, stop: set[str]) -> bool:
        nonlocal in_link
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                in_link -= sum(t == "a" for t, _ in stack[i:])
                del stack[i:]
                return True
            if stack[i][0] in stop:
                return False
        return False

    while at < size:
        m = TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            part = page[at:stop]
            text.append(part)
            if in_link:
                link += len(part.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in INLINE:
                pop_to(tag, CLOSES_P)
            else:
                flush()
                pop_to(tag, set())
            continue
        if tag in SKIPPED:
            if tag in ("svg", "math") and m[3].endswith("/"):
                continue
            end = _end(page, at, tag, ends)
            if end:
                flush() if tag not in INLINE else None
                at = end
            elif tag in RAW:
                at = size
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                text.append(" ")
                continue
            if tag == "a" and in_link:
                pop_to("a", CLOSES_P)
        else:
            flush()
            if tag in CLOSES_P:
                pop_to("p", {"div", "article", "section", "td", "li", "main", "body", "aside", "footer", "header", "nav", "form", "blockquote"})
            elif tag in OWN_KIND:
                pop_to(tag, {"ul", "ol", "dl", "table", "select"})
        if tag not in VOID and not m[3].endswith("/"):
            stack.append((tag, tag + _names(m[3])))
            in_link += tag == "a"
    flush()
    return out


def path_features(path: tuple[str, ...]) -> list[str]:
    out = []
    tags = [e.partition(".")[0] for e in path]
    for depth, (tag, element) in enumerate(zip(reversed(tags), reversed(path), strict=True)):
        out.append(f"in:{tag}")
        if depth < 2:
            out.append(f"up{depth}:{tag}")
        for word in element.split(".")[1:]:
            out.append(f"name:{word}")
            if depth == 0:
                out.append(f"own:{word}")
    return sorted(set(out)) + [f"deep:{min(len(path), 8)}"]


def text_features(block: Block, place: float) -> list[str]:
    text = block.text
    n = text.count(" ") + 1
    return [
        "bias",
        f"words:{min(7, n.bit_length())}",
        f"link:{min(4, int(4 * block.link / max(1, len(text))))}",
        f"stop:{text[-1] in '.!?:;…'}",
        f"commas:{min(2, text.count(','))}",
        f"sign:{'©' in text or '|' in text or '·' in text}",
        f"place:{int(place * 4)}",
        f"digits:{n < 20 and any(map(str.isdigit, text))}",
    ]


class Model:
    """Weights for the label ``main`` and for pairs of neighbouring labels."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.weights = np.zeros(0)
        self.pairs = np.zeros((2, 2))
        self.table: dict[str, float] = {}
        self.paths: dict[tuple[str, ...], float] = {}

    @classmethod
    def of(cls, table: dict[str, float], pairs: list[list[float]]) -> Model:
        model = cls()
        model.table, model.pairs = table, np.array(pairs)
        return model

    def features(self, found: list[Block]) -> list[list[str]]:
        n = max(1, len(found) - 1)
        return [path_features(b.path) + text_features(b, i / n) for i, b in enumerate(found)]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]]) -> Model:
        """Stochastic gradient ascent (AdaGrad) on the conditional log-likelihood."""
        for features, _ in pages:
            for f in features:
                for name in f:
                    self.ids.setdefault(name, len(self.ids))
        self.weights = np.zeros(len(self.ids))
        seen, seen_pairs = np.full(len(self.ids), 1e-6), np.full((2, 2), 1e-6)
        rows = [([np.array([self.ids[n] for n in f]) for f in features], np.array(labels)) for features, labels in pages if labels]
        pick = random.Random(SEED)
        for _ in range(EPOCHS):
            pick.shuffle(rows)
            for features, labels in rows:
                unary = np.array([self.weights[f].sum() for f in features])
                single, double = marginals(unary, self.pairs)
                error = labels - single
                step = np.zeros_like(self.weights)
                for f, e in zip(features, error, strict=True):
                    step[f] += e
                step -= DECAY * self.weights
                seen += step * step
                self.weights += RATE * step / np.sqrt(seen)
                real = np.zeros((2, 2))
                np.add.at(real, (labels[:-1], labels[1:]), 1)
                step_pairs = real - double - DECAY * self.pairs
                seen_pairs += step_pairs * step_pairs
                self.pairs += RATE * step_pairs / np.sqrt(seen_pairs)
        self.table = {n: float(self.weights[i]) for n, i in self.ids.items()}
        return self

    def score(self, block: Block, place: float) -> float:
        table = self.table
        own = self.paths.get(block.path)
        if own is None:
            if len(self.paths) >= MAX_PATHS:
                self.paths.clear()
            own = self.paths[block.path] = sum(table.get(f, 0.0) for f in path_features(block.path))
        return own + sum(table.get(f, 0.0) for f in text_features(block, place))

    def label(self, found: list[Block]) -> list[int]:
        n = max(1, len(found) - 1)
        return viterbi([self.score(b, i / n) for i, b in enumerate(found)], self.pairs.tolist())

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, main in zip(found, self.label(found), strict=True) if main)


def viterbi(unary: list[float], pairs: list[list[float]]) -> list[int]:
    """The best labelling; ties go to ``not main``."""
    if not unary:
        return []
    (p00, p01), (p10, p11) = pairs
    a, b, back = 0.0, unary[0], []
    for u in unary[1:]:
        x0, x1, y0, y1 = a + p00, b + p10, a + p01, b + p11
        back.append((x1 > x0, y1 > y0))
        a, b = (x1 if x1 > x0 else x0), (y1 if y1 > y0 else y0) + u
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def marginals(unary: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(main) per block, and the expected counts of neighbouring labels."""
    n = len(unary)
    local = np.stack((np.zeros(n), unary), 1)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = local[0]
    for i in range(1, n):
        ahead[i] = local[i] + np.logaddexp(ahead[i - 1, 0] + pairs[0], ahead[i - 1, 1] + pairs[1])
    for i in range(n - 2, -1, -1):
        x = local[i + 1] + behind[i + 1]
        behind[i] = np.logaddexp(pairs[:, 0] + x[0], pairs[:, 1] + x[1])
    total = np.logaddexp(*ahead[-1])
    single = np.exp(ahead[:, 1] + behind[:, 1] - total)
    double = np.zeros((2, 2))
    if n > 1:
        double = np.exp(ahead[:-1, :, None] + pairs + (local[1:] + behind[1:])[:, None, :] - total).sum(0)
    return single, double


MAIN = ""  # marks the blocks of the main text in a built page


class Layouts:
    """Labelled pages: layouts in random variants, filled with given words."""

    def __init__(self, words: list[str], seed: int = SEED):
        self.words, self.pick = words or ["word", "text"], random.Random(seed)

    def some(self, low: int, high: int) -> str:
        start = self.pick.randrange(len(self.words))
        n = self.pick.randint(low, high)
        return entities.escape(" ".join((self.words[start:] + self.words)[:n]), quote=False)

    def one(self, *options: str) -> str:
        return self.pick.choice(options)

    def named(self, tags: str, names: str) -> tuple[str, str]:
        tag, name = self.one(*tags.split()), self.one(*names.split())
        named = f' {self.one("class", "id")}="{name}"' if tag in ("div", "section", "ul", "td", "span") or self.pick.random() < 0.3 else ""
        return f"<{tag}{named}>", f"</{tag}>"

    def links(self, n: int) -> str:
        items = "".join(f'<li><a href="/{i}">{self.some(1, 3)}</a></li>' for i in range(n))
        return f"<ul>{items}</ul>" if self.pick.random() < 0.7 else items.replace("<li>", " ").replace("</li>", self.one(" | ", " ", ""))

    def wrap(self, tags: str, names: str, inner: str) -> str:
        start, end = self.named(tags, names)
        return start + inner + end

    def menu(self) -> str:
        return self.wrap("nav nav div ul", "menu nav navbar navigation breadcrumb topnav main-menu", self.links(self.pick.randint(2, 9)))

    def head(self) -> str:
        inner = self.one("<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>", "<h2>{}</h2>", "{}").format(self.some(1, 6))
        return self.wrap("header header div", "header masthead banner site-header top logo", inner + (self.menu() if self.pick.random() < 0.3 else ""))

    def foot(self) -> str:
        inner = self.one("&copy; {}", "<p>&copy; 2020 {}</p>", "<p>{}</p>", "{} &middot; {}", "<small>{}</small>")
        text = inner.replace("{}", self.some(1, 25))
        return self.wrap("footer footer div", "footer site-footer bottom copyright colophon", text + (self.links(3) if self.pick.random() < 0.4 else ""))

    def side(self) -> str:
        inner = f"<h3>{self.some(1, 4)}</h3>" + self.one(self.links(4), f"<p>{self.some(3, 40)}</p>")
        return self.wrap("aside aside div", "sidebar side widget related recommended popular more-stories", inner)

    def advert(self) -> str:
        return self.wrap("div div ins aside", "ad ads advert advertisement sponsored promo banner-ad", self.one("{}", "<p>{}</p>").format(self.some(2, 30)))

    def notice(self) -> str:
        inner = f"<p>{self.some(4, 30)}</p>" + self.one("", "<button>{}</button>", '<a href="#">{}</a>').format(self.some(1, 2))
        return self.wrap("div section", "cookie cookie-notice consent gdpr notice alert popup newsletter subscribe", inner)

    def form(self) -> str:
        return f'<form action="/x"><label>{self.some(1, 3)}</label><input name="q"><p>{self.some(2, 15)}</p><button>{self.some(1, 2)}</button></form>'

    def share(self) -> str:
        return self.wrap("div ul", "share social tags meta byline toolbar", self.links(3))

    def comments(self) -> str:
        each = "".join(
            self.wrap("div li article", "comment reply comment-body", f"<b>{self.some(1, 2)}</b>" + self.one("<p>{}</p>", "{}").format(self.some(3, 60)))
            for _ in range(self.pick.randint(1, 5))
        )
        return self.wrap("section div", "comments responses discussion comment-list", f"<h3>{self.some(1, 3)}</h3>" + each)

    def paragraph(self) -> str:
        text = MAIN + self.some(1, 90) + self.one(".", ".", ".", "")
        return self.one(
            f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li></ul>",
            f"<h2>{text}</h2>", f'<p>{text} <a href="/y">{self.some(1, 3)}</a> {self.some(1, 9)}</p>', f"<pre>{text}</pre>", f"<div>{text}</div>",
        )

    def main(self) -> str:
        body = [f"<h1>{MAIN}{self.some(2, 12)}</h1>"] if self.pick.random() < 0.8 else []
        for _ in range(self.pick.randint(1, 14)):
            body.append(self.paragraph())
            if self.pick.random() < 0.08:
                body.append(self.one(self.advert(), self.side(), self.share(), self.form(), self.notice()))
        inner = "".join(body)
        start, end = self.named("article article article main div div section td", "content article post entry-content article-body story main-content post-body text")
        if self.pick.random() < 0.2:
            inner += self.comments()
        out = start + inner + end
        return f"<main>{out}</main>" if self.pick.random() < 0.2 else out

    def page(self) -> str:
        some = lambda p, part: part() if self.pick.random() < p else ""
        before = [some(0.4, self.head), some(0.8, self.menu), some(0.4, self.advert), some(0.25, self.notice), some(0.2, self.side), some(0.15, self.form)]
        after = [some(0.3, self.side), some(0.3, self.comments), some(0.2, self.form), some(0.3, self.advert), some(0.2, self.notice), some(0.8, self.foot)]
        self.pick.shuffle(before)
        page = "<html><head><title>" + self.some(2, 8) + "</title></head><body>" + "".join(before) + self.main() + "".join(after)
        return page + self.one("</body></html>", "")


def labelled(words: list[str], n: int = LABELLED_PAGES, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    layouts, out = Layouts(words, seed), []
    for _ in range(n):
        found = blocks(layouts.page())
        marks = [int(MAIN in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(MAIN, "").strip() or "-"
        out.append((found, marks))
    return out


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> Model | None:
    """Fit on layouts filled with words of the sample; None for an empty table."""
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{html}`").cast("string").alias("html"))
    total = rows.count()
    if not total:
        return None
    rate = min(1.0, 2 * SAMPLE_PAGES / total)
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    near = rows.where((mark < int(rate * (1 << 20)) + 1) & (F.octet_length("html") <= SAMPLE_BYTES))
    found = near.orderBy(mark, "id", "html").limit(SAMPLE_PAGES).collect()
    words = [w for r in found for b in blocks(r.html) for w in b.text.split()]
    model = Model()
    return model.fit([(model.features(f), marks) for f, marks in labelled(words)])


def extract(pages: DataFrame, model: Model | None, *, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep``, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model and (model.table, model.pairs.tolist()))
    label = uuid.uuid4().hex
    names = [*keep]
    source = pages.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{html}`").cast("string").alias("__html"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value and per_process(("crf", label), lambda: Model.of(*shared.value))
        for piece in slices(batches, "__html"):
            texts = [model.text(h) if model else "" for h in piece.column("__html").to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(names))), *made], [*names, "text", "n_chars"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(work, types + "text string, n_chars long")


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract(pages, train(pages))
