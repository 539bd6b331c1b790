"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags and line
breaks (inline tags do not cut), without comments and the content of raw text
elements (scripts, styles, titles), templates and drawings; character references
are decoded and white space is one space. A block is described by a hashed vector
of its tag path (tags and names of the open elements), a hashed vector of its words
and a few shape figures. A name (of classes, ids and roles) counts by its last word
and as a whole; html, body, the article and what is round it have none. A
bidirectional LSTM in numpy reads the page's blocks in order, so every label rests on
the whole document, and labels each block as main text or not. The main text is the
labelled blocks in page order, joined by one space, without those that stand in an
element that is plainly something else (``outside``): a menu, footer, form and the
like, or an element that is named as one.

Training takes the blocks of at most ``TRAIN_PAGES`` pages (by hash of the page; at
most ``TRAIN_BLOCKS`` neighbouring blocks of ``TRAIN_CHARS`` characters each),
labelled by their semantic elements (inside article or main, and not inside nav,
header of the site, footer, aside, form, advert, notice or comments), and as many
made-up pages that lay such blocks out with other tags, classes and ids; in a
third of them the names say nothing, so that text, links and order have to tell.

Null html is empty; a page without blocks has an empty text. A page of any length
is one sequence; pages are padded to equal length in small groups. Cutting a page
takes time in proportion to its length, however malformed it is, and open elements
share their path. Equal pages get equal texts, repeated rows each their own; an empty
table has nothing to learn from and gives an empty result. The column functions
add one column, so other columns stay, whatever their names; where training found
nothing, made-up pages are all it learns from.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from triageflow.llm import bilstm
from triageflow.llm.common import bound_batches, struct_udf

PATH_DIM, WORD_DIM, SHAPE_DIM = 96, 32, 8
DIM = PATH_DIM + WORD_DIM + SHAPE_DIM
HIDDEN = 16
TRAIN_PAGES = 120
TRAIN_BLOCKS = 200
TRAIN_CHARS = 2000
STEPS, BATCH = 360, 24
GROUP_STEPS = 1 << 14

# HTML's element classes.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form frame frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol optgroup option p pre "
                  "section select summary table tbody td tfoot th thead tr ul video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
SILENT = frozenset("template svg".split())
ENDS_P = BLOCK - {"br", "button", "option", "optgroup"}

_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/><]*+)|<(!--)|<[!?]")
_NAMES = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")

# Words that name what is not main text. As the last word of a name
# they tell what it is (left-sidebar, but not sidebar-article or related-work); the
# second list does so as the first word too, the third as whole names only.
_HEAD = re.compile(r"(nav\w*|menu\w*|footer|header|aside|sidebar|form|ads?|adverts?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|"
                   r"notice|popup|modal|newsletter|subscribe|share|social|related|comments?|replies|reply|breadcrumbs?)")
_FIRST = frozenset("nav navbar navigation menu footer sidebar ad ads advert cookie cookies comment comments breadcrumb breadcrumbs popup modal newsletter".split())
_WHOLE = frozenset("related-posts related-articles related-links related-stories related-content related-items share-buttons share-links "
                   "social-links social-icons social-buttons social-media notice-box banner-ad promo-box".split())
_SHELL = frozenset("content main article post entry story text body page wrapper container site layout has with".split())
#: Whole names of elements that hold the main text.
MAIN_NAMES = ["content", "main", "post", "entry", "story", "article-body", "main-content", "post-content", "text", "entry-content", "page-body"]
_MAIN = frozenset(MAIN_NAMES)


class Path:
    """Open elements of a block, from the root on; the elements of a page share
    those round them. ``vector`` sums the hashed names on the way, ``article``:
    some element is the article or main, ``body``: or is named as the text,
    ``plain``: the tag of some element tells that it is not main text, ``vetoed``:
    or its name does."""

    __slots__ = ("parent", "frame", "depth", "article", "body", "tagged", "plain", "vetoed", "vector")

    def __init__(self, parent: Path | None, frame: tuple[str, ...]):
        tag = frame[0]
        root = tag in ("<article", "<main")
        self.parent, self.frame, self.depth = parent, frame, 1 + (parent.depth if parent else 0)
        self.article = root or bool(parent and parent.article)
        self.body = self.article or not _MAIN.isdisjoint(frame[1:]) or bool(parent and parent.body)
        self.tagged = tag in OUTSIDE_TAGS or bool(parent and parent.tagged)
        self.plain = tag in OUTSIDE_TAGS | {"<button", "<select"} or (tag == "<header" and not (parent and parent.article)) or bool(parent and parent.plain)
        # names of the page's shell, of the article and what is round it tell nothing, nor do those of headings and paragraphs in it
        named = not (tag in ("<html", "<body") or root or (parent is not None and parent.article and tag in PROSE))
        above = None if root else parent
        self.vetoed = (named and names_other(frame)) or bool(above and above.vetoed)
        self.vector = np.zeros(PATH_DIM, np.float32) if above is None else above.vector
        if tag not in ("<html", "<body"):
            self.vector = self.vector.copy()
            for t in (frame if named else frame[:1]):
                for salt in (b"", b"+"):
                    h = crc32(salt + t.encode())
                    self.vector[h % PATH_DIM] += 1.0 if h >> 20 & 1 else -1.0

    def __iter__(self):
        frames, at = [], self
        while at is not None:
            frames.append(at.frame)
            at = at.parent
        return reversed(frames)

    def __getitem__(self, k):
        return tuple(self)[k]

    def __eq__(self, other) -> bool:
        return tuple(self) == tuple(other)

    __hash__ = None


OUTSIDE_TAGS = frozenset("<nav <footer <aside <form <menu <dialog".split())
PROSE = frozenset("<h1 <h2 <h3 <h4 <h5 <h6 <p".split())


def path_of(frames) -> Path | None:
    """The path of frames from the root on."""
    at = None
    for f in frames:
        at = Path(at, tuple(f))
    return at


def names_other(frame: tuple[str, ...]) -> bool:
    """The names of an element tell that it holds something else than main text."""
    if not _SHELL.isdisjoint(frame[1:]):
        return False
    for name in frame[1:]:
        first, _, rest = name.partition("-")
        last = name.rpartition("-")[2]
        if name in _WHOLE or _HEAD.fullmatch(last) or (rest and first in _FIRST and last not in _SHELL):
            return True
    return False


def frame(tag: str, attrs: str) -> tuple[str, ...]:
    """Path tokens of an open element: its tag, and of each of its names the last
    word and the whole."""
    out = [f"<{tag}"]
    if attrs:
        for m in _NAMES.finditer(attrs):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                words = _WORD.findall(name)
                out += words[-1:] + (["-".join(words)] if len(words) > 1 else [])
    return tuple(out)


class Scanner:
    """Ends of tags in a page, each place looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.memo, self.cache = page, {}, {}

    def next_of(self, marks: str, at: int) -> int:
        """First place at or after ``at`` of one of ``marks``, or the page's length."""
        start, found = self.cache.get(marks, (1, 0))
        if not start <= at <= found:
            m = _MARKS[marks].search(self.page, at)
            found = m.start() if m else len(self.page)
            self.cache[marks] = (at, found)
        return found

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes begin at ``at``: the first
        outside quotes; if there is none, the first before another ``<``; else -1."""
        chain, end, k = [], -1, at
        while True:
            k = self.next_of("\"'>", k)
            if k in self.memo:
                end = self.memo[k]
                break
            if k == len(self.page):
                break
            chain.append(k)
            if self.page[k] == ">":
                end = k
                break
            k = self.next_of(self.page[k], k + 1) + 1
            if k > len(self.page):
                break
        self.memo.update(dict.fromkeys(chain, end))
        if end < 0:
            k = self.next_of("<>", at)
            end = k if self.page[k:k + 1] == ">" else -1
        return end


_MARKS = {m: re.compile(f"[{m}]") for m in ("\"'>", "<>", "\"", "'", ">")}


def blocks(page: str | None) -> list[tuple[str, Path | tuple, float]]:
    """(text, path of the open elements, share of the text in links) of every
    leaf block, in page order."""
    page = page or ""
    out, paths, names, held = [], [None], [], []
    count: Counter = Counter()
    linked = 0
    scan = Scanner(page)

    def end() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, paths[-1] or (), min(1.0, linked / max(1, sum(map(len, held))))))
            held.clear()
        linked = 0

    def put(s: str) -> None:
        nonlocal linked
        if s and not (count["template"] or count["svg"]):
            held.append(s)
            if count["a"]:
                linked += len(s)

    def pop_to(k: int) -> None:
        for name in names[k:]:
            count[name] -= 1
        del names[k:], paths[k + 1:]

    def last(name: str) -> int:
        k = len(names) - 1
        while names[k] != name:
            k -= 1
        return k

    at = 0  # text from here on is not yet put
    m = _OPEN.search(page)
    while m:
        put(page[at:m.start()])
        tag = (m[2] or "").lower()
        if m[3]:
            close = page.find("-->", m.end())
            stop = len(page) if close < 0 else close + 3
        elif not tag:
            close = scan.next_of(">", m.end())
            stop = close + 1 if close < len(page) else m.start()
        else:
            close = scan.tag_end(m.end())
            stop = close + 1 if close >= 0 else m.start()
        if stop == m.start():  # no tag after all
            put(page[m.start():m.end()])
            at = m.end()
            m = _OPEN.search(page, at)
            continue
        at = stop
        if tag:
            attrs = page[m.end():close]
            if tag in BLOCK:
                end()
            if m[1]:
                if count[tag]:
                    pop_to(last(tag))
            elif tag in RAW:
                raw = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = raw.start() if raw else len(page)
            else:
                if tag in ENDS_P and count["p"] and not (count["template"] and last("template") > last("p")):
                    pop_to(last("p"))
                if tag == "li" and count["li"]:
                    k = last("li")
                    if not any(x in ("ul", "ol", "menu") for x in names[k:]):
                        pop_to(k)
                if tag not in VOID and not attrs.endswith("/"):
                    names.append(tag)
                    paths.append(Path(paths[-1], frame(tag, attrs)))
                    count[tag] += 1
        m = _OPEN.search(page, at)
    put(page[at:])
    end()
    return out


_words: dict[str, int] = {}


def features(page_blocks) -> np.ndarray:
    """(blocks, DIM) description of a page's blocks."""
    x = np.zeros((len(page_blocks), DIM), np.float32)
    for k, (text, path, linked) in enumerate(page_blocks):
        row = x[k]
        if path:
            row[:PATH_DIM] = np.clip(path.vector, -3, 3)
        ws = text.lower().split(" ")
        hs = []
        for w in ws:
            h = _words.get(w)
            if h is None:
                if len(_words) > 1 << 17:
                    _words.clear()
                h = _words[w] = crc32(w.encode("utf-8", "replace")) % WORD_DIM
            hs.append(h)
        row[PATH_DIM:PATH_DIM + WORD_DIM] = np.bincount(hs, minlength=WORD_DIM) / np.sqrt(len(hs)) * 0.3
        row[PATH_DIM + WORD_DIM:] = (np.log1p(len(text)) / 5, np.log1p(len(ws)) / 4, linked, text[-1] in ".!?", k / len(page_blocks),
                                     min(k, 10) / 10, min(len(page_blocks) - k, 10) / 10, "©" in text)
    return x


def semantic_label(path: Path | tuple) -> bool:
    """Main text by semantic elements and the names around them."""
    return bool(path) and path.article and not path.plain and not path.vetoed


def outside(path: Path | tuple) -> bool:
    """Some open element is a menu, footer, sidebar, form or dialog, or is named as
    something else than main text: such blocks are never kept."""
    return bool(path) and (path.tagged or path.vetoed)


# How made-up pages name what they lay out (besides MAIN_NAMES).
OTHER_NAMES = ["menu", "navbar", "navigation", "sidebar", "footer", "site-header", "ad", "advert", "advertisement", "sponsored", "promo", "banner",
               "cookie-notice", "notice", "consent", "popup", "newsletter", "subscribe-form", "share", "social", "related", "comments", "comment-list",
               "reply", "breadcrumbs", "copyright", "login-form", "widget"]
OTHER_TAGS = ["nav", "footer", "aside", "header", "form", "div", "section", "ul"]


def made_up(rng: np.random.Generator, texts: list[str]):
    """Blocks and labels of a page in a layout of its own."""
    text = lambda: texts[int(rng.integers(len(texts)))]
    short = lambda: " ".join(text().split(" ")[:int(rng.integers(1, 5))])
    silent = rng.random() < 0.33
    attr = lambda names: f' class="{"x%d" % rng.integers(1000) if silent else names[int(rng.integers(len(names)))]}"'
    shell = [frame("html", ""), frame("body", "")] + [frame("div", attr(["wrapper", "container", "page", "site"]))] * int(rng.integers(0, 2))
    out = []

    def other(inside=()):
        tag = "div" if silent else str(rng.choice(OTHER_TAGS))
        root = [*shell, *inside, frame(tag, attr(OTHER_NAMES) if silent or tag in ("div", "section", "ul") or rng.random() < 0.3 else "")]
        for _ in range(int(rng.integers(1, 6))):
            inner = [[("<ul",), ("<li",), ("<a",)], [("<p",)], [], [("<div",)], [("<a",)]][int(rng.integers(5))]
            link = silent or any(f[0] == "<a" for f in inner)
            out.append(((short() if link or rng.random() < 0.5 else text()), path_of(root + inner), float(link), 0))

    for _ in range(int(rng.integers(0, 4))):
        other()
    kind = rng.random()
    root = ([frame("div", attr(["x"]))] if silent else [("<article",)] if kind < 0.4 else [("<main",)] if kind < 0.5 else
            [frame(str(rng.choice(["div", "section", "article", "main"])), attr(MAIN_NAMES))])
    if not silent and rng.random() < 0.3:
        root = [("<main",), *root]
    if rng.random() < 0.8:
        out.append((short(), path_of(shell + root + [[("<header",), ("<h1",)], [("<h1",)]][int(rng.random() < 0.8)]), 0.0, 1))
    for _ in range(int(rng.integers(1, 12))):
        inner = [[("<p",)], [("<p",)], [("<p",), ("<b",)], [("<h2",)], [("<ul",), ("<li",)], [("<blockquote",), ("<p",)], [("<table",), ("<tr",), ("<td",)],
                 [], [("<pre",)], [("<div",), ("<p",)], [("<section", "work", f"{rng.choice(OTHER_NAMES)}-work"), ("<p",)]][int(rng.integers(11))]
        out.append((short() if rng.random() < 0.2 and not silent else text(), path_of(shell + root + inner), float(rng.random() * 0.4 * (rng.random() < 0.3)), 1))
        if not silent and rng.random() < 0.08:
            other(root)
    for _ in range(int(rng.integers(0, 5))):
        other()
    return [o[:3] for o in out], np.array([o[3] for o in out], np.float32)


def logits(p: dict, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """(T, B) scores of blocks being main text; x is (T, B, DIM)."""
    a, b = ([], []) if keep is not None else (None, None)
    fw = bilstm.run(x @ p["xf"] + p["bf"], p["hf"], mask, a)
    bw = bilstm.run(x[::-1] @ p["xb"] + p["bb"], p["hb"], mask[::-1], b)[::-1]
    both = np.concatenate([fw, bw], 2)
    if keep is not None:
        keep.update(a=a, b=b, both=both)
    return (both @ p["o"] + x @ p["d"])[:, :, 0] + p["c"]


def _pad(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, max(map(len, xs)))
    x, mask = np.zeros((steps, len(xs), DIM), np.float32), np.zeros((steps, len(xs)), np.float32)
    for b, one in enumerate(xs):
        x[:len(one), b] = one
        mask[:len(one), b] = 1
    return x, mask


def train(pages: list[list], seed: int = 11, steps: int = STEPS) -> dict:
    """Fit on the blocks of real pages, by semantic labels, and of made-up ones."""
    rng = np.random.default_rng(seed)
    pages = [p for p in pages if p]
    real = [(features(p), np.array([semantic_label(b[1]) for b in p], np.float32)) for p in pages]
    real = [(x, y) for x, y in real if y.any()]  # without semantic elements there is nothing to learn from
    texts = [b[0] for p in pages for b in p] or ["lorem ipsum dolor sit amet.", "consectetur adipiscing elit, sed do eiusmod."]
    p = {"xf": bilstm.start(rng, DIM, 4 * HIDDEN), "hf": bilstm.start(rng, HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN, np.float32),
         "xb": bilstm.start(rng, DIM, 4 * HIDDEN), "hb": bilstm.start(rng, HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN, np.float32),
         "o": bilstm.start(rng, 2 * HIDDEN, 1), "d": np.zeros((DIM, 1), np.float32), "c": np.zeros(1, np.float32)}
    adam = bilstm.Adam(p)
    for step in range(steps):
        some = []
        for _ in range(BATCH):
            if real and rng.random() < 0.4:
                some.append(real[int(rng.integers(len(real)))])
            else:
                made, y = made_up(rng, texts)
                some.append((features(made), y))
        x, mask = _pad([s[0] for s in some])
        y = np.zeros(mask.shape, np.float32)
        for b, (_, one) in enumerate(some):
            y[:len(one), b] = one
        kept: dict = {}
        z = logits(p, x, mask, kept)
        dz = ((1 / (1 + np.exp(-z)) - y) * mask / mask.sum())[:, :, None]
        both = kept["both"]
        dboth = dz @ p["o"].T
        dxf, dhf = bilstm.back(np.ascontiguousarray(dboth[:, :, :HIDDEN]), p["hf"], kept["a"])
        dxb, dhb = bilstm.back(np.ascontiguousarray(dboth[::-1, :, HIDDEN:]), p["hb"], kept["b"])
        flat = x.reshape(-1, DIM)
        adam.step({"xf": flat.T @ dxf.reshape(-1, 4 * HIDDEN), "hf": dhf, "bf": dxf.sum((0, 1)),
                   "xb": x[::-1].reshape(-1, DIM).T @ dxb.reshape(-1, 4 * HIDDEN), "hb": dhb, "bb": dxb.sum((0, 1)),
                   "o": both.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1), "d": flat.T @ dz.reshape(-1, 1), "c": dz.sum((0, 1))},
                  rate=0.02 * (1 - step / steps) + 0.001)
    return p


def labelled(p: dict, pages: list[list]) -> list[np.ndarray]:
    """Per page, which blocks are main text."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        longest, group = 0, []
        while order and (not group or max(longest, len(pages[order[0]])) * (len(group) + 1) <= GROUP_STEPS):
            longest = max(longest, len(pages[order[0]]))
            group.append(order.pop(0))
        x, mask = _pad([features(pages[i]) for i in group])
        z = logits(p, x, mask)
        for b, i in enumerate(group):
            out[i] = z[:len(pages[i]), b] > 0
    return out


def extract(p: dict, htmls: list[str | None]):
    """Main text per page."""
    for k in range(0, len(htmls), 256):
        pages = [blocks(h) for h in htmls[k:k + 256]]
        for page, keep in zip(pages, labelled(p, pages)):
            yield " ".join(b[0] for b, yes in zip(page, keep) if yes and not outside(b[1]))


def training_pages(pages: DataFrame, html: str = "html", rows: int = TRAIN_PAGES, most: int = TRAIN_BLOCKS) -> list[list]:
    """Blocks of at most ``rows`` distinct pages in the order of a hash, ``most``
    neighbouring blocks of each from its middle outwards."""
    bound_batches(pages.sparkSession)
    base = pages.where(F.col(html).isNotNull()).select(F.xxhash64(html).alias("h"), F.col(html).alias("html"))
    first = [r.h for r in base.select("h").distinct().orderBy("h").limit(rows).collect()]
    if not first:
        return []
    base = base.where(F.col("h").isin(first)).groupBy("h").agg(F.min("html").alias("html"))

    def cut(htmls):
        for h in htmls:
            bs = blocks(h)
            at = max(0, (len(bs) - most) // 2)
            yield ([{"text": t[:TRAIN_CHARS], "path": [list(f) for f in path], "linked": linked} for t, path, linked in bs[at:at + most]],)

    udf = struct_udf("b array<struct<text:string,path:array<array<string>>,linked:double>>", cut)
    got = base.select("h", udf("html").alias("b")).select("h", "b.b").collect()
    return [[(x.text, path_of(x.path) or (), x.linked) for x in r.b] for r in sorted(got, key=lambda r: r.h)]


def fit(pages: DataFrame, html: str = "html", rows: int = TRAIN_PAGES) -> dict:
    return train(training_pages(pages, html, rows))


def main_text(spark: SparkSession, model: dict):
    """Column function html -> struct(text, n_chars)."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # weights, about 100 KB
    return struct_udf("text string, n_chars bigint", lambda htmls: ((t, len(t)) for t in extract(shared.value, htmls)))
