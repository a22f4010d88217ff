"""HTML extraction by a recurrent block labeller (operator 6).

A page becomes the sequence of its leaf blocks: the runs of text between block-level tags. A bidirectional LSTM,
written and trained in numpy, reads for each block a vector of its tag path, a vector of its hashed words and a few
numbers, and labels it as main text or not, with the whole page as context. It learns from pages that `sample_page`
makes up: articles under many layouts, with menus, headers, footers, sidebars, notices, adverts, forms and comments.

Never part of a text: the content of head, title, script, style, template and iframe, and form controls (textarea,
select, option, button), which count as forms. All other elements' text is read; formulas and drawings (math, svg) don't
break the block that they are in.

Defined cases: null or empty html, an empty table, and pages without a main block, give the empty string or no rows;
unclosed elements end where their parent does, an unclosed head or title at the first tag (for a head: or text) that
can't be inside a head, and unclosed comments, scripts and styles run to the end of the page; pages of any length and
elements nested to any depth are read whole, in memory in proportion to the page (one page at a time if they are long);
a page's text depends on the page only, so repeated rows get equal texts; columns called text or n_chars are replaced,
all others stay.
"""

from __future__ import annotations

import html
import re
import zlib
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that don't break a block, elements without content, and elements whose content is no text.
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark math noscript object q s samp small span strike strong sub sup svg time tt u var video wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title script style template iframe textarea select option button".split())
#: Elements inside which no tag breaks a block.
DRAWN = ("math", "svg")
#: Start tags that don't end an open head.
IN_HEAD = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
#: An open element of these is ended by another one of the same name in the same parent.
SIBLINGS = frozenset("li dt dd tr td th option".split())
PARENTS = ("ul", "ol", "dl", "table", "select")
BREAKS_P = frozenset("address article aside blockquote details dl div fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

TOKEN = re.compile(
    # a title that has its end tag holds no tags
    r"<!--.*?(?:-->|\Z)|(?P<title><title(?:\s[^>]*+)?+(?<!/)>[^<]*+(?:<(?!/?(?:title|head|body)\b)[^<]*+)*+</title\s*>)|<(?P<raw>script|style|template|textarea|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?>[^\"'>]|\"[^\"]*\"|'[^']*'|[\"'])*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME = re.compile(r"[A-Za-z]+")

PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 96, 48, 8, 16
DIM = PATH_DIM + WORD_DIM + NUMBERS
#: Blocks (padding included) of the pages that are read together.
GROUP = 20_000


def slot(name: str, dim: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % dim


class Block(NamedTuple):
    text: str
    #: How often each slot of the tag path is there, two at most; shared by the blocks of an element.
    path: np.ndarray
    #: Characters inside links.
    linked: int


class Element(NamedTuple):
    tag: str
    breaks: bool
    path: np.ndarray


class Parser:
    """Blocks of pages; remembers the slots of words and attributes that it has met, up to a bound."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.tags: dict[tuple[str, str], list[int]] = {}

    def path_slots(self, tag: str, attributes: str) -> list[int]:
        key = (tag, attributes)
        if (out := self.tags.get(key)) is None:
            names = [tag]
            for m in ATTRIBUTE.finditer(attributes):
                names += ["." + x.lower() for x in NAME.findall(m[2] or m[3] or m[4] or "")]
            out = [slot(x, PATH_DIM) for x in names]
            if len(attributes) < 200:  # longer ones rarely come again
                if len(self.tags) > 50_000:
                    self.tags.clear()
                self.tags[key] = out
        return out

    def blocks(self, page: str) -> list[Block]:
        """The leaf blocks in page order; each step looks at the places of a few open elements only."""
        out: list[Block] = []
        stack = [Element("", True, np.zeros(PATH_DIM, np.uint8))]
        places: dict[str, list[int]] = {}  # of the open elements of each name, outermost first
        parts: list[str] = []
        linked = hidden = at = 0

        def innermost(*tags: str) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def end() -> None:
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    out.append(Block(text, stack[-1].path, linked))
                parts.clear()
            linked = 0

        def close(k: int) -> None:
            """End the elements from the k-th on."""
            nonlocal hidden
            if any(e.breaks for e in stack[k:]):
                end()
            for e in stack[k:]:
                hidden -= e.tag in DROPPED
                places[e.tag].pop()
            del stack[k:]

        def words_in_head(a: int, b: int) -> None:
            """End an open head before text from a to b that lies in none of its elements."""
            if hidden and stack[-1].tag == "head" and page[a:b].strip(" \t\n\f\r"):
                close(len(stack) - 1)

        for m in TOKEN.finditer(page):
            if m.start() > at:
                words_in_head(at, m.start())
                if not hidden:
                    text = page[at : m.start()]
                    parts.append(text)
                    if places.get("a"):
                        linked += len(text)
            at = m.end()
            if not m["tag"]:
                if m["raw"] or m["title"]:
                    end()
                continue
            tag = m["tag"].lower()
            breaks = tag not in INLINE and not innermost(*DRAWN)
            if m["end"]:
                if k := innermost(tag):
                    close(k)
                elif breaks:
                    end()
                continue
            if hidden and tag not in IN_HEAD and (k := min((places[t][0] for t in ("head", "title") if places.get(t)), default=0)):
                close(k)
            if tag == "br":
                parts.append(" ")
                continue
            if breaks:
                end()
                if tag in BREAKS_P and (k := innermost("p")):
                    close(k)
                if tag in SIBLINGS and (k := innermost(tag)) and k > innermost(*PARENTS):
                    close(k)
            if tag not in VOID and not m["attributes"].endswith("/"):
                path = stack[-1].path
                if breaks:
                    path = path.copy()
                    for x in self.path_slots(tag, m["attributes"]):
                        path[x] = min(2, path[x] + 1)
                places.setdefault(tag, []).append(len(stack))
                stack.append(Element(tag, breaks, path))
                hidden += tag in DROPPED
        words_in_head(at, len(page))
        if at < len(page) and not hidden:
            parts.append(page[at:])
        end()
        return out

    def vectors(self, blocks: list[Block]) -> np.ndarray:
        x = np.zeros((len(blocks), DIM), np.float32)
        words, n = self.words, len(blocks)
        for k, (text, path, linked) in enumerate(blocks):
            x[k, :PATH_DIM] = path
            slots = []
            for w in text.split(" "):
                if (s := words.get(w)) is None:
                    if len(words) > 200_000:
                        words.clear()
                    s = words[w] = slot(w.lower().strip(".,;:!?()"), WORD_DIM)
                slots.append(s)
            counts = np.bincount(slots, minlength=WORD_DIM)
            x[k, PATH_DIM : PATH_DIM + WORD_DIM] = counts / np.sqrt((counts * counts).sum())
            size = len(text)
            x[k, -NUMBERS:] = (np.log1p(size) / 6, min(1.0, linked / size), min(1.0, 8 * sum(map(text.count, ".,;")) / size), len(slots) < 4, text[-1] in ".!?", k / n, 1 - k / n, min(n, 50) / 50)
        return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(w: dict, k: int, x: np.ndarray, cache: list | None = None) -> np.ndarray:
    """Hidden states (step, page, HIDDEN) of one direction; gates in the order input, forget, output, candidate."""
    gx = x @ w["x"][k] + w["b"][k]
    h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((*x.shape[:2], HIDDEN), np.float32)
    for t in range(len(x)):
        a = gx[t] + h @ w["u"][k]
        s, g = sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        before, h0 = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = out[t] = o * tc
        if cache is not None:
            cache.append((h0, before, i, f, o, g, tc))
    return out


def lstm_back(w: dict, k: int, x: np.ndarray, cache: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    da = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
    du, dh, dc = np.zeros_like(w["u"][k]), np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(x) - 1, -1, -1):
        h0, before, i, f, o, g, tc = cache[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        da[t] = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        du += h0.T @ da[t]
        dh, dc = da[t] @ w["u"][k].T, dc * f
    flat = da.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse order; what pads it stays behind them, so that no page reads another's padding."""
    step = np.arange(len(x))[:, None]
    return np.take_along_axis(x, np.where(step < sizes, sizes - 1 - step, step)[:, :, None], axis=0)


def label(w: dict, x: np.ndarray, sizes: np.ndarray, caches: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The probability that each block (step, page) is main text, and the states; sizes: blocks of each page."""
    ahead = lstm(w, 0, x, caches and caches[0])
    back = turned(lstm(w, 1, turned(x, sizes), caches and caches[1]), sizes)
    states = np.concatenate((ahead, back), axis=2)
    return sigmoid(states @ w["w"] + w["v"]), states


def sample_page(rng: np.random.Generator) -> list[tuple[str, bool]]:
    """Fragments of an invented page in order, each with whether its text is main text."""
    syllables = "ka re to mi sun del or vit an eth lo ber qua zi ent mor".split()
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick(*syllables) for _ in range(int(rng.integers(1, 4))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))

    def prose() -> str:
        return " ".join(words(2, 14).capitalize() + pick(".", ".", ".", ",", "!", "?") for _ in range(int(rng.integers(1, 7))))

    def small() -> str:
        boiler = ["Subscribe to our newsletter", "Accept cookies", "Share this", "Read more", "Advertisement", "Sponsored", "All rights reserved.", "Log in", "Sign up", "Privacy policy", "Leave a reply", "Related posts", "Copyright 2020", "Contact us", "Terms of use"]
        return pick(pick(*boiler), words(1, 5), prose(), words(2, 12).capitalize() + ".")

    attr = lambda *names: pick(f' class="{pick(*names)}"', f' id="{pick(*names)}"', f" class='{pick(*names)} {word()}'", f' class="{word()} {pick(*names)}-{word()}"')

    def box(open_: str, close: str, inner: list[str]) -> list[tuple[str, bool]]:
        return [(open_, False), *((x, False) for x in inner), (close, False)]

    def menu(tag: str, names: tuple) -> list[tuple[str, bool]]:
        items = [f"<li><a href='/{word()}'>{words(1, 4)}</a></li>" for _ in range(int(rng.integers(2, 10)))]
        extra = pick("", attr(*names)) if tag != "div" else attr(*names)
        return box(f"<{tag}{extra}><ul>", f"</ul></{tag}>", items)

    def junk() -> list[tuple[str, bool]]:
        kind = int(rng.integers(9))
        paragraphs = [pick(f"<p>{small()}</p>", f"<div>{small()}</div>", small()) for _ in range(int(rng.integers(1, 4)))]
        if kind == 0:
            return menu(pick("nav", "div"), ("nav", "menu", "navbar", "breadcrumb", "toc"))
        if kind in (1, 2):
            return box(f"<{pick('div', 'aside', 'section')}{attr('ad', 'ads', 'advert', 'sponsor', 'promo', 'banner')}>", "</div>", paragraphs)
        if kind == 3:
            return box(f"<aside{pick('', attr('sidebar', 'widget', 'related'))}>", "</aside>", [f"<h3>{words(1, 4)}</h3>", *paragraphs])
        if kind == 4:
            return box(f"<div{attr('cookie', 'notice', 'consent', 'newsletter', 'subscribe', 'popup', 'alert', 'share', 'social')}>", "</div>", paragraphs)
        if kind == 5:
            return box(f"<form{pick('', attr('search', 'signup', 'login'))}>", "</form>", [f"<label>{words(1, 3)}</label><input>", f"<p>{small()}</p>", f"<button>{words(1, 2)}</button>"])
        if kind == 6:
            return menu("div", ("sidebar", "related", "widget", "tags"))
        if kind == 7:
            return box(f"<div{attr('related', 'recommended', 'more')}>", "</div>", [f"<p><a href='/'>{words(3, 9)}</a></p>" for _ in range(int(rng.integers(1, 5)))])
        comments = [f"<{pick('p', 'div', 'li')}>{prose()}" for _ in range(int(rng.integers(1, 7)))]
        return box(f"<{pick('div', 'section', 'ol')}{attr('comments', 'comment', 'reply', 'replies', 'discussion')}>", pick("</div>", "</section>"), comments)

    body: list[tuple[str, bool]] = []
    if rng.random() < 0.8:
        body += menu(pick("nav", "header", "div"), ("nav", "menu", "header", "topbar"))
    if rng.random() < 0.4:
        body += box(f"<header{pick('', attr('header', 'masthead'))}>", "</header>", [f"<p>{small()}</p>", f"<h2>{words(1, 3)}</h2>"])
    for _ in range(int(rng.integers(0, 3))):
        body += junk()
    wrap = pick("article", "article", "main", "div", "section")
    name = attr("content", "article", "post", "entry", "story", "body", "main", "text")
    body.append((f"<{wrap}{name if wrap in ('div', 'section') else pick('', '', name)}>", False))
    if rng.random() < 0.85:
        body.append((f"<{pick('h1', 'h1', 'h2')}>{words(2, 14)}</h1>", True))
    for _ in range(int(rng.integers(1, 14))):
        r = rng.random()
        if r < 0.7:
            body.append((f"<p>{pick('', '', '<b>')}{prose()}{pick('', '', '<br>', '</p>', '</p>')}", True))
        elif r < 0.76:
            body.append((f"<h2>{words(1, 6)}</h2>", True))
        elif r < 0.82:
            body.append((f"<blockquote>{prose()}</blockquote>", True))
        elif r < 0.87:
            body.append(("<ul>" + "".join(f"<li>{words(2, 12)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>", True))
        elif r < 0.92:
            odd = pick(f"{words(1, 3)}.", words(1, 3), f"{words(1, 2).upper()}!!", " | ".join(word() for _ in range(int(rng.integers(2, 12)))), small())
            body += [(f"<p>{odd}</p>", True)] * pick(1, 1, 1, int(rng.integers(2, 30)))
        elif r < 0.94:
            body.append((f"<pre>{prose()}</pre>", True))
        else:
            body += junk()
    body.append((f"</{wrap}>", False))
    for _ in range(int(rng.integers(0, 3))):
        body += junk()
    if rng.random() < 0.85:
        body += box(f"<{pick('footer', 'footer', 'div class=footer')}>", pick("</footer>", ""), [pick(f"&copy; {word()}.example &middot; {small()}", f"<p>{small()}</p>")])
    return body


def sample_sequence(rng: np.random.Generator, parser: Parser) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of the blocks of an invented page; main text carries a mark that is taken out again."""
    page = "".join(re.sub(r">(?=[^<\s])", ">\x01", x) if main else x for x, main in sample_page(rng))
    blocks = parser.blocks(page)
    y = np.array(["\x01" in b.text for b in blocks], np.float32)
    return parser.vectors([b._replace(text=b.text.replace("\x01", "") or "-") for b in blocks]), y


def train(pages: int = 1500, epochs: int = 3, batch: int = 24, seed: int = 5) -> dict:
    rng, f = np.random.default_rng(seed), np.float32
    parser = Parser()
    data = [d for d in (sample_sequence(rng, parser) for _ in range(pages)) if len(d[1])]
    w = {
        "x": [rng.normal(0, 0.15, (DIM, 4 * HIDDEN)).astype(f) for _ in range(2)],
        "u": [rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(f) for _ in range(2)],
        "b": [np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN).astype(f) for _ in range(2)],
        "w": rng.normal(0, 0.3, 2 * HIDDEN).astype(f),
        "v": np.zeros(1, f),
    }
    flat = [*w["x"], *w["u"], *w["b"], w["w"], w["v"]]
    m1, m2, step = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
    total = epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            x, y, on = padded([data[k] for k in order[at : at + batch]])
            x[:, :, :PATH_DIM] *= rng.random((1, x.shape[1], PATH_DIM)) > 0.1  # names that some site doesn't use
            caches = ([], [])
            sizes = on.sum(0).astype(np.int64)
            p, states = label(w, x, sizes, caches)
            d = ((p - y) * on / on.sum()).astype(f)
            ds = d[:, :, None] * w["w"]
            gx0, gu0, gb0 = lstm_back(w, 0, x, caches[0], ds[:, :, :HIDDEN])
            gx1, gu1, gb1 = lstm_back(w, 1, turned(x, sizes), caches[1], turned(ds[:, :, HIDDEN:], sizes))
            grads = [gx0, gx1, gu0, gu1, gb0, gb1, np.tensordot(d, states, ((0, 1), (0, 1))), d.sum().reshape(1)]
            step += 1
            rate = 0.012 * min(1.0, 3 * (1 - step / (total + 1)))
            for q, g, a, b in zip(flat, grads, m1, m2):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(f)
    return w


@cache
def model() -> dict:
    """The weights of train(), which are the same whenever it runs; trained once in a process."""
    return train()


def padded(data: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side (step, page); the shorter ones end in zeros, which `on` marks."""
    longest = max(len(y) for _, y in data)
    x, y, on = np.zeros((longest, len(data), DIM), np.float32), np.zeros((longest, len(data)), np.float32), np.zeros((longest, len(data)), np.float32)
    for k, (a, b) in enumerate(data):
        x[: len(b), k], y[: len(b), k], on[: len(b), k] = a, b, 1
    return x, y, on


def main_texts(w: dict, parser: Parser, pages: list[str]) -> list[str]:
    """The main text of each page; pages of like length are read together."""
    found = [parser.blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k, b in enumerate(found) if b), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(found[order[end]]) <= GROUP:
            end += 1
        group = order[at:end]
        x, _, _ = padded([(parser.vectors(found[k]), np.zeros(len(found[k]), np.float32)) for k in group])
        p, _ = label(w, x, np.array([len(found[k]) for k in group]))
        for column, k in enumerate(group):
            out[k] = "\n".join([b.text for b, on in zip(found[k], (p[:, column] >= 0.5).tolist()) if on])
        at = end
    return out


def main_text(w: dict):
    """An Arrow function from html to main text."""

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        parser, out, group, size = Parser(), [], [], 0
        for page in pages.to_pylist():
            group.append(page or "")
            size += len(group[-1])
            if size >= 4_000_000:
                out += main_texts(w, parser, group)
                group, size = [], 0
        return pa.array(out + main_texts(w, parser, group), pa.string())

    return extract


def extract(pages: DataFrame, w: dict | None = None, html_col: str = "html") -> DataFrame:
    """Add text and n_chars; narrow, no shuffle. w: weights of train(), else those of model()."""
    df = pages.withColumn("text", main_text(w or model())(F.col(html_col)))
    return df.withColumn("n_chars", F.length("text").cast("long"))
