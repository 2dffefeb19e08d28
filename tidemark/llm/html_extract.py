"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each block is a vector of its tag path (hashed tag
names, class and id words of its ancestors), its words (hashed) and a few numbers (length, share of links, punctuation).
A bidirectional LSTM in numpy reads the blocks of a whole page in order and labels each as main text or not, so every
decision sees what stands before and after. It is trained here, on pages that a seeded generator makes with known labels
(articles among menus, headers, footers, sidebars, notices, adverts, forms and comments, in many markups).

Defined cases: null and empty html give an empty text; html without a tag is one block; unclosed and stray tags are read
as browsers do in the main (a new paragraph closes an open one); contents of scripts, styles, templates, iframes,
noscript and title elements are never text, those of math, svg and object are; character references are decoded once; repeated rows give equal texts; an empty table no rows.
"""

from __future__ import annotations

import functools
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 512, 32, 6, 20
TRAIN_PAGES = 1200

#: HTML element names by how they are read.
FOREIGN = frozenset(
    "math maction annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics "
    "svg circle clippath defs desc ellipse filter g image line lineargradient marker mask path pattern polygon polyline radialgradient rect stop symbol text textpath tspan use".split()
)
INLINE = FOREIGN | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style template noscript iframe title".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)|([^<]+)|<", re.S)
_STOP = re.compile(r"""[>"']""")
DEPTH = 512  # as deep as browsers nest elements; deeper ones are read beside one another
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")

Block = tuple[tuple[str, ...], str, int]  # path tokens, text, characters inside links


class TagEnds:
    """Where the tags of a page end, each character being looked at a few times at most, whatever is left open."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.unclosed = {'"': len(page), "'": len(page)}  # from where on a quote isn't closed
        self.failed: set[int] = set()  # marks outside quotes from which no end was found

    def end(self, at: int) -> int:
        """Index of the > that ends a tag: the first outside quotes, or if quotes stay open the first at all; -1 if there is none."""
        if at > self.last:
            return -1
        met, pos = [], at
        while pos <= self.last:
            m = _STOP.search(self.page, pos)
            i = m.start() if m else -1
            if i < 0 or i in self.failed:
                break
            quote = self.page[i]
            if quote == ">":
                return i
            met.append(i)
            closed = self.page.find(quote, i + 1) if i < self.unclosed[quote] else -1
            if closed < 0:
                self.unclosed[quote] = min(i, self.unclosed[quote])
                break
            pos = closed + 1
        self.failed.update(met)
        return self.page.find(">", at)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: path tokens (each once), text with white space as single spaces, characters in links."""
    out: list[Block] = []
    # open elements: tag, and the path down to it, which blocks share
    stack: list[tuple[str, tuple[str, ...]]] = []
    beside: dict[str, int] = {}  # elements beyond DEPTH that are open
    parts: list[str] = []
    linked = links = 0
    at, n = 0, len(page)
    ends = TagEnds(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1][1] if stack else (), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len(text)

    while at < n:
        if at > ends.last:  # no tag can end any more, but a comment can begin
            cut = page.find("<!--", at)
            said(page[at : cut if cut >= 0 else n])
            break
        m = _TOKEN.match(page, at)
        at = m.end()
        close, tag = m[1], m[2]
        if tag is None:
            if m[3] or m[0] == "<":
                said(m[3] or "<")
            continue
        end = ends.end(at)
        attrs, at = page[at:end], end + 1
        tag = tag.lower()
        if close:
            if tag not in INLINE:
                flush()
            if beside.get(tag):
                beside[tag] -= 1
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE and tag in INLINE:
                    break
            links = sum(x[0] == "a" for x in stack)
            continue
        if tag not in INLINE:
            flush()
        if tag in OPAQUE:
            if not attrs.endswith("/"):
                shut_at = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = shut_at.end() if shut_at else n
            continue
        if tag in VOID or tag in FOREIGN and attrs.endswith("/"):
            continue
        shut = SAME.get(tag) or ({"p"} if tag in CLOSES_P else None)
        if shut:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if len(stack) >= DEPTH:
            beside[tag] = beside.get(tag, 0) + 1
            continue
        path = stack[-1][1] if stack else ()
        if tag not in INLINE:
            names = ["." + w for x in _NAMES.finditer(attrs) for w in _PARTS.findall((x[1] or x[2] or x[3] or "").lower())] if attrs else []
            if more := [t for t in dict.fromkeys([tag, *names]) if t not in path]:
                path = (*path, *more)
        stack.append((tag, path))
        links = sum(x[0] == "a" for x in stack)
    flush()
    return out


@functools.lru_cache(maxsize=100_000)
def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


def path_slots(path: tuple[str, ...]) -> list[int]:
    return sorted({_slot(t, PATH_DIM) for t in path})


def word_features(text: str, linked: int) -> np.ndarray:
    """Hashed words of the whole block and its numbers."""
    v = np.zeros(WORD_DIM + NUMBERS, dtype=np.float32)
    words = text.lower().split()
    counts = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIM for w in words], minlength=WORD_DIM)
    v[:WORD_DIM] = counts / max(1.0, float(np.sqrt((counts * counts).sum())))
    n = len(text)
    v[WORD_DIM:] = (np.log1p(n) / 6, np.log1p(len(words)) / 5, linked / max(1, n), sum(map(text.count, ".,;:!?")) / max(1, len(words)), text[-1:] in ".!?:", any(c in text for c in "©|»›"))
    return v


class Labeller:
    """Weights of both directions and of the output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {}
        for d in "fb":
            bias = np.zeros(4 * h, dtype=np.float32)
            bias[h : 2 * h] = 1  # remember at first
            self.w |= {f"p{d}": draw(PATH_DIM, 4 * h) * 2, f"x{d}": draw(WORD_DIM + NUMBERS, 4 * h), f"h{d}": draw(h, 4 * h), f"c{d}": bias}
        self.w |= {"o": draw(2 * h, 1), "q": np.zeros(1, dtype=np.float32)}
        self._paths: dict[tuple[str, ...], np.ndarray] = {}

    def predict(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of main text for each block of each page."""
        if not pages or not any(pages):
            return [np.zeros(len(p)) for p in pages]
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        i = 0
        while i < len(order):  # pages of like length together; a step's memory is bounded
            j = i + 1
            while j < len(order) and (j - i) * len(pages[order[j]]) < 8192:
                j += 1
            for k, p in zip(order[i:j], self._forward([pages[k] for k in order[i:j]])):
                out[k] = p
            i = j
        return out

    def _forward(self, pages: list[list[Block]]) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in pages])
        if not sizes.max():
            return [np.zeros(0) for _ in pages]
        if len(self._paths) > 50_000:
            self._paths.clear()
        both = np.concatenate((self.w["pf"], self.w["pb"]), axis=1)
        rows = []
        for p in pages:
            for path, _, _ in p:
                v = self._paths.get(path)
                if v is None:
                    v = self._paths[path] = both[path_slots(path)].sum(axis=0)
                rows.append(v)
        x = np.array([word_features(b[1], b[2]) for p in pages for b in p], dtype=np.float32)
        z = np.array(rows) + x @ np.concatenate((self.w["xf"], self.w["xb"]), axis=1) + np.concatenate((self.w["cf"], self.w["cb"]))
        page = np.repeat(np.arange(len(pages)), sizes)
        pos = np.concatenate([np.arange(n) for n in sizes])
        h = HIDDEN
        logits = np.zeros(len(page), dtype=np.float32)
        for d, at, cols, o in (("f", pos, slice(0, 4 * h), slice(0, h)), ("b", sizes[page] - 1 - pos, slice(4 * h, None), slice(h, None))):
            zs = np.zeros((sizes.max(), len(pages), 4 * h), dtype=np.float32)
            zs[at, page] = z[:, cols]
            hs, _ = _run(zs, self.w[f"h{d}"])
            logits += (hs[at, page] @ self.w["o"][o])[:, 0]
        prob = _sigmoid(logits + self.w["q"])
        return np.split(prob, np.cumsum(sizes)[:-1])

    def fit(self, pages: list[list[Block]], labels: list[list[int]], epochs: int = 8, size: int = 24, rate: float = 0.01, seed: int = 5) -> Labeller:
        """Backpropagation through time over whole pages, with Adam; class and id words are left out at random."""
        rng = np.random.default_rng(seed)
        h = HIDDEN
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        feats = [np.array([word_features(b[1], b[2]) for b in p], dtype=np.float32) for p in pages]
        t = 0
        total = epochs * -(-len(pages) // size)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for start in range(0, len(order), size):
                own = order[start : start + size]
                sizes = np.array([len(pages[i]) for i in own])
                page = np.repeat(np.arange(len(own)), sizes)
                pos = np.concatenate([np.arange(n) for n in sizes])
                x = np.concatenate([feats[i] for i in own])
                y = np.concatenate([np.array(labels[i], dtype=np.float32) for i in own])
                hot = np.zeros((len(page), PATH_DIM), dtype=np.float32)
                r = 0
                for i in own:
                    drop = rng.random() < 0.3
                    for path, _, _ in pages[i]:
                        hot[r, path_slots(tuple(p for p in path if not (drop and p[0] == "." and rng.random() < 0.15)))] = 1
                        r += 1
                grad = {}
                logits = np.full(len(page), self.w["q"][0], dtype=np.float32)
                kept = {}
                for d, at, o in (("f", pos, slice(0, h)), ("b", sizes[page] - 1 - pos, slice(h, None))):
                    zs = np.zeros((sizes.max(), len(own), 4 * h), dtype=np.float32)
                    zs[at, page] = hot @ self.w[f"p{d}"] + x @ self.w[f"x{d}"] + self.w[f"c{d}"]
                    hs, trace = _run(zs, self.w[f"h{d}"], keep=True)
                    kept[d] = (at, o, hs, trace)
                    logits += (hs[at, page] @ self.w["o"][o])[:, 0]
                g = (_sigmoid(logits) - y) / len(page)
                grad["q"] = np.array([g.sum()], dtype=np.float32)
                grad["o"] = np.zeros_like(self.w["o"])
                for d, (at, o, hs, trace) in kept.items():
                    grad["o"][o] = hs[at, page].T @ g[:, None]
                    dh = np.zeros_like(hs)
                    dh[at, page] = g[:, None] * self.w["o"][o][:, 0]
                    dz, grad[f"h{d}"] = _back(dh, hs, trace, self.w[f"h{d}"])
                    dz = dz[at, page]
                    grad[f"p{d}"], grad[f"x{d}"], grad[f"c{d}"] = hot.T @ dz, x.T @ dz, dz.sum(axis=0)
                t += 1
                step = rate * (1 - 0.9 * t / total)
                norm = np.sqrt(sum(float((v**2).sum()) for v in grad.values()))
                for k, v in grad.items():
                    v = v * min(1.0, 1.0 / max(norm, 1e-9)) + 1e-5 * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.w[k] = (self.w[k] - step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self._paths.clear()
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(z: np.ndarray, w: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """LSTM over projected inputs z (T, B, 4H); gates in the order input, forget, output, cell."""
    steps, batch, _ = z.shape
    h = HIDDEN
    hs = np.zeros((steps, batch, h), dtype=np.float32)
    state, cell, trace = np.zeros((batch, h), dtype=np.float32), np.zeros((batch, h), dtype=np.float32), []
    for t in range(steps):
        a = z[t] + state @ w
        gates = _sigmoid(a[:, : 3 * h])
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        g = np.tanh(a[:, 3 * h :])
        before = cell
        cell = f * cell + i * g
        tc = np.tanh(cell)
        if keep:
            trace.append((state, before, i, f, o, g, tc))
        state = hs[t] = o * tc
    return hs, trace


def _back(dh: np.ndarray, hs: np.ndarray, trace: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the recurrent weights."""
    steps, batch, h = hs.shape
    dz, dw = np.zeros((steps, batch, 4 * h), dtype=np.float32), np.zeros_like(w)
    later, dcell = np.zeros((batch, h), dtype=np.float32), np.zeros((batch, h), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        state, before, i, f, o, g, tc = trace[t]
        d = dh[t] + later
        dcell = dcell + d * o * (1 - tc * tc)
        a = dz[t]
        a[:, :h] = dcell * g * i * (1 - i)
        a[:, h : 2 * h] = dcell * before * f * (1 - f)
        a[:, 2 * h : 3 * h] = d * tc * o * (1 - o)
        a[:, 3 * h :] = dcell * i * (1 - g * g)
        dw += state.T @ a
        later = a @ w.T
        dcell = dcell * f
    return dz, dw


class PageMaker:
    """Pages with known labels. The block texts are made-up words, so only markup, place and form tell the kinds apart."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *x):
        return x[int(self.rng.integers(len(x)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        syl = "an er th on re in ou le la de qu en st ch au ie pf zu el os as ga ción ment tion é è ü ß".split()
        out = []
        for _ in range(n):
            w = "".join(self.pick(*syl) for _ in range(int(self.rng.integers(1, 4))))
            out.append(w + self.pick("", "", "", "", "", ",", "."))
        if self.chance(0.1):
            out = [w + self.pick("***", "###", "%%%", "$$$", "&amp;&amp;", "!!") for w in out]
        if self.chance(0.1):
            out = " | ".join(out).split(" ")
        if self.chance(0.08):
            out = [w.upper() for w in out]
        text = " ".join(out)
        return (text[:1].upper() + text[1:]).rstrip(",.") + self.pick(".", ".", ".", "", "!", "?")

    def tag(self, name: str, inner: str, names: str = "") -> str:
        noise = self.pick("", "", "", "row", "col-md-8", "wrap", "inner", "clearfix", "container", "box", "x" + str(int(self.rng.integers(99))))
        attr = " ".join(x for x in (names, noise) if x)
        how = self.pick("class", "class", "class", "id") if names else "class"
        return f'<{name} {how}="{attr}">{inner}</{name}>' if attr and (names or self.chance(0.4)) else f"<{name}>{inner}</{name}>"

    def links(self, wrap: bool = True) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(int(self.rng.integers(2, 9)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if wrap and self.chance(0.7) else self.pick(" ", " | ").join(items)

    def para(self) -> str:
        text = self.words(1, self.pick(4, 30, 90, 160))
        if self.chance(0.2):
            text = f"<b>{text}" + self.pick("</b>", "", "<br>")
        if self.chance(0.2):
            text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(2, 20)}'
        if self.chance(0.15):
            text = text.replace(" ", self.pick(" <em>x</em> ", "&nbsp;", " &amp; "), 1)
        return text

    def boiler(self) -> str:
        p = lambda: f"<p>{self.words(2, 40)}</p>"
        kind = self.pick("nav", "menu", "header", "footer", "aside", "sidebar", "ad", "ad", "notice", "form", "related", "share", "crumbs", "promo", "tags", "author")
        div = self.pick("div", "div", "section", "aside")
        if kind == "nav":
            return self.tag("nav", self.links(), self.pick("", "", "main-nav", "top"))
        if kind == "menu":
            return self.tag(self.pick("div", "ul"), self.links(False), self.pick("menu", "nav", "navigation", "navbar", "site-menu", "topbar"))
        if kind == "header":
            return self.tag("header", self.pick(f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 5)}</div>", p()) + self.pick("", self.links()), self.pick("", "site-header", "masthead"))
        if kind == "footer":
            return self.tag("footer", self.pick("&copy; ", "Copyright ", "") + self.words(2, 25) + self.pick("", self.links(), " &middot; " + self.words(2, 8)), self.pick("", "", "site-footer"))
        if kind == "aside":
            return self.tag("aside", self.pick(f"<h3>{self.words(1, 4)}</h3>", "") + self.pick(p(), self.links()), self.pick("", "", "widget"))
        if kind == "sidebar":
            return self.tag(div, f"<h4>{self.words(1, 4)}</h4>" + self.pick(p(), p() + p(), self.links()), self.pick("sidebar", "side-bar", "widget", "right-rail", "secondary"))
        if kind == "ad":
            return self.tag(div, self.pick(self.words(2, 30), p(), f'<a href="/b">{self.words(2, 9)}</a>'), self.pick("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "banner-ad", "ad-slot", "adbox"))
        if kind == "notice":
            return self.tag(div, self.pick(p(), self.words(4, 40)) + self.pick("", "<button>OK</button>"), self.pick("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "warning", "cookie-banner", "paywall", "disclaimer"))
        if kind == "form":
            return f'<form action="/s" class="{self.pick("search", "login", "newsletter", "subscribe", "f")}">{self.pick("<label>", "<p>", "")}{self.words(1, 12)} <input name="q"> <button>{self.words(1, 2)}</button></form>'
        if kind == "related":
            return self.tag(div, f"<h3>{self.words(1, 4)}</h3>" + self.links(), self.pick("related", "recommended", "more-stories", "popular", "trending", "read-more"))
        if kind == "share":
            return self.tag(div, self.links(False), self.pick("share", "social", "sharing", "follow"))
        if kind == "crumbs":
            return self.tag(self.pick("div", "ol", "nav"), self.links(False), self.pick("breadcrumb", "breadcrumbs", "crumbs"))
        if kind == "tags":
            return self.tag(self.pick("div", "ul", "p"), self.links(False), self.pick("tags", "categories", "meta", "pager", "pagination"))
        if kind == "author":
            return self.tag("div", self.words(3, 20), self.pick("newsletter", "subscribe", "promo", "toolbar", "skip-link"))
        return self.tag(div, p(), self.pick("promo", "promotion", "newsletter", "subscribe", "banner", "teaser", "cta"))

    def comments(self) -> str:
        each = self.pick("div", "li", "article", "p")
        inner = "".join(self.tag(each, self.pick("", f"<b>{self.words(1, 2)}</b> ", f"<h4>{self.words(1, 3)}</h4>") + self.pick(self.words(3, 60), f"<p>{self.words(3, 60)}</p>"), self.pick("comment", "comment", "reply", "comment-body", "user-comment")) for _ in range(int(self.rng.integers(1, 6))))
        head = self.pick("", f"<h3>{self.words(1, 3)}</h3>", "<h2>Comments</h2>")
        return self.tag(self.pick("section", "div", "ol", "ul", "aside"), head + inner, self.pick("comments", "comments", "comment-list", "commentlist", "discussion", "responses", "reader-comments"))

    def page(self) -> str:
        """Html in which control characters mark the spans of main text; labelled() cuts them out."""
        body: list[tuple[str, bool]] = []
        for _ in range(int(self.rng.integers(0, 5))):
            body.append((self.boiler(), False))
        inside: list[tuple[str, bool]] = []
        if self.chance(0.8):
            inside.append((f"<h1>{self.words(1, 12)}</h1>", True))
        style = self.pick("p", "p", "p", "p", "openp", "div", "br", "bare")
        for _ in range(self.pick(1, 1, 2, 3, 5, 8, 14)):
            r = self.rng.random()
            if r < 0.72 or style == "bare":
                text = self.para()
                inside.append(({"p": f"<p>{text}</p>", "openp": f"<p>{text}", "div": f"<div>{text}</div>", "br": f"{text}<br>", "bare": f"{text} "}[style], True))
            elif r < 0.78:
                inside.append((f"<h2>{self.words(1, 8)}</h2>", True))
            elif r < 0.83:
                tag = self.pick("ul", "ol")
                inside.append((f"<{tag}>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(3)) + f"</{tag}>", True))
            elif r < 0.87:
                inside.append((f"<blockquote>{self.pick('<p>', '')}{self.words(5, 40)}</blockquote>", True))
            elif r < 0.90:
                inside.append((f"<table><tr><td>{self.words(1, 6)}</td><td>{self.words(1, 6)}</td></tr></table>", True))
            elif r < 0.92:
                inside.append((f"<figure><figcaption>{self.words(2, 15)}</figcaption></figure>", True))
            else:
                inside.append((self.boiler(), False))
        if self.chance(0.12):
            inside.append((self.comments(), False))
        box = self.pick(("article", ""), ("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article"), ("div", "post-content"), ("div", "entry-content"), ("div", "story"), ("div", "article-body"), ("div", "main-content"), ("section", "content"), ("div", "post"), ("div", "text"))
        open_box, close_box = f"<{box[0]}" + (f' class="{box[1]}"' if box[1] else "") + ">", f"</{box[0]}>"
        outer = self.pick(("", ""), ("", ""), ("<div>", "</div>"), ('<div class="page">', "</div>"), ("<main>", "</main>"), ('<div id="main">', "</div>"), ('<div class="layout"><section>', "</section></div>"))
        middle = "".join(f"\x02{h}\x03" if ok else h for h, ok in inside)
        tail = [(self.comments(), False)] if self.chance(0.35) else []
        for _ in range(int(self.rng.integers(0, 5))):
            tail.append((self.boiler(), False))
        lead = "".join(h for h, _ in body)
        end = "".join(h for h, _ in tail)
        inner_tail = self.chance(0.5)
        content = lead + outer[0] + open_box + middle + close_box + (end if inner_tail else "") + outer[1] + ("" if inner_tail else end)
        head = f"<head><title>{self.words(1, 8)}</title><script>var a='<p>';</script></head>" if self.chance(0.8) else ""
        return f"<!DOCTYPE html><html>{head}<body>{content}" + self.pick("</body></html>", "")

    def labelled(self) -> tuple[list[Block], list[int]]:
        """Blocks and labels of a page. Marked spans are known by their characters' private marks."""
        page = self.page()
        pieces = re.split("([\x02\x03])", page)
        # main text is written in a copy with a private letter before each word, so that blocks tell what they hold
        inside, out = False, []
        for piece in pieces:
            if piece in ("\x02", "\x03"):
                inside = piece == "\x02"
            else:
                out.append(re.sub(r">([^<]*[^<\s][^<]*)|^([^<]*[^<\s][^<]*)", lambda m: m[0][:1] + "\ue000" + m[0][1:], piece) if inside else piece)
        got = blocks("".join(out))
        labels = [int("\ue000" in text) for _, text, _ in got]
        return [(p, " ".join(t.replace("\ue000", "").split()), n) for p, t, n in got], labels


def training_pages(n: int, seed: int = 11) -> tuple[list[list[Block]], list[list[int]]]:
    maker = PageMaker(seed)
    rows = [x for x in (maker.labelled() for _ in range(n)) if x[0]]
    return [x[0] for x in rows], [x[1] for x in rows]


@functools.lru_cache(maxsize=2)
def labeller(pages: int = TRAIN_PAGES) -> Labeller:
    """The trained labeller; the same for the same number of pages."""
    return Labeller().fit(*training_pages(pages))


def extract_texts(pages: list[str], model: Labeller) -> list[str]:
    cut = [blocks(p) for p in pages]
    return [" ".join(b[1] for b, p in zip(own, probs) if p >= 0.5) for own, probs in zip(cut, model.predict(cut))]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or labeller())  # some 100,000 weights
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = extract_texts([x or "" for x in b.column(2).to_pylist()], shared.value)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", F.col("html").alias("html")), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
