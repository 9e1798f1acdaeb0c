"""Main text of web pages: a bidirectional LSTM labels every block of a page, given all the others.

A page is cut into blocks, the runs of text between block-level tags, in order. A block's vector has the hashed tags and
words of class, id and role attributes on its path, its hashed words, and a few measures. The network is plain
numpy; it is trained on the driver from a bounded sample of pages, whose paragraphs are also set into other
layouts drawn by rule, so that what isn't the article is known by construction. Each task labels the pages it reads.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PATH, WORDS, MEASURES = 384, 128, 8  # slots of hashed path tokens and words; measures of a block
INPUT, DENSE, HIDDEN = PATH + WORDS + MEASURES, 32, 24
CELLS = 16_384  # blocks that are held as vectors at once

# Elements of HTML whose text isn't shown as text, has no end tag, or runs on within a line.
UNSHOWN = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "select", "button", "svg", "object", "canvas", "audio", "video", "datalist", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
UNENDED = re.compile(r"<[a-zA-Z/!?]")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # slots of the tokens on the way to it
    linked: int  # characters inside links
    tags: tuple[str, ...]
    depth: int = 0


def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode()) % slots


def _tokens(tag: str, attributes: str) -> list[str]:
    out = ["t:" + tag]
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = a or b or c, name.lower()
        if name in ("hidden", "style", "aria-hidden"):
            if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)) or (name == "aria-hidden" and value.lower() == "true"):
                out.append("hidden")
        else:
            out += (f"c:{w.lower()}" for w in PIECE.findall(value))
    return out


def blocks_of(page: str) -> list[Block]:
    """The page's blocks that hold text, in order: references decoded, white space turned into one space, trimmed.

    ``br`` is white space; comments and tags within a line leave nothing. Unclosed tags end with their parent, stray
    end tags are passed over, an unclosed script or style runs to the end.
    """
    found: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], tuple[str, ...]]] = [("", (), ())]
    text: list[str] = []
    linked = link = 0

    def flush() -> None:
        nonlocal linked
        if text and (whole := " ".join("".join(text).split())):
            found.append(Block(whole, stack[-1][1], linked, stack[-1][2], len(stack)))
        text.clear()
        linked = 0

    def said(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece) if "&" in piece else piece
        text.append(piece)
        linked += link * len(piece)

    at, end = 0, page.rfind(">") + 1
    while at < end and (m := TAG.search(page, at, end)):
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in UNSHOWN:
            if not closing and not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else len(page)
        elif tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            text.append(" ")
        elif tag in INLINE:
            continue
        elif closing:
            flush()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            del stack[depth or len(stack) :]
        else:
            flush()
            if len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ENDS_ITSELF):
                stack.pop()
            if tag not in VOID and not m[3].endswith("/"):
                up, tokens = stack[-1], _tokens(tag, m[3])
                own = tuple(sorted({*up[1], *(_slot(x, PATH) for x in tokens)}))
                stack.append((tag, own if own != up[1] else up[1], (*up[2][-7:], *tokens)))
    if at < len(page):  # a tag or comment that never ends takes what is left
        rest = page[at:]
        said(rest[: m.start()] if (m := UNENDED.search(rest)) else rest)
    flush()
    return found


class _Slots(dict):
    """Words' slots, kept as long as there aren't too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = slot = _slot(word.lower(), WORDS)
        return slot


_slots = _Slots()


def vectors(blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row for each block; ``first`` and ``total`` place them within the page."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    total = len(blocks) if total is None else total
    said = [b.text.split(" ") for b in blocks]
    sizes = np.array([len(w) for w in said])
    found = np.fromiter((k for w in said for k in map(_slots.__getitem__, w)), np.int64, sizes.sum())
    rows = np.arange(len(blocks))
    counts = np.bincount(np.repeat(rows, sizes) * WORDS + found, minlength=len(blocks) * WORDS).reshape(-1, WORDS)
    x[:, PATH : PATH + WORDS] = counts / np.sqrt((counts * counts).sum(1, keepdims=True))
    paths = [b.path for b in blocks]
    x[np.repeat(rows, [len(p) for p in paths]), [k for p in paths for k in p]] = 1
    chars = np.array([len(b.text) for b in blocks])
    measures = (np.log1p(sizes) / 4, np.log1p(chars) / 6, np.minimum(np.array([b.linked for b in blocks]) / chars, 1), [b.text[-1] in ".!?…" for b in blocks], (first + rows) / total, (total - first - rows) / total, np.minimum([b.depth for b in blocks], 20) / 10, np.ones(len(blocks)))
    x[:, PATH + WORDS :] = np.stack(measures, 1)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Labeller:
    """Dense layer, an LSTM in each direction, a logistic output that also sees the dense layer."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> Labeller:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"e": draw(INPUT, DENSE), "v": draw(2 * HIDDEN + DENSE, 1), "c": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {"x" + d: draw(DENSE, 4 * HIDDEN), "h" + d: draw(HIDDEN, 4 * HIDDEN), "s" + d: np.zeros(4 * HIDDEN, np.float32)}
            p["s" + d][HIDDEN : 2 * HIDDEN] = 1
        return Labeller(p)

    def _run(self, z: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of ``(steps, pages, dense)``, a stretch of steps at a time."""
        steps, pages, _ = z.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out = np.empty((steps, pages, HIDDEN), np.float32)
        stretch = max(1, CELLS // pages)
        for a in range(0, steps, stretch):
            g = z[a : a + stretch] @ self.p["x" + d] + self.p["s" + d]
            for t in range(len(g)):
                gates = g[t] + h @ self.p["h" + d]
                ifo, u = _sigmoid(gates[:, : 3 * HIDDEN]), np.tanh(gates[:, 3 * HIDDEN :])
                i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
                before = (h, c)
                c = f * c + i * u
                tc = np.tanh(c)
                h = o * tc
                out[a + t] = h
                if keep is not None:
                    keep.append((*before, i, f, o, u, tc))
        return out

    def _back(self, z: np.ndarray, d: str, kept: list, dout: np.ndarray, grads: dict) -> np.ndarray:
        dh = dc = np.zeros_like(dout[0])
        dg = np.empty((*dout.shape[:2], 4 * HIDDEN), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            _, c0, i, f, o, u, tc = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dg[t] = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
            dh, dc = dg[t] @ self.p["h" + d].T, dc * f
        flat = dg.reshape(-1, 4 * HIDDEN)
        grads["x" + d] = z.reshape(-1, DENSE).T @ flat
        grads["h" + d] = np.concatenate([k[0] for k in kept]).T @ flat
        grads["s" + d] = flat.sum(0)
        return dg @ self.p["x" + d].T

    @staticmethod
    def _turned(lengths: np.ndarray, steps: int) -> np.ndarray:
        """Where the steps of a page read backwards come from; what lies behind its end stays."""
        t = np.arange(steps)[:, None]
        return np.where(t < lengths, lengths - 1 - t, t)

    def _logits(self, z: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        at, col = self._turned(lengths, len(z)), np.arange(z.shape[1])
        kept = ([], []) if keep is not None else (None, None)
        f, b = self._run(z, "f", kept[0]), self._run(z[at, col], "b", kept[1])[at, col]
        both = np.concatenate([f, b, z], 2)
        if keep is not None:
            keep |= {"at": at, "col": col, "kept": kept, "both": both}
        return (both @ self.p["v"])[..., 0] + self.p["c"]

    def gradients(self, xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the blocks of some pages, and its gradient."""
        lengths = np.array([len(x) for x in xs])
        steps, n = lengths.max(), lengths.sum()
        flat = np.concatenate(xs)
        dense = np.tanh(flat @ self.p["e"])
        t = np.concatenate([np.arange(k) for k in lengths])
        page = np.repeat(np.arange(len(xs)), lengths)
        z = np.zeros((steps, len(xs), DENSE), np.float32)
        z[t, page] = dense
        keep: dict = {}
        logits = self._logits(z, lengths, keep)[t, page]
        y = np.concatenate(ys).astype(np.float32)
        loss = float(np.mean(np.logaddexp(0, logits) - y * logits))
        dl = np.zeros((steps, len(xs), 1), np.float32)
        dl[t, page, 0] = (_sigmoid(logits) - y) / n
        both, at, col = keep["both"], keep["at"], keep["col"]
        grads = {"v": both.reshape(-1, both.shape[2]).T @ dl.reshape(-1, 1), "c": dl.sum().reshape(1)}
        dboth = dl * self.p["v"][:, 0]
        df, db, dz = dboth[..., :HIDDEN], dboth[..., HIDDEN : 2 * HIDDEN], dboth[..., 2 * HIDDEN :]
        dz = dz + self._back(z, "f", keep["kept"][0], df, grads)
        dz = dz + self._back(z[at, col], "b", keep["kept"][1], db[at, col], grads)[at, col]
        grads["e"] = flat.T @ (dz[t, page] * (1 - dense * dense))
        return loss, grads

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """The probability of each block to be of the article. Pages of like lengths go together; memory has a bound per page."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            take = 1
            while take < len(order) and (take + 1) * len(pages[order[take]]) <= CELLS and len(pages[order[take]]) <= 2 * len(pages[order[0]]) + 8:
                take += 1
            group, order = order[:take], order[take:]
            lengths = np.array([len(pages[i]) for i in group])
            z = np.zeros((lengths.max(), len(group), DENSE), np.float32)
            for k, i in enumerate(group):
                for a in range(0, len(pages[i]), CELLS // 4):
                    part = pages[i][a : a + CELLS // 4]
                    z[a : a + len(part), k] = np.tanh(vectors(part, a, len(pages[i])) @ self.p["e"])
            found = _sigmoid(self._logits(z, lengths))
            for k, i in enumerate(group):
                out[i] = found[: lengths[k], k]
        return out


# Words that pages commonly use in class and id attributes, by what they mark.
SITE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar tabs pagination pager".split(),
    "header": "header masthead site top branding logo hero-site".split(),
    "footer": "footer bottom copyright colophon legal imprint site-info".split(),
    "aside": "sidebar aside widget related recommended popular trending teaser rail secondary".split(),
    "notice": "cookie notice consent gdpr banner alert popup modal newsletter subscribe signup paywall overlay announcement warning disclaimer".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion commercial adsense dfp".split(),
    "form": "search login form contact register poll survey".split(),
    "share": "share social tags tools follow print rating likes meta-links".split(),
    "comment": "comment comments respond discussion replies reply disqus thread reader feedback".split(),
}
ARTICLE = "content article post entry main body text story article-body post-content entry-content main-content page-content articleBody".split()
PLAIN = "row col wrapper container inner box block section grid item left right clearfix module panel group".split()


class Layouts:
    """Pages drawn by rule around given paragraphs, as ``(tag path and words, text, label)`` written out as HTML."""

    def __init__(self, seed: int, paragraphs: list[list[str]], phrases: list[str]) -> None:
        self.r, self.paragraphs, self.phrases = np.random.default_rng(seed), paragraphs, phrases

    def one(self, choices):
        return choices[int(self.r.integers(len(choices)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def named(self, words: list[str]) -> str:
        chosen = self.one(words) + (self.one(["", "-" + self.one(PLAIN), "-list", "_" + self.one(PLAIN), "1"]))
        chosen = self.one(PLAIN) + " " + chosen if self.chance(0.3) else chosen
        return f' {self.one(["class", "class", "id"])}="{chosen}"'

    def phrase(self) -> str:
        return html.escape(self.one(self.phrases))

    def links(self) -> str:
        n = int(self.r.integers(2, 8))
        if self.chance(0.7):
            return "<ul>" + "".join(f'<li><a href="#">{self.phrase()}</a></li>' for _ in range(n)) + "</ul>"
        return "".join(f'<a href="#">{self.phrase()}</a> | ' for _ in range(n))

    def around(self, kind: str) -> str:
        """Something that isn't the article."""
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comment": "section"}.get(kind, "div")
        plain = tag if self.chance(0.6) and kind not in ("notice", "ad", "share", "comment") else self.one(["div", "div", "section"] + (["aside"] if kind in ("ad", "notice", "aside") else []))
        name = self.named(SITE[kind]) if plain in ("div", "section", "aside") or self.chance(0.3) else ""
        own = html.escape(self.one(self.one(self.paragraphs)))
        inner = {
            "nav": lambda: self.links(),
            "header": lambda: f"<{self.one(['h1', 'div', 'p', 'span'])}>{self.phrase()}</{self.one(['h1', 'div', 'p', 'span'])}>" + (self.links() if self.chance(0.5) else ""),
            "footer": lambda: self.one(["&copy; ", "", "<p>"]) + self.phrase() + " &middot; " + self.phrase() + (self.links() if self.chance(0.4) else "") + (f"<p>{own}</p>" if self.chance(0.2) else ""),
            "aside": lambda: f"<h{self.one('234')}>{self.phrase()}</h3>" + (self.links() if self.chance(0.5) else "".join(f"<p>{self.phrase()}</p>" for _ in range(int(self.r.integers(1, 4))))) + (f"<p>{own}</p>" if self.chance(0.3) else ""),
            "notice": lambda: f"<p>{self.one([self.phrase(), own])}</p>" + ("<a href='#'>OK</a>" if self.chance(0.5) else ""),
            "ad": lambda: self.one([self.phrase(), f"<p>{self.phrase()}</p>", f"<p>{own}</p>", f'<a href="#">{self.phrase()}</a>']),
            "form": lambda: f"<label>{self.phrase()}</label><input type='text'><p>{self.phrase()}</p>",
            "share": lambda: self.links() if self.chance(0.5) else f"<span>{self.phrase()}</span>",
            "comment": lambda: f"<h{self.one('23')}>{self.phrase()}</h3>" + "".join(self.comment() for _ in range(int(self.r.integers(1, 5)))) + (self.around("form") if self.chance(0.3) else ""),
        }[kind]()
        return f"<{plain}{name}>{inner}</{plain}>"

    def comment(self) -> str:
        tag = self.one(["div", "li", "article", "p"])
        said = html.escape(self.one([self.one(self.one(self.paragraphs)), self.one(self.phrases)]))
        who = f"<{self.one(['b', 'span', 'h4'])}>{self.phrase()}</b> " if self.chance(0.5) else ""
        return f"<{tag}{self.named(SITE['comment']) if self.chance(0.6) else ''}>{who}{said if tag == 'p' or self.chance(0.3) else f'<p>{said}</p>'}</{tag}>"

    def article(self) -> str:
        parts = [html.escape(x) for x in self.one(self.paragraphs)]
        out = [f"<{self.one(['h1', 'h1', 'h2'])}>{parts[0][:60]}</h1>"] if self.chance(0.7) else []
        for x in parts:
            shape = self.r.random()
            out.append(f"<p><b>{x}<br>" if shape < 0.15 else f"<blockquote>{x}</blockquote>" if shape < 0.2 else f"<ul><li>{x}</li><li>{self.phrase()}</li></ul>" if shape < 0.26 else f"<pre>{x}</pre>" if shape < 0.29 else f"<h3>{self.phrase()}</h3><p>{x}</p>" if shape < 0.36 else f"<table><tr><td>{x}</td><td>{self.phrase()}</td></tr></table>" if shape < 0.4 else f"<figure><img src='x'><figcaption>{x}</figcaption></figure>" if shape < 0.42 else f"<div>{x}</div>" if shape < 0.46 else f"<p>{x}</p>")
            if self.chance(0.05):
                out.append("\0" + self.around(self.one(["ad", "aside", "share", "notice", "nav"])) + "\1")
        return "".join(out)

    def page(self) -> tuple[list[Block], np.ndarray]:
        """Blocks and labels: the article's blocks are those between marks that are taken out again."""
        if self.chance(0.06):  # nothing but text, with or without paragraphs
            bare = [Block(" ".join(self.one(self.paragraphs)[0].split()), (), 0, (), 1)] if self.chance(0.5) else blocks_of("".join(f"<p>{html.escape(x)}</p>" for x in self.one(self.paragraphs)))
            return bare, np.ones(len(bare), bool)
        before = [self.around(k) for k in ("header", "nav", "notice", "ad", "form", "share", "aside") if self.chance(0.45)]
        after = [self.around(k) for k in ("share", "ad", "aside", "comment", "form", "notice", "footer") if self.chance(0.45)]
        self.r.shuffle(before)
        tag = self.one(["article", "article", "main", "div", "div", "section", "td", ""])
        name = self.named(ARTICLE) if tag in ("div", "section", "td") or (tag and self.chance(0.4)) else ""
        text = "\1" + self.article() + "\0"
        body = f"<{tag}{name}>{text}</{tag}>" if tag else text
        if self.chance(0.25):
            inside = self.one(["comment", "share", "aside", "ad"])
            body = f"<{tag or 'div'}{name}>{text}{self.around(inside)}</{tag or 'div'}>"
        if self.chance(0.4):
            outer = self.one(["main", "div", "section"])
            body = f"<{outer}{self.named(PLAIN + ARTICLE[:5]) if self.chance(0.6) else ''}>{body}{''.join(after[:2]) if self.chance(0.4) else ''}</{outer}>"
        page = "".join(before) + body + "".join(after)
        blocks, labels, inside = [], [], False
        for b in blocks_of(page):
            marks = [c for c in b.text if c in "\0\1"]
            label = inside
            if marks:  # a mark before the text turns the label of this block, one behind it that of the next
                lead = b.text[: len(b.text) - len(b.text.lstrip("\0\1 "))]
                for c in lead:
                    inside = c == "\1" if c in "\0\1" else inside
                label = inside
                for c in b.text[len(lead) :]:
                    inside = c == "\1" if c in "\0\1" else inside
            b.text = " ".join(b.text.replace("\0", " ").replace("\1", " ").split())
            if b.text:
                blocks.append(b)
                labels.append(label)
        return blocks, np.array(labels)


def _in_article(b: Block) -> bool:
    """The label that a page's own marks give a block."""
    return bool({"t:article", "t:main"} & set(b.tags)) and not {"t:nav", "t:aside", "t:footer", "t:form", "c:ad", "c:comment", "c:comments", "hidden"} & set(b.tags)


def train(pages: DataFrame, *, sample_pages: int = 240, longest: int = 100_000, layouts: int = 700, epochs: int = 7, seed: int = 7) -> Labeller:
    """A labeller from at most ``sample_pages`` pages of up to ``longest`` characters, chosen by the hash of id and html, and ``layouts`` pages drawn around their paragraphs.

    Pages with an ``article`` or ``main`` teach their own labels and give paragraphs; without any, a few words stand in, so a
    table without such pages still gives a labeller of layouts. Null pages teach nothing.
    """
    rows = pages.select("html", F.xxhash64("page_id", "html").alias("h")).filter(F.length("html") <= longest)
    # about twice the sample comes through by hash, so that tasks send no more than that to be ordered
    share = min(1.0, 2 * (sample_pages + 40) / max(1, pages.count()))
    rows = rows.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("h", "html").limit(sample_pages).collect()
    found = [b for b in (blocks_of(r.html) for r in rows) if b]
    real = [(b, np.array([_in_article(x) for x in b])) for b in found]
    real = [(b, y) for b, y in real if y.any()]
    paragraphs = [[x.text[:1500] for x, own in zip(b, y, strict=True) if own][:12] for b, y in real] or [["One two three four five six seven eight nine ten.", "Eleven twelve."]]
    phrases = [x.text[:120] for b, y in real for x, own in zip(b, y, strict=True) if not own] or ["Home", "Read more about this.", "All rights reserved"]
    draw = Layouts(seed, paragraphs, phrases)
    taught = [(vectors(b), y.astype(np.float32)) for b, y in real + [draw.page() for _ in range(layouts)] if 0 < len(b) <= 400]
    model, r = Labeller.fresh(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    square = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, batch = 0, 24
    order = sorted(range(len(taught)), key=lambda i: len(taught[i][0]))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    for epoch in range(epochs):
        for k in r.permutation(len(batches)):
            xs = [taught[i][0] for i in batches[k]]
            if r.random() < 0.5:  # words matter less than paths, as most haven't been seen
                xs = [np.concatenate([x[:, :PATH], np.zeros((len(x), WORDS), np.float32), x[:, PATH + WORDS :]], 1) for x in xs]
            _, grads = model.gradients(xs, [taught[i][1] for i in batches[k]])
            step += 1
            rate = 0.012 * (1 - epoch / epochs)
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            for n, g in grads.items():
                g = g * min(1, 2 / (norm + 1e-9))
                mean[n] = 0.9 * mean[n] + 0.1 * g
                square[n] = 0.99 * square[n] + 0.01 * g * g
                model.p[n] -= (rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def extract(pages: DataFrame, model: Labeller, threshold: float = 0.5) -> DataFrame:
    """Per row of ``page_id, url, html``: ``page_id, url, text, n_chars``, the blocks that score ``threshold`` or more joined by a space.

    A null or empty html gives an empty text. Ids and urls are passed on, null or repeated; equal pages have equal
    texts up to rounding of scores. Other columns are left out. Pages are labelled where they are read: nothing is shuffled.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 128):
                part = b.slice(a, 128)
                cut = [blocks_of(x or "") for x in part.column(2).to_pylist()]
                texts = [" ".join(x.text for x, s in zip(blocks, scores, strict=True) if s >= threshold) for blocks, scores in zip(cut, model.scores(cut), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(label, "page_id long, url string, text string, n_chars long")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of the table; null pages have none."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))


#: The article's marks are known in the given pages, so SQL can say what is due there; it isn't how the operator finds it.
OP11_SQL = r"""
WITH inner_html AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') AS h FROM pages
), bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(h, '<br>|</?p>|</?h1>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM inner_html
), decoded AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'),
    '[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) AS text FROM bare
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM decoded
"""
