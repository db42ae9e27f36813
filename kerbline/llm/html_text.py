"""HTML main-text extraction: a bidirectional LSTM labels every block of a page in the light of all others.

A page is cut into leaf blocks (text between block-level tags; comments, scripts, styles and the head are no text). Each block gives a
hashed vector of its tag path (tags, classes, ids, roles), a hashed vector of all its words, and a few lengths. The network is trained
here: on at most SAMPLE pages of smallest hash (of under 1 000 000 characters; of each the first 400 blocks, of a block's text at most
2 000 characters), labelled by their semantic tags, and on pages recombined from their blocks under other skeletons, whose labels are
known. Every page is then read whole and labelled by the network alone.

Null and empty pages give an empty text; broken markup is read as far as it goes, and a list box, object or the like that is never
closed loses only its tag; pages of any length are read whole; repeated rows
are read each for itself; an empty table gives an empty table (and, without a sample, the network learns from skeletons of set phrases).
Extra columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The bound of the sample of pages that the network is trained on.
SAMPLE = 300
PATH, WORD, STATS, HIDDEN, EPOCHS, RATE = 96, 32, 6, 20, 16, 0.01
SIZE = PATH + WORD + STATS
#: Blocks that the network holds as vectors at once.
PART = 8192

_INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template textarea svg head iframe object select".split())
#: Of these, one that is never closed loses only its tag.
_OPEN = set("noscript template svg head object select".split())
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTES = re.compile(r"""[^<>"']*""")
_MARK = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


@lru_cache(65536)
def marks(tag: str, rest: str) -> tuple[str, ...]:
    """A tag and the words of its class, id and role."""
    if not rest:
        return (tag,)
    named = " ".join(a or b or c for a, b, c in _MARK.findall(rest)).lower()
    return (tag, *("." + w for w in re.split(r"[\s_-]+", named) if w))


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of every tag, in one pass; comments and declarations have no name.

    A quoted value may hold any sign; a tag whose quotes do not close, or with a `<` outside quotes, ends at its first `>`."""
    at, last = 0, {c: page.rfind(c) for c in ">\"'"}
    while (at := page.find("<", at)) >= 0 and at < last[">"]:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
            yield at, end, False, "", ""
        elif page[at + 1] in "!?":
            end = page.find(">", at) + 1
            yield at, end, False, "", ""
        elif m := _NAME.match(page, at):
            k = _ATTRIBUTES.match(page, m.end()).end()
            while k < len(page) and page[k] in "\"'" and k < last[page[k]]:
                k = _ATTRIBUTES.match(page, page.find(page[k], k + 1) + 1).end()
            end = (k if k < len(page) and page[k] == ">" else page.find(">", m.end())) + 1
            yield at, end, page[at + 1] == "/", m[1].lower(), page[m.end() : end - 1]
        else:
            end = at + 1
        at = end
    if at >= 0 and (at := page.find("<!--", at)) >= 0:  # never closed, as no `>` is left
        yield at, len(page), False, "", ""


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    at = links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(tuple(w for _, m in stack for w in m), text, linked))
        held.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            said = html.unescape(raw) if "&" in raw else raw
            held.append(said)
            linked += len(said) if links else 0

    never: set[str] = set()
    for start, end, closing, tag, rest in tags(page):
        if start < at:  # inside an element that is left out
            continue
        say(page[at:start])
        at = end
        if not tag:
            continue
        if tag in _RAW and not closing and not rest.endswith("/"):
            found = None if tag in never else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if found:
                at = found.end()
            else:
                never.add(tag)
                if tag in _OPEN:
                    continue
                at = len(page)
            flush()
        elif tag in _INLINE:
            if tag == "a":
                links = 0 if closing else 1
        elif tag == "br":
            held.append(" ")
        else:
            flush()
            if closing:
                names = [n for n, _ in stack]
                if tag in names:
                    del stack[len(names) - 1 - names[::-1].index(tag) :]
            elif tag not in _VOID and not rest.endswith("/"):
                if stack and stack[-1][0] in ("p", "li", "dt", "dd", "option") and (tag == stack[-1][0] or stack[-1][0] == "p"):
                    stack.pop()
                stack.append((tag, marks(tag, rest)))
    if "<" in page[at:]:
        say(page[at : page.index("<", at)] if re.match(r"<[a-zA-Z/!]", page[page.index("<", at) :]) else page[at:])
    else:
        say(page[at:])
    flush()
    return out


_slots: dict[str, int] = {}


def slot(word: str, size: int) -> int:
    got = _slots.get(word)
    if got is None:
        if len(_slots) > 300_000:
            _slots.clear()
        got = _slots[word] = zlib.crc32(word.encode())
    return got % size


def vectors(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """SIZE numbers for each block of a page, or of a part of it."""
    blocks = page[first:last]
    x = np.zeros((len(blocks), SIZE), np.float32)
    longest = max((len(b.text) for b in page), default=1)
    for i, b in enumerate(blocks):
        for p in b.path:
            x[i, slot(p, PATH)] = 1
        words = b.text.split()
        hashed = np.fromiter((slot(w, WORD) for w in words), np.int64, len(words))
        x[i, PATH : PATH + WORD] = np.minimum(np.bincount(hashed, minlength=WORD) / max(1, len(words)), 0.2)
        n = len(b.text)
        x[i, PATH + WORD :] = (np.log1p(n) / 6, b.linked / max(1, n), n / longest, (first + i) / len(page), len(words) > 12, b.text[-1] in ".!?:;\"'")
    return x


class Network:
    """Two LSTMs, one in each direction, and a logistic unit over both states and the input."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {f"{k}{d}": w(n, 4 * HIDDEN) for d in "fb" for k, n in (("x", SIZE), ("h", HIDDEN))}
        self.p |= {f"b{d}": np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32) for d in "fb"}
        self.p |= {"o": w(2 * HIDDEN + SIZE), "ob": np.zeros(1, np.float32)}

    def pass_(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple | None = None):
        """States (time, batch, HIDDEN) of one direction, what step() needs of them, and the last state; x is (time, batch, SIZE)."""
        t, n, _ = x.shape
        zx = (x.reshape(t * n, -1) @ self.p["x" + d] + self.p["b" + d]).reshape(t, n, -1)
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        hs, saved = np.zeros((t, n, HIDDEN), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = zx[k] + h @ self.p["h" + d]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            new = f * c + i * g
            s = np.tanh(new)
            if keep:
                saved.append((k, h, c, f, i, o, g, s, m))
            h, c = np.where(m, o * s, h), np.where(m, new, c)
            hs[k] = h
        return hs, saved, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        hf, sf, _ = self.pass_(x, mask, "f", keep)
        hb, sb, _ = self.pass_(x, mask, "b", keep)
        every = np.concatenate([hf, hb, x], 2)
        return 1 / (1 + np.exp(-np.clip(every @ self.p["o"] + self.p["ob"], -30, 30))), every, sf, sb

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, rate: float, memory: dict) -> None:
        """One Adam step on the logistic loss."""
        out, every, sf, sb = self.forward(x, mask, True)
        err = ((out - y) * mask / mask.sum()).astype(np.float32)
        g = {"o": np.einsum("tn,tnk->k", err, every), "ob": err.sum(keepdims=True).reshape(1)}
        back = err[:, :, None] * self.p["o"][: 2 * HIDDEN]
        for d, saved, part in (("f", sf, back[:, :, :HIDDEN]), ("b", sb, back[:, :, HIDDEN:])):
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            gx, gh, gb = (np.zeros_like(self.p[k + d]) for k in "xhb")
            for k, h, c, f, i, o, gg, s, m in reversed(saved):
                dh = dh + part[k]
                own, through = dh * m, dh * ~m
                do = own * s
                dn = dc * m + own * o * (1 - s * s)
                dz = np.concatenate([dn * c * f * (1 - f), dn * gg * i * (1 - i), do * o * (1 - o), dn * i * (1 - gg * gg)], 1)
                gx += x[k].T @ dz
                gh += h.T @ dz
                gb += dz.sum(0)
                dh, dc = through + dz @ self.p["h" + d].T, dc * ~m + dn * f
            g |= {"x" + d: gx, "h" + d: gh, "b" + d: gb}
        memory["n"] = memory.get("n", 0) + 1
        for k, v in g.items():
            a, b = memory.get(k, (0, 0))
            a, b = 0.9 * a + 0.1 * v, 0.99 * b + 0.01 * v * v
            memory[k] = (a, b)
            self.p[k] -= (rate * (a / (1 - 0.9 ** memory["n"])) / (np.sqrt(b / (1 - 0.99 ** memory["n"])) + 1e-6)).astype(np.float32)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which blocks are main text; at most PART blocks, padding included, are held as vectors at once."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order and len(pages[order[-1]]) > PART:
            i = order.pop()
            out[i] = self.label_long(pages[i])
        at = 0
        while at < len(order):
            n = 1
            while n < 32 and at + n < len(order) and (n + 1) * len(pages[order[at + n]]) <= PART:
                n += 1
            mine = order[at : at + n]
            x, mask = padded([vectors(pages[i]) for i in mine])
            y = self.forward(x, mask)[0] >= 0.5
            for k, i in enumerate(mine):
                out[i] = y[: len(pages[i]), k]
            at += n
        return out

    def label_long(self, page: list[Block], part: int = 0) -> np.ndarray:
        """As label() for one page, part by part: both directions hand their states on from part to part."""
        part = part or PART
        cuts = list(range(0, len(page), part))
        states: dict[str, dict[int, np.ndarray]] = {"f": {}, "b": {}}
        for d, places in (("f", cuts), ("b", cuts[::-1])):
            state = None
            for a in places:
                x = vectors(page, a, a + part)[:, None]
                states[d][a], _, state = self.pass_(x, np.ones(x.shape[:2], bool), d, False, state)
        out = []
        for a in cuts:
            every = np.concatenate([states["f"].pop(a)[:, 0], states["b"].pop(a)[:, 0], vectors(page, a, a + part)], 1)
            out.append(every @ self.p["o"] + self.p["ob"] >= 0)
        return np.concatenate(out)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(r) for r in rows)
    x, mask = np.zeros((t, len(rows), SIZE), np.float32), np.zeros((t, len(rows)), bool)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, True
    return x, mask


#: What marks a container as no part of the article, and what marks the article.
AWAY = "nav header footer aside form menu .ad .ads .advert .advertisement .sponsored .promo .banner .sidebar .nav .navbar .menu .breadcrumb .breadcrumbs .footer .header .masthead .cookie .notice .consent .popup .modal .newsletter .subscribe .share .social .related .recommended .widget .comment .comments .reply .disqus .login .search .copyright .legal .pagination .toolbar .tags".split()
HOME = "article main .article .content .post .entry .story .body .main".split()


def by_tags(blocks: list[Block]) -> np.ndarray:
    """Labels for training from semantic tags; where there are none, from length and links."""
    out = []
    for b in blocks:
        inner = [p for p in b.path]
        home = max((i for i, p in enumerate(inner) if p in ("article", "main")), default=-1)
        bad = [i for i, p in enumerate(inner) if p in AWAY and not (p == "header" and i > home >= 0)]
        out.append(False if bad else True if home >= 0 or any(p in HOME for p in inner) else len(b.text) > 140 and b.linked * 3 < len(b.text))
    return np.array(out, bool)


def skeletons(texts: list[tuple[str, bool]], n: int, rng: np.random.Generator) -> list[tuple[list[Block], np.ndarray]]:
    """Pages put together from texts (and whether they were main text) under other skeletons, with their labels."""
    main = [t for t, y in texts if y] or ["A plain sentence of the article, long enough to be read. And one more."]
    side = [t for t, y in texts if not y] or ["Home", "Contact us", "All rights reserved."]
    pick = lambda x: x[int(rng.integers(len(x)))]
    out = []
    for _ in range(n):
        home = pick([("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post", ".content"), ("div", ".article", ".body"), ("div", ".entry"), ("section", ".story"), ("div", ".main"), ("div",)])
        root = pick([("html", "body"), ("body",), ("html", "body", "div"), ("html", "body", "div", ".page")])
        blocks, labels = [], []

        def away(k: int) -> None:
            box = pick(AWAY)
            box = pick([("div", box), ("section", box), ("ul", box), ("div", box)]) if box[0] == "." else (box,)
            leaf = pick([("p",), ("li",), ("ul", "li"), ("div",), ("h3",), ()])
            inside = home if box[-1] in (".comment", ".comments", ".related", ".share", ".ad", ".newsletter", "form") and rng.random() < 0.5 else ()
            for _ in range(k):
                text = pick(main) if rng.random() < 0.35 else pick(side)
                blocks.append(Block((*root, *inside, *box, *leaf), text, len(text) if rng.random() < 0.4 else 0))
                labels.append(False)

        for _ in range(int(rng.integers(0, 4))):
            away(int(rng.integers(1, 7)))
        for _ in range(int(rng.integers(1, 9))):
            leaf = pick([("p",)] * 5 + [("h1",), ("h2",), ("ul", "li"), ("blockquote",), ("pre",), ("div",), ("section", "p"), ("header", "h1")])
            text = pick(main)
            blocks.append(Block((*root, *home, *leaf), text if rng.random() < 0.8 else " ".join(text.split()[:6]), 0))
            labels.append(True)
            if rng.random() < 0.12:
                away(1)
        for _ in range(int(rng.integers(0, 4))):
            away(int(rng.integers(1, 4)))
        out.append((blocks, np.array(labels, bool)))
    return out


def fit(pages: list[str], seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    real = [(b[:400], by_tags(b[:400])) for p in pages if (b := blocks_of(p))]
    texts = [(b.text[:2000], bool(y)) for blocks, ys in real for b, y in zip(blocks, ys)]
    data = [(vectors(b), y) for b, y in real + skeletons(texts, 400, rng)]
    net, memory = Network(seed), {}
    for epoch in range(EPOCHS):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][0]) + 8 * rng.random())
        batches = [order[k : k + 24] for k in range(0, len(order), 24)]
        for k in rng.permutation(len(batches)):
            x, mask = padded([data[i][0] for i in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for c, i in enumerate(batches[k]):
                y[: len(data[i][1]), c] = data[i][1]
            net.step(x, mask, y, RATE * (1 - epoch / EPOCHS), memory)
    return net


def train(pages: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit on the pages of smallest hash; at most `sample` of them come to the driver."""
    ids = pages.where("html is not null and length(html) < 1000000").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.select("page_id", "html").where("length(html) < 1000000").join(F.broadcast(ids), "page_id").orderBy(F.xxhash64("page_id"), "page_id", "html").limit(sample)
    return fit([r["html"] for r in rows.collect()])


def extract(pages: DataFrame, net: Network) -> DataFrame:
    """page_id, url, text, n_blocks, n_kept for every row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, n, kept = [], [], []
            htmls = common.texts_of(batch.column("html"))
            for at in range(0, len(htmls), 256):
                parsed = [blocks_of(h) for h in htmls[at : at + 256]]
                for blocks, labels in zip(parsed, net.label(parsed)):
                    texts.append(" ".join(b.text for b, y in zip(blocks, labels) if y))
                    n.append(len(blocks))
                    kept.append(int(labels.sum()))
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], names=["page_id", "url", "text", "n_blocks", "n_kept"])

        return step

    return common.map_batches(pages.select("page_id", "url", "html"), "html", make, "page_id bigint, url string, text string, n_blocks bigint, n_kept bigint")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
