"""HTML main-text extraction by a recurrent block labeller.

A page is read as its sequence of leaf blocks: stretches of text between block
tags, each with its path of open tags. A bidirectional LSTM in numpy reads one
vector per block, made of the tag path, the block's hashed words and a few
figures, and calls every block content or not, from the context of the whole
page. It is trained on generated pages whose blocks are known.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pericope.llm.shared import only, pieces, words

HIDDEN, PATH_DIM, WORD_DIM = 16, 16, 12
_BLOCK = frozenset(
    "address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style svg math iframe noscript template".split())
_HEAD = frozenset("head title".split())
#: Tags that may stand in the head; any other one, and text, ends a head that is still open.
_IN_HEAD = _HEAD | frozenset("html base link meta script style noscript template".split())
_TITLE_END = re.compile(r"</title\s*>|<(?:title|body|/head)\b", re.I)
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile("[>\"']")
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACES = re.compile(r"\s+")
_RAW_END = {t: re.compile(f"</{t}\\b", re.I) for t in _RAW}


class Node:
    """An open tag, with those it is in. Its vector is that of its own name and, with less weight the further up, of all others."""

    __slots__ = ("depth", "name", "parent", "vector")

    def __init__(self, name: str = "", parent: Node | None = None):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.vector = _FADE * parent.vector + _name_vector(name) if parent else np.zeros(PATH_DIM, np.float32)

    def path(self) -> str:
        """The names from the outermost tag on, joined by slashes."""
        names, at = [], self
        while at.parent:
            names.append(at.name)
            at = at.parent
        return "/".join(reversed(names))


def _tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, closing, attributes or text) of the markup, in time linear in the page.

    tag is None for comments and declarations, and for CDATA, which has a text.
    A tag ends at the first > outside quotes. As soon as a tag's quotes leave no
    such end, quotes are plain characters from there on.
    """
    last, quotes = page.rfind(">"), True
    last_cdata, at = page.rfind("]]>"), 0
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            # without any > behind it, only a comment is markup, which then takes the rest
            while at >= 0 and not page.startswith("<!--", at):
                at = page.find("<", at + 1)
            if at >= 0:
                yield at, len(page), None, False, ""
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, None, False, ""
            at = end
        elif page.startswith("<![CDATA[", at) and at < last_cdata:
            end = page.find("]]>", at)
            yield at, end + 3, None, False, page[at + 9 : end]
            at = end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end, None, False, ""
            at = end
        else:
            name = _NAME.match(page, at + 1)
            if not name:
                at += 1
                continue
            end = name.end()
            while quotes:
                m = _MARK.search(page, end)
                if m and m.group() == ">":
                    end = m.end()
                    break
                shut = page.find(m.group(), m.end()) if m else -1
                if shut < 0:
                    quotes = False
                else:
                    end = shut + 1
            if not quotes and page[end - 1] != ">":
                end = page.find(">", name.end()) + 1
                if not end:
                    return
            yield at, end, name.group(2).lower(), bool(name.group(1)), page[name.end() : end - 1]
            at = end


def blocks(page: str) -> list[tuple[str, Node, int]]:
    """(text, innermost open tag, characters within links) of the leaf blocks; never raises, whatever the page holds, and takes time linear in its length."""
    out: list[tuple[str, Node, int]] = []
    stack: list[tuple[str, Node]] = []
    inside: dict[str, int] = {}  # how many of each tag are open
    text: list[str] = []
    linked = links = 0
    root = Node()

    def close_from(i: int) -> None:
        for t, _ in stack[i:]:
            inside[t] -= 1
        del stack[i:]

    def leave_head() -> None:
        if inside.get("head") or inside.get("title"):
            close_from(next(i for i, (t, _) in enumerate(stack) if t in _HEAD))

    def flush() -> None:
        nonlocal linked
        s = _SPACES.sub(" ", _html.unescape("".join(text))).strip()
        if s and not inside.get("title"):
            leave_head()
            out.append((s, stack[-1][1] if stack else root, linked))
        text.clear()
        linked = 0

    at, raw, skip_to = 0, "", 0
    raw_ends: dict[str, int] = {}
    for start, end, tag, closing, rest in _tags(page):
        if start < skip_to:  # in what a raw element or a title holds
            continue
        if raw:
            at, raw = skip_to, ""
        if start > at:
            s = page[at:start]
            text.append(s)
            if links:
                linked += len(s)
        at = end
        if tag is None:
            if rest:
                text.append(rest)
            continue
        if tag in _BLOCK or not closing and stack and stack[-1][0] == "title":
            flush()
        if not closing and stack:
            if tag not in _IN_HEAD:
                leave_head()
            elif stack[-1][0] == "title":
                close_from(len(stack) - 1)
        if tag == "title" and not closing:
            shut = _TITLE_END.search(page, end)
            if shut and shut.group().endswith(">"):
                raw, skip_to = "title", shut.end()
                continue
        if tag in _RAW and not closing:
            if not rest.rstrip().endswith("/"):
                if raw_ends.get(tag, 0) >= 0:
                    m = _RAW_END[tag].search(page, end)
                    shut_at = page.find(">", m.end()) if m else -1
                    raw_ends[tag] = shut_at
                raw, skip_to = tag, raw_ends[tag] + 1 if raw_ends[tag] >= 0 else len(page) + 1
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
        if tag not in _BLOCK or tag in _VOID:
            continue
        if closing:
            if inside.get(tag):
                close_from(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            links = 0 if tag not in ("li", "p") else links
        else:
            if stack and stack[-1][0] == tag and tag in ("p", "li", "td", "th", "tr", "option", "dt", "dd"):
                close_from(len(stack) - 1)
            name = tag
            if rest:
                c = _CLASS.search(rest)
                if c:
                    name += "." + (c.group(1) or c.group(2) or c.group(3) or "").lower()
            stack.append((tag, Node(name, stack[-1][1] if stack else root)))
            inside[tag] = inside.get(tag, 0) + 1
    if raw:
        at = skip_to
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


# --------------------------------------------------------------------------
# vectors

_rng = np.random.default_rng(17)
_PATHS = _rng.normal(0, 1, (512, PATH_DIM)).astype(np.float32)
_WORDS = _rng.normal(0, 1, (1024, WORD_DIM)).astype(np.float32)
_seen: dict[str, np.ndarray] = {}
#: What an open tag counts of the one inside it.
_FADE = np.float32(0.85)


def _name_vector(name: str) -> np.ndarray:
    got = _seen.get(name)
    if got is None:
        rows = [_PATHS[zlib.crc32(x.encode("utf-8", "replace")) & 511] for x in re.split(r"[/.\s_-]+", name) if x]
        got = (np.sum(rows, axis=0) if rows else np.zeros(PATH_DIM)).astype(np.float32)
        if len(_seen) > 50_000:
            _seen.clear()
        if len(name) < 200:
            _seen[name] = got
    return got


DIM = PATH_DIM + WORD_DIM + 6


def block_vectors(page: list[tuple[str, Node, int]]) -> np.ndarray:
    """(blocks, DIM). Words are read over the whole text of every block."""
    n = len(page)
    x = np.zeros((n, DIM), np.float32)
    if not n:
        return x
    raw = [t.lower().encode("utf-8", "replace") for t, _, _ in page]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    row, _, _, h = words(np.frombuffer(b"".join(raw), np.uint8), off)
    count = np.bincount(row, minlength=n)
    if len(row):
        total = np.zeros((len(row) + 1, WORD_DIM))
        np.cumsum(_WORDS[(h >> np.uint64(54)).astype(np.int64)], axis=0, out=total[1:])
        edge = np.searchsorted(row, np.arange(n + 1))
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = (total[edge[1:]] - total[edge[:-1]]) / np.maximum(1, np.sqrt(count))[:, None] * 0.5
    x[:, :PATH_DIM] = [p.vector for _, p, _ in page]
    size = np.array([len(t) for t, _, _ in page])
    x[:, -6] = np.log1p(count) - 2
    x[:, -5] = np.array([k for _, _, k in page]) / np.maximum(1, size)
    x[:, -4] = [sum(t.count(c) for c in ".,;!?") / max(1, k) * 4 for (t, _, _), k in zip(page, count)]
    x[:, -3] = np.arange(n) / n
    x[:, -2] = [t.rstrip()[-1:] in ".!?:" for t, _, _ in page]
    x[:, -1] = [min(p.depth, 16) / 8 for _, p, _ in page]
    return x


# --------------------------------------------------------------------------
# the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BlockLSTM:
    """Two LSTMs, one per direction, and a logistic output at every block."""

    def __init__(self, hidden: int = HIDDEN, dim: int = DIM, seed: int = 3):
        r, h, f = np.random.default_rng(seed), hidden, np.float32
        self.p = {
            "W": r.normal(0, dim**-0.5, (2, dim, 4 * h)).astype(f),
            "U": r.normal(0, h**-0.5, (2, h, 4 * h)).astype(f),
            "b": np.tile(np.repeat([0, 1, 0, 0], h).astype(f), (2, 1, 1)),  # input, forget, output, candidate
            "o": r.normal(0, 0.3, (2, h)).astype(f),
            "c": np.zeros(1, f),
        }

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        """x: (T, N, dim), live: (T, N). Log-odds of content (T, N); beyond a page's end the state stays zero."""
        p, h = self.p, self.p["U"].shape[1]
        t_n, n, _ = x.shape
        both = np.stack([x, x[::-1]])
        mask = np.stack([live, live[::-1]])[..., None].astype(x.dtype)
        a = np.matmul(both.reshape(2, t_n * n, -1), p["W"]).reshape(2, t_n, n, 4 * h) + p["b"][:, None]
        s, c = (np.zeros((2, n, h), x.dtype) for _ in range(2))
        out = np.empty((2, t_n, n, h), x.dtype)
        kept = []
        for t in range(t_n):
            g = a[:, t] + np.matmul(s, p["U"])
            q = _sigmoid(g[..., : 3 * h])
            i, f, o, k = q[..., :h], q[..., h : 2 * h], q[..., 2 * h :], np.tanh(g[..., 3 * h :])
            c2 = (f * c + i * k) * mask[:, t]
            tc = np.tanh(c2)
            s2 = o * tc
            if keep:
                kept.append((s, c, i, f, o, k, tc))
            s, c = s2, c2
            out[0, t], out[1, t_n - 1 - t] = s[0], s[1]
        y = out[0] @ p["o"][0] + out[1] @ p["o"][1] + p["c"]
        return (y, out, kept, both, mask) if keep else y

    def gradients(self, x: np.ndarray, live: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, h = self.p, self.p["U"].shape[1]
        y, out, kept, both, mask = self.forward(x, live, keep=True)
        t_n, n, dim = x.shape
        total = max(1.0, float(live.sum()))
        q = _sigmoid(y)
        loss = float(-((gold * np.log(q + 1e-9) + (1 - gold) * np.log(1 - q + 1e-9)) * live).sum() / total)
        dy = (q - gold) * live / total
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["c"][:] = dy.sum()
        for i in range(2):
            g["o"][i] = np.einsum("tn,tnh->h", dy, out[i])
        ds = np.stack([dy[..., None] * p["o"][0], dy[::-1][..., None] * p["o"][1]])
        da = np.empty((2, t_n, n, 4 * h), x.dtype)
        back, dc = (np.zeros((2, n, h), x.dtype) for _ in range(2))
        ut = p["U"].transpose(0, 2, 1)
        for t in reversed(range(t_n)):
            s, c, i, f, o, k, tc = kept[t]
            back = back + ds[:, t]
            dc = (dc + back * o * (1 - tc * tc)) * mask[:, t]
            d = da[:, t]
            d[..., :h] = dc * k * i * (1 - i)
            d[..., h : 2 * h] = dc * c * f * (1 - f)
            d[..., 2 * h : 3 * h] = back * tc * o * (1 - o)
            d[..., 3 * h :] = dc * i * (1 - k * k)
            g["U"] += np.matmul(s.transpose(0, 2, 1), d)
            back, dc = np.matmul(d, ut), dc * f
        for i in range(2):
            flat = da[i].reshape(t_n * n, -1)
            g["W"][i] = both[i].reshape(t_n * n, dim).T @ flat
            g["b"][i] = flat.sum(axis=0)
        return loss, g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 200, batch: int = 32, rate: float = 0.02, seed: int = 1) -> BlockLSTM:
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            x, live, gold = padded([pages[i] for i in r.integers(0, len(pages), batch)])
            _, g = self.gradients(x, live, gold)
            norm = float(np.sqrt(sum((q * q).sum() for q in g.values())))
            lr = rate * (1 - 0.9 * step / steps)
            for k, q in g.items():
                q = q * min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (q - m[k])
                v[k] += 0.01 * (q * q - v[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is content, by page. Pages of like length go together, of at most _CELLS places with the padding, unless one page alone has more."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(pages[order[n]]) <= _CELLS:
                n += 1
            own, order = order[:n], order[n:]
            x, live, _ = padded([(pages[i], np.zeros(len(pages[i]))) for i in own])
            y = self.forward(x, live)
            for j, i in enumerate(own):
                out[i] = y[: len(pages[i]), j] > 0
        return out


#: Places, blocks times pages, that go through the network at a time.
_CELLS = 1 << 15


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t_n = max(len(x) for x, _ in pages)
    x = np.zeros((t_n, len(pages), pages[0][0].shape[1]), np.float32)
    live, gold = (np.zeros((t_n, len(pages)), np.float32) for _ in range(2))
    for i, (a, y) in enumerate(pages):
        x[: len(a), i], gold[: len(a), i], live[: len(a), i] = a, y, 1
    return x, live, gold


# --------------------------------------------------------------------------
# generated pages


def generated_pages(n: int = 240, seed: int = 23) -> list[str]:
    """Pages whose content texts hold a marker, U+E000, and no others; labelled() takes the markers out."""
    r = np.random.default_rng(seed)
    syllables = "an the or ing tion er es ka lo mi ra de quo ba é über ña zu sch eau ment ion que".split()
    menu = "home about contact login register privacy terms help search shop news sport more share follow subscribe imprint impressum accueil inicio".split()

    def word() -> str:
        return "".join(r.choice(syllables, r.integers(1, 4)))

    def sentence(lo: int = 3, hi: int = 18) -> str:
        s = " ".join(word() for _ in range(r.integers(lo, hi)))
        return s.capitalize() + str(r.choice([".", ".", ".", "!", "?", "", "***", " |"]))

    def pick(*x: str) -> str:
        return str(r.choice(x))

    def nav() -> str:
        items = [f'<li><a href="/{i}">{pick(*menu) if r.integers(0, 2) else word() + pick("", "", ".", ",", "***", " |").strip()}</a></li>' for i in range(r.integers(3, 9))]
        return f"<{(t := pick('nav', 'div'))}{pick('', ' class=\"menu\"', ' class=\"navbar\"', ' id=\"nav\"') if t == 'nav' else pick(' class=\"menu\"', ' class=\"navbar\"', ' id=\"nav\"')}><ul>{''.join(items)}</ul></{t}>"

    def ad() -> str:
        return f'<div class="{pick("ad", "ads", "banner", "promo", "sponsored", "cookie-notice")}">{sentence(3, 20)}</div>'

    def side() -> str:
        return f"<aside{pick('', ' class=\"sidebar\"')}><h3>{sentence(2, 5)}</h3><ul>{''.join(f'<li><a href=\"#\">{sentence(2, 8)}</a></li>' for _ in range(r.integers(2, 6)))}</ul></aside>"

    def foot() -> str:
        body = pick(f"&copy; {word()}.example.com &middot; {sentence()}", f"Copyright 20{r.integers(10, 30)} {word()}. All rights reserved.", f"<p>{sentence()}</p>")
        return f"<footer>{body}</footer>" if r.integers(0, 2) else f'<div class="{pick("footer", "foot", "legal")}">{body}</div>'

    def deep(x: str) -> str:
        for _ in range(r.integers(0, 6) if r.integers(0, 3) == 0 else r.integers(0, 2)):
            x = f"<div{pick('', '', ' class=\"wrap\"', ' class=\"row\"', ' id=\"inner\"', ' class=\"col-8\"')}>{x}</div>"
        return x

    def article() -> str:
        mark = "\ue000"
        open_, close = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post">', "</div></div>"), ('<section class="story">', "</section>"), ("<div>", "</div>")][r.integers(0, 6)]
        out = [open_]
        if r.integers(0, 5):
            out.append(f"<h1>{mark}{sentence(1, 9)}</h1>")
        for _ in range(r.integers(1, 12)):
            k = r.integers(0, 14)
            text = mark + " ".join(sentence(1, 14) for _ in range(r.integers(1, 6)))
            if k == 0:
                out.append(f"<p><b>{text}<br><p>{mark}{sentence()}</p>")
            elif k == 1:
                out.append(f"<ul><li>{text}</li><li>{mark}{sentence()}</li></ul>")
            elif k == 2:
                out.append(f"<blockquote>{text}</blockquote>")
            elif k == 3:
                out.append(f"<h2>{mark}{sentence(1, 6)}</h2>")
            elif k == 4:
                out.append(f"<table><tr><td>{text}</td><td>{mark}{sentence(1, 3)}</td></tr></table>")
            elif k == 5:
                out.append(f"<pre>{text}</pre>")
            elif k == 6:
                out.append(ad())
            else:
                out.append(f"<p>{text}</p>")
        return out[0] + deep("".join(out[1:])) + close

    pages = []
    for i in range(n):
        parts = [x() for x in (nav, ad, nav, ad) if r.integers(0, 3)][: r.integers(0, 4)] + [article()] + [x() for x in (ad, side, nav) if r.integers(0, 3) == 0]
        if r.integers(0, 6):
            parts.append(foot())
        parts = [deep(x) for x in parts]
        whole = deep("".join(parts))
        pages.append(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{sentence()}</title><style>p{{margin:0}}</style><script>var t="</p>";track({i});</script></head><body>{whole}</body></html>')
    return pages


def labelled(page: str) -> tuple[list[tuple[str, Node, int]], np.ndarray]:
    b = blocks(page)
    return [(t.replace("\ue000", "").strip() or "-", p, k) for t, p, k in b], np.array([float("\ue000" in t) for t, _, _ in b])


@lru_cache(1)
def train(pages: int = 240) -> BlockLSTM:
    """The labeller of generated pages, fitted once in a process."""
    got = [labelled(p) for p in generated_pages(pages)]
    return BlockLSTM().fit([(block_vectors(b), y) for b, y in got])


_OUT = "page_id long, url string, n_blocks int, n_content int, labels string, text string"


def extract(docs: DataFrame, model: BlockLSTM, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of docs: (page_id, url, n_blocks, n_content, labels, text).

    labels has one letter per leaf block in page order, C for content and B for
    boilerplate; text is the content blocks, one per line. Scripts, styles,
    comments and the head are no blocks. Broken markup is read as far as its
    tags can be told; text without any tag is one block.

    A null or empty page has no blocks, empty labels and an empty text. Pages of
    any length are read whole, in linear time, with all their tags and classes;
    a batch is split by what the network holds at a time. Null ids and urls are
    kept, repeated rows each give a row; a block with log-odds of exactly 0 is
    boilerplate. An empty table gives an empty result. Other columns are
    ignored, whatever their names. Ids have to be of whole numbers, else a
    TypeError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2):
            own = [blocks(x or "") for x in part.column(2).to_pylist()]
            flags = model.label([block_vectors(x) for x in own])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(x) for x in own], pa.int32()),
                    pa.array([int(f.sum()) for f in flags], pa.int32()),
                    pa.array(["".join("BC"[int(y)] for y in f) for f in flags], pa.string()),
                    pa.array(["\n".join(t for (t, _, _), y in zip(x, f) if y) for x, f in zip(own, flags)], pa.string()),
                ],
                ["page_id", "url", "n_blocks", "n_content", "labels", "text"],
            )

    d = only(docs, page_id=id_col, url=url_col, html=html_col)
    return d.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, _OUT)
