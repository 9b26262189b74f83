"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: text between block-level tags, character references decoded, white space
turned into one space. Every block is read as a vector of hashed tag-path names (tags, class and id words, by depth) and
hashed words with a few densities. A bidirectional LSTM in NumPy runs over the whole sequence, so that each label sees
the document on both sides. It is trained here on pages that a generator makes, with known labels, from
many layouts: plain and nested wrappers, semantic and anonymous tags, and boilerplate of every kind.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import only, released, tune

PATH_DIM = 128
WORD_DIM = 16
NUMBERS = 8
DIM = PATH_DIM + WORD_DIM + NUMBERS
HIDDEN = 24
TRAIN_PAGES = 1600
EPOCHS = 12
SEED = 7

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|textarea|iframe)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z][^>]*>?|<[!?][^>]*>?|[^<]+|<", re.S | re.I)
#: Left out with what they hold if they are closed; without an end the tag alone is.
_HIDDEN = re.compile(r"<(/?)(template|select|svg)(?=[\s/>])[^>]*>", re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags inside a block; all others end one.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of these closes an open one of the same name.
SELF_CLOSING = frozenset("p li dt dd option tr td th".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int


def _hidden_ends(tokens: list[re.Match]) -> dict[int, int]:
    """Where every hidden element that has an end ends: numbers of the tokens. One that ends itself is no element."""
    ends: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for k, m in enumerate(tokens):
        if h := _HIDDEN.fullmatch(m[0]):
            name = h[2].lower()
            if not h[1]:
                if name != "svg" or not m[0].endswith("/>"):
                    begun.setdefault(name, []).append(k)
            elif begun.get(name):
                ends[begun[name].pop()] = k
    return ends


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order; broken markup is read on: unclosed tags stay open, stray ends are dropped."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links = in_link = in_title = 0

    def close() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text and not in_title:
                out.append(Block(text, tuple(x for _, x in stack), links))
            parts.clear()
        links = 0

    tokens = _TOKEN.finditer(page or "")
    hides = bool(page and _HIDDEN.search(page))
    ends: dict[int, int] = {}
    if hides:
        tokens = list(tokens)
        ends = _hidden_ends(tokens)
    until = -1
    for number, m in enumerate(tokens):
        if number <= until:
            continue
        t = m[0]
        if hides and _HIDDEN.fullmatch(t):
            until = ends.get(number, number)
            parts.append(" ")
            continue
        if t[0] != "<" or t == "<" or (name := _NAME.match(t)) is None:
            if t[0] != "<" or t == "<":
                parts.append(t)
                if in_link:
                    links += len(t)
            continue
        tag = name[1].lower()
        if m[1]:
            if tag not in INLINE:
                parts.append(" ")
            continue
        if t[1] == "/":
            if tag in INLINE:
                if tag == "a":
                    in_link = 0
                continue
            close()
            if tag == "title":
                in_title = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            continue
        close()
        if tag == "br" or tag in VOID:
            continue
        if tag in SELF_CLOSING and any(x == tag for x, _ in stack):
            k = max(i for i, (x, _) in enumerate(stack) if x == tag)
            if tag != "li" or not any(x in ("ul", "ol") for x, _ in stack[k + 1 :]):
                del stack[k:]
        in_title = int(tag == "title")
        words = " ".join(a or b or c for _, a, b, c in _ATTR.findall(t)) if "=" in t else ""
        stack.append((tag, f"{tag} {words.lower()}" if words else tag))
    close()
    return out


def _slot(text: str, dim: int, salt: int) -> tuple[int, float]:
    h = zlib.crc32(text.encode("utf-8", "surrogatepass"), salt)
    return (h >> 1) % dim, 1.0 if h & 1 else -1.0


_path_cache: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = _path_cache.get(path)
    if v is None:
        v = np.zeros(PATH_DIM, dtype=np.float32)
        for depth, element in enumerate(reversed(path)):
            for k, word in enumerate(re.split(r"[^a-z0-9]+", element)):
                if word:
                    i, s = _slot(("t:" if k == 0 else "c:") + word, PATH_DIM, 1)
                    v[i] += s * (1.0 if depth < 2 or k else 0.7)
        if len(_path_cache) > 20_000:
            _path_cache.clear()
        _path_cache[path] = v
    return v


class _WordSlot(dict):
    """Slots and signs of words, kept for the words seen last."""

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 200_000:
            self.clear()
        v = self[word] = _slot(word.lower(), WORD_DIM, 2)
        return v


_word_slots = _WordSlot()


def word_vector(words: list[str]) -> np.ndarray:
    """All words of a block, hashed; of unit length, however many they are."""
    v = [0.0] * WORD_DIM
    for w in words:
        i, s = _word_slots[w]
        v[i] += s
    out = np.array(v, dtype=np.float32)
    norm = float(np.sqrt(out @ out))
    return out / norm if norm else out


def block_vectors(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), DIM), dtype=np.float32)
    for k, b in enumerate(blocks):
        x[k, :PATH_DIM] = path_vector(b.path)
        words = b.text.split(" ")
        x[k, PATH_DIM : PATH_DIM + WORD_DIM] = word_vector(words)
        n = len(b.text)
        marks = sum(b.text.count(c) for c in ".,;!?")
        x[k, PATH_DIM + WORD_DIM :] = (
            np.log1p(n) / 6, min(1.0, b.link_chars / n), min(1.0, 20 * marks / n), float(b.text[-1] in ".!?:\"'"), np.log1p(len(words)) / 6,
            k / max(1, len(blocks) - 1), float(n > 160), 1.0,
        )
    return x


# -- the network -----------------------------------------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Network:
    """Input, recurrent and bias weights of each direction, and the output layer."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.out, self.bias]

    @classmethod
    def fresh(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        b = [np.zeros(4 * HIDDEN, dtype=np.float32) for _ in range(2)]
        for x in b:
            x[HIDDEN : 2 * HIDDEN] = 1  # remember at first
        return cls([draw(DIM, 4 * HIDDEN) for _ in range(2)], [draw(HIDDEN, 4 * HIDDEN) for _ in range(2)], b, draw(2 * HIDDEN, 1), np.zeros(1, dtype=np.float32))

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: time x batch x DIM, mask: time x batch. Logits, and what the way back needs."""
        steps, batch, _ = x.shape
        hs, saved = [], []
        for d in range(2):
            z_in = x @ self.w[d] + self.b[d]
            h = np.zeros((batch, HIDDEN), dtype=np.float32)
            c = np.zeros_like(h)
            hist = np.zeros((steps, batch, HIDDEN), dtype=np.float32)
            trace = []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                z = z_in[t] + h @ self.u[d]
                i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
                g = np.tanh(z[:, 3 * HIDDEN :])
                m = mask[t][:, None]
                c_new = f * c + i * g
                tc = np.tanh(c_new)
                if keep:
                    trace.append((t, h, c, i, f, o, g, tc, m))
                h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
                hist[t] = h
            hs.append(hist)
            saved.append(trace)
        both = np.concatenate(hs, axis=2)
        logits = (both @ self.out)[..., 0] + self.bias[0]
        return (logits, both, saved) if keep else logits

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        logits, both, saved = self.run(x, mask, keep=True)
        p = _sigmoid(logits)
        n = mask.sum()
        loss = float(-(np.where(y, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * mask).sum() / n)
        dz_out = ((p - y) * mask / n).astype(np.float32)
        d_out = np.einsum("tbh,tb->h", both, dz_out)[:, None]
        d_both = dz_out[..., None] * self.out[:, 0]
        dw, du, db = [], [], []
        for d in range(2):
            dh_out = d_both[..., d * HIDDEN : (d + 1) * HIDDEN]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            d_u = np.zeros_like(self.u[d])
            dh = np.zeros(x.shape[1:2] + (HIDDEN,), dtype=np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, g, tc, m in reversed(saved[d]):
                a = dh + dh_out[t]
                dht, dct = a * m, dc * m
                dct = dct + dht * o * (1 - tc * tc)
                z = np.concatenate((dct * g * i * (1 - i), dct * c * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - g * g)), axis=1)
                dz[t] = z
                d_u += h.T @ z
                dh, dc = z @ self.u[d].T + a * (1 - m), dct * f + dc * (1 - m)
            dw.append(np.einsum("tbd,tbk->dk", x, dz))
            du.append(d_u)
            db.append(dz.sum(axis=(0, 1)))
        return loss, [*dw, *du, *db, d_out, dz_out.sum(keepdims=True).ravel()]


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), DIM), dtype=np.float32)
    mask = np.zeros((steps, len(pages)), dtype=bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam over pages of the generator, in batches of like length; the same seed gives the same network."""
    r = random.Random(seed)
    data = []
    for _ in range(pages):
        page, want = make_page(r)
        blocks = blocks_of(page)
        left = list(want)
        y = np.zeros(len(blocks), dtype=bool)
        for k, b in enumerate(blocks):
            if left and b.text == left[0]:
                y[k] = True
                left.pop(0)
        if left:
            raise ValueError("a generated page was not read as it was written")
        if blocks:
            data.append((block_vectors(blocks), y))
    data.sort(key=lambda p: len(p[1]))
    groups = [data[i : i + 32] for i in range(0, len(data), 32)]
    net = Network.fresh(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        r.shuffle(groups)
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for g in groups:
            x, mask = _batch([p for p, _ in g])
            y = np.zeros(mask.shape, dtype=bool)
            for k, (_, label) in enumerate(g):
                y[: len(label), k] = label
            step += 1
            for p, m, v, grad in zip(net.parameters(), first, second, net.gradients(x, mask, y)[1], strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


_trained: dict[tuple[int, int, int], Network] = {}


def trained() -> Network:
    key = (TRAIN_PAGES, EPOCHS, SEED)
    if key not in _trained:
        _trained[key] = train(*key)
    return _trained[key]


# -- training pages --------------------------------------------------------------------------------------------------

_SYLLABLES = "an er in on re th en ti es or te at ed is it al ar st nd to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur é ü ö ß ñ ç ó la un di ver ge tion ment".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, low: int = 3, high: int = 24) -> str:
    s = " ".join(_word(r) + (r.choice(("&amp;", "%%%", "***", "###")) if r.random() < 0.02 else "") for _ in range(r.randint(low, high)))
    return s[:1].upper() + s[1:] + r.choice("....!?")


def _prose(r: random.Random) -> str:
    odd = r.random()
    if odd < 0.05:  # a word again and again
        return " ".join(w for w in (_word(r) for _ in range(r.randint(1, 8))) for _ in range(r.randint(4, 20)))
    if odd < 0.1:
        return " | ".join(_word(r) for _ in range(r.randint(2, 60))) + r.choice(("", " |", "."))
    if odd < 0.15:
        return " ".join(_word(r) + r.choice(("&amp;&amp;&amp;", "%%%", "***", "###", "$$$")) for _ in range(r.randint(2, 80)))
    return " ".join(_sentence(r) for _ in range(r.randint(1, 6))) if r.random() > 0.15 else _sentence(r, 1, 3)


def _links(r: random.Random) -> str:
    n = r.randint(2, 9)
    kind = r.choice(("li", "a", "div"))
    item = lambda: f'<a href="/{_word(r)}">{_word(r)}{" " + _word(r) if r.random() < 0.4 else ""}</a>'
    if kind == "li":
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
    return " | ".join(item() for _ in range(n)) if kind == "a" else "".join(f"<div>{item()}</div>" for _ in range(n))


def _boilerplate(r: random.Random, kind: str) -> str:
    named = r.random() < 0.85
    mark = lambda *names: f' {r.choice(("class", "id"))}="{r.choice(names)}"' if named else ""
    text = _prose(r) if r.random() < 0.5 else _sentence(r)
    if kind == "nav":
        return f"<nav>{_links(r)}</nav>" if r.random() < 0.6 else f"<div{mark('nav', 'menu', 'navbar', 'navigation', 'breadcrumb', 'main-menu')}>{_links(r)}</div>"
    if kind == "header":
        inner = r.choice((_sentence(r, 1, 5), f"<h1>{_word(r)}</h1><p>{_sentence(r, 2, 6)}</p>", _links(r), f"<p>{text}</p>"))
        return f"<header>{inner}</header>" if r.random() < 0.6 else f"<div{mark('header', 'masthead', 'site-header', 'top', 'banner')}>{inner}</div>"
    if kind == "footer":
        site = f"{r.choice(('', 'www.', 'm.', 'blog.'))}{_word(r)}.example.{r.choice(('com', 'org', 'net'))}"
        text = r.choice((text, _prose(r)))
        inner = r.choice((f"&copy; {site} &middot; {text}", f"<p>{text}</p>", f"<p>&copy; {r.randint(1999, 2030)} {_word(r)}</p>{_links(r)}", text))
        return f"<footer>{inner}</footer>" if r.random() < 0.65 else f"<div{mark('footer', 'site-footer', 'bottom', 'copyright', 'legal')}>{inner}</div>"
    if kind == "ad":
        tag = r.choice(("div", "div", "div", "section", "aside", "p"))
        inner = r.choice((text, text if tag == "p" else f"<p>{text}</p>", f'<a href="/buy">{_sentence(r, 2, 6)}</a>'))
        return f"<!-- ad {r.randint(0, 99)} --><{tag}{f' class="{r.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"))}"'}>{inner}</{tag}>"
    if kind == "sidebar":
        inner = r.choice((_links(r), f"<h3>{_sentence(r, 1, 4)}</h3>{_links(r)}", f"<p>{text}</p>", f"<h2>{_word(r)}</h2><p>{text}</p><p>{_sentence(r)}</p>"))
        return f"<aside>{inner}</aside>" if r.random() < 0.5 else f"<div class=\"{r.choice(('sidebar', 'side', 'related', 'widget', 'recommended', 'aside', 'rail'))}\">{inner}</div>"
    if kind == "notice":
        return f"<div class=\"{r.choice(('cookie', 'cookie-banner', 'notice', 'alert', 'consent', 'gdpr', 'popup', 'modal', 'newsletter', 'subscribe', 'banner'))}\">{r.choice((text, f'<p>{text}</p>'))}{r.choice(('', '<button>OK</button>'))}</div>"
    if kind == "form":
        return f"<form action=\"/{_word(r)}\"><label>{_word(r)}</label><input name=\"q\"><p>{_sentence(r)}</p><button>{_word(r)}</button></form>"
    if kind == "comments":
        one = lambda: r.choice((f"<p>{_prose(r)}</p>", f'<div class="comment"><b>{_word(r)}</b><p>{_prose(r)}</p></div>', f"<li>{_prose(r)}</li>"))
        body = "".join(one() for _ in range(r.randint(1, 6)))
        return f"<{(t := r.choice(('div', 'section', 'ol')))} {r.choice(('class', 'id'))}=\"{r.choice(('comments', 'comment-list', 'discussion', 'responses', 'replies'))}\">{r.choice(('', f'<h2>{_sentence(r, 1, 4)}</h2>'))}{body}</{t}>"
    if kind == "share":
        return f"<div class=\"{r.choice(('share', 'social', 'tags', 'meta', 'byline', 'pagination'))}\">{r.choice((_links(r), _sentence(r, 1, 4)))}</div>"
    return f"<script>var t=\"</p>\";track({r.randint(0, 9)});</script><style>p{{margin:0}}</style>"


_BEFORE = ("nav", "header", "ad", "notice", "script", "form", "sidebar")
_AFTER = ("footer", "comments", "sidebar", "ad", "form", "notice", "nav", "share")


def make_page(r: random.Random) -> tuple[str, list[str]]:
    """A page of a random layout, and the texts of its main blocks in order."""
    want: list[str] = []

    def keep(text: str) -> str:
        clean = _SPACE.sub(" ", html.unescape(text)).strip()
        if clean:
            want.append(clean)
        return text

    title = _sentence(r, 2, 12)
    parts = []
    if r.random() < 0.85:
        parts.append(f"<h1>{keep(title)}</h1>")
    for _ in range(int(r.expovariate(1 / 6)) + 1):
        kind = r.random()
        if kind < 0.68:
            parts.append(f"<p>{keep(_prose(r))}</p>" if r.random() < 0.9 else f"<p>{keep(_prose(r))}")
        elif kind < 0.8:
            parts.append(f"<p><b>{keep(_prose(r))}<br>" if r.random() < 0.8 else f"<p>{keep(_prose(r))}<br>{keep(_prose(r))}</p>")
        elif kind < 0.86:
            parts.append(f"<h{(h := r.randint(2, 4))}>{keep(_sentence(r, 1, 6))}</h{h}>")
        elif kind < 0.9:
            parts.append("<ul>" + "".join(f"<li>{keep(_sentence(r, 2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.93:
            parts.append(f"<blockquote>{keep(_sentence(r))}</blockquote>")
        elif kind < 0.95:
            parts.append("<table>" + "".join(f"<tr><td>{keep(_word(r))}</td><td>{keep(_sentence(r, 1, 4))}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
        else:
            parts.append(_boilerplate(r, r.choice(("ad", "share", "script", "form", "notice"))))
    body = "".join(parts)
    wrap = r.random()
    if wrap < 0.6:
        body = f"<article>{body}</article>"
    elif wrap < 0.75:
        body = f"<main>{body}</main>"
    elif wrap < 0.95:
        body = f"<div {r.choice(('class', 'id'))}=\"{r.choice(('content', 'post', 'article', 'entry-content', 'main', 'story', 'body-text'))}\">{body}</div>"
    if r.random() < 0.15:
        body = f"<div class=\"{r.choice(('page', 'container', 'wrapper'))}\">{body}</div>"
    before = "".join(_boilerplate(r, k) for k in r.sample(_BEFORE, r.randint(0, 4)))
    after = "".join(_boilerplate(r, k) for k in r.sample(_AFTER, r.randint(0, 4)))
    end = r.choice(("</body></html>", "</body></html>", ""))
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{before}{body}{after}{end}", want


# -- extraction ------------------------------------------------------------------------------------------------------


def main_texts(pages: list[str | None], net: Network) -> list[str]:
    """Main text of every page: its blocks that the network labels main, one a line; empty if there is none."""
    blocks = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    at = 0
    while at < len(order):
        group = order[at : at + 64]
        while len(group) > 1 and len(blocks[group[-1]]) * len(group) > 32_768:  # long pages in smaller batches
            group = group[: len(group) // 2]
        at += len(group)
        logits = net.run(*_batch([block_vectors(blocks[i]) for i in group]))
        for k, i in enumerate(group):
            out[i] = "\n".join(b.text for b, z in zip(blocks[i], logits[:, k], strict=False) if z > 0)
    return out


def extract(pages: DataFrame, column: str = "html", net: Network | None = None) -> DataFrame:
    """pages with text (the main text) and n_chars (its code points) in place of the column.

    Null, empty and textless pages have an empty text; repeated rows get the same; other columns come through, those
    named text or n_chars are replaced. Whole pages are read, whatever their length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    tune(pages.sparkSession)
    net = net or trained()
    pages = pages.drop(*({"text", "n_chars"} - {column}))
    kept = [f for f in pages.schema.fields if f.name != column]
    schema = StructType(kept + StructType.fromDDL("text string, n_chars bigint").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = main_texts(b.column(column).to_pylist(), net)
            own = [b.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return pages.mapInArrow(released(run), schema)


def html_query(spark, sf_dir: str) -> DataFrame:
    """op7: the main text of every page."""
    pages = only(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.col("n_chars"))
