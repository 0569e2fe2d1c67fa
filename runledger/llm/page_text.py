"""Main text of web pages by a recurrent block labeller.

A page is read as a sequence of blocks: runs of text between block-level tags, each with the tags, classes and ids it lies
in. A bidirectional LSTM in numpy reads the sequence, a block being hashed tokens of its tag path, hashed words and a few
lengths, and labels every block as main text or not in the light of the whole page.

It is trained on a bounded sample of pages (``SAMPLE``). Their blocks are labelled by what HTML itself says (an article or
main element, less navigation, asides, forms and the like), and every page is also rebuilt in other forms, with its text
in other containers and its furniture in others (``FURNITURE``, ``CONTAINERS``), so that the labeller knows more layouts
than the sample has.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import table

SAMPLE = 150
SAMPLE_CHARS = 40_000
PATH_BINS, WORD_BINS, HIDDEN = 192, 32, 16
ACCEPT = 0.5

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<)|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Not text of the page. The first go on to the end of the page where they are not closed; of the others, which may be
# nested, only what is closed is left out.
_RAW = {t: re.compile(rf"</{t}(?=[\s>/])[^>]*>?", re.I) for t in ("script", "style", "textarea", "title")}
_CLOSED = {t: re.compile(rf"<!--.*?(?:-->|\Z)|<(/?){t}(?=[\s>/])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.I | re.S) for t in ("noscript", "template", "svg", "iframe", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_WORD = re.compile(r"[^\W_]+")

# Where main text is found and what else a page has: for labels by markup, and for rebuilding pages in other forms.
CONTAINERS = ("article", "main", 'div class="content"', 'div id="main-content"', 'div class="post entry"', 'div class="article-body"', 'section class="story"')
FURNITURE = (
    'nav', 'ul class="menu"', 'div class="navbar"', 'div class="breadcrumb"', 'header', 'div id="header"', 'div class="top banner"', 'footer', 'div id="footer"',
    'div class="copyright"', 'aside', 'div class="sidebar"', 'div class="widget"', 'div class="related"', 'div class="cookie notice"', 'div class="popup consent"', 'div role="alert"',
    'div class="ad"', 'div class="ads sponsor"', 'ins class="adsbygoogle"', 'div class="promo advert"', 'form', 'form class="newsletter subscribe"', 'div class="login"', 'div class="share social"',
    'section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="reader reply"', 'div class="tags"', 'div class="pagination"',
)
_INSIDE = frozenset(("article", "main"))
_OUTSIDE = frozenset("nav footer aside form header menu button dialog comments comment reply sidebar ad ads advert sponsor promo cookie notice consent newsletter subscribe related share social breadcrumb".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def _names(attributes: str) -> list[str]:
    return [w.lower() for m in _NAMES.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")]


def _word_bin(word: str) -> int:
    return zlib.crc32(word.encode()) % PATH_BINS


@functools.lru_cache(maxsize=20_000)
def _marks(token: str) -> frozenset[int]:
    """What a token of a path adds to the features and labels of its blocks: bins, and two marks for furniture and articles."""
    words = token.split()
    found = {_word_bin(w) for w in words}
    if words[0] in _INSIDE:
        found.add(-1)
    if not _OUTSIDE.isdisjoint(words):
        found.add(-2)
    return frozenset(found)


def _ends(tag: str, page: str) -> dict[int, int]:
    """Where each element of the tag that is closed begins and ends."""
    begun: list[int] = []
    found: dict[int, int] = {}
    for m in _CLOSED[tag].finditer(page):
        if m[1] is None:
            continue
        if not m[1]:
            if not (tag == "svg" and m[2].rstrip().endswith("/")):
                begun.append(m.start())
        elif begun:
            found[begun.pop()] = m.end()
    return found


def blocks(page: str) -> list[Block]:
    """The page's text in order, one block for each run without a block-level tag; references decoded, white space single.

    A block's path leaves out the elements that add nothing to its features and labels beyond those around them, so that
    paths are short however deep the page is; the innermost element is always there.
    """
    out: list[Block] = []
    # Tag, its path token with class and id words, the tokens of the path that add to it, and what they add.
    stack: list[tuple[str, str, tuple[str, ...], frozenset[int]]] = []
    open_tags: Counter[str] = Counter()
    closed: dict[str, dict[int, int]] = {}
    parts: list[str] = []
    linked = at = 0
    path: tuple[str, ...] = ()

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(path, text, linked))
        parts.clear()
        linked = 0

    def pop(tag: str) -> None:
        while stack:
            top = stack.pop()[0]
            open_tags[top] -= 1
            if top == tag:
                return

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            if not parts:
                path = ()
                if stack:
                    _, token, kept, _ = stack[-1]
                    path = kept if kept[-1] == token else (*kept, token)
            parts.append(text)
            if open_tags["a"] > 0:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in _BLOCKS:
            close()
        if m[1]:
            if open_tags[tag] > 0:
                pop(tag)
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _CLOSED:
            if tag not in closed:
                closed[tag] = _ends(tag, page)
            at = closed[tag].get(m.start(), at)
            continue
        if tag in _VOID or m[3].rstrip().endswith("/"):
            continue
        if tag in _BLOCKS and open_tags["p"] > 0:
            pop("p")
        token = " ".join([tag, *_names(m[3])])
        kept, marks = stack[-1][2:] if stack else ((), frozenset())
        own = _marks(token)
        if not own <= marks:
            kept, marks = (*kept, token), marks | own
        stack.append((tag, token, kept, marks))
        open_tags[tag] += 1
    close()
    return out


def markup_labels(page: list[Block]) -> list[float]:
    """1 for blocks in an article or main element and in no furniture; without such an element, long text in no furniture."""
    inside = [any(t.split()[0] in _INSIDE for t in b.path) for b in page]
    outside = [any(w in _OUTSIDE for t in b.path for w in t.split()) for b in page]
    if any(inside):
        return [float(i and not o) for i, o in zip(inside, outside, strict=True)]
    return [float(not o and len(b.text) >= 60 and 3 * b.linked < len(b.text)) for b, o in zip(page, outside, strict=True)]


def rebuilt(page: list[Block], labels: list[float], rng: random.Random) -> tuple[list[Block], list[float]]:
    """The page in another form: another container for its main text, other furniture around and within."""
    def path_of(element: str) -> str:
        tag, _, rest = element.partition(" ")
        return " ".join([tag, *_names(rest)])

    main = [b for b, y in zip(page, labels, strict=True) if y]
    rest = [b for b, y in zip(page, labels, strict=True) if not y] or [Block((), "Menu", 4)]
    top = rng.choice(["html", "html body", "html body page", "html body wrapper div"]).split()
    container = path_of(rng.choice(CONTAINERS))
    inner = lambda: (rng.choice(["p", "p", "p", "div", "blockquote", "li", "pre", "p b"]),)
    out: list[tuple[Block, float]] = []

    def furniture(within: tuple[str, ...], often: float) -> None:
        while rng.random() < often:
            own = path_of(rng.choice(FURNITURE))
            for _ in range(rng.randint(1, 4)):
                b = rng.choice([*rest, *main]) if rng.random() < 0.5 else rng.choice(rest)
                tail = rng.choice([("ul", "li", "a"), ("p",), ("div",), (), ("label",), ("h3",)])
                text = b.text if rng.random() < 0.7 else " ".join(b.text.split()[: rng.randint(1, 6)])
                out.append((Block((*within, own, *tail), text, len(text) if "a" in tail else 0), 0.0))

    furniture(tuple(top), 0.7)
    for k, b in enumerate(main):
        own = ("h1",) if k == 0 and rng.random() < 0.8 else inner()
        out.append((Block((*top, container, *own), b.text, b.linked), 1.0))
        furniture((*top, container), 0.06)
    furniture((*top, container), 0.1)
    furniture(tuple(top), 0.7)
    return [b for b, _ in out], [y for _, y in out]


@functools.lru_cache(maxsize=20_000)
def _path_bins(path: tuple[str, ...]) -> tuple[int, ...]:
    words = {w for token in path for w in token.split()}
    words |= {f"{path[-1].split()[0]}/last"} if path else {"/none"}
    return tuple(map(_word_bin, words))


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), PATH_BINS + WORD_BINS + 4), np.float32)
    for i, b in enumerate(page):
        out[i, list(_path_bins(b.path))] = 1
        words = b.text.lower().split()
        bins = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % WORD_BINS
        out[i, PATH_BINS : PATH_BINS + WORD_BINS] = np.bincount(bins, minlength=WORD_BINS) / (2 * np.sqrt(len(words)))
        out[i, -4:] = np.log1p(len(b.text)) / 8, b.linked / max(1, len(b.text)), i / len(page), np.log1p(len(page)) / 8
    return out


def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
    h = HIDDEN
    s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
    return s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])


def _run(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], d: str, keep: list | None = None) -> np.ndarray:
    """One direction over padded sequences (pages, blocks, inputs); padding leaves the state as it was."""
    pages, steps, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out = np.zeros((pages, steps, HIDDEN), np.float32)
    into = x @ w["x" + d] + w["b" + d]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        i, f, o, g = _gates(into[:, t] + h @ w["h" + d])
        m = mask[:, t, None]
        new = f * c + i * g
        th = np.tanh(new)
        if keep is not None:
            keep.append((t, i, f, o, g, c, th, h, m))
        c, h = np.where(m, new, c), np.where(m, o * th, h)
        out[:, t] = h
    return out


def _back(dout: np.ndarray, x: np.ndarray, w: dict[str, np.ndarray], d: str, kept: list, grad: dict[str, np.ndarray]) -> None:
    pages = len(x)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
    for t, i, f, o, g, c, th, h, m in reversed(kept):
        dh = dh + dout[:, t]
        live = dh * m
        dnew = dc * m + live * o * (1 - th**2)
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - g**2)], 1)
        dz_all[:, t] = dz
        grad["h" + d] += h.T @ dz
        dh = np.where(m, dz @ w["h" + d].T, dh)
        dc = np.where(m, dnew * f, dc)
    grad["x" + d] += np.einsum("ptk,pth->kh", x, dz_all, optimize=True)
    grad["b" + d] += dz_all.sum((0, 1))


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask


def probabilities(pages: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page's block vectors, how likely each block is main text. Pages of like lengths go together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
    while order:
        longest = len(pages[order[-1]])
        n = max(1, min(64, 20_000 // longest))
        some, order = order[-n:], order[:-n]
        x, mask = _padded([pages[k] for k in some])
        both = np.concatenate([_run(x, mask, w, "f"), _run(x, mask, w, "r")], 2)
        p = 1 / (1 + np.exp(-np.clip(both @ w["out"] + w["bias"], -30, 30)))[:, :, 0]
        for row, k in enumerate(some):
            out[k] = p[row, : len(pages[k])]
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, rate: float = 0.02, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights of the labeller by back-propagation through time, with Adam, on (block vectors, labels) of pages."""
    rng = np.random.default_rng(seed)
    inputs = PATH_BINS + WORD_BINS + 4
    w = {f"x{d}": rng.normal(0, 0.08, (inputs, 4 * HIDDEN)) for d in "fr"} | {f"h{d}": rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)) for d in "fr"}
    w |= {f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN) for d in "fr"} | {"out": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    pages = [p for p in pages if len(p[0])]
    for _ in range(epochs if pages else 0):
        order = rng.permutation(len(pages))
        for begin in range(0, len(order), 48):
            some = [pages[k] for k in order[begin : begin + 48]]
            x, mask = _padded([p for p, _ in some])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, own) in enumerate(some):
                y[k, : len(own)] = own
            kept_f: list = []
            kept_r: list = []
            both = np.concatenate([_run(x, mask, w, "f", kept_f), _run(x, mask, w, "r", kept_r)], 2)
            p = 1 / (1 + np.exp(-np.clip((both @ w["out"] + w["bias"])[:, :, 0], -30, 30)))
            dlogit = ((p - y) * mask / mask.sum())[:, :, None]
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["out"] += np.einsum("pth,pto->ho", both, dlogit)
            grad["bias"] += dlogit.sum((0, 1))
            dboth = dlogit @ w["out"].T
            _back(dboth[:, :, :HIDDEN], x, w, "f", kept_f, grad)
            _back(dboth[:, :, HIDDEN:], x, w, "r", kept_r, grad)
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def labeller(pages: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights learnt from at most ``sample`` pages of at most ``SAMPLE_CHARS`` characters, chosen by a hash of page_id."""
    some = pages.where(F.length("html").between(1, SAMPLE_CHARS))
    share = int(min(1.0, 2.0 * sample / max(1, pages.count())) * (1 << 31))
    some = some.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 31)) <= share)
    texts = sorted(r.html for r in some.select("html").limit(sample).collect())
    rng, taught = random.Random(5), []
    for text in texts:
        page = blocks(text)
        labels = markup_labels(page)
        taught.append((page, labels))
        if any(labels):
            taught += [rebuilt(page, labels, rng) for _ in range(3)]
    return train([(vectors(p), np.array(y, np.float32)) for p, y in taught])


def main_text(page: list[Block], p: np.ndarray) -> str:
    return "\n".join(b.text for b, own in zip(page, p, strict=True) if own >= ACCEPT)


def page_texts(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page has the empty text, and so has a page without main text. Every page is read whole and on its own,
    so repeated rows get the same text. No rows give no rows, and train nothing.
    """
    pages = pages.select("page_id", "url", "html")
    weights = labeller(pages) if weights is None else weights

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 128):
                part = batch.slice(begin, 128)
                found = [blocks(page.as_py() or "") for page in part["html"]]
                marks = probabilities([vectors(page) for page in found], weights)
                texts = [main_text(page, p) for page, p in zip(found, marks, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))
