"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags, with character references decoded, scripts, styles, form
controls and comments left out.  Formulas, drawings and what embedded objects hold for readers without them are part of their line;
that a block is hidden is a word of its path, for the labeller to weigh.  Each block is a vector: the tags on its path with their class, id and role words (hashed embeddings), all its words
(hashed embeddings), its length, share of text in links and place in the page.  A bidirectional LSTM in numpy
reads all blocks of a page and labels each one as main text or not, so every label sees the whole document.

Nothing marks main text in the pages themselves, so the labeller learns from pages whose structure does (``article`` or ``main``
around the text, ``nav``, ``header``, ``footer``, ``aside``, ``form`` around the rest): a bounded sample of ``MAX_PAGES``
pages.  So that it does not merely read those tags, each page is shown again with its blocks under other containers (``div``s with
telling classes, or bare ones around the main text), and with blocks of other pages as sidebars, notices, adverts and
reader comments, and parts of the path are hidden at random.

Defined results: null, empty and blank html, and pages without a block labelled main, give the empty text; broken markup
is read as browsers do in the main (unclosed tags end with their parents); a page without any structural tag is judged by the
labeller alone; rows that repeat are extracted each; other columns are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.samples import draw, threshold
from tidemark.llm.words import ALNUM, mix, sum_rows, word_hashes

MAX_PAGES = 1500
HIDDEN = 24
PATH = 20
WORDS = 12
BUCKETS = 2048
NUMBERS = 8
#: Words whose vectors are held at a time.
STEP = 1 << 18
EPOCHS = 3
#: Elements whose content is never text, elements without content, and elements inside a line: fixed values of HTML.
RAW = frozenset("script style template title select textarea button".split())
#: Elements inside a line that hold elements of their own, which are inside the line, too: fixed values of HTML.
WITHIN = frozenset("math svg object canvas iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements that an opening tag of the same kind (or of the group) closes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Block-level elements close an open paragraph.
NOT_IN_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("ul ol dl table div article section main aside nav header footer form body blockquote td".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A run of text: its path (tags with class, id and role words), text, and characters in links."""

    path: tuple[tuple[str, ...], ...]
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # name, words, inline
    parts: list[str] = []
    linked = links = within = 0
    page, at = page or "", 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(tuple(w for _, w, inline in stack if not inline), text, min(linked, len(text))))
            linked = 0

    def pop():
        nonlocal links, within
        name, _, _ = stack.pop()
        links -= name == "a"
        within -= name in WITHIN

    while at < len(page):
        match = _TOKEN.match(page, at)
        at = match.end()
        close, name, rest, text = match.groups()
        if text is not None:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if close:
            if name in INLINE or name in WITHIN or within and name not in NOT_IN_P:
                for i in range(len(stack) - 1, -1, -1):
                    if not stack[i][2]:
                        break
                    if stack[i][0] == name:
                        if name in WITHIN:
                            while len(stack) > i:
                                pop()
                        else:
                            links -= name == "a"
                            del stack[i]
                        break
            elif any(s[0] == name for s in stack):
                flush()
                while stack:
                    top = stack[-1][0]
                    pop()
                    if top == name:
                        break
            continue
        if name in RAW:
            if not rest.rstrip().endswith("/"):
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
            if name not in ("script", "style", "template", "button", "select"):
                parts.append(" ")
            continue
        if (within or name in INLINE or name in WITHIN) and name not in VOID:
            if not rest.rstrip().endswith("/"):
                stack.append((name, (), True))
                links += name == "a"
                within += name in WITHIN
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                flush()
            continue
        flush()
        closing = CLOSES.get(name, {"p"} if name in NOT_IN_P else set())
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closing:
                    while len(stack) > i:
                        pop()
                    if "p" in closing and len(closing) == 1:
                        break
                elif stack[i][0] in SCOPES:
                    break
        words = [name]
        if "=" in rest or "hidden" in rest:
            for _, value in _ATTRIBUTE.findall(rest):
                words += _PARTS.findall(value.lower())
            if _HIDDEN.search(rest):
                words.append("hidden")
        stack.append((name, tuple(words), False))
    flush()
    return out


# ---- block vectors --------------------------------------------------------------------------------------------------

_CACHE: dict[str, int] = {}


def _bucket(word: str) -> int:
    found = _CACHE.get(word)
    if found is None:
        raw = np.frombuffer(word.encode("utf-8", "replace")[:64].ljust(8, b"\0"), np.uint8).astype(np.uint64)
        found = int(mix(np.array([np.bitwise_xor.reduce(mix(raw + np.arange(len(raw), dtype=np.uint64) * np.uint64(257)))]))[0] % np.uint64(BUCKETS))
        if len(_CACHE) < 100_000:
            _CACHE[word] = found
    return found


@dataclass
class Page:
    """Bags of path and word buckets per block (flat, with counts) and the numbers."""

    path: np.ndarray
    path_of: np.ndarray
    words: np.ndarray
    words_of: np.ndarray
    numbers: np.ndarray


def encode(found: list[Block]) -> Page:
    path, path_of = [], []
    numbers = np.zeros((len(found), NUMBERS), np.float32)
    for i, b in enumerate(found):
        own = [w for step in b.path for w in step if w not in ("html", "body")]
        own.append("<" + (b.path[-1][0] if b.path else ""))
        path += [_bucket(w) for w in own]
        path_of += [i] * len(own)
        n = len(b.text)
        numbers[i] = (np.log1p(n) / 5, min(b.linked / n, 1), i / len(found), (len(found) - i) / len(found), n > 120, n < 25, b.text[-1] in ".!?", len(b.path) / 8)
    words, first = word_hashes(pa.array([b.text.lower().encode("utf-8", "replace") for b in found], pa.large_binary()), ALNUM)
    words_of = np.repeat(np.arange(len(found)), np.diff(first))
    return Page(np.array(path, np.int64), np.array(path_of, np.int64), (words % np.uint64(BUCKETS)).astype(np.int64), words_of, numbers)


# ---- the network -------------------------------------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def new_parameters(rng) -> dict[str, np.ndarray]:
    inputs = PATH + WORDS + NUMBERS

    def normal(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"path": (rng.standard_normal((BUCKETS, PATH)) * 0.3).astype(np.float32), "words": (rng.standard_normal((BUCKETS, WORDS)) * 0.1).astype(np.float32)}
    for way in ("f", "b"):
        p |= {f"{way}_in": normal(inputs, 4 * HIDDEN), f"{way}_rec": normal(HIDDEN, 4 * HIDDEN), f"{way}_bias": np.zeros(4 * HIDDEN, np.float32)}
        p[f"{way}_bias"][HIDDEN : 2 * HIDDEN] = 1
    return p | {"out": normal(2 * HIDDEN, 1), "out_bias": np.zeros(1, np.float32)}


def _sums(of: np.ndarray, values: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    """The sums of ``values[at]`` in each of ``rows`` groups, a bounded number of them at a time."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    for low in range(0, len(of), STEP):
        out += sum_rows(of[low : low + STEP], values[at[low : low + STEP]], rows)
    return out


def _bag(table: np.ndarray, items: np.ndarray, of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.bincount(of, minlength=rows), 1).astype(np.float32)
    return _sums(of, table, items, rows) / np.sqrt(n)[:, None], np.sqrt(n)


def _layout(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page) grid of block numbers, -1 where a page has ended; and block counts."""
    sizes = np.array([len(p.numbers) for p in pages])
    grid = np.full((int(sizes.max(initial=0)), len(pages)), -1)
    start = 0
    for j, n in enumerate(sizes.tolist()):
        grid[:n, j] = np.arange(start, start + n)
        start += n
    return grid, sizes


def _join(pages: list[Page]):
    shift = np.concatenate([[0], np.cumsum([len(p.numbers) for p in pages])]).astype(np.int64)
    path, words = np.concatenate([p.path for p in pages]), np.concatenate([p.words for p in pages])
    path_of = np.concatenate([p.path_of + s for p, s in zip(pages, shift)])
    words_of = np.concatenate([p.words_of + s for p, s in zip(pages, shift)])
    return path, path_of, words, words_of, np.concatenate([p.numbers for p in pages])


def _run(p, way: str, x: np.ndarray, grid: np.ndarray, keep: bool):
    order = grid if way == "f" else grid[::-1]
    pages = grid.shape[1]
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out, memo = np.zeros((len(x), HIDDEN), np.float32), []
    for at in order:
        live = np.flatnonzero(at >= 0)
        rows = at[live]
        a = x[rows] @ p[f"{way}_in"] + h[live] @ p[f"{way}_rec"] + p[f"{way}_bias"]
        i, f, o = _sigmoid(a[:, :HIDDEN]), _sigmoid(a[:, HIDDEN : 2 * HIDDEN]), _sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(a[:, 3 * HIDDEN :])
        old_h, old_c = h[live], c[live]
        new_c = f * old_c + i * g
        t = np.tanh(new_c)
        c[live], h[live] = new_c, o * t
        out[rows] = h[live]
        if keep:
            memo.append((live, rows, i, f, o, g, old_h, old_c, t))
    return out, memo


def forward(p: dict[str, np.ndarray], pages: list[Page], keep: bool = False, drop: np.ndarray | None = None):
    """Logit of each block of all pages, and what the way back needs."""
    path, path_of, words, words_of, numbers = _join(pages)
    if drop is not None:
        path, path_of = path[drop], path_of[drop]
    v_path, n_path = _bag(p["path"], path, path_of, len(numbers))
    v_words, n_words = _bag(p["words"], words, words_of, len(numbers))
    x = np.hstack([v_path, v_words, numbers])
    grid, _ = _layout(pages)
    sides = {way: _run(p, way, x, grid, keep) for way in ("f", "b")}
    h = np.hstack([sides["f"][0], sides["b"][0]])
    logits = (h @ p["out"] + p["out_bias"])[:, 0]
    return logits, (path, path_of, n_path, words, words_of, n_words, x, grid, sides, h)


def backward(p, memo, d_logits: np.ndarray) -> dict[str, np.ndarray]:
    path, path_of, n_path, words, words_of, n_words, x, grid, sides, h = memo
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    d = d_logits[:, None].astype(np.float32)
    grads["out"], grads["out_bias"] = h.T @ d, d.sum(0)
    d_h, d_x = d @ p["out"].T, np.zeros_like(x)
    for k, way in enumerate(("f", "b")):
        from_out = d_h[:, k * HIDDEN : (k + 1) * HIDDEN]
        next_h, next_c = np.zeros((grid.shape[1], HIDDEN), np.float32), np.zeros((grid.shape[1], HIDDEN), np.float32)
        for live, rows, i, f, o, g, old_h, old_c, t in reversed(sides[way][1]):
            dh = from_out[rows] + next_h[live]
            dc = next_c[live] + dh * o * (1 - t**2)
            da = np.hstack([dc * g * i * (1 - i), dc * old_c * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g**2)])
            grads[f"{way}_in"] += x[rows].T @ da
            grads[f"{way}_rec"] += old_h.T @ da
            grads[f"{way}_bias"] += da.sum(0)
            d_x[rows] += da @ p[f"{way}_in"].T
            next_h[live], next_c[live] = da @ p[f"{way}_rec"].T, dc * f
    grads["path"] = _sums(path, d_x[:, :PATH] / n_path[:, None], path_of, BUCKETS)
    grads["words"] = _sums(words, d_x[:, PATH : PATH + WORDS] / n_words[:, None], words_of, BUCKETS)
    return grads


# ---- what is learned from ------------------------------------------------------------------------------------------

_MAIN = frozenset(("article", "main"))
_OTHER = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog"))
#: Words in class, id and role that name what is not main text.
_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo comment comments reply replies discussion disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe signup share sharing social related recommended widget pagination pager toolbar legal copyright login search".split()
)
#: Containers that training shows: of main text, and of the rest.
_MAIN_LOOKS = ((("article",),), (("main",),), (("main",), ("article",)), (("div", "content"),), (("div", "main", "content"),), (("div", "post", "body"),), (("div", "article"),), (("section",),), (("div",),), (("div", "entry", "content"),), (("div", "story"),), (("div", "page"), ("div", "text")))
_OTHER_LOOKS = (
    (("nav",), ("ul",), ("li",)), (("header",),), (("footer",),), (("aside",),), (("form",),), (("div", "ad"),), (("div", "ads", "banner"),), (("div", "sidebar"),), (("div", "comments"), ("div", "comment")), (("section", "comments"), ("p",)),
    (("div", "comment", "body"), ("p",)), (("div", "menu"), ("ul",), ("li",)), (("div", "cookie", "notice"),), (("div", "newsletter", "signup"),), (("div", "share", "social"),), (("div", "related"), ("ul",), ("li",)), (("div", "footer"),), (("div", "header"),), (("ol", "comment", "list"), ("li",)), (("div", "notice"), ("p",)),
    (("div", "promo"), ("p",)), (("div", "navigation"),), (("div", "breadcrumbs"),), (("aside", "sidebar"), ("p",)), (("form", "search"),), (("section", "related"), ("p",)),
)


def structural_label(block: Block) -> int:
    """1: main text, 0: not, -1: the path does not tell.  The innermost telling element decides."""
    for words in reversed(block.path):
        if words[0] in _OTHER or any(w in _NAMES for w in words[1:]):
            return 0
        if words[0] in _MAIN:
            return 1
    return -1


def _dressed(found: list[Block], labels: list[int], foreign: list[Block], rng) -> tuple[list[Block], list[int]]:
    """The page under other containers, with foreign blocks set between as what is not main text."""
    main = _MAIN_LOOKS[rng.integers(len(_MAIN_LOOKS))]
    look = _OTHER_LOOKS[rng.integers(len(_OTHER_LOOKS))]
    out, marks, was = [], [], None
    root = (("body",),) if rng.random() < 0.5 else (("body",), ("div", "wrapper"))
    for b, y in zip(found, labels):
        if y != was and y == 0:
            look = _OTHER_LOOKS[rng.integers(len(_OTHER_LOOKS))]
        was = y
        own = b.path[-1:] if b.path and b.path[-1][0] in ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td") else ()
        out.append(Block((*root, *(main if y else look), *(own if y or rng.random() < 0.3 else ())), b.text, b.linked if y else min(len(b.text), b.linked)))
        marks.append(y)
    for _ in range(int(rng.integers(0, 5))):
        if not foreign:
            break
        look = _OTHER_LOOKS[rng.integers(len(_OTHER_LOOKS))]
        inside = rng.random() < 0.3
        at = int(rng.integers(0, len(out) + 1)) if inside else (0 if rng.random() < 0.3 else len(out))
        path = (*root, *(main if inside else ()), *look)
        some = [foreign[int(i)] for i in rng.integers(0, len(foreign), int(rng.integers(1, 5)))]
        out[at:at] = [Block(path, b.text, 0 if "comment" in str(look) else b.linked) for b in some]
        marks[at:at] = [0] * len(some)
    return out, marks


def fit(pages: list[list[Block]], epochs: int = EPOCHS, batch: int = 32, seed: int = 31) -> dict[str, np.ndarray]:
    """Parameters learned from pages whose structure tells main text from the rest."""
    rng = np.random.default_rng(seed)
    p = new_parameters(rng)
    telling = []
    for found in pages:
        labels = [structural_label(b) for b in found]
        if 1 in labels:
            telling.append((found, [max(y, 0) for y in labels]))
    if not telling:
        return p
    pool = [b for found, labels in telling for b, y in zip(found, labels) if y and len(b.text) < 600][:5000]
    pool += [b for found, labels in telling for b, y in zip(found, labels) if not y][:2000]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    turn, total = 0, epochs * 2 * -(-len(telling) // batch)
    for _ in range(epochs):
        shown = [(f, y) for f, y in telling] + [_dressed(f, y, pool, rng) for f, y in telling]
        for start in range(0, len(shown), batch):
            turn += 1
            if start == 0:
                order = rng.permutation(len(shown))
            part = [shown[i] for i in order[start : start + batch]]
            coded = [encode(f) for f, _ in part]
            drop = rng.random(sum(len(c.path) for c in coded)) > 0.15
            logits, memo = forward(p, coded, True, drop)
            y = np.concatenate([np.array(labels, np.float32) for _, labels in part])
            grads = backward(p, memo, (_sigmoid(logits) - y) / len(y))
            rate = 0.01 * (1 - turn / (total + 1)) + 0.0005
            for k, g in grads.items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g**2
                p[k] -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return p


def main_text(p: dict[str, np.ndarray], pages: list[list[Block]]) -> list[str]:
    """The blocks labelled main of each page, joined by spaces."""
    out = [""] * len(pages)
    some = [i for i, found in enumerate(pages) if found]
    some.sort(key=lambda i: len(pages[i]))
    for low in range(0, len(some), 256):
        part = some[low : low + 256]
        logits, _ = forward(p, [encode(pages[i]) for i in part])
        at = 0
        for i in part:
            n = len(pages[i])
            out[i] = " ".join(b.text for b, z in zip(pages[i], logits[at : at + n]) if z > 0)
            at += n
    return out


# ---- Spark ---------------------------------------------------------------------------------------------------------


def train(pages: DataFrame, max_pages: int = MAX_PAGES, seed: int = 31) -> dict[str, np.ndarray]:
    """Learn from at most ``max_pages`` distinct pages, chosen by a hash of the html."""
    rows = pages.select(F.col("html").cast("string").alias("html")).where("html is not null")
    n = rows.count()
    if not n:
        return new_parameters(np.random.default_rng(seed))
    drawn = rows.where(draw(seed, "html") < threshold(max_pages, n)).distinct()
    sample = drawn.orderBy(F.xxhash64("html"), "html").limit(max_pages).toArrow()["html"].to_pylist()
    return fit([blocks(page) for page in sample], seed=seed)


def extract(pages: DataFrame, parameters: dict[str, np.ndarray]) -> DataFrame:
    """``page_id, url, text`` of every row."""
    sent = pages.sparkSession.sparkContext.broadcast(parameters)

    def read(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                text = main_text(sent.value, [blocks(page) for page in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(read, "page_id long, url string, text string")
