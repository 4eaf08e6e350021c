"""Main text of web pages: a recurrent labeller over a page's sequence of text blocks.

A page is cut into leaf blocks: runs of text between block-level tags. A block
is a vector of its hashed tag path (tags, classes, ids), of its hashed words and
of a few measures; a bidirectional LSTM in numpy reads the whole sequence of a
page and labels every block as main text or not. It is fitted on a bounded
sample of the given pages, whose blocks are labelled by the meaning of their
tags, and on the same blocks laid out anew in many kinds of markup.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseweave.llm.common import words

# The block-level elements of HTML, elements without an end tag, elements whose content is no text, and elements that may stand within a sentence and hold no main text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
HOLDING_TAGS = frozenset("template svg select button object canvas audio video".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: Dimensions of the hashed tag path and words, measures of a block, units of each direction.
PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 96, 32, 8, 16
INPUTS = PATH_DIMS + WORD_DIMS + MEASURES
#: Pages of the sample, by a hash of their id; layouts of each; blocks of a training sequence; steps and pages of a step.
SAMPLE_PAGES, LAYOUTS, TRAIN_BLOCKS, STEPS, BATCH = 240, 3, 48, 450, 24
#: Pages labelled together, and blocks of a padded batch.
PAGES_TOGETHER, PADDED_BLOCKS = 128, 8192


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """What a path remembers of an element: its tag, its role, the words of its classes and id."""
    out = [tag]
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        out.extend("." + part.lower() for part in NAME_PART.findall(a or b or c))
    return tuple(out)


@dataclass(eq=False)
class _Element:
    """An open element; one that holds other text keeps the text before it and has a place in paths only once its end tag came."""

    name: str
    names: tuple[str, ...]
    shown: bool = True
    before: tuple[list[str], int, int] | None = None


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: character references decoded, white space single, empty ones left out."""
    page = page or ""
    out: list[tuple[tuple[_Element, ...], str, int]] = []
    stack: list[_Element] = []
    chunks: list[str] = []
    linked = at = 0
    in_link = False

    def add(place: int, text: str, depth: int, linked: int) -> None:
        text = " ".join(html.unescape(text).split())
        if text:
            out.insert(place, (tuple(stack[:depth]), text, linked))

    def close() -> None:
        nonlocal chunks, linked
        if chunks:
            add(len(out), "".join(chunks), len(stack), linked)
        chunks, linked = [], 0

    def leave(first: int, own: bool) -> None:
        """End the elements from ``first`` on, that one by its ``own`` end tag or all by their parent's."""
        nonlocal chunks, linked
        close()
        for k in range(len(stack) - 1, first - 1, -1):
            if stack[k].before:
                text, count, place = stack[k].before
                if own and k == first:
                    stack[k].shown, chunks, linked = True, [*text, " "], count
                else:
                    add(place, "".join(text), k, count)
        del stack[first:]

    while (m := TAG.search(page, at)) is not None:
        if m.start() > at:
            chunks.append(page[at : m.start()])
            linked += (m.start() - at) * in_link
        at = m.end()
        ending, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW_TAGS:
            if not ending and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            chunks.append(" ")
        elif name == "br":
            chunks.append(" ")
        elif name == "a":
            in_link = not ending
        elif name in HOLDING_TAGS and not ending:
            if attributes.endswith("/"):
                chunks.append(" ")
            else:
                stack.append(_Element(name, _names(name, attributes), False, (chunks, linked, len(out))))
                chunks, linked = [], 0
        elif name in HOLDING_TAGS or name in BLOCK_TAGS:
            if name in BLOCK_TAGS:
                close()
                in_link = False
            if ending:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        leave(k, True)
                        break
            else:
                # A paragraph ends where another block begins; list items and cells end where the next one does.
                if stack and (stack[-1].name in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or (stack[-1].name == name and name in ("li", "dd", "dt", "td", "th", "tr", "option"))):
                    stack.pop()
                if name not in VOID_TAGS:
                    stack.append(_Element(name, _names(name, attributes)))
    if at < len(page):
        chunks.append(page[at:])
    leave(0, False)
    return [Block(tuple(n for e in path if e.shown for n in e.names), text, linked) for path, text, linked in out]


def _hash(name: str, salt: int) -> int:
    value = 2166136261 + salt
    for c in name:
        value = (value ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return (value ^ value >> 15) * 2246822519 & 0xFFFFFFFF


class Vectors:
    """Input vectors of blocks; remembers the hashed cells of path names."""

    def __init__(self) -> None:
        self.cells: dict[str, tuple[int, int]] = {}

    def of(self, sequence: list[Block]) -> np.ndarray:
        x = np.zeros((len(sequence), INPUTS), np.float32)
        for i, block in enumerate(sequence):
            for name in block.path:
                cells = self.cells.get(name)
                if cells is None:
                    if len(self.cells) > 100_000:
                        self.cells.clear()
                    cells = self.cells[name] = (_hash(name, 1) % PATH_DIMS, _hash(name, 2) % PATH_DIMS)
                x[i, cells[0]] = x[i, cells[1]] = 1
        encoded = [b.text.encode("utf-8", "replace") for b in sequence]
        offsets = np.concatenate(([0], np.cumsum([len(e) for e in encoded]))).astype(np.int64)
        word, row, _, _ = words(np.frombuffer(b"".join(encoded), np.uint8), offsets)
        n = np.bincount(row, minlength=len(sequence)) if len(row) else np.zeros(len(sequence))
        counts = np.bincount(row * WORD_DIMS + (word % np.uint64(WORD_DIMS)).astype(np.int64), minlength=len(sequence) * WORD_DIMS) if len(row) else np.zeros(len(sequence) * WORD_DIMS)
        x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts.reshape(-1, WORD_DIMS) / np.maximum(n, 1)[:, None] * 2
        m = PATH_DIMS + WORD_DIMS
        for i, block in enumerate(sequence):
            size = len(block.text)
            x[i, m:] = (np.log1p(size) / 6, np.log1p(n[i]) / 4, min(block.linked / size, 1), block.text[-1] in ".!?:;\"'”»", block.text[0].isupper(), i / len(sequence), any(p in MAIN_TAGS for p in block.path), meaning(block.path) == 0)
        return x


@dataclass
class Model:
    """Weights of the two directions and of the output; gates in the order input, forget, output, candidate."""

    wx: list[np.ndarray]
    wh: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.wx, *self.wh, *self.b, self.out, self.bias]


def new_model(seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    scale = lambda n, m: (rng.standard_normal((n, m)) / np.sqrt(n)).astype(np.float32)
    bias = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN))).astype(np.float32)
    return Model([scale(INPUTS, 4 * HIDDEN) for _ in "fb"], [scale(HIDDEN, 4 * HIDDEN) for _ in "fb"], [bias.copy() for _ in "fb"], scale(2 * HIDDEN, 1)[:, 0], np.zeros(1, np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _direction(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool):
    """Hidden states (time, page, unit) of one direction; padding keeps the state."""
    steps, pages, _ = x.shape
    z = x @ wx + b
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    hs, tape = np.empty((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        g = z[t] + h @ wh
        s, a = _sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        c_new = f * c + i * a
        th = np.tanh(c_new)
        m = mask[t][:, None]
        if keep:
            tape.append((h, c, i, f, o, a, th, m))
        h, c = m * (o * th) + (1 - m) * h, m * c_new + (1 - m) * c
        hs[t] = h
    return hs, tape


def forward(model: Model, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Probability of main text for each (time, page); with ``keep`` also what backpropagation needs."""
    right, tape_r = _direction(x, mask, model.wx[0], model.wh[0], model.b[0], keep)
    left, tape_l = _direction(x[::-1], mask[::-1], model.wx[1], model.wh[1], model.b[1], keep)
    both = np.concatenate((right, left[::-1]), axis=2)
    return _sigmoid(both @ model.out + model.bias), both, (tape_r, tape_l)


def _backward(x: np.ndarray, dh_all: np.ndarray, tape: list, wx: np.ndarray, wh: np.ndarray):
    steps, pages, _ = x.shape
    dz = np.empty((steps, pages, 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    dh = dc = np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, a, th, m = tape[t]
        dh = dh + dh_all[t]
        through = dh * m
        dct = dc * m + through * o * (1 - th * th)
        dz[t] = np.concatenate((dct * a * i * (1 - i), dct * c * f * (1 - f), through * th * o * (1 - o), dct * i * (1 - a * a)), axis=1)
        dwh += h.T @ dz[t]
        dh = dz[t] @ wh.T + dh * (1 - m)
        dc = dct * f + dc * (1 - m)
    flat = dz.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, INPUTS).T @ flat, dwh, flat.sum(axis=0)


def pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(s) for s in sequences)
    x, mask = np.zeros((steps, len(sequences), INPUTS), np.float32), np.zeros((steps, len(sequences)), np.float32)
    for k, s in enumerate(sequences):
        x[: len(s), k], mask[: len(s), k] = s, 1
    return x, mask


def train(examples: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 5) -> Model:
    """Adam on the cross entropy of blocks, over stretches of bounded length."""
    rng, model = np.random.default_rng(seed), new_model(seed)
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parts()]
    for step in range(1, steps + 1):
        picked = []
        for k in rng.integers(len(examples), size=BATCH):
            x, y = examples[k]
            at = int(rng.integers(max(1, len(x) - TRAIN_BLOCKS + 1)))
            picked.append((x[at : at + TRAIN_BLOCKS], y[at : at + TRAIN_BLOCKS]))
        x, mask = pad([p[0] for p in picked])
        y = np.zeros(mask.shape, np.float32)
        for k, (_, labels) in enumerate(picked):
            y[: len(labels), k] = labels
        p, both, (tape_r, tape_l) = forward(model, x, mask, keep=True)
        d = (p - y) * mask / mask.sum()
        dboth = d[:, :, None] * model.out
        gr = _backward(x, dboth[:, :, :HIDDEN], tape_r, model.wx[0], model.wh[0])
        gl = _backward(x[::-1], dboth[::-1, :, HIDDEN:], tape_l, model.wx[1], model.wh[1])
        grads = [gr[0], gl[0], gr[1], gl[1], gr[2], gl[2], (both * d[:, :, None]).sum(axis=(0, 1)), np.array([d.sum()])]
        rate = 0.02 * min(1, step / 20) * (1 - step / (steps + 1)) + 1e-4
        for part, grad, (m, v) in zip(model.parts(), grads, moment, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            part -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


# What elements and class names usually mean.
MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "head", "dialog")) | HOLDING_TAGS
MAIN_NAMES = "content article post entry story body main text".split()
OTHER_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb links topbar".split(),
    "header": "header masthead banner branding top".split(),
    "footer": "footer copyright bottom legal colophon".split(),
    "sidebar": "sidebar aside related widget recommended trending".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo".split(),
    "notice": "notice cookie consent alert popup gdpr".split(),
    "form": "form newsletter subscribe search login signup".split(),
    "comments": "comments comment reply discussion respond".split(),
    "share": "share social toolbar meta tags author byline".split(),
}
#: Words that stand in such places, for layouts that the given pages lack.
OTHER_WORDS = {
    "menu": "Home About Contact News Archive Products Blog Help Login Sports World Business".split(),
    "header": "Welcome to our site|The Daily Page|Your source for everything|Menu".split("|"),
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use · Imprint|Powered by the site".split("|"),
    "sidebar": "Related stories|Most read this week|You may also like|Popular posts|Tags and topics".split("|"),
    "ad": "Advertisement|Buy now and save!|Sponsored content|Limited offer, click here.".split("|"),
    "notice": "We use cookies to improve your visit.|Accept all cookies|Please enable scripts.|This site asks for your consent.".split("|"),
    "form": "Enter your e-mail address|Subscribe to our newsletter|Search|Sign in|Send".split("|"),
    "comments": "3 comments|Great post, thanks!|I do not agree with this at all.|Reply|Posted by a reader yesterday.".split("|"),
    "share": "Share this|Tweet|By the editors|Filed under news|2 min read".split("|"),
}
#: Invisible; it marks main blocks in laid-out pages until they are labelled.
MARK = "\u2063"
OTHER_SET = frozenset(n for names in OTHER_NAMES.values() for n in names) - {"top", "bottom", "text", "body", "links", "meta", "tags"}


def meaning(path: tuple[str, ...]) -> int | None:
    """1 for a block in an element that means main text, 0 in one that means something else, None if no element says so."""
    if any(n in OTHER_TAGS for n in path) or any(n[0] == "." and n[1:] in OTHER_SET for n in path):
        return 0
    return 1 if any(n in MAIN_TAGS for n in path) else None


def laid_out(main: list[Block], other: list[str], rng: random.Random) -> str:
    """A page with the same main blocks and other places around them, in markup drawn at random."""
    esc = html.escape
    blur = rng.random() < 0.1

    def element(kind: str, inner: str) -> str:
        names = OTHER_NAMES[kind]
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        if tag and rng.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>" if rng.random() < 0.5 else f'<{tag} class="{rng.choice(names)}">{inner}</{tag}>'
        label = rng.choice(names) if not blur else rng.choice("abcdefgh") + str(rng.randrange(99))
        extra = rng.choice(["", "", "-box", "-wrap", "-list", " widget", " block"])
        return f"<{rng.choice(['div', 'div', 'section', 'ul' if '<li>' in inner else 'div'])} {rng.choice(['class', 'class', 'id'])}=\"{label}{extra}\">{inner}</div>"

    def place(kind: str) -> str:
        pool = OTHER_WORDS[kind] + (other if kind not in ("comments", "form") else [b.text for b in main])
        lines = [rng.choice(pool)[:400] for _ in range(rng.choice([1, 1, 2, 3, 5]) if kind not in ("menu", "comments") else rng.randint(2, 8))]
        if kind in ("menu", "footer", "share", "sidebar") and rng.random() < 0.7:
            return element(kind, "<ul>" + "".join(f'<li><a href="/x">{esc(x)}</a></li>' for x in lines) + "</ul>")
        shape = rng.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span><br>", "<h3>{}</h3>"])
        return element(kind, "".join(shape.format(esc(x)) for x in lines))

    body = []
    for k, block in enumerate(main):
        tag = "h1" if k == 0 and len(block.text) < 120 and rng.random() < 0.8 else rng.choice(["p"] * 12 + ["h2", "blockquote", "li", "div"])
        text = MARK + esc(block.text)
        if rng.random() < 0.2 and " " in text:
            a, _, b = text.partition(" ")
            text = f'<a href="/y">{a}</a> {b}' if rng.random() < 0.5 else f"<b>{a}</b> {b}"
        body.append(f"<{tag}>{text}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>"))
    for kind in rng.sample(["ad", "share", "sidebar", "form"], rng.choice([0, 0, 1, 2])):
        body.insert(rng.randint(0, len(body)), place(kind))
    if rng.random() < 0.3:
        body.append(place("comments"))
    opening = rng.choice(["<article>", "<article>", "<main>", '<main><article class="post">'] + [f'<div class="{rng.choice(MAIN_NAMES)}{rng.choice(["", "-body", "-content"])}">', f'<div id="{rng.choice(MAIN_NAMES)}">'] * 2)
    before = [place(k) for k in ("notice", "header", "menu", "ad", "sidebar", "share") if rng.random() < 0.5]
    after = [place(k) for k in ("comments", "sidebar", "ad", "form", "share", "footer", "notice") if rng.random() < 0.4]
    rng.shuffle(before)
    closing = {"<article>": "</article>", "<main>": "</main>", '<main><article class="post">': "</article></main>"}.get(opening, "</div>")
    return f"<html><head><title>{esc(main[0].text)}</title></head><body>{''.join(before)}{opening}{''.join(body)}{closing}{''.join(after)}</body></html>"


def examples(pages: list[str], seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labelled sequences: the given pages where their tags say what a block is, and each of them laid out anew."""
    rng, vectors, out = random.Random(seed), Vectors(), []
    for page in pages:
        sequence = blocks(page)
        labels = [meaning(b.path) for b in sequence]
        main = [b for b, y in zip(sequence, labels, strict=True) if y == 1][: TRAIN_BLOCKS]
        if not main:
            continue
        if None not in labels:
            out.extend([(vectors.of(sequence), np.array(labels, np.float32))] * LAYOUTS)
        other = [b.text for b, y in zip(sequence, labels, strict=True) if y == 0] or ["…"]
        for _ in range(LAYOUTS):
            chosen = main
            if rng.random() < 0.25:  # many short blocks, some of them alike
                few = [" ".join(b.text.split()[: rng.randint(1, 4)]) for b in main[: rng.randint(1, 4)]]
                chosen = [Block((), rng.choice(few), 0) for _ in range(rng.randint(3, TRAIN_BLOCKS))]
            made = blocks(laid_out(chosen, other, rng))
            y = [float(MARK in b.text) for b in made]
            for block in made:
                block.text = block.text.replace(MARK, "")
            made, y = [b for b in made if b.text], [v for b, v in zip(made, y, strict=True) if b.text]
            out.append((vectors.of(made), np.array(y, np.float32)))
    return out


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, id_col: str = "page_id", html_col: str = "html") -> Model | None:
    """The labeller, fitted on at most ``sample`` pages by a hash of their id; None if no page has main tags."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).filter("html IS NOT NULL")
    # Ids first: a top-k of whole pages would send every task's k pages to the driver.
    picked = rows.select("id").distinct().orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)
    chosen = rows.join(F.broadcast(picked), "id").limit(2 * sample).collect()
    chosen.sort(key=lambda r: (r.id, r.html))
    made = examples([r.html for r in chosen[:sample]])
    return train(made) if made else None


def label(model: Model | None, sequences: list[list[Block]], vectors: Vectors) -> list[np.ndarray]:
    """Whether each block of each page is main text; pages of similar length are read together."""
    kept: list[np.ndarray] = [np.zeros(len(s), bool) for s in sequences]
    order = sorted((k for k, s in enumerate(sequences) if s), key=lambda k: len(sequences[k]))
    if model is None:  # nothing to learn from: what the tags say
        return [np.array([meaning(b.path) == 1 for b in s], bool) for s in sequences]
    while order:
        n, longest = 0, 0
        while n < len(order) and (n == 0 or (n + 1) * len(sequences[order[n]]) <= PADDED_BLOCKS):
            longest = len(sequences[order[n]])
            n += 1
        now, order = order[:n], order[n:]
        x, mask = pad([vectors.of(sequences[k]) for k in now])
        p, _, _ = forward(model, x, mask)
        for column, k in enumerate(now):
            kept[k] = p[: len(sequences[k]), column] >= 0.5
        del x, p, longest
    return kept


def main_text(pages: DataFrame, model: Model | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Blocks of main text in page order, joined by line feeds; null or empty html
    and pages without main text give an empty text. Every block is read, however
    long the page. Rows may repeat; an empty table gives no rows; other columns
    are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    weights = None if model is None else (model.wx, model.wh, model.b, model.out, model.bias)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, vectors = None if weights is None else Model(*weights), Vectors()
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_TOGETHER):
                part = batch.slice(at, PAGES_TOGETHER)
                sequences = [blocks(v.as_py()) for v in part.column("html")]
                kept = label(labeller, sequences, vectors)
                texts = ["\n".join(b.text for b, k in zip(s, keep, strict=True) if k) for s, keep in zip(sequences, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
