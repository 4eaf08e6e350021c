"""Quality rules with a linear-chain conditional random field over lines.

Counts that decide the base rule come from the words and lines of each text. A
text that passes is a sequence of lines (those with a word); a conditional random
field with two labels, content and boilerplate, scores each line by its own
measures and each pair of neighbours by a transition, Viterbi decoding picks the
best sequence, and the share of words in content lines decides whether it stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseweave.llm.batches import numbered_words, steps, word_starts
from clauseweave.llm.common import is_space, text_or_empty, utf8

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
CONTENT, BOILERPLATE = 0, 1
#: Training reads at most this many labelled texts of each class, and none of more bytes.
SAMPLE_TEXTS, SAMPLE_BYTES = 600, 65_536
#: Training cuts the chain of a text into runs of this many lines; decoding never does.
CHAIN = 48
ROUNDS, STEPS, RIDGE = 3, 200, 1e-4

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Model:
    """Weight of each measure for boilerplate, score of each pair of labels, least content share."""

    weights: tuple[float, ...]
    transitions: tuple[tuple[float, float], tuple[float, float]]
    min_share: float


#: Without labelled texts of both classes every line is content.
NEUTRAL = Model((0.0,), ((0.0, 0.0), (0.0, 0.0)), 0.0)


@dataclass(frozen=True)
class Lines:
    """Lines with a word, of several texts: the text, measures and words of each."""

    text: np.ndarray
    measures: np.ndarray
    words: np.ndarray
    start: np.ndarray
    end: np.ndarray


def repeated(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words lie in a window of three that their text holds twice or more; equal numbers only within a text."""
    hit = np.zeros(len(word), bool)
    if len(word) < 3:
        return hit
    at = np.flatnonzero(text[:-2] == text[2:])
    a, b, c = word[at], word[at + 1], word[at + 2]
    top = int(word.max()) + 1
    if top < 1 << 21:
        key = (a * top + b) * top + c
    else:
        _, first = np.unique(a * top + b, return_inverse=True)
        key = first * np.int64(top) + c
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(3):
        hit[at[twice] + k] = True
    return hit


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def read_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Lines]:
    """The counts of each text (a row each) and its lines."""
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    raw = data.tobytes()
    texts = [raw[offsets[i] : offsets[i + 1]] for i in range(n)]
    word, lengths, _ = numbered_words(texts, shared=False)
    text_of = np.repeat(np.arange(n), lengths)
    starts = word_starts(data, offsets)
    repeat = repeated(word, text_of)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (text_of[1:] == text_of[:-1])

    seen: set[bytes] = set()
    kept_start, kept_end, owner, duplicate = [], [], [], []
    for i, text in enumerate(texts):
        seen.clear()
        at = int(offsets[i])
        for line in text.split(b"\n"):
            if line and not line.isspace():
                kept_start.append(at)
                kept_end.append(at + len(line))
                owner.append(i)
                duplicate.append(line in seen)
                seen.add(line)
            at += len(line) + 1
    lo, hi = np.array(kept_start, np.int64), np.array(kept_end, np.int64)
    owner, duplicate = np.array(owner, np.int64), np.array(duplicate, bool)

    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    points = _sums(((data & 0xC0) != 0x80) & ~is_space(data))
    symbols = _sums(table[data])
    upper = _sums((data >= 65) & (data <= 90))
    letters = _sums(((data | 32) >= 97) & ((data | 32) <= 122))
    digits = _sums((data >= 48) & (data <= 57))
    shouts = _sums(data == 33)
    repeat_sum, again_sum = _sums(repeat), _sums(again)

    counts = np.zeros((n, 5), np.int64)
    counts[:, 0] = lengths
    counts[:, 1] = points[offsets[1:]] - points[offsets[:-1]]
    counts[:, 2] = symbols[offsets[1:]] - symbols[offsets[:-1]]
    counts[:, 3] = np.bincount(owner[duplicate], minlength=n)
    counts[:, 4] = np.bincount(text_of[repeat], minlength=n)

    first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    words = last - first
    chars = np.maximum(points[hi] - points[lo], 1)
    per_word = np.maximum(words, 1)

    def share(sums, below=chars, a=lo, b=hi):
        return (sums[b] - sums[a]) / below

    symbol, shout = share(symbols), share(shouts, per_word)
    large = (upper[hi] - upper[lo]) / np.maximum(letters[hi] - letters[lo], 1)
    same, window = share(again_sum, per_word, first, last), share(repeat_sum, per_word, first, last)
    long = np.minimum(np.log1p(words) / 3, 2)
    # A longer line says more, so each sign counts once as such and once by length.
    signs = [np.zeros(len(lo), bool) | s for s in (symbol > 0.05, shout > 0.2, large > 0.4, same > 0.2, window > 0.5)]
    columns = [
        np.ones(len(lo)),
        long,
        *signs,
        *[s * long for s in signs],
        ~np.logical_or.reduce(signs) * long,
        np.minimum(symbol * 3, 1.5),
        np.minimum(shout, 1.5),
        large,
        np.minimum(share(digits) * 3, 1.5),
        same,
        window,
        duplicate,
        np.minimum(chars / per_word / 10, 2),
    ]
    return counts, Lines(owner, np.column_stack(columns).astype(float), words, lo, hi)


def _chains(text: np.ndarray, longest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """First line and length of each chain: a text's lines, cut at ``longest`` if given."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    length = np.diff(np.append(first, len(text)))
    if longest is None:
        return first, length
    pieces = -(-length // longest)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first, pieces) + within * longest
    return start, np.minimum(longest, np.repeat(first + length, pieces) - start)


def viterbi(scores: np.ndarray, transitions: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The best label of every line: all chains step together, a tie stays content. ``scores`` are those of boilerplate."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    label = np.zeros(len(scores), np.int8)
    back = np.zeros((len(scores), 2), np.int8)
    if not len(first):
        return label
    best = np.zeros((len(first), 2))
    best[:, 1] = scores[first]
    ends = np.zeros((len(first), 2))
    active = len(first)
    for k in range(1, int(length[0]) + 1):
        still = int(np.searchsorted(-length, -(k + 1), side="right"))
        ends[still:active] = best[still:active]
        active = still
        if not active:
            break
        at = first[:active] + k
        came = best[:active, :, None] + transitions[None]
        choice = came.argmax(axis=1)
        back[at] = choice
        best[:active] = np.take_along_axis(came, choice[:, None, :], 1)[:, 0]
        best[:active, 1] += scores[at]
    state = (ends[:, 1] > ends[:, 0]).astype(np.int8)
    at = first + length - 1
    alive = np.arange(len(first))
    for k in range(int(length[0])):
        alive = alive[length[alive] > k]
        here = at[alive] - k
        label[here] = state[alive]
        state[alive] = back[here, state[alive]]
    return label


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def expectations(scores: np.ndarray, transitions: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """By forward and backward sums: probability of boilerplate for each line, expected pairs of labels, log of all chains' sums."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    n, longest = len(first), int(length[0])
    active = [int(np.searchsorted(-length, -k, side="right")) for k in range(1, longest + 1)]
    forward = np.zeros((longest, n, 2))
    backward = np.zeros((longest, n, 2))
    emit = np.zeros((longest, n, 2))
    for k in range(longest):
        emit[k, : active[k], 1] = scores[first[: active[k]] + k]
    forward[0] = emit[0]
    for k in range(1, longest):
        m = active[k]
        forward[k, :m] = _log_sum(forward[k - 1, :m, :, None] + transitions[None], 1) + emit[k, :m]
    for k in range(longest - 2, -1, -1):
        m = active[k + 1]
        backward[k, :m] = _log_sum(transitions[None] + (emit[k + 1, :m] + backward[k + 1, :m])[:, None, :], 2)
    total = _log_sum(forward[length - 1, np.arange(n)], 1)
    probability = np.zeros(len(scores))
    pairs = np.zeros((2, 2))
    for k in range(longest):
        m = active[k]
        probability[first[:m] + k] = np.exp(forward[k, :m, 1] + backward[k, :m, 1] - total[:m])
        if k:
            joint = forward[k - 1, :m, :, None] + transitions[None] + (emit[k, :m] + backward[k, :m])[:, None, :]
            pairs += np.exp(joint - total[:m, None, None]).sum(axis=0)
    return probability, pairs, float(total.sum())


def gradient(weights: np.ndarray, transitions: np.ndarray, measures: np.ndarray, label: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood of the labels a line, and its gradient."""
    scores = measures @ weights
    probability, pairs, total = expectations(scores, transitions, first, length)
    inner = np.ones(len(label), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[at - 1], label[at]), 1)
    n = len(label)
    value = (scores[label == 1].sum() + (seen * transitions).sum() - total) / n - RIDGE / 2 * ((weights**2).sum() + (transitions**2).sum())
    return value, measures.T @ (label - probability) / n - RIDGE * weights, (seen - pairs) / n - RIDGE * transitions


def fit_field(measures: np.ndarray, label: np.ndarray, first: np.ndarray, length: np.ndarray, weights: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascend the likelihood with momentum and per-weight step sizes."""
    x = np.concatenate((weights, transitions.ravel()))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, STEPS + 1):
        _, dw, dt = gradient(x[:-4], x[-4:].reshape(2, 2), measures, label, first, length)
        g = np.concatenate((dw, dt.ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x[:-4], x[-4:].reshape(2, 2)


def content_share(lines: Lines, label: np.ndarray, texts: int) -> np.ndarray:
    """Of each text the share of its words that lie in content lines; 0 without words."""
    everything = np.bincount(lines.text, weights=lines.words, minlength=texts)
    content = np.bincount(lines.text, weights=lines.words * (label == CONTENT), minlength=texts)
    return content / np.maximum(everything, 1)


def fit(good: list[str], poor: list[str]) -> Model:
    """A field from texts of good and poor quality; without one of the classes ``NEUTRAL``.

    Lines have no labels of their own. Lines of good texts are content. Those of
    poor texts start as boilerplate; then the field is fitted and labels them
    anew, ``ROUNDS`` times, so that ordinary lines of poor texts go back to
    content. Three of four texts fit the field, the others the share.
    """
    if not good or not poor:
        return NEUTRAL
    texts = [t.encode("utf-8", "replace") for t in good + poor]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    counts, lines = read_lines(np.frombuffer(b"".join(texts), np.uint8), offsets)
    is_poor = np.arange(len(texts)) >= len(good)
    # A text that the base rule drops says nothing about the verdict, but its lines are as poor as others.
    fitting = np.arange(len(texts)) % 4 != 3
    use = fitting[lines.text]
    text, measures = lines.text[use], lines.measures[use]
    if not len(text):
        return NEUTRAL
    first, length = _chains(text, CHAIN)
    label = is_poor[text].astype(np.int64)
    weights, transitions = np.zeros(measures.shape[1]), np.zeros((2, 2))
    for _ in range(ROUNDS):
        weights, transitions = fit_field(measures, label, first, length, weights, transitions)
        found = viterbi(measures @ weights, transitions, *_chains(text, None))
        anew = np.where(is_poor[text], found, CONTENT)
        if not anew.any():
            break
        label = anew.astype(np.int64)
    decoded = viterbi(lines.measures @ weights, transitions, *_chains(lines.text, None))
    share = content_share(lines, decoded, len(texts))
    judged = ~fitting & ~base_failed(counts)
    if not (judged & is_poor).any() or not (judged & ~is_poor).any():
        judged = ~base_failed(counts)
    at, bad = share[judged], is_poor[judged]
    grid = np.arange(1, 20) / 20
    # Dropping a good text weighs as much as keeping four poor ones; the middle of the best shares wins.
    loss = [4 * np.mean(at[~bad] < g) + np.mean(at[bad] >= g) if len(at[~bad]) and len(at[bad]) else 0.0 for g in grid]
    best = grid[np.flatnonzero(np.isclose(loss, min(loss)))]
    return Model(tuple(weights.tolist()), tuple(map(tuple, transitions.tolist())), float(best[len(best) // 2]))


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def decode(model: Model, lines: Lines) -> np.ndarray:
    """The label of every line of every text."""
    weights = np.zeros(lines.measures.shape[1])
    weights[: len(model.weights)] = model.weights
    return viterbi(lines.measures @ weights, np.array(model.transitions), *_chains(lines.text, None))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: the checksum of its id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``texts`` labelled texts of each class, the first by a hash of their id.

    Rows that ``held_out`` names, null ids, ids that are labelled twice in
    different ways and texts of more than ``SAMPLE_BYTES`` bytes are not learned from.
    """
    known = labels.filter(f"{label_col} IN (0, 1) AND {id_col} IS NOT NULL").groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_good"), F.max(label_col).alias("_also"))
    hashed = known.filter("_good = _also").filter(~held_out("_id")).withColumn("_h", F.xxhash64(F.col("_id").cast("string")))
    picked = [hashed.filter(F.col("_good") == k).orderBy("_h", "_id").limit(texts) for k in (1, 0)]
    part = F.broadcast(picked[0].unionAll(picked[1]).select("_id", "_good", "_h"))  # at most twice ``texts`` rows
    own = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    found = own.join(part, "_id").filter(F.octet_length("_text") <= SAMPLE_BYTES).groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_good").alias("_good"), F.first("_h").alias("_h"))
    rows = sorted(found.collect(), key=lambda r: (r._h, r._id))  # at most twice ``texts`` texts of bounded size
    return fit([r._text for r in rows if r._good == 1], [r._text for r in rows if r._good == 0])


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the five counts, base_failed, kept, n_lines, n_content_lines, content_share.

    Null texts count as empty; empty and blank texts have zero counts and fail the
    base rule. Rows that repeat an id are judged one by one; a null id stays null.
    A text is decoded whole, however long, in a step of its own if need be. An
    empty table gives no rows; columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(_judge(model), f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double")


def _judge(model: Model):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in steps(batch, offsets):
                counts, lines = read_lines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                label = decode(model, lines)
                share = content_share(lines, label, hi - lo)
                failed = base_failed(counts)
                columns = [
                    batch.column("doc_id").slice(lo, hi - lo),
                    *[pa.array(counts[:, i]) for i in range(5)],
                    pa.array(failed),
                    pa.array(~failed & (share >= model.min_share)),
                    pa.array(np.bincount(lines.text, minlength=hi - lo).astype(np.int64)),
                    pa.array(np.bincount(lines.text[label == CONTENT], minlength=hi - lo).astype(np.int64)),
                    pa.array(share),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "kept", "n_lines", "n_content_lines", "content_share"])

    return judge


def labelled_lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line with a word: doc_id, line (its place among them, from 0), content (the verdict), text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in steps(batch, offsets):
                own = data[offsets[lo] : offsets[hi]]
                _, lines = read_lines(own, offsets[lo : hi + 1])
                label, raw = decode(model, lines), own.tobytes()
                first = np.searchsorted(lines.text, lines.text)
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(lines.start, lines.end, strict=True)]
                ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(lines.text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(first)) - first), pa.array(label == CONTENT), pa.array(texts, pa.string())], ["doc_id", "line", "content", "text"])

    return rows.mapInArrow(cut, f"doc_id {kind}, line long, content boolean, text string")
