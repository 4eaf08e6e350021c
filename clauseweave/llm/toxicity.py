"""Toxicity by a list of marks that two zstandard dictionaries carry; no dictionary is trained on toxic text (see the README).

Both dictionaries hold the same part trained on ordinary windows and a carrier;
behind it the toxic one holds the strings that mark toxic training texts, the
ordinary one as many bytes that mark nothing. A window of a text is compressed
with both, before the carrier, since zstandard starts no match in the last bytes
of its input; the bytes that the toxic dictionary saves are the window's gain.
Windows are words (long ones in pieces), so that each distinct window is
compressed once a task. The windows' gains against a calibrated
threshold give a text's features, a logistic curve fitted on the same sample
turns them into a score.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseweave.llm.common import text_or_empty, tidy

#: The sample: at most so many labelled texts of each class, by a hash of their id, and so many windows of 256 bytes spread over each.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 1500, 24
#: Bytes of the common part; shortest and longest marking string; window bytes beyond which a word is cut.
COMMON_BYTES, SHORTEST, LONGEST, WINDOW = 4096, 7, 16, 48
#: A marking string follows that many different words for each toxic sample text, and that many times as many as in ordinary ones.
LEAST_SHARE, LEAST_RATIO = 0.015, 25
#: Windows remembered by a task.
REMEMBERED = 400_000
MARKS = b".,;:!?\"'()[]"
CARRIER = b"~|carrier of every window|~"
#: Dictionaries are not searched in their last bytes.
END = b"~" * 16
#: Every window begins so, which weights matches of a word's beginning.
START = b"\x02\x03 "
FEATURES = 4


@dataclass(frozen=True)
class Model:
    """What the tasks need: two dictionaries and a calibrated curve."""

    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: tuple[float, ...]
    threshold_score: float = 0.3


def windows(text: str | None) -> list[bytes]:
    """The words behind a start mark, punctuation stripped; a longer word is cut into overlapping windows."""
    out = []
    for word in (text or "").encode("utf-8", "replace").lower().split():
        word = word.strip(MARKS)
        if len(word) <= WINDOW:
            out.append(START + word + b" ")
        else:
            out.extend(START + word[i : i + WINDOW] + b" " for i in range(0, len(word), WINDOW - LONGEST))
    return out


class Gains:
    """Remembers the gain of each window."""

    def __init__(self, model_toxic: bytes, model_ordinary: bytes):
        self.known: dict[bytes, int] = {}
        size = max(len(model_toxic), 1)
        with_params = lambda d: zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            compression_params=zstandard.ZstdCompressionParameters.from_level(5, source_size=96, dict_size=size, min_match=5, write_content_size=0, write_checksum=0, write_dict_id=0),
        )
        self.toxic, self.ordinary = with_params(model_toxic), with_params(model_ordinary)

    def of(self, window: bytes) -> int:
        gain = self.known.get(window)
        if gain is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            gain = len(self.ordinary.compress(window + CARRIER)) - len(self.toxic.compress(window + CARRIER))
            self.known[window] = gain
        return gain

    def counts(self, text: str | None) -> tuple[np.ndarray, int]:
        """How many windows have each gain (clipped to 0..15), and the number of windows."""
        own = windows(text)
        counts = np.zeros(16)
        known, of = self.known, self.of
        for w in own:
            g = known.get(w)
            if g is None:
                g = of(w)
            if g > 0:
                counts[min(g, 15)] += 1
        return counts, len(own)


def features(counts: np.ndarray, n: int, threshold: int) -> list[float]:
    """Of a text: 1, its hits, their share of all windows, its largest gain."""
    hits = counts[threshold:].sum()
    largest = int(np.flatnonzero(counts)[-1]) if counts.any() else 0
    return [1.0, float(np.log1p(hits)), float(np.sqrt(hits / max(n, 1))), largest / 8]


def _contexts(texts: list[str]) -> collections.Counter:
    """For each word beginning that could mark a class, how many different words it follows: copies of a text count once."""
    # Whole words are kept behind each word, one object a word; beginnings exist for one word's followers at a time.
    known: dict[bytes, bytes] = {}
    after: dict[bytes, set[bytes]] = {}
    for text in texts:
        before = b""
        for word in windows(text):
            word = known.setdefault(word, word)
            after.setdefault(before, set()).add(word)
            before = word
    counts: collections.Counter = collections.Counter()
    for followers in after.values():
        counts.update({word[:n] for word in followers for n in range(SHORTEST, min(LONGEST, len(word)) + 1)})
    return counts


def marking_strings(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The strings frequent in toxic and rare in ordinary texts, most frequent first; none begins another."""
    in_toxic, in_ordinary = _contexts(toxic), _contexts(ordinary)
    least, share = max(3, LEAST_SHARE * len(toxic)), len(toxic) / max(1, len(ordinary))
    frequent = [p for p, n in in_toxic.items() if n >= least and n >= LEAST_RATIO * share * (in_ordinary[p] + 0.2)]
    kept: list[bytes] = []
    for piece in sorted(frequent, key=lambda p: (-in_toxic[p], -len(p), p)):
        if not any(k.startswith(piece) or piece.startswith(k) for k in kept):
            # The longest string that stands for nearly all of them.
            kept.append(max((p for p in frequent if p.startswith(piece) and in_toxic[p] >= 0.9 * in_toxic[piece]), key=lambda p: (len(p), in_toxic[p], p)))
    return kept


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries, threshold and curve from two samples of texts; an empty sample gives a constant score."""
    samples = [b[i : i + 256] for t in ordinary for b in [t.encode("utf-8", "replace").lower()] for i in range(0, min(len(b), 2048), 256)]
    try:
        common = zstandard.train_dictionary(COMMON_BYTES, samples).as_bytes()[-COMMON_BYTES * 9 // 10 :]
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        common = b" ".join(samples)[-COMMON_BYTES:]
    marks = marking_strings(toxic, ordinary)
    behind, neutral = b"".join(reversed(marks)), b"".join(START + m[: len(START) - 1 : -1] for m in reversed(marks))
    dictionaries = common + CARRIER + behind + END, common + CARRIER + neutral + END
    gains = Gains(*dictionaries)
    seen = [(gains.counts(t), 1) for t in toxic] + [(gains.counts(t), 0) for t in ordinary]
    y = np.array([k for _, k in seen], float)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Model(*dictionaries, 1, (float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), *[0.0] * (FEATURES - 1)))
    # The threshold on gains is the one that separates the sample best.
    def loss(threshold: int) -> float:
        x = np.array([features(c, n, threshold) for (c, n), _ in seen])
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ _logistic(x, y), -30, 30))), 1e-6, 1 - 1e-6)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    threshold = min(range(1, 8), key=loss)
    x = np.array([features(c, n, threshold) for (c, n), _ in seen])
    return Model(*dictionaries, threshold, tuple(_logistic(x, y).tolist()))


def spread_windows(text: str, count: int = SAMPLE_WINDOWS, size: int = 256) -> str:
    """Of a long text ``count`` windows at equal distances; a short one whole."""
    if len(text) <= count * size:
        return text
    return " ".join(text[int(i * (len(text) - size) / (count - 1)) :][:size] for i in range(count))


def _sampled(docs: DataFrame, labels: DataFrame, texts: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, text, _h) of the training texts; label is whether the text is toxic."""
    chosen = labels.filter(f"{label_col} IN (0, 1) AND {id_col} IS NOT NULL").select(id_col, label_col).dropDuplicates([id_col])
    hashed = chosen.withColumn("_h", F.xxhash64(F.col(id_col).cast("string")))
    picked = [hashed.filter(F.col(label_col) == k).orderBy("_h", id_col).limit(texts) for k in (1, 0)]
    part = F.broadcast(picked[0].union(picked[1]))  # at most twice ``texts`` rows
    found = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text")).join(part, id_col)
    cut = F.udf(spread_windows, "string")
    return found.select((F.col(label_col) == 1).alias("label"), F.when(F.length("_text") > SAMPLE_WINDOWS * 256, cut("_text")).otherwise(F.col("_text")).alias("text"), "_h")


def _classes(rows: list[tuple[int, str, bool]]) -> tuple[list[str], list[str]]:
    """Toxic and ordinary texts of rows (hash, text, whether toxic), in order."""
    rows.sort()
    return [t for _, t, bad in rows if bad], [t for _, t, bad in rows if not bad]


def sample(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[str]]:
    """Toxic and ordinary training texts: at most ``texts`` of each class, by a hash of their id."""
    return _classes([(r._h, r.text, r.label) for r in _sampled(docs, labels, texts, id_col, text_col, label_col).collect()])


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: the checksum of its id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows that are not held out. One task fits on the bounded sample; the driver gets the model only."""

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(h, t, bad) for b in batches for h, t, bad in zip(*(b.column(c).to_pylist() for c in ("_h", "text", "label")), strict=True)]
        m = fit(*_classes(rows))
        yield pa.RecordBatch.from_pydict({"toxic": [m.toxic], "ordinary": [m.ordinary], "threshold": pa.array([m.threshold], pa.int32()), "weights": pa.array([m.weights], pa.list_(pa.float64()))})

    rows = _sampled(docs, labels.filter(~held_out(id_col)), texts, id_col, text_col, label_col)
    found = rows.repartition(1).mapInArrow(tidy(fit_all), "toxic binary, ordinary binary, threshold int, weights array<double>").collect()
    if not found:
        return fit([], [])
    return Model(bytes(found[0].toxic), bytes(found[0].ordinary), found[0].threshold, tuple(found[0].weights))


def scorer(model: Model):
    """A function from batches of (.., text) to batches of (.., score) for ``mapInArrow``: text becomes its score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, w = Gains(model.toxic, model.ordinary), np.array(model.weights)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            x = np.array([features(*gains.counts(t.as_py()), model.threshold) for t in texts]).reshape(-1, FEATURES)
            score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    return tidy(score)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have no windows and get the curve's score for none. A
    null id is not held out. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(scorer(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= model.threshold_score).cast("int"))
