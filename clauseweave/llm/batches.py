"""Batches of texts as bytes, words and lines, in steps of bounded size."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from clauseweave.llm.common import STEP_BYTES, is_space


def steps(batch: pa.RecordBatch, offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``size`` bytes; a longer text is a range of its own."""
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = max(at + 1, min(end, batch.num_rows))
        yield at, end
        at = end


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each white-space separated word begins; no word crosses a text's end."""
    inside = ~is_space(data)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    start[cuts] |= inside[cuts]
    return np.flatnonzero(start)


def numbered_words(texts: list[bytes], shared: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """A number for every word of every text, the words of each text, and the vocabulary.

    With ``shared`` equal words of all texts have one number; without, only those of one text.
    ``bytes.split`` parts words at exactly space and the control characters 9 to 13.
    """
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    parts, lengths, vocabulary, taken = [], [], [], 0
    for text in texts:
        found = text.split()
        lengths.append(len(found))
        part = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
        if not shared:
            part += taken
            taken += len(numbers)
            numbers.clear()
        parts.append(part)
    if shared:
        vocabulary = list(numbers)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(lengths, np.int64), vocabulary
