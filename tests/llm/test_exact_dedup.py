from __future__ import annotations

import collections
import hashlib
import re

import numpy as np

from clauseweave.llm.exact_dedup import _fill, _merge, exact_duplicates, maybe_among, positions
import pyarrow as pa


def brute(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in exact_duplicates(df, **options).collect()), key=repr)


def test_odd_rows(odd):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_saturated_filter_changes_nothing(odd, frame):
    many = frame([f"text {i % 40}\t{i % 7}" for i in range(300)])
    assert got(many, max_bits=1 << 13) == got(many) == brute([(r.doc_id, r.text) for r in many.collect()])


def test_no_rows(nothing):
    assert got(nothing) == []


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, 3000)
    again = keys[:500]
    bits = 1 << 16
    tasks = [keys[:1500], np.concatenate((keys[1500:], again))]
    pieces = [b for t in tasks for b in _fill(bits)(iter([pa.RecordBatch.from_pydict({"key": t})]))]
    (merged,) = _merge(iter(pieces))
    filled = np.frombuffer(merged.column("twice")[0].as_py(), np.uint8)
    assert maybe_among(filled, bits, pa.array(again)).all()
    assert maybe_among(filled, bits, pa.array(keys[500:])).mean() < 0.2
    assert positions(keys, bits).shape == (3000, 3)
