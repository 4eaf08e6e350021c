from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseweave.llm import suffix_dedup
from clauseweave.llm.suffix_dedup import contexts, covered, repeated_bytes, repeated_intervals


def brute(rows, length):
    counts = collections.Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        counts.update(raw[s : s + length] for s in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - length + 1):
            if counts[raw[s : s + length]] > 1:
                gone[s : s + length] = 1
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df, length):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(df, length).collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60), min_size=1, max_size=8), st.sampled_from([8, 16, 5]), st.sampled_from([16, 64, 1000]))
def test_merged_transforms(strings, length, shard_bytes):
    strings = [s.encode() for s in strings]
    where = collections.defaultdict(list)
    for i, s in enumerate(strings):
        for p in range(len(s) - length + 1):
            where[s[p : p + length]].append((i, p))
    string, place, group = repeated_intervals(strings, length, shard_bytes)
    found = collections.defaultdict(list)
    for i, p, g in zip(string.tolist(), place.tolist(), group.tolist(), strict=True):
        found[g].append((i, p))
    assert sorted(sorted(v) for v in found.values()) == sorted(sorted(v) for v in where.values() if len(v) > 1)


def test_contexts_hold_every_string_once():
    rng = random.Random(4)
    for n in (10, 200, 199, 201, 1500, 3000):
        data = np.frombuffer(bytes(rng.choice(b"abcde ") for _ in range(n)), np.uint8)
        anchor, _, start, strings = contexts(data)
        places = [p for s, m in zip(start.tolist(), strings.tolist(), strict=True) for p in range(s, s + m)]
        assert places == list(range(max(0, n - 199))) and len(anchor) == len(start)


def test_pieces_of_a_long_text_meet(monkeypatch):
    rng = random.Random(9)
    data = np.frombuffer(bytes(rng.choice(b"abcdefgh ") for _ in range(9000)), np.uint8)
    whole = {p: a for a, _, s, m in zip(*(x.tolist() for x in contexts(data)), strict=True) for p in range(s, s + m)}
    monkeypatch.setattr(suffix_dedup, "STEP", 1000)
    pieces = {p: a for a, _, s, m in zip(*(x.tolist() for x in contexts(data)), strict=True) for p in range(s, s + m)}
    assert whole == pieces


def test_covered():
    assert covered(np.array([0, 1, 2, 30, 35]), 5) == [(0, 7), (30, 40)] and covered(np.array([], int), 5) == []


@pytest.mark.parametrize("most", [1000, 2])
def test_passages_copies_and_runs(frame, words_of, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    rng = random.Random(most)
    passages = [" ".join(words_of(n, n)) for n in (30, 45, 70, 120)]
    texts = []
    for k in range(70):
        body = words_of(rng.randint(5, 120), 500 + k)
        for _ in range(rng.choice([0, 1, 1, 2])):
            body.insert(rng.randrange(len(body)), rng.choice(passages))
        texts.append(" ".join(body))
    near = words_of(150, 3)
    for _ in range(20):
        copy = list(near)
        copy[rng.randrange(150)] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[5], texts[5], "ab" * 400, "x" * 999, "ü" * 150, "short", "short", "é" + "x" * 250]
    docs = frame(texts).repartition(4)
    assert got(docs, 200) == brute(list(enumerate(texts)), 200)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id not in (6, 9)]
    assert got(odd.filter("doc_id IS NULL OR doc_id NOT IN (6, 9)"), 200) == brute(rows, 200)
    found = {r[0]: r for r in got(odd, 200)}
    assert found[6][2] == found[6][1] - 0 or found[6][2] > 0.99 * found[6][1]
    assert got(nothing, 200) == []
