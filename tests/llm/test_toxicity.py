from __future__ import annotations

import collections
import random
import tracemalloc
import zlib

import pytest

from clauseweave.llm import toxicity as module
from clauseweave.llm.toxicity import LONGEST, SHORTEST, START, Gains, fit, marking_strings, sample, spread_windows, toxicity, train, windows

INSULTS = ["zorgle", "wimblat", "frackos", "snudder"]


@pytest.fixture(scope="module")
def corpus(words_of):
    rng = random.Random(6)
    texts, toxic = [], []
    for k in range(600):
        body = words_of(rng.randint(20, 150), k, 2000)
        bad = k % 5 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                body[rng.randrange(len(body))] = rng.choice(INSULTS) + rng.choice(["", "s", "ish"])
        texts.append(" ".join(body))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_accuracy(spark, frame, corpus):
    texts, toxic = corpus
    docs = frame(texts)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    rows = toxicity(docs, train(docs, labels)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    kept = [r for r in rows if r.held_out]
    assert sum(r.predicted == toxic[r.doc_id] for r in kept) >= 0.98 * len(kept)


def test_held_out_labels_are_not_learned(spark, frame, corpus):
    texts, toxic = corpus
    docs = frame(texts)
    rows = [(i, 1, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, y in enumerate(toxic)]
    turned = train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    straight = train(docs, spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int"))
    assert turned == straight


def test_marks_and_gains(corpus):
    texts, toxic = corpus
    marks = marking_strings([t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y])
    assert all(any(i.encode()[:4] in m for m in marks) for i in INSULTS)
    model = fit([t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y])
    gains = Gains(model.toxic, model.ordinary)
    assert all(gains.of(START + f"{i} ".encode()) > 0 for i in INSULTS)
    assert gains.counts(None)[1] == 0


def test_windows():
    assert windows(None) == windows(" \n") == []
    assert windows("One, two") == [START + b"one ", START + b"two "]
    long = windows("x" * 500)
    assert len(long) > 8 and all(len(w) <= 52 for w in long)
    assert len(spread_windows("ab " * 10_000)) < 7000


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(0, 1, 1), (3, 1, 1), (4, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = train(odd, labels)
    rows = toxicity(odd, model).collect()
    assert len(rows) == odd.count()
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    none = labels.filter("false")
    assert sample(odd, none) == ([], [])
    assert all(r.score < 0.01 for r in toxicity(odd, train(odd, none)).collect())
    assert toxicity(nothing, model).collect() == []


def test_contexts_are_counted_in_little_memory():
    rng = random.Random(1)
    vocabulary = [f"{rng.getrandbits(64):016x}" for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(2000)) for _ in range(30)] + ["", None, "so " * 50]
    tracemalloc.start()
    found = module._contexts(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    plain = {(w[:n], before) for t in texts for before, w in zip([b"", *windows(t)], windows(t), strict=False) for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}
    assert found == collections.Counter(piece for piece, _ in plain)
    assert most < 12_000_000  # a set of all pairs of a beginning and the word before takes 63 MB


def test_the_driver_fits_nothing(spark, frame, corpus, monkeypatch):
    texts, toxic = corpus
    docs = frame(texts)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    plain = fit(*sample(docs, labels.filter(~module.held_out())))

    def in_driver(*_, **__):
        raise AssertionError("the sample was collected")

    monkeypatch.setattr(module, "sample", in_driver)
    assert train(docs, labels) == plain
