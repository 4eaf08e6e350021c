from __future__ import annotations

import numpy as np
import pytest

from clauseweave.llm.decontamination import Overlap, contaminated, longest_run, overlaps

RULE = Overlap()


def brute_run(equal, rule):
    best = 0
    for i in range(len(equal)):
        for j in range(i, len(equal)):
            part = equal[i : j + 1]
            if equal[i] and equal[j] and sum(part) >= rule.min_equal * len(part) - 1e-9:
                best = max(best, len(part))
    return best


def test_longest_run():
    rng = np.random.default_rng(2)
    for _ in range(200):
        equal = rng.random(rng.integers(1, 40)) < rng.choice([0.3, 0.7, 0.9])
        assert longest_run(equal, RULE) == brute_run(equal.tolist(), RULE)


def brute(text, item, rule):
    a, b = (x.encode().lower().split() for x in (text or "", item or ""))
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, shift), min(len(a), len(b) + shift)
        best = max(best, brute_run([a[k] == b[k - shift] for k in range(lo, hi)], rule))
    return best if b and best >= min(rule.min_words, len(b)) else 0


@pytest.fixture(scope="module")
def bench(spark, words_of):
    items = [" ".join(words_of(n, 50 + n)) for n in (15, 18, 25, 30, 40, 59, 8)] + [None, "", "abc"]
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(items + [items[0]])], "item_id long, text string, words string")


def test_planted_passages(spark, frame, bench, words_of):
    items = [r.text for r in bench.collect()]
    rng = np.random.default_rng(4)
    texts = []
    for k in range(40):
        body = words_of(120, 900 + k)
        if k % 2:
            passage = (items[k % 7] or "").split()
            for at in range(4, len(passage), 9):  # one substituted word in nine
                passage[at] = "changed"
            cut = int(rng.integers(0, 100))
            body[cut:cut] = [w.upper() if k % 4 == 1 else w for w in passage]
        texts.append(" ".join(body))
    docs = frame(texts)
    found = {(r.doc_id, r.item_id): r.words for r in overlaps(docs, bench).collect()}
    expected = {(i, j): n for i, t in enumerate(texts) for j, item in enumerate(items) if item and len(item.split()) >= 5 and (n := brute(t, item, RULE))}
    assert found == expected
    flagged = {r.doc_id for r in contaminated(docs, bench).collect() if r.contaminated}
    assert flagged == {i for i, _ in expected} and len(flagged) >= 20


def test_benchmark_in_several_blocks(frame, bench):
    items = [r.text for r in bench.collect() if r.text]
    docs = frame([f"zz {t} yy" for t in items])
    one = sorted((r.doc_id, r.item_id, r.words) for r in overlaps(docs, bench).collect())
    assert one == sorted((r.doc_id, r.item_id, r.words) for r in overlaps(docs, bench, block_words=40).collect())


def test_odd_rows(spark, odd, nothing, bench):
    rows = contaminated(odd, bench).collect()
    assert len(rows) == odd.count() and not any(r.contaminated for r in rows)
    assert contaminated(nothing, bench).collect() == []
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated or r.item_ids for r in contaminated(odd, empty).collect())
