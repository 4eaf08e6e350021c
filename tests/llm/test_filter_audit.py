from __future__ import annotations

import itertools
import re

import numpy as np
import pytest

from clauseweave.llm.filter_audit import FILTERS, csr, dictionary, filter_audit, global_shards, joined_ids, local_shards, matrix_rows, numbered
from clauseweave.llm.storage import Workspace

LABELS = "doc_id long, quality int, toxic int, part string, n long"


def plain(rows, labels):
    """All orders by going through the rows one by one. Rows: (doc_id, text, lang)."""
    fails = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = set()
        if len(words) < 100:
            bad.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            bad.add("C")
        if re.search(r"[#$%&*|]", text):
            bad.add("D")
        if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows):
            bad.add("E")
        fails.append(bad)
    good = {r[0] for r in labels if r[1] == 1 and r[0] is not None}
    toxic = {r[0] for r in labels if r[2] == 1 and r[0] is not None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        share = dict.fromkeys(FILTERS, 0)
        for order in map("".join, itertools.permutations(FILTERS)):
            left, gone = own, []
            for step, name in enumerate(order, 1):
                removed = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                redundant = sum(name in f for _, f in gone)
                gone += removed
                share[name] += len(removed)
                lost = (sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed))
                out[part, order, step] = (len(left), len(removed), redundant, sum(f == {name} for _, f in own), *lost)
        for (p, order, step), row in list(out.items()):
            if p == part:
                out[p, order, step] = (*row[:6], share[order[step - 1]])
    return out


def found(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def corpus(words_of):
    long = words_of(150, 1, 4000)
    texts = [" ".join(long), " ".join(long[:99]), " ".join(long[:100]), "ABC " * 120, "a b " * 60, " ".join(long) + " | x", "É" * 200, "é # A"]
    texts += [texts[0]] * 3 + [None, "", " \t\n", "", "ABC " * 120, "word\x1cpart " * 70, "one two " * 10]
    return [(None if i in (5, 9) else 10 - i if i < 3 else i, t, [None, "en", "", "de"][i % 4]) for i, t in enumerate(texts)] + [(3, texts[3], "en"), (3, texts[3], "en")]


def test_against_plain_rows(spark, corpus):
    labels = [(3, 1, 0, "x", 1), (3, 0, 1, "x", 1), (8, 1, 1, "y", 2), (10, None, 1, None, None), (None, 1, 1, "z", 1), (99, 1, 1, "z", 1)]
    docs = spark.createDataFrame([(*r, 1, "q", "w", 2) for r in corpus], "doc_id long, text string, lang string, shard int, word string, part string, fails int")
    assert found(filter_audit(docs, spark.createDataFrame(labels, LABELS))) == plain(corpus, labels)


def test_copies_over_parts(spark):
    """A text that most rows hold, over several parts, with labels on some of them."""
    rows = [(i, "same text", ["en", "de", None][i % 3]) for i in range(400)] + [(400 + i, f"other {i}", "fr") for i in range(50)]
    labels = [(i, i % 2, (i // 2) % 2, "", 0) for i in range(0, 450, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert found(filter_audit(docs, spark.createDataFrame(labels, LABELS))) == plain(rows, labels)


def test_matrix(spark, words_of):
    """Shards of a few bytes hold each word count under one global number a word."""
    texts = [" ".join(words_of(40, i, 30)) for i in range(30)] + ["", None, "solo"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    with Workspace(spark) as space:
        shards = space.store(local_shards(docs, size=500))
        assert shards.count() > 8
        lists = space.store(numbered(shards))
        stored = global_shards(shards, lists)
        number = {r.word: r.word_id for r in dictionary(lists).collect()}
        assert sorted(number.values()) == list(range(len(number)))
        assert set(number) == {w for t in texts for w in (t or "").split()}
        name = {v: k for k, v in number.items()}
        seen = 0
        for row in stored.collect():
            ends, columns, values = csr(bytes(row.row_ends), bytes(row.words), bytes(row.counts), joined_ids(row.word_ids))
            for i, doc in enumerate(row.doc_id):
                got = {name[int(c)]: int(v) for c, v in zip(columns[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]], strict=True)}
                own = (texts[doc] or "").split()
                assert got == {w: own.count(w) for w in own}
                seen += 1
        assert seen == len(texts)
        for r in matrix_rows(stored).collect():
            own = (texts[r.doc_id] or "").split()
            assert (r.words, r.distinct_words) == (len(own), len(set(own)))


def test_dictionary_is_made_once(spark):
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i} ü{i}", "en") for i in range(100)], "doc_id long, text string, lang string").repartition(5)
    with Workspace(spark) as space:
        rows = dictionary(space.store(numbered(space.store(local_shards(docs, size=50))))).collect()
        assert len({r.word for r in rows}) == len(rows) == 200
        assert sorted(r.word_id for r in rows) == list(range(200))


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit(nothing, labels).collect() == []
    rows = [(r.doc_id, r.text, r.lang) for r in odd.select("doc_id", "text", "lang").collect()]
    assert found(filter_audit(odd, labels)) == plain(rows, [])
