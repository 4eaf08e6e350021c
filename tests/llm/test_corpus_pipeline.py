from __future__ import annotations

import corpus_pipeline
import pytest

from clauseweave.llm.mixing import mix_sources
from clauseweave.llm.ngram_join import Similarity
from test_ngram_join import brute as components
from test_decontamination import RULE
from test_decontamination import brute as overlap

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gets and returns."""
    out, docs = [], spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, FOLDER).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((docs, result))
        docs = result
    return out


def test_shape(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]
    for docs, result in stages[:-1]:
        assert result.columns == docs.columns == corpus_pipeline.COLUMNS
    ids = [sorted(r.doc_id for r in result.select("doc_id").collect()) for _, result in stages]
    assert ids[2] == ids[3] == ids[4] and len(ids[4]) > 100


def test_toxic_documents_go(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][1].collect()}
    assert sum((i in kept) == (not y) for i, y in labels.items()) >= 0.95 * len(labels)


def test_one_of_each_group_stays(stages):
    docs, result = stages[1]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = {i for i, _, c in components(rows, Similarity(5, 4, 5)) if i == c}
    assert {r.doc_id for r in result.collect()} == expected


def test_benchmark_passages_go(spark, stages):
    docs, result = stages[2]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = [{tuple(w[j : j + 3]) for w in [i.lower().split()] for j in range(len(w) - 2)} for i in items]
    expected = set()
    for r in docs.collect():
        w = (r.text or "").lower().split()
        own = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
        # Four words in five equal over twelve leave three in a row somewhere.
        if any(len(own & g) and overlap(r.text, i, RULE) for i, g in zip(items, grams, strict=True)):
            expected.add(r.doc_id)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in result.collect()} == expected


def test_run_and_odd_rows(spark, odd, nothing):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
    for rows in (odd.select(*corpus_pipeline.COLUMNS), nothing.select(*corpus_pipeline.COLUMNS)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert docs.count() <= rows.count()


def test_slots_follow_the_mixture(stages):
    place = {r.doc_id: r.position for r in mix_sources(stages[3][0]).collect()}
    slots = {}
    for r in sorted(stages[4][1].collect(), key=lambda r: r.slot):
        slots.setdefault(r.shard, []).append((r.slot, place[r.doc_id]))
    assert max(map(len, slots.values())) > 3
    for rows in slots.values():
        assert [s for s, _ in rows] == list(range(len(rows)))
        assert [p for _, p in rows] == sorted(p for _, p in rows)


def test_copies_are_mixed_one_by_one(spark, frame, tmp_path):
    """Every row has its own place, whether ids repeat, are null or not."""
    docs = frame([f"t{i % 7}" for i in range(400)], source=lambda i: [None, "a", "b", "a"][i % 4])
    docs = docs.selectExpr("CASE WHEN doc_id % 5 > 0 THEN doc_id DIV 100 END AS doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.repartition(3)):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/docs")
        stored = spark.read.parquet(f"{tmp_path}/docs")
        expected = [(r.doc_id, r.source) for r in sorted(mix_sources(stored).collect(), key=lambda r: r.position)]
        found = corpus_pipeline.mixed(spark, stored, FOLDER)
        assert [(r.doc_id, r.source) for r in found.collect()] == expected
        assert sorted(found.collect(), key=repr) == sorted(stored.select(*found.columns).collect(), key=repr)
        # The order holds over the files, stored by whoever calls the stage or not.
        found.write.mode("overwrite").parquet(f"{tmp_path}/mixed")
        once, twice = (corpus_pipeline.sharded(spark, t, FOLDER).collect() for t in (spark.read.parquet(f"{tmp_path}/mixed"), found))
        assert sorted(once, key=repr) == sorted(twice, key=repr) and len(once) == 400
