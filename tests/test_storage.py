"""What long jobs leave on the disk, and work done in slices."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from clauseweave.operators import attribution
from clauseweave.operators import clusters as C
from clauseweave.operators.keyed import first_k_per_key
from clauseweave.session import cut_lineage
from clauseweave.sources import filings


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_stored_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    stored = cut_lineage(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert stored.count() == 7


def test_keywords_in_slices(spark, monkeypatch):
    texts = [(i % 3 - 1, None if i == 5 else f"alpha w{i % 4} beta w{i % 7} Gamma alpha {'delta ' * (i % 5)}") for i in range(60)]
    rows = spark.createDataFrame(texts, "cluster_id int, clause_text string")

    def ranked(**options):
        found = C.cluster_keywords(rows, stop_words=["gamma"], **options).collect()
        return {(r.cluster_id, r["rank"]): (r.term, round(r.weight, 9)) for r in found}

    whole, few = ranked(), ranked(vocabulary_size=4)
    monkeypatch.setattr(C, "SLICE_CHARS", 800)
    assert ranked() == whole and ranked(vocabulary_size=4) == few
    assert {c for c, _ in whole} == {0, 1} and len(whole) == 20
    assert len({t for t, _ in few.values()}) == 4


def test_keywords_need_sums_of_frequent_terms_only(spark, monkeypatch):
    texts = [(i % 3 - 1, f"c{i % 3} d{i % 3} c{i % 3} d{i % 3} only{i} {'shared' if i % 2 else 'often'}") for i in range(90)] + [(7, "lone words"), (None, "none at all")]
    rows = spark.createDataFrame(texts, "cluster_id int, clause_text string")
    summed = []

    def watched(df, keys, order, k, rank_col):
        summed.append({r.term for r in df.select("term").collect()})
        return first_k_per_key(df, keys, order, k, rank_col)

    def ranked(k, frequent):
        summed.clear()
        monkeypatch.setattr(C, "FREQUENT_ROWS", frequent, raising=False)
        found = C.cluster_keywords(rows.where("cluster_id < 7 OR cluster_id IS NULL") if k == 2 else rows, stop_words=[], per_cluster=k).collect()
        return {(r.cluster_id, r["rank"]): (r.term, round(r.weight, 9)) for r in found}

    monkeypatch.setattr(C, "first_k_per_key", watched)
    whole = ranked(2, 10**9)
    assert ranked(2, 30) == whole and len(whole) == 4
    assert not any(t.startswith("only") for terms in summed for t in terms)
    # A cluster of one row, and one that lacks keywords, need all terms.
    for k in (3, 500):
        assert ranked(k, 30) == ranked(k, 10**9)
        assert {c for c, _ in ranked(k, 30)} == {0, 1, 7}


def test_masked_copies_are_not_stored(spark, monkeypatch):
    stored = []

    def watched(df, **options):
        stored.append(df.columns)
        return cut_lineage(df, **options)

    monkeypatch.setattr(attribution, "cut_lineage", watched)
    rows = spark.createDataFrame([(1, "pay the fee"), (2, "pay the fee"), (3, None), (4, "fee")], "clause_id int, clause_text string")
    # Equal texts are scored once, and get their words in every row.
    seen = []

    def score(table):
        seen.append(table.count())
        return table.withColumn("score", F.size(F.filter(F.split("text", " "), lambda w: w == "fee")).cast("double"))

    found = {r.clause_id: [tuple(w) for w in r.top_words] for r in attribution.with_word_attribution(rows, score).collect()}
    assert found == {1: [("fee", 1.0), ("pay", 0.0), ("the", 0.0)], 2: [("fee", 1.0), ("pay", 0.0), ("the", 0.0)], 3: [], 4: [("fee", 1.0)]}
    assert seen == [4 + 2]
    assert not any("text" in columns for columns in stored)


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(1500):
        (tmp_path / f"{i}.txt").write_text(f"text {i}\r\n")
    read = filings.read_filings(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= filings.SPLITS_A_CORE * spark.sparkContext.defaultParallelism
    assert {(r.file_name, r.text) for r in read.collect()} == {(f"{i}.txt", f"text {i}\n") for i in range(1500)}


def test_masked_copies_join_segments(spark):
    """The copies are those of the words one by one, and no copy is made from all words."""
    texts = {n: "  ".join(f"w{i}" for i in range(n)) + " \n" for n in (0, 1, 2, 3, 62, 63, 64, 126, 127, 200)}
    rows = spark.createDataFrame(list(texts.items()), "n int, text string")
    copies = attribution.masked_copies(rows, "n", "text", 64)
    expected = set()
    for n, text in texts.items():
        words = text.split()
        run = -(-n // 63)
        count = (n - 1) // run + 1 if n else 0
        for mask in range(1 << count.bit_length() if n else 0):
            kept = [(mask & (i // run + 1)).bit_count() % 2 == 0 for i in range(n)]
            expected.add((n, mask, " ".join(w if k else "[MASK]" for w, k in zip(words, kept, strict=True))))
    found = [tuple(r) for r in copies.collect()]
    assert len(found) == len(expected) and set(found) == expected
    above, generate, _ = copies._jdf.queryExecution().optimizedPlan().toString().partition("Generate")
    assert generate and "_words" not in above
