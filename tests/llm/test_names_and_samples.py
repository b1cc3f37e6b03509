"""Columns of any name, and training samples that one large text cannot empty."""

import warnings

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import chat_format, exact_dedup, labels, quality_classifier, toxicity

BODY = "\n".join(f"one{i} two{i} three{i} four{i}" for i in range(20))
ODD = ["a`b", "``", "x.y`z", "label", "quality", "toxic", "bag", "score", "held_out", "predicted", "sums", "tokens", "total", "most"]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_learned_scores_ignore_columns_of_their_own_names(spark, kind):
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    named = plain.select("*", *[F.lit("7" if kind == "int" else "spam").cast(kind).alias(c) for c in ODD])
    for score in (toxicity.score_toxicity, quality_classifier.score_quality):
        want = sorted((r.doc_id, r.score) for r in score(plain, marks).collect())
        got = sorted((r.doc_id, r.score) for r in score(named, marks).collect())
        assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-6)


def test_chats_with_clashing_names(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    named = turns.select("*", *[F.lit(1).alias(c) for c in ("formatted", "segments", "state", "t", "r", "loss", "a`b", "turns", "n_turns")])
    want = sorted(repr(r) for r in chat_format.format_chats(turns).collect())
    assert sorted(repr(r) for r in chat_format.format_chats(named).collect()) == want != []


def test_stages_keep_columns_with_backticks(spark):
    docs = spark.createDataFrame([(1, BODY), (2, BODY), (3, BODY + " x")], "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(7).cast("long").alias("n_chars"), *[F.lit(k).alias(c) for k, c in enumerate(ODD)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() > 0
        if name != "packing":
            assert out.columns == docs.columns, name
            assert all([r[len(docs.columns) - len(ODD) + k] for k in range(len(ODD))] == list(range(len(ODD))) for r in out.collect())


def test_one_large_text_does_not_empty_the_sample(spark):
    docs = spark.createDataFrame([(i, "v" * 10) for i in range(1, 60)] + [(0, "w" * 4000)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    for seed in range(3):  # whatever the order
        got = labels.training_texts(docs, lab, "quality", 60, seed=seed, most_bytes=2000).collect()
        assert 0 < len(got) and 0 not in {r.doc_id for r in got} and sum(len(r.text) for r in got) <= 2000
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert labels.training_texts(docs, lab, "quality", 60, most_bytes=100).count() == 0
    assert any("small enough" in str(w.message) for w in said)


@pytest.mark.parametrize("fanout", [2, 3])
def test_filters_of_the_merge_index_change_the_work_and_not_the_rows(spark, tmp_path, fanout):
    batch = lambda k: spark.range(400 * k, 400 * k + 400).select(F.unhex(F.sha2(F.when(F.col("id") % 40 == 7, "same").otherwise((F.col("id") % 1500).cast("string")), 256)).alias("digest"), "id")
    key = lambda i: "same" if i % 40 == 7 else str(i % 1500)
    names = [[key(i) for i in range(400 * k, 400 * k + 400)] for k in range(5)]
    want = [len({x for x in own if own.count(x) > 1 or any(x in b for b in names[:k])}) for k, own in enumerate(names)]
    seen, rows, asked = [], [], []
    for filters in (True, False):
        index = exact_dedup.MergeIndex(spark, f"file://{tmp_path}/{filters}", fanout=fanout, filters=filters)
        seen.append([sorted(bytes(r.digest) for r in index.insert(batch(k)).collect()) for k in range(5)])
        assert sum(map(len, index.levels)) < 5 and len(list((tmp_path / str(filters)).iterdir())) == sum(map(len, index.levels))  # merged by level, old runs gone
        rows.append(sorted(tuple(r) for r in index.compact().collect()))
        asked.append((index.asked, index.askable))
    assert seen[0] == seen[1] and rows[0] == rows[1] and [len(x) for x in seen[0]] == want
    assert asked[0][0] < asked[0][1] / 3 and asked[1][0] == asked[1][1] == asked[0][1]


def test_exact_groups_in_any_number_of_batches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 5000))
    want = sorted(map(tuple, exact_dedup.exact_groups(docs, batches=1).collect()))
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, batches=5).collect())) == want
    assert sum(r[3] for r in want) == docs.select("text").distinct().count()
