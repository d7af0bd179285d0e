"""Results do not depend on how rows fall into Arrow batches and partitions."""

import pytest
import test_decontam
import test_lines
import test_neardup
import test_substring

from millrace.llm import decontam, lines, neardup, substring

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture(params=[(1, 1), (2, 3), (7, 2)])
def small(request, spark):
    was = spark.conf.get(KEY)
    spark.conf.set(KEY, str(request.param[0]))
    yield request.param[1]
    spark.conf.set(KEY, was)


def test_substring_(spark, small):
    docs = test_substring.corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(small)
    got = {(r.doc_id, r.kind, r.first_word, r.last_word) for r in substring.spans(df, window=20, gram=5).collect()}
    assert got == test_substring.brute(docs, 20)


def test_lines_(spark, small):
    docs = test_lines.corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(small)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup(df, tally=True, shard_lines=16, probes=20).collect()}
    assert got == test_lines.brute(docs)


def test_lines_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lines, "PROBES", 20)
    docs = test_lines.corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup(df, tally=True, shard_lines=30).collect()}
    assert got == test_lines.brute(docs)


def test_decontam_(spark, small):
    docs, items = test_decontam.corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(small)
    known = decontam.slices(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert sorted((r.doc_id, r.first_word, r.last_word) for r in decontam.spans(df, known).collect()) == test_decontam.brute(docs, items)


def test_partners_verified_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TOGETHER", 5)
    base = test_neardup.prose(3, 150)
    docs = [(k, test_neardup.near(base, k, 0.02)) for k in range(60)]
    got = neardup.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 60 and {r.group_id for r in got} == {0}
