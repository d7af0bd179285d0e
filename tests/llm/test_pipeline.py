"""Every stage on its own input against a brute-force version, and the whole on odd tables."""


import duckdb
import pytest
from conftest import ODD, odd_rows
from test_bpe import known  # noqa: F401
from test_decontam import brute as brute_spans
from test_decontam import words
from test_lines import brute as brute_lines
from test_neardup import jaccards

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm import neardup

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before and after every stage, over sf0.001."""
    folder, docs, out = str(tmp_path_factory.mktemp("steps")), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append((name, before, docs))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(steps):
    assert [n for n, _, _ in steps] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for _, _, after in steps[:-1]:
        assert after.columns == COLUMNS
        assert all(r.n_chars == len(r.text) for r in after.collect())


def test_toxicity_stage(steps):
    _, before, after = steps[0]
    toxic = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE toxic = 1").fetchall()}
    clean = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE toxic = 0").fetchall()}
    kept = {i for i, _ in pairs(after)}
    assert len(kept & clean) >= 0.97 * len(clean) and len(kept & toxic) <= 0.3 * len(toxic)
    assert set(pairs(after)) <= set(pairs(before))


def test_line_stage(steps):
    _, before, after = steps[1]
    want = brute_lines(pairs(before))
    assert dict(pairs(after)) == {i: t for i, (t, _, lost) in want.items() if not lost or t.strip()}


def test_near_stage(steps):
    _, before, after = steps[2]
    docs, kept = pairs(before), {i for i, _ in pairs(after)}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), j in jaccards([d for d in docs if words(d[1])]).items():
        if j >= neardup.THRESHOLD:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {i for i in root if find(i) == i}
    assert want <= kept and len(kept - want) <= 0.1 * (len(docs) - len(want))
    assert set(pairs(after)) <= set(docs)


def test_decontamination_stage(steps):
    _, before, after = steps[3]
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    docs, got = pairs(before), dict(pairs(after))
    spans = brute_spans(docs, items)
    for i, t in docs:
        gone = [(a, b) for d, a, b in spans if d == i]
        assert words(got[i]) == [w for k, w in enumerate(words(t)) if not any(a <= k <= b for a, b in gone)]
        assert gone or got[i] == t


def test_token_stage(steps, known):  # noqa: F811
    _, before, after = steps[4]
    texts = dict(pairs(before))
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert r.round_trip and r.token_ids == known.encode_ordinary(texts[r.doc_id])


def test_run_gives_the_last_stage(spark, steps):
    got = entry.queries()["pipeline"](spark, SF)
    key = lambda df: sorted((r.doc_id, tuple(r.token_ids)) for r in df.collect())
    assert key(got) == key(steps[-1][2])


def test_odd_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(odd_rows(), ODD).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    assert corpus_pipeline.run(spark, folder).count() == docs.count() > 0
    none = f"{folder}/none"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{none}/{t}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
