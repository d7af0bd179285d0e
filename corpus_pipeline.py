"""From raw documents to token ids: five operators of millrace.llm, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next one. All but the last return the columns of documents, n_chars made right
where the text changed. What nulls, empty and very long texts, ties, repeated rows, empty tables and
columns of any other name give is stated by each operator's module; the stages add:

- a document with a null or empty text passes every stage (as long as the classifier does not reject
  what has no words), with null or no token ids at the end;
- rows that share a doc_id, or have none, are judged for toxicity one by one, keep one occurrence of every
  line, and stay or go together as one document in near-dedup (all without an id stay);
- an empty table passes as an empty one; without labels nothing is toxic, without benchmark nothing is cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, common, decontam, lines, neardup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.keep(docs, toxicity.train(docs, common.load(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line stays at its first occurrence only; documents of which nothing is left go."""
    return lines.dedup(docs, emptied=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; all documents stay."""
    return decontam.clean(docs, decontam.slices(common.load(spark, sf_dir, "benchmark")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and round_trip."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenize),
]
#: SQL can't express the classifier chain; tests hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, docs = docs, common.stash(out)
        common.unstash(before, out)  # the stage's own tables as well; those of the caller are no stashes
    return docs
