"""Benchmark decontamination with an FM-index for each training shard (operator 2).

Test phrases are all runs of PHRASE words of the benchmark's items, and the whole of a shorter item
that has MIN_WORDS at least. A shard is some SHARD_BYTES of documents that a task holds. Its index is
over words: the words of the phrases are the alphabet; any other word, and the end of a document, is
a terminator of its own that no phrase can contain. The suffixes are sorted by prefix doubling; the
Burrows-Wheeler transform goes into a wavelet matrix, whose ranks drive the backward search of all
phrases at once. Occurrences are located by walking back to sampled suffix positions. What is found
is merged into removal spans.

The benchmark is sent to the tasks in slices of SLICE_BYTES of text, with a pass over the documents
for each, so that no broadcast grows with it. All passes search the unchanged texts; the spans of all
slices are merged before anything is cut, so that results do not depend on the slices.

Defined results: null and empty texts have no spans; a longer text than SHARD_BYTES is a shard by itself;
phrases that overlap or touch give one span; ids are whole numbers; rows that share a doc_id are searched one by one
and their spans reported together; a null doc_id is reported as null; items without MIN_WORDS words
are no phrases, and repeated items count once; an empty benchmark finds nothing; other columns are passed
on or left alone; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

PHRASE, MIN_WORDS = 13, 6
SHARD_BYTES = 4 << 20
#: Every so many positions of a shard's text the suffix array is kept.
SAMPLE = 16
SLICE_BYTES = 16 << 20


@dataclass
class Phrases:
    """Sorted word hashes, and the phrases as word numbers from 1, at the right of rows that 0 fills."""

    vocabulary: np.ndarray
    rows: np.ndarray


def phrases(column: pa.Array, size: int = PHRASE, least: int = MIN_WORDS) -> Phrases:
    w = common.words(column)
    vocabulary, which = np.unique(w.hashes(), return_inverse=True)
    which, out = which.astype(np.int32) + 1, []
    for k in range(least, size + 1):
        first = w.first[:-1][np.diff(w.first) == k] if k < size else None
        if first is None:
            count = np.maximum(np.diff(w.first) - size + 1, 0)
            edge = np.cumsum(count)
            first = np.repeat(w.first[:-1] - edge + count, count) + np.arange(count.sum())
        row = np.zeros((len(first), size), np.int32)
        row[:, size - k :] = which[first[:, None] + np.arange(k)]
        out.append(row)
    return Phrases(vocabulary, np.unique(np.concatenate(out), axis=0))


class Index:
    """FM-index of symbols 1 to top - 1; every 0 is a terminator of its own. The last symbol must be 0."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        self.text_size = n = len(text)
        end = np.flatnonzero(text == 0)
        self.ends = z = len(end)
        suffix = self._sort(text, end, z)
        symbols = np.bincount(text, minlength=top + 1)
        symbols[0] = z
        self.begin = np.concatenate([[0], np.cumsum(symbols)])[: top + 2]
        before = np.where(suffix > 0, text[suffix - 1], 0)
        self.kept = (before == 0) | (suffix % sample == 0)
        self.sampled = suffix[self.kept]
        self.nth = np.cumsum(self.kept) - 1
        self.bits = max(1, int(top).bit_length())
        self.before = before
        self.zeros, self.split = [], []
        level = before
        node = np.zeros(top + 1, np.int64)
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1 == 1
            zero = np.zeros(n + 1, np.int32)
            np.cumsum(~one, out=zero[1:])
            self.zeros.append(zero)
            self.split.append(int(zero[-1]))
            level = np.concatenate([level[~one], level[one]])
            high = (np.arange(top + 1) >> b) & 1 == 1
            node = np.where(high, zero[-1] + node - zero[node], zero[node])
        self.node = node

    @staticmethod
    def _sort(text: np.ndarray, end: np.ndarray, z: int) -> np.ndarray:
        """The suffix array."""
        n = len(text)
        value = text.astype(np.int64) + (z - 1)
        value[end] = np.arange(z)
        rank = value.copy()
        who = np.flatnonzero(text)
        width = int(value.max(initial=1)).bit_length()
        depth = max(1, 62 // width)
        key = np.zeros(len(who), np.int64)
        ended = np.zeros(len(who), bool)  # what follows a terminator does not count
        for d in range(depth):
            v = value[np.minimum(who + d, n - 1)]
            key = (key << width) | np.where(ended, 0, v)
            ended |= v < z
        suffix = np.empty(n, np.int64)
        suffix[:z] = end
        order = np.argsort(key, kind="stable")
        who, key = who[order], key[order]
        place = np.arange(len(who)) + z
        suffix[z:] = who
        while len(who):
            new = np.append(True, key[1:] != key[:-1])
            head = place[np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))]
            rank[who] = head
            alone = new & np.append(new[1:], True)
            who, place, head = who[~alone], place[~alone], head[~alone]
            key = (head << 32) | rank[np.minimum(who + depth, n - 1)]
            order = np.argsort(key, kind="stable")
            who, key = who[order], key[order]
            suffix[place] = who
            depth *= 2
        return suffix

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        at = row
        for j, b in enumerate(range(self.bits - 1, -1, -1)):
            zero = self.zeros[j][at]
            at = np.where((symbol >> b) & 1 == 1, self.split[j] + at - zero, zero)
        return at - self.node[symbol]

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, first and last + 1 suffix-array row of each phrase that occurs."""
        which = np.arange(len(rows))
        last = rows[:, -1]
        lo, hi = self.begin[last], self.begin[last + 1]
        for j in range(rows.shape[1] - 2, -1, -1):
            some = hi > lo
            which, lo, hi = which[some], lo[some], hi[some]
            symbol = rows[which, j]
            go = np.flatnonzero(symbol)
            c = symbol[go]
            both = self.rank(np.concatenate([c, c]), np.concatenate([lo[go], hi[go]]))
            lo[go], hi[go] = self.begin[c] + both[: len(c)], self.begin[c] + both[len(c) :]
        some = hi > lo
        return which[some], lo[some], hi[some]

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, steps = np.zeros(len(row), np.int64), 0
        left = np.arange(len(row))
        while len(left):
            hit = self.kept[row]
            out[left[hit]] = self.sampled[self.nth[row[hit]]] + steps
            left, row = left[~hit], row[~hit]
            symbol = self.before[row]
            row = self.begin[symbol] + self.rank(symbol, row)
            steps += 1
        return out


def find(column: pa.Array, known: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans of words that are phrases: first, last + 1 (numbers within the text) and text number."""
    none = np.zeros(0, np.int64)
    if not len(known.rows):
        return none, none, none
    w = common.words(column)
    h = w.hashes()
    at = np.minimum(np.searchsorted(known.vocabulary, h), len(known.vocabulary) - 1)
    symbol = np.where(known.vocabulary[at] == h, at + 1, 0).astype(np.int64)
    docs = len(w.first) - 1
    text = np.zeros(len(symbol) + docs, np.int64)  # a terminator after each document
    text[np.arange(len(symbol)) + w.doc] = symbol
    index = Index(text, len(known.vocabulary))
    which, lo, hi = index.search(known.rows)
    if not len(which):
        return none, none, none
    count = hi - lo
    edge = np.cumsum(count)
    place = index.locate(np.repeat(lo - edge + count, count) + np.arange(edge[-1]))
    size = np.repeat((known.rows[which] > 0).sum(axis=1), count)
    start = w.first + np.arange(docs + 1)
    doc = np.searchsorted(start, place, side="right") - 1
    return common.runs(place - start[doc], place - start[doc] + size, doc)


def slices(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = PHRASE, least: int = MIN_WORDS, most: int = SLICE_BYTES) -> list[Phrases]:
    """The phrases of the benchmark, in slices of about `most` bytes of text."""
    items = common.only(benchmark, id_col, text_col).where("text is not null")
    parts = max(1, -(-(items.select(F.sum(F.octet_length("text"))).first()[0] or 0) // most))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    return [phrases(common.as_array(items.where(part == p).select("text").toArrow().column(0)), size, least) for p in range(parts)]


def _merged(texts: pa.Array, known: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [np.concatenate(x) for x in zip(*(find(texts, k) for k in known))]
    return common.runs(*parts)


def _found(docs: DataFrame, known: list[Phrases], id_col: str, text_col: str) -> DataFrame:
    """doc_id, a, b: the spans of every slice, which may overlap or touch those of other slices."""
    found = None
    for k in known:
        shared = docs.sparkSession.sparkContext.broadcast(k)  # of SLICE_BYTES of text

        def fn(batch, shared=shared):
            for lo, hi in common.blocks(batch.column(1), SHARD_BYTES):
                a, b, doc = find(common.as_array(batch.column(1)).slice(lo, hi - lo), shared.value)
                if len(a):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(a), pa.array(b)], names=["doc_id", "a", "b"])

        part = common.only(docs, id_col, text_col).mapInArrow(common.flat_map(fn), "doc_id long, a long, b long")
        found = part if found is None else found.union(part)
    return found


def spans(docs: DataFrame, known: list[Phrases], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_word, last_word and n_words of each removal span; words are numbered from 0."""
    found = _found(docs, known, id_col, text_col)
    if len(known) > 1:  # spans of different slices may touch
        found = found.groupBy("doc_id").applyInArrow(_join, "doc_id long, a long, b long")
    return found.select("doc_id", F.col("a").alias("first_word"), (F.col("b") - 1).alias("last_word"), (F.col("b") - F.col("a")).alias("n_words"))


def _join(key, table):
    a, b, _ = common.runs(table.column("a").to_numpy(), table.column("b").to_numpy(), np.zeros(table.num_rows, np.int64))
    return pa.table({"doc_id": pa.array([key[0].as_py()] * len(a), pa.int64()), "a": a, "b": b})


def clean(docs: DataFrame, known: list[Phrases], text_col: str = "text") -> DataFrame:
    """docs without the spans, n_chars made right where there is one; all rows and columns stay."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(known[0]) if len(known) == 1 else None
    if shared is None:
        docs = _spanned(docs, known, text_col)

    def fn(batch):
        for lo, hi in common.blocks(batch.column(at), SHARD_BYTES):
            part = batch.slice(lo, hi - lo)
            texts = common.as_array(part.column(at))
            if shared is not None:
                a, b, doc = find(texts, shared.value)
            else:
                places = part.column(len(names))
                a, b = (pc.struct_field(places.flatten(), c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
                a, b, doc = common.runs(a, b, np.repeat(np.arange(hi - lo), np.asarray(pc.fill_null(pc.list_value_length(places), 0))))
            columns = [part.column(i) for i in range(len(names))]
            if len(a):
                columns[at] = common.as_array(common.cut_words(texts, doc, a, b))
                if "n_chars" in names and (i := names.index("n_chars")) != at:
                    columns[i] = pc.cast(pc.utf8_length(columns[at]), columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(common.flat_map(fn), schema)


def _spanned(docs: DataFrame, known: list[Phrases], text_col: str) -> DataFrame:
    """docs with one more column, the spans of all slices in the row's text."""
    keyed, row = common.numbered(docs)
    spans_at = common.free("__spans", keyed.columns)
    places = _found(keyed, known, row, text_col).groupBy(F.col("doc_id").alias(spans_at + "_row")).agg(F.collect_list(F.struct("a", "b")).alias(spans_at))
    return keyed.join(places, keyed[row] == places[spans_at + "_row"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], spans_at)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removal spans of the whole documents table against the whole benchmark."""
    return spans(common.load(spark, sf_dir, "documents"), slices(common.load(spark, sf_dir, "benchmark")))


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT array_to_string(w[i:i + {PHRASE - 1}], ' ') AS t, CAST({PHRASE} AS BIGINT) AS k
  FROM b, unnest(range(1, len(w) - {PHRASE - 2})) AS u(i)
  UNION
  SELECT DISTINCT array_to_string(w, ' '), CAST(len(w) AS BIGINT) FROM b WHERE len(w) BETWEEN {MIN_WORDS} AND {PHRASE - 1}
), s AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM d, (SELECT DISTINCT k FROM p), unnest(range(1, len(w) - k + 2)) AS u(i)
), h AS (
  SELECT DISTINCT doc_id, i - 1 AS a, i - 1 + k AS z FROM s SEMI JOIN p USING (t, k)
), m AS (
  SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h
), g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, z) AS island FROM m
)
SELECT doc_id, CAST(min(a) AS BIGINT) AS first_word, CAST(max(z) - 1 AS BIGINT) AS last_word, CAST(max(z) - min(a) AS BIGINT) AS n_words
FROM g GROUP BY doc_id, island
"""
