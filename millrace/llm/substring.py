"""Substring dedup with a count-min prefilter (operator 4).

A passage of WINDOW words that occurs more than once, in any documents, is repeated. Every window has
an anchor, the least of the GRAM-word hashes inside it; equal windows have equal anchors, so an
anchor's count is never below the count of its windows. Pass 1 sketches how often anchors occur: each
partition counts into the cells of a count-min sketch, the partial counts are merged shard by shard,
and the cells that reach two are kept. The sketch is as wide as CELLS times the anchors expected. Pass
2 sends on only windows whose anchor is estimated to occur twice or more, in rows of one anchor with
its windows, groups them exactly by anchor and window hash, and merges what is repeated into spans. The
sketch only overestimates, so no repeated window is lost. Windows are told apart by 128 bits, the anchor's
64 and the window's, so that of N different windows N * N / 2^129 pairs are expected to be taken for one
(10^13 windows: never).

Up to BROADCAST_BYTES the cells that reach two go to every task. Beyond that the anchors' cells are
joined with them, and each document gets its own list.

Defined results: null, empty and short texts have no windows; a text of any length is read whole; ids are
whole numbers; rows that share a doc_id are different texts, and their spans are reported together; a null doc_id counts as the least; a window repeated
inside one document counts as well; the first occurrence (least doc_id, then topmost) is not to be
removed; other columns are passed on or left alone; an empty table has no spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

WINDOW, GRAM = 50, 8
#: Cells of a sketch row for each anchor expected, and rows. A narrower sketch would only let more through.
CELLS, DEPTH = 8, 2
SHARD_BITS = 22
BROADCAST_BYTES = 64 << 20
_NULL = -(1 << 63)
_SALT = common.mix(np.arange(DEPTH, dtype=np.uint64) + np.uint64(0x50B5))


def _slide(x: np.ndarray, size: int, take) -> np.ndarray:
    """take (minimum or maximum) over each run of `size`; the last size - 1 are not to be used."""
    have, out = 1, x
    while have < size:
        by = min(have, size - have)
        out = np.concatenate([take(out[:-by], out[by:]), out[-by:]]) if by < len(out) else out
        have += by
    return out


def anchors(column: pa.Array, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: anchor, hash, number of the first word within the text, and text; in order."""
    w = common.words(column)
    h = w.hashes()
    full, at, firsts = common.gram_table(h, w.first, window)
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    if not len(at):
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), doc
    least = _slide(common.grams(h, gram), window - gram + 1, np.minimum)[at]
    return least, full[: len(at)], at - w.first[doc], doc


def chosen(column: pa.Array, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchors of some texts, once for every place at which they stand."""
    w = common.words(column)
    h = w.hashes()
    _, at, _ = common.gram_table(h, w.first, window)
    if not len(at):
        return np.zeros(0, np.uint64)
    span = window - gram + 1
    g = common.grams(h, gram)
    least = np.zeros(len(h) + span, np.uint64)
    least[at + span - 1] = _slide(g, span, np.minimum)[at]  # window i stands at i + span - 1
    most = _slide(least, span, np.maximum)[: len(h)]  # over the windows that cover a place
    return g[(most == g) & (most > 0)]


def cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (common.mix(anchor ^ _SALT[row]) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, bits: int, window: int, gram: int) -> DataFrame:
    """row, cell: the cells of the merged sketch that reach two; docs has columns id and text."""
    low = min(bits, max(SHARD_BITS, bits - 14))

    def count(batch):
        found = [chosen(common.as_array(batch.column(1)).slice(a, b - a), window, gram) for a, b in common.blocks(batch.column(1))]
        anchor = np.concatenate(found)
        rows, shards, inside, twice = [], [], [], []
        for row in range(DEPTH):
            cell, n = np.unique(cells(anchor, row, bits), return_counts=True)
            shard = cell >> low
            edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
            for a, b in zip(edge, [*edge[1:], len(shard)]):
                rows.append(row), shards.append(int(shard[a]))
                inside.append((cell[a:b] & ((1 << low) - 1)).astype(np.uint32).tobytes())
                twice.append(np.packbits(n[a:b] > 1).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(shards, pa.int32()), pa.array(inside, pa.binary()), pa.array(twice, pa.binary())], names=["row", "shard", "cells", "twice"])

    def merge(key, table):
        total = np.zeros(1 << low, np.uint8)
        for inside, twice in zip(table.column("cells").to_pylist(), table.column("twice").to_pylist()):
            c = np.frombuffer(inside, np.uint32)
            total[c] = np.minimum(total[c] + 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(c)), 2)
        cell = np.flatnonzero(total > 1) + (np.int64(key[1].as_py()) << low)
        return pa.table({"row": pa.array(np.full(len(cell), key[0].as_py(), np.int32)), "cell": pa.array(cell)})

    parts = docs.mapInArrow(common.flat_map(count), "row int, shard int, cells binary, twice binary")
    return parts.groupBy("row", "shard").applyInArrow(merge, "row int, cell long")


def _candidates(batch: pa.RecordBatch, often, window: int, gram: int):
    """Rows of one anchor occurrence with its windows: anchor, id, first word, windows' hashes and places."""
    for lo, hi in common.blocks(batch.column(1)):
        least, full, pos, doc = anchors(common.as_array(batch.column(1)).slice(lo, hi - lo), window, gram)
        ok = np.flatnonzero(often(least, doc + lo))
        if not len(ok):
            continue
        least, full, pos, doc = least[ok], full[ok], pos[ok], doc[ok]
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)]))
        size = np.diff(np.append(new, len(least)))
        offsets = pa.array((np.append(new, len(least)) * 8).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(least[new].view(np.int64)), batch.column(0).slice(lo, hi - lo).take(pa.array(doc[new])), pa.array(pos[new].astype(np.int32)), pa.array(size.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(new), [None, offsets.buffers()[1], pa.py_buffer(full.tobytes())])],
            names=["anchor", "id", "pos", "n", "hashes"],
        )


class _Seen:
    """The windows met so far of the anchor that the last batch ended in, each with its first place."""

    def __init__(self):
        self.anchor, self.h = None, np.zeros(0, np.uint64)
        self.id, self.pos, self.told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)


def _by(h: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The order by window hash and anchor; the order of places is kept within each."""
    order = np.argsort(h, kind="stable")
    clash = (h[order][1:] == h[order][:-1]) & (anchor[order][1:] != anchor[order][:-1])
    return np.lexsort((anchor, h)) if clash.any() else order  # rows of one hash all but always have one anchor


def _repeats(batches):
    """Runs of repeated windows, from rows sorted by anchor, id and pos: id, kind (0 all, 1 not the first), first and last + 1 window.

    What is held between batches is one place for each different window of one anchor, however often it occurs.
    """
    seen = _Seen()
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, n = batch.column("anchor").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        pos = batch.column("pos").to_numpy()[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        ids = pc.fill_null(batch.column("id"), _NULL).to_numpy()[row]
        h = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64)
        k = len(seen.h) if seen.anchor == anchor[0] else 0  # else nothing here can meet them again
        key = np.concatenate([np.full(k, anchor[0]), anchor[row]])
        h, ids, pos = np.concatenate([seen.h[:k], h]), np.concatenate([seen.id[:k], ids]), np.concatenate([seen.pos[:k], pos])
        row = np.concatenate([np.full(k, -1), row])
        order = _by(h, key)
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1]))
        last = np.append(new[1:], True)
        many, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
        many[order], later[order] = ~(new & last), ~new
        tell = many.copy()
        tell[:k] &= ~seen.told[:k]
        later[:k] = False
        for kind, flag in ((0, tell), (1, later)):
            at = np.flatnonzero(flag)
            if len(at):
                near = (row[at][1:] == row[at][:-1]) & (at[1:] == at[:-1] + 1) & (row[at][1:] >= 0)
                cut = np.flatnonzero(np.append(True, ~near))
                a, b = at[cut], at[np.append(cut[1:], len(at)) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a], mask=ids[a] == _NULL), pa.array(np.full(len(a), kind, np.int32)), pa.array(pos[a].astype(np.int32)), pa.array(pos[b].astype(np.int32) + 1)], names=["id", "kind", "a", "b"])
        first = order[new]  # the first place of each window
        first = first[np.where(row[first] < 0, anchor[0], anchor[np.maximum(row[first], 0)]) == anchor[-1]]
        seen.anchor, seen.h, seen.id, seen.pos = anchor[-1], h[first], ids[first], pos[first]
        seen.told = many[first]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, kind, first_word, last_word and n_words.

    kind is `repeat` for all that is repeated, `remove` for what is repeated but not a first occurrence.
    """
    spark = docs.sparkSession
    rows = common.only(docs, id_col, text_col)
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = size / 5 * 2 / (window - gram + 2)
    bits = int(min(40, max(12, np.ceil(np.log2(CELLS * expected + 1)))))
    often = common.stash(sketch(rows, bits, window, gram))
    if often.count() * 8 <= limit:
        table = often.toArrow()
        known = [np.sort(table.filter(pc.equal(table.column("row"), r)).column("cell").to_numpy()) for r in range(DEPTH)]
        shared = spark.sparkContext.broadcast(known)
        common.unstash(often)

        def fn(batch):
            def hit(least, doc):
                out = np.ones(len(least), bool)
                for r, k in enumerate(shared.value):
                    c = cells(least, r, bits)
                    out &= k[np.minimum(np.searchsorted(k, c), len(k) - 1)] == c if len(k) else False
                return out

            yield from _candidates(batch, hit, window, gram)

    else:
        rows = _with_cells(rows, often, bits, window, gram)

        def fn(batch):
            lists = batch.column(2)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            own = np.unique(common.mix(lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)) ^ common.mix(np.repeat(np.arange(len(size)), size).astype(np.uint64) + np.uint64(1)))

            def hit(least, doc):
                c = common.mix(cells(least, 0, bits).astype(np.uint64)) ^ common.mix(doc.astype(np.uint64) + np.uint64(1))
                return own[np.minimum(np.searchsorted(own, c), len(own) - 1)] == c if len(own) else np.zeros(len(c), bool)

            yield from _candidates(batch, hit, window, gram)

    found = rows.mapInArrow(common.flat_map(fn), "anchor long, id long, pos int, n int, hashes binary")
    runs = found.repartition(F.col("anchor")).sortWithinPartitions("anchor", "id", "pos").mapInArrow(_repeats, "id long, kind int, a int, b int")

    def merge(batches):
        for table in common.whole_groups(batches):
            ids = pa.concat_arrays(table.column("id").chunks)
            code = np.cumsum(np.append(False, pc.fill_null(ids, _NULL).to_numpy()[1:] != pc.fill_null(ids, _NULL).to_numpy()[:-1])) * 2 + table.column("kind").to_numpy()
            a, b, group = common.runs(table.column("a").to_numpy().astype(np.int64), table.column("b").to_numpy() + np.int64(window - 1), code)
            first = np.searchsorted(code // 2, group // 2)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(np.where(group % 2, "remove", "repeat")), pa.array(a), pa.array(b - 1), pa.array(b - a)], names=["doc_id", "kind", "first_word", "last_word", "n_words"])

    return runs.repartition(F.col("id")).sortWithinPartitions("id").mapInArrow(merge, "doc_id long, kind string, first_word long, last_word long, n_words long")


def _with_cells(rows: DataFrame, often: DataFrame, bits: int, window: int, gram: int) -> DataFrame:
    """id, text and the first-row cells of the text's anchors that reach two in all rows, found by joins."""

    def emit(batch):
        for lo, hi in common.blocks(batch.column(1)):
            least, _, _, doc = anchors(common.as_array(batch.column(1)).slice(lo, hi - lo), window, gram)
            if len(least):
                at = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).fill_null(_NULL).take(pa.array(doc[at])), *(pa.array(cells(least[at], r, bits)) for r in range(DEPTH))], names=["id", *(f"c{r}" for r in range(DEPTH))])

    hits = rows.mapInArrow(common.flat_map(emit), "id long, " + ", ".join(f"c{r} long" for r in range(DEPTH)))
    for r in range(DEPTH):
        hits = hits.join(often.where(F.col("row") == r).select(F.col("cell").alias(f"c{r}")), f"c{r}", "left_semi")
    lists = hits.groupBy(F.col("id").alias("k")).agg(F.collect_set("c0").alias("cells"))
    return rows.join(lists, F.coalesce(rows["id"], F.lit(_NULL)) == lists["k"]).select("id", "text", "cells")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of the whole documents table."""
    return spans(common.load(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), s AS (
  SELECT doc_id, i - 1 AS a, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS t FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)
), c AS (
  SELECT doc_id, a, count(*) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY doc_id, a) AS rn FROM s
), k AS (
  SELECT doc_id, 'repeat' AS kind, a FROM c WHERE n > 1 UNION ALL SELECT doc_id, 'remove', a FROM c WHERE rn > 1
), m AS (
  SELECT *, lag(a) OVER (PARTITION BY doc_id, kind ORDER BY a) AS b FROM k
), g AS (
  SELECT *, sum(CASE WHEN b IS NULL OR a > b + {WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, kind ORDER BY a) AS island FROM m
)
SELECT doc_id, kind, CAST(min(a) AS BIGINT) AS first_word, CAST(max(a) + {WINDOW - 1} AS BIGINT) AS last_word, CAST(max(a) - min(a) + {WINDOW} AS BIGINT) AS n_words
FROM g GROUP BY doc_id, kind, island
"""
