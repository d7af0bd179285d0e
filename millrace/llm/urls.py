"""URL filter by the ratio of two character language models (operator 5).

Rows are labelled accepted or rejected: by a boolean column of the caller's (null: unlabelled), else URLs
with one of the seed terms among the words of their host count as rejected and the others as accepted.
For each side a variable-order Markov model over up to ORDER characters of context is counted over all
labelled URLs, one row for each distinct run of characters. Probabilities are interpolated from the
longest context that was seen MIN_CONTEXT times down to single characters (Witten and Bell's weights)
and a uniform one at the end. The score of a URL is its log-likelihood as a rejected URL less that as an
accepted one, divided by its length, so hosts that no seed term names but that are spelt like those are
rejected as well.

The cut is calibrated on held-out URLs, one in HELD by hash of the URL: the counts of these are kept apart
as well, so that they are scored once by the counts of all others, and the cut is the one of best F1 over
the histogram of these scores. Where the held-out URLs lack a side, it is taken from all URLs' own scores.

Up to MODEL_BYTES the counts go to every task. Beyond that the URLs are dealt into blocks, the distinct
runs of each block are joined with the table of counts, and every block is scored by what it gets
back. Both ways use the same counts, of 64 bits where they need them, and give the same scores.

Defined results: URLs are lower-cased and digits taken as 0; a null or empty URL scores 0 and is not
rejected; a URL of any length is scored whole; repeated rows count and are scored one by one, and lie on
one side of the hold-out; ties with the cut are rejected; a null page_id stays null; ids are whole numbers;
with URLs of one side only nothing is rejected; other columns are left alone; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Words of hosts whose URLs count as rejected where the caller gives no labels.
SEEDS = ("casino", "bets", "porn", "adult", "pills", "viagra", "spam", "ads", "loans", "poker")
ORDER, MIN_CONTEXT = 5, 2
#: One URL in so many is held out for the cut.
HELD = 5
MODEL_BYTES = 64 << 20
#: Bytes of URLs that are scored together where the counts are joined to them.
BLOCK_BYTES = 1 << 18
_ENTRY = 8 + 4 * 4
#: Of runs: how often they occur, by side, in all URLs and in those that are not held out.
_RUNS = ("n0", "n1", "m0", "m1")
#: Of contexts: how often they have a follower and how many kinds, in the same order.
_CONTEXTS = ("t0", "t1", "u0", "u1", "k0", "k1", "j0", "j1")
_SALT = common.mix(np.arange(ORDER + 1, dtype=np.uint64) + np.uint64(0x0DD))
_BIN = 1000


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the normalised URLs, each after ORDER zeros and before one, and their offsets without those."""
    data, off = common.utf8(pc.utf8_lower(common.as_array(column)))
    x = np.where((data >= 48) & (data <= 57), 48, data).astype(np.uint64)
    n = len(off) - 1
    size = np.where(np.diff(off) > 0, np.diff(off) + 1, 0)  # the end is a letter as well; an empty URL has none
    starts = np.concatenate([[0], np.cumsum(size + ORDER)])
    out = np.zeros(starts[-1], np.uint64)
    doc = np.repeat(np.arange(n), np.diff(off))
    out[np.arange(len(x)) + starts[doc] + ORDER - off[doc]] = x
    return out, starts


def places(starts: np.ndarray) -> np.ndarray:
    """Where the letters stand, zeros before them left out."""
    size = np.diff(starts) - ORDER
    first = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(starts[:-1] + ORDER - first, size)


def contexts(x: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The hash of the 0 to ORDER letters before each place."""
    h = [np.full(len(at), _SALT[0])]
    for k in range(1, ORDER + 1):
        h.append(common.mix(h[-1] ^ (x[at - k] + _SALT[k])))
    return h


def run(context: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return common.mix(context * np.uint64(0x9E3779B97F4A7C15) + letter)


def counts(urls: DataFrame) -> DataFrame:
    """context, run and _RUNS of each run of characters of labelled URLs (columns url, bad, held)."""

    def fn(batch):
        x, starts = letters(batch.column(0))
        at = places(starts)
        flag = lambda i: np.repeat(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(starts) - ORDER)
        bad, held = flag(1), flag(2)
        kinds = [(1 - bad), bad, (1 - bad) * (1 - held), bad * (1 - held)]
        keys, found = contexts(x, at), []
        for c in keys:
            r = run(c, x[at])
            order = np.argsort(r, kind="stable")
            edge = np.flatnonzero(np.append(True, r[order][1:] != r[order][:-1])) if len(r) else np.zeros(0, np.int64)
            found.append((c[order][edge], r[order][edge], *(np.add.reduceat(k[order], edge) if len(edge) else k[:0] for k in kinds)))
        c, r, *n = (np.concatenate(v) for v in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(r.view(np.int64)), *map(pa.array, n)], names=["context", "run", *_RUNS])

    found = urls.mapInArrow(common.flat_map(fn), "context long, run long, " + ", ".join(f"{n} long" for n in _RUNS))
    return found.groupBy("context", "run").agg(*[F.sum(n).alias(n) for n in _RUNS])


@dataclass
class Model:
    """Sorted run and context hashes; counts of runs, and counts and kinds of followers of contexts, by side:
    rows 0 and 1 over all URLs, 2 and 3 over those that are not held out."""

    runs: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray

    def scores(self, column: pa.Array, blind: bool = False) -> np.ndarray:
        """blind: by the counts without those of held-out URLs."""
        x, starts = letters(column)
        size = np.diff(starts) - ORDER
        at = places(starts)
        out = np.zeros(len(size))
        if not len(at) or not len(self.runs):
            return out
        side = slice(2, 4) if blind else slice(0, 2)
        p = np.full((2, len(at)), 1 / 256)
        for c in contexts(x, at):
            p = self._step(p, c, x[at], side)
        some = np.flatnonzero(size)
        first = (np.cumsum(size) - size)[some]
        out[some] = np.add.reduceat(np.log(p[1]) - np.log(p[0]), first) / size[some]
        return out

    def _step(self, p: np.ndarray, context: np.ndarray, letter: np.ndarray, side: slice) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        r = run(context, letter)
        j = np.minimum(np.searchsorted(self.runs, r), len(self.runs) - 1)
        total, kinds = self.total[side, i], self.kinds[side, i]
        known = (self.contexts[i] == context) & (total.sum(axis=0) >= MIN_CONTEXT)
        n = np.where(self.runs[j] == r, self.n[side, j], 0)
        return np.where(known & (total > 0), (n + kinds * p) / np.maximum(total + kinds, 1), p)


def seen(found: DataFrame) -> DataFrame:
    """context, _CONTEXTS, and kinds of followers of any side, of contexts seen MIN_CONTEXT times."""
    total = [F.sum(n).alias(t) for n, t in zip(_RUNS, _CONTEXTS)]
    kinds = [F.sum(F.when(F.col(n) > 0, 1).otherwise(0)).alias(k) for n, k in zip(_RUNS, _CONTEXTS[4:])]
    return found.groupBy("context").agg(*total, *kinds, F.count("*").alias("runs")).where(F.col("t0") + F.col("t1") >= MIN_CONTEXT)


def _numbers(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    x = np.stack([table.column(n).to_numpy().astype(np.int64) for n in names])
    return x.astype(np.int32) if x.max(initial=0) < 1 << 31 else x


def model(found: DataFrame, kept: DataFrame) -> Model:
    """From the counts of all runs and those of the contexts."""
    c = kept.toArrow()
    r = found.join(kept.select("context"), "context", "left_semi").select("run", *_RUNS).toArrow()
    ch, rh = (t.column(k).to_numpy().view(np.uint64) for t, k in ((c, "context"), (r, "run")))
    co, ro = np.argsort(ch), np.argsort(rh)
    return Model(rh[ro], _numbers(r, _RUNS)[:, ro], ch[co], _numbers(c, _CONTEXTS[:4])[:, co], _numbers(c, _CONTEXTS[4:])[:, co])


_SCORED = "page_id long, url string, bad boolean, held boolean, score double, blind double"


def _both(columns: list, known: Model) -> list:
    """The columns page_id, url, bad, held with the score, and the blind score of held-out rows."""
    url, held = columns[1], np.asarray(columns[3].to_numpy(zero_copy_only=False), bool)
    blind = np.zeros(len(held))
    if held.any():
        blind[held] = known.scores(url.filter(pa.array(held)), blind=True)
    return [*columns, pa.array(known.scores(url)), pa.array(blind, mask=~held)]


def _broadcast(rows: DataFrame, known: Model) -> DataFrame:
    """rows (page_id, url, bad, held) and their scores; every task gets the model."""
    shared = rows.sparkSession.sparkContext.broadcast(known)  # of MODEL_BYTES at most

    def fn(batch):
        yield pa.RecordBatch.from_arrays(_both(batch.columns, shared.value), names=["page_id", "url", "bad", "held", "score", "blind"])

    return rows.mapInArrow(common.flat_map(fn), _SCORED)


def _joined(rows: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """The same, where the counts go only to the blocks of URLs that need them. Stashed."""

    def number(batch):
        for lo, hi in common.blocks(batch.column(1), BLOCK_BYTES):
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.repeat(part.column(4)[0], hi - lo)], names=["page_id", "url", "bad", "held", "block"])

    def need(batch):
        block = batch.column(1).to_numpy()
        edge = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for lo, hi in zip(edge, np.append(edge[1:], len(block))):
            x, starts = letters(batch.column(0).slice(lo, hi - lo))
            at = places(starts)
            r = np.concatenate([np.unique(run(c, x[at])) for c in contexts(x, at)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), block[lo])), pa.array(r.view(np.int64))], names=["block", "run"])

    def fn(left, right):
        hashes = {k: np.unique(right.column(k).to_numpy().view(np.uint64), return_index=True) for k in ("run", "context")}
        (rh, ro), (ch, co) = hashes["run"], hashes["context"]
        known = Model(rh, _numbers(right, _RUNS)[:, ro], ch, _numbers(right, _CONTEXTS[:4])[:, co], _numbers(right, _CONTEXTS[4:])[:, co])
        names = ["page_id", "url", "bad", "held"]
        return pa.table(_both([common.as_array(left.column(n)) for n in names], known), names=[*names, "score", "blind"])

    kind = "page_id long, url string, bad boolean, held boolean, block long"
    blocks = common.stash(rows.withColumn("block", F.monotonically_increasing_id()).mapInArrow(common.flat_map(number), kind))
    wanted = blocks.where("url <> ''").select("url", "block").mapInArrow(common.flat_map(need), "block long, run long")
    got = wanted.join(found.join(kept, "context"), "run").select("block", "run", "context", *_RUNS, *_CONTEXTS)
    out = common.stash(blocks.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(fn, _SCORED))
    common.unstash(blocks)
    return out


def seeded(url: Column, seeds: tuple[str, ...] = SEEDS) -> Column:
    """Whether one of the words of the URL's host is a seed term."""
    host = F.regexp_extract(F.lower(url), "^(?:[a-z0-9+.-]+://)?([^/?#]*)", 1)
    return F.arrays_overlap(F.split(host, "[^a-z]+"), F.array(*[F.lit(s) for s in seeds]))


def score(pages: DataFrame, seeds: tuple[str, ...] = SEEDS, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, most: int = MODEL_BYTES) -> DataFrame:
    """page_id, url, score and reject of every row. label_col: a boolean column, true for URLs to be rejected."""
    url = F.col(f"`{url_col}`").cast("string")
    bad = seeded(url, seeds) if label_col is None else F.col(f"`{label_col}`").cast("boolean")
    held = (F.pmod(F.xxhash64(url), F.lit(HELD)) == 0) & bad.isNotNull() & F.coalesce(url != "", F.lit(False))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), bad.alias("bad"), held.alias("held"))
    found = common.stash(counts(rows.where("url is not null and bad is not null").select("url", "bad", "held")))
    kept = common.stash(seen(found))
    size = (kept.select(F.sum(F.col("runs") + 2)).first()[0] or 0) * _ENTRY
    scored = common.stash(_broadcast(rows, model(found, kept))) if size <= most else _joined(rows, found, kept)
    common.unstash(found, kept)

    def bins(name: str) -> pa.Table:
        told = scored.where(f"url <> '' and bad is not null and {name} is not null")
        return told.groupBy(F.floor(F.col(name) * _BIN).alias("bin")).agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n")).orderBy("bin").toArrow()

    least = cut(bins("blind"))
    least = cut(bins("score")) if least is None else least
    reject = (F.col("score") >= F.lit(float("inf") if least is None else least)) & (F.coalesce("url", F.lit("")) != "")
    return scored.select("page_id", "url", "score", reject.alias("reject"))


def cut(bins: pa.Table) -> float | None:
    """The score of best F1, from a histogram of scores, halfway to the next bin below; None where one side is missing."""
    bad, n, at = bins.column("bad").to_numpy().astype(np.int64), bins.column("n").to_numpy(), bins.column("bin").to_numpy()
    if not len(n) or not bad.sum() or bad.sum() == n.sum():
        return None
    hit, all_ = np.cumsum(bad[::-1])[::-1], np.cumsum(n[::-1])[::-1]
    k = int(np.argmax(2 * hit / (all_ + bad.sum())))
    return float(at[k] + at[k - 1] + 1 if k else 2 * at[k]) / 2 / _BIN


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score and verdict of every URL of the whole pages table."""
    return score(common.load(spark, sf_dir, "pages"))
