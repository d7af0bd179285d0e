"""Near-duplicates by MinHash with sequential Bayesian verification (operator 1).

Documents are sets of SHINGLE-word shingles (a shorter one is a single shingle). HASHES min-hashes
in bands of ROWS find candidates. In every bucket the least doc_id leads, and the others are paired
with it, so a bucket of n documents costs n - 1 comparisons. Pairs are compared signature batch by
signature batch: with a uniform prior, the similarity after m matches of n has a Beta(m + 1, n - m + 1)
posterior, and a pair is dropped once the chance that it reaches THRESHOLD is under the miss
probability of the batch. Pairs that survive are verified exactly on the shingle sets of the whole
texts. Groups are connected components.

Where some partner turns out unlike its leader, the bucket's partners are put into finer buckets, one
for each of FINER min-hashes in which a document lies below that leader, and the same goes on there. Such a min-hash
is of a shingle that the leader lacks, so documents that share with the leader all that they share (a
template with own text for each) meet in none and cost one comparison a bucket, not one for each pair. Two
documents that are alike, while one of them is unlike the leader, share shingles that the leader lacks: at
similarities of 0.5 to each other and 0.4 to the leader these are the least of all three in 5 of 80
min-hashes on average, or more. What is left after LEVELS levels is compared pair by pair. Buckets that hold
the same documents count once.

Defined results: texts without words, null or empty, are in no group; a null doc_id is in no group
and its row is always kept; ids are whole numbers (anything else raises); rows that share a doc_id are
one document, as similar to others as the most similar of them; the least doc_id of a group stays; a
text of any length is compared whole; other columns are left alone; an empty table has no groups.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

SHINGLE, THRESHOLD = 3, 0.5
BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
BATCH = 16
#: Chance, over all batches, that a pair at the threshold is dropped before exact verification.
MISS = 0.01
#: Levels of buckets, the bands included, and the min-hashes that make finer ones.
LEVELS, FINER = 3, 80
#: Bytes of partners of one leader that are verified together, about.
TOGETHER = 4 << 20
_RANDOM = common.mix(np.arange(2 * HASHES, dtype=np.uint64) + np.uint64(0x5151))
_MUL, _ADD = (_RANDOM[:HASHES] | np.uint64(1)).astype(np.uint32), _RANDOM[HASHES:].astype(np.uint32)
_SALT = common.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(0xBA9D))
_SIGS = "id long, size long, whole1 long, whole2 long, bands array<long>, sig binary"


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, common.Words, np.ndarray]:
    """Shingle hashes with firsts by text, the words and their hashes."""
    w = common.words(column)
    h = w.hashes()
    g, _, firsts = common.gram_table(h, w.first, SHINGLE)
    short = np.flatnonzero((np.diff(firsts) == 0) & (np.diff(w.first) > 0))
    if len(short):
        a, b = h[w.first[short]], h[w.first[short + 1] - 1]
        one = common.mix(a ^ common.mix(b + np.diff(w.first)[short].astype(np.uint64)))
        g = np.insert(g, firsts[short], one)
        more = np.zeros(len(firsts), np.int64)
        more[short + 1] = 1
        firsts = firsts + np.cumsum(more)
    return g, firsts, w, h


def _signatures(batch: pa.RecordBatch):
    for lo, hi in common.blocks(batch.column(1)):
        texts = common.as_array(batch.column(1)).slice(lo, hi - lo)
        g, firsts, w, h = shingles(texts)
        some = np.flatnonzero(np.diff(firsts))
        if not len(some):
            continue
        start = firsts[some]
        x = (g >> np.uint64(32)).astype(np.uint32)
        sig, work = np.empty((len(some), HASHES), np.uint32), np.empty_like(x)
        for i in range(HASHES):
            np.multiply(x, _MUL[i], out=work)
            np.add(work, _ADD[i], out=work)
            sig[:, i] = np.minimum.reduceat(work, start)
        place = np.arange(len(h)) - np.repeat(w.first[:-1], np.diff(w.first))
        spread = common.mix(h + common.mix(place.astype(np.uint64)))
        whole = [np.add.reduceat(s, w.first[some]) for s in (spread, common.mix(spread ^ np.uint64(0x77)))]
        bands = np.repeat(_SALT[None, :], len(some), axis=0)
        for r in range(ROWS):
            bands = common.mix(bands ^ sig[:, r::ROWS].astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(lo, hi - lo).take(pa.array(some)),
                pa.array(np.diff(common.utf8(texts)[1])[some]),
                *(pa.array(v.view(np.int64)) for v in whole),
                pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64))),
                pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.arange(len(some) + 1) * HASHES * 4).astype(np.int32)), pa.py_buffer(sig.tobytes())]),
            ],
            names=["id", "size", "whole1", "whole2", "bands", "sig"],
        )


def least_matches(threshold: float, miss: float) -> list[int]:
    """After each batch, the matches below which the posterior chance of reaching the threshold is under miss / batches."""
    batches = HASHES // BATCH
    out = []
    for j in range(1, batches + 1):
        n, total, m = j * BATCH + 1, 0.0, -1
        while total < miss / batches:  # P(Beta(m + 1, n - m) >= t) = P(Binomial(n, t) <= m)
            m += 1
            total += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, need: list[int]) -> np.ndarray:
    """Which rows of two signature matrices are not dropped after any batch."""
    matches, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for j, least in enumerate(need):
        s = slice(j * BATCH, (j + 1) * BATCH)
        matches[alive] += (a[alive, s] == b[alive, s]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def _side(sigs: DataFrame, name: str) -> DataFrame:
    return sigs.select(F.col("id").alias(name), F.col("size").alias(f"{name}n"), F.col("whole1").alias(f"{name}1"), F.col("whole2").alias(f"{name}2"), F.col("sig").alias(f"{name}s"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _with_signatures(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with both sides' columns; signatures in no pair are left out before the shuffle, if the rest are few."""
    own = common.narrowed(sigs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return pairs.join(_side(own, "a"), "a").join(_side(own, "b"), "b")


def _compare(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """a, b, size, same: pairs that survive the signatures, the bytes of b, and whether their words are the same."""
    need = least_matches(threshold, miss)
    both = _with_signatures(pairs, sigs).selectExpr("a", "b", "bn as size", "a1 = b1 and a2 = b2 as same", "as", "bs")

    def fn(batch):
        yield batch.select(["a", "b", "size", "same"]).take(pa.array(survivors(_matrix(batch.column(4)), _matrix(batch.column(5)), need)))

    return both.mapInArrow(common.flat_map(fn), "a long, b long, size long, same boolean")


def _parts(pairs: DataFrame) -> DataFrame:
    """The pairs with a part for each, so that no leader has more than about TOGETHER bytes of partners in one."""
    often = pairs.groupBy("a").agg(F.sum("size").alias("n"))
    return pairs.join(often, "a").select("a", "b", F.expr(f"pmod(xxhash64(b), ceil(n / {TOGETHER}))").cast("int").alias("part"))


def _verify(part: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar as the threshold asks."""
    members = part.select("a", "part", F.col("a").alias("id")).distinct().union(part.select("a", "part", F.col("b").alias("id")))

    def fn(key, table):
        leader, ids, text = key[0].as_py(), table.column("id").to_numpy(), common.as_array(table.column("text"))
        led, own, found = [], [], []
        for lo, hi in common.blocks(text):
            g, firsts, _, _ = shingles(text.slice(lo, hi - lo))
            for r in range(hi - lo):
                (led if ids[lo + r] == leader else own).append((ids[lo + r], np.unique(g[firsts[r] : firsts[r + 1]])))
        for b, s in own:
            for _, base in led:
                at = np.minimum(np.searchsorted(base, s), max(len(base) - 1, 0))
                common_ = int((base[at] == s).sum()) if len(base) else 0
                if common_ and common_ >= threshold * (len(s) + len(base) - common_):
                    found.append(b)
                    break
        return pa.table({"a": pa.array([leader] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    wanted = common.narrowed(texts, members.select("id").distinct())
    return wanted.join(members.hint("shuffle_hash"), "id").select("a", "part", "id", "text").groupBy("a", "part").applyInArrow(fn, "a long, b long")


def _edges(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs that are similar, stashed."""
    close = common.stash(_compare(pairs, sigs, threshold, miss))
    part = common.stash(_parts(close.where("not same").select("a", "b", "size")))
    found = common.stash(close.where("same").select("a", "b").union(_verify(part, texts, threshold)).distinct())
    common.unstash(close, part)
    return found


def _buckets(rows: DataFrame) -> DataFrame:
    """key, n, a, b: the least id of every bucket (columns key, id) with each of the others; buckets of the same documents once. Stashed."""
    held = rows.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("all")).where("n > 1")
    once = common.stash(held.groupBy("a", "n", "all").agg(F.min("key").alias("key")).select("key", "n", "a"))
    out = common.stash(rows.join(common.within(once, 1_300_000), "key").where("id <> a").select("key", "n", "a", F.col("id").alias("b")))
    common.unstash(once)
    return out


def _mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Those buckets of more than two in which someone is unlike the leader."""
    told = buckets.where("n > 2").join(found.withColumn("like", F.lit(1)), ["a", "b"], "left")
    odd = told.where("like is null").select("key").distinct()
    return buckets.join(odd, "key", "left_semi")


def _finer(mixed: DataFrame, sigs: DataFrame) -> DataFrame:
    """key, id: the partners in those buckets, by each min-hash below the leader's."""
    both = _with_signatures(mixed, sigs).select("key", "b", "as", "bs")

    def fn(batch):
        a, b = _matrix(batch.column(2))[:, :FINER], _matrix(batch.column(3))[:, :FINER]
        row, j = np.nonzero(b < a)
        old = common.mix(batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(0xF19E))
        key = common.mix(old[row] ^ (j.astype(np.uint64) << np.uint64(32) | b[row, j]))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(batch.column(1).to_numpy()[row])], names=["key", "id"])

    return both.mapInArrow(common.flat_map(fn), "key long, id long")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, miss: float = MISS, levels: int = LEVELS) -> DataFrame:
    """Verified similar pairs (a, b), enough of them to connect all candidates that are similar."""
    texts = common.only(docs, id_col, text_col).where("id is not null")
    sigs = common.stash(texts.mapInArrow(common.flat_map(_signatures), _SIGS))
    buckets = _buckets(sigs.select("id", F.explode("bands").alias("key")))
    tried, found = [common.stash(buckets.select("a", "b").distinct())], []
    for level in range(levels + 1):
        if not tried[-1].isEmpty():
            found.append(_edges(tried[-1], sigs, texts, threshold, miss))
        if level == levels or not found:
            break
        mixed = common.stash(_mixed(buckets, _all(found)))
        common.unstash(buckets)
        if mixed.isEmpty():
            buckets = mixed
            break
        if level < levels - 1:
            buckets = _buckets(_finer(mixed, sigs))
            fresh = buckets.select("a", "b")
        else:
            buckets, fresh = mixed, mixed.select("key", "b").join(mixed.select("key", F.col("b").alias("y")), "key").where("b < y").select(F.col("b").alias("a"), F.col("y").alias("b"))
        if level < levels - 1:
            common.unstash(mixed)
        fresh = fresh.distinct()
        for before in tried:
            fresh = fresh.join(before, ["a", "b"], "left_anti")
        tried.append(common.stash(fresh))
    common.unstash(sigs, buckets, *tried)
    return _all(found) if found else docs.sparkSession.createDataFrame([], "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """doc_id, group_id (its least doc_id) and keep of every document that has a near-duplicate."""
    similar = edges(docs, id_col, text_col, threshold, miss)
    found = common.components(similar)
    common.unstash(similar)
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), (F.col("node") == F.col("root")).alias("keep"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """docs without all but one document of each group, all columns as they are."""
    out = common.stash(groups(docs, id_col, text_col, threshold, miss).where("not keep").select(F.col("doc_id").alias("__lost")))
    return docs.join(common.within(out), docs[f"`{id_col}`"].cast("long") == out["__lost"], "left_anti")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates of the whole documents table."""
    return groups(common.load(spark, sf_dir, "documents"))
