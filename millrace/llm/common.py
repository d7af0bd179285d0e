"""Shared pieces: Arrow text buffers, vectorised word splitting and hashing, stored tables.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text. Everything works on whole texts; a null text counts as an empty one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time; keeps the work arrays of a Python worker in tens of MB.
BLOCK_BYTES = 1 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame, least: int = 1 << 20, most: int = 32 << 20) -> DataFrame:
    """df, dealt out to more tasks where it is small and lies in few files.

    Such files tend to have one row group each, which a single task would read. A task gets `least`
    bytes or more; tables of `most` bytes a core are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = min(cores, size // least)
    return df.repartition(tasks) if size < cores * most and tasks > 2 * len(df.inputFiles()) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that is unset, a temporary one in local mode; on a cluster that would be another disk on every
    machine, so it raises there.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir()
    if not isinstance(found, str):
        found = found.get() if found.isDefined() else None
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(name: str, names: list[str]) -> str:
    """name, made longer until no column has it."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, stashed with a number for every row, and that column's name. Once written, a row keeps its number."""
    name = free("__row", docs.columns)
    return stash(docs.withColumn(name, F.monotonically_increasing_id())), name


def only(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text, under names of our own, so that other columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = x + _G
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def as_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.chunk(0) if isinstance(a, pa.ChunkedArray) else a


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; nulls become empty."""
    a = as_array(column)
    if a.null_count:
        a = pc.fill_null(a, "")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    _, off, data = a.buffers()
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text is a block by itself."""
    _, off = utf8(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """Words of some texts in order. `first[d]:first[d+1]` are those of text d; start and end are
    byte places in `data`, the lower-cased texts one after another."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, most: int = 1 << 30) -> np.ndarray:
        """64-bit hash of every word, or of its first `most` bytes."""
        return hash_spans(self.data, self.start, np.minimum(self.end, self.start + most))


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, bases: tuple[np.uint64, ...]) -> list[np.ndarray]:
    """A 64-bit hash of every byte span for each base, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    full = size >> 3
    out = [mix(size.astype(np.uint64) ^ b) for b in bases]
    who, done = np.flatnonzero(full), 0
    at = start[who]
    while len(who):
        part = eights[at]
        for h, b in zip(out, bases):
            x = (h[who] ^ part) * b
            x ^= x >> np.uint64(32)
            h[who] = x
        done += 1
        more = full[who] > done
        who, at = who[more], at[more] + 8
    rest = eights[start + (full << 3)] & _MASKS[size & 7]
    return [mix((h ^ rest) * b) for h, b in zip(out, bases)]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    return _spans(data, start, end, (_BASE,))[0]


def hash_spans_twice(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, and 32-bit hashes that have nothing to do with them."""
    h, c = _spans(data, start, end, (_BASE, _M2))
    return h, (c >> np.uint64(32)).astype(np.uint32)


def words(column: pa.Array) -> Words:
    data, off = utf8(pc.utf8_lower(as_array(column)))
    m = _WORD[data]
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, off, z, z, np.zeros(len(off), np.int64))
    begin = m.copy()
    begin[1:] &= ~m[:-1]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = m[edges]
    stop = m.copy()
    stop[:-1] &= ~m[1:]
    stop[edges - 1] = m[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(data, off, start, end, np.searchsorted(start, off))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes, by doubling; as long as h, the last k - 1 are not to be used."""
    out, have, power = None, 0, np.uint64(0x9FB21C651E98DF25)
    piece, size = h, 1
    shift = lambda x, by: np.concatenate([x[by:], np.zeros(min(by, len(x)), np.uint64)])
    while k:
        if k & 1:
            out = piece if out is None else mix(out * power ^ shift(piece, have))
            have += size
        k >>= 1
        if k:
            piece = mix(piece * power ^ shift(piece, size))
            size *= 2
    return out


def gram_table(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word runs inside each text, the place (word number over all texts) of each, and firsts by text."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    firsts = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - firsts[:-1], count) + np.arange(firsts[-1])
    return (grams(h, k)[at] if len(h) else h), at, firsts


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many characters of the UTF-8 bytes begin before each byte place."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return lead[at]


def runs(lo: np.ndarray, hi: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open intervals within each group; touching ones are joined. Sorted by group and start."""
    if not len(lo):
        return lo, hi, group
    order = np.lexsort((lo, group))
    lo, hi, group = lo[order], hi[order], group[order]
    span = int(max(hi.max(), lo.max())) + 2
    reach = np.maximum.accumulate(hi + group.astype(np.int64) * span) - group.astype(np.int64) * span
    new = np.ones(len(lo), bool)
    new[1:] = (group[1:] != group[:-1]) | (lo[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return lo[at], np.maximum.reduceat(hi, at), group[at]


def cut_words(texts: pa.Array, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The texts without words lo to hi (by number within the text); what stands between spans stays."""
    touched = {}
    for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist()):
        touched.setdefault(d, []).append((a, b))
    values = texts.to_pylist() if len(touched) * 4 > len(texts) else None
    pieces, last = [], 0
    for d in sorted(touched):
        text = values[d] if values else texts[d].as_py()
        w = words(pa.array([text]))
        starts, ends = code_points(w.data, w.start), code_points(w.data, w.end)
        kept, at = [], 0
        for a, b in touched[d]:
            kept.append(text[at : starts[a]])
            at = int(ends[b - 1])
        kept.append(text[at:])
        pieces += [texts.slice(last, d - last), pa.array(["".join(kept)], type=texts.type)]
        last = d + 1
    return pa.concat_arrays([*pieces, texts.slice(last)]) if pieces else texts


def flat_map(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None]):
    """A mapInArrow function that applies fn to every batch."""

    def over(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return over


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unstash(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in sorted({f.rpartition("/")[0] for f in df.inputFiles()}):
            if folder.rpartition("/")[2].startswith("stash-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def within(keys: DataFrame, most: int = 4_000_000) -> DataFrame:
    """keys, to be broadcast if they are `most` rows at most (32 MB of ids); else left to the optimizer."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def narrowed(rows: DataFrame, ids: DataFrame, most: int = 4_000_000) -> DataFrame:
    """rows whose id is among `ids`, filtered before any shuffle, if those are `most` at most (32 MB); else all rows."""
    return rows.join(F.broadcast(ids), "id", "left_semi") if ids.limit(most + 1).count() <= most else rows


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component, for all nodes of edges (a, b).

    Alternates the large-star and small-star steps (Kiveris and others, 2014) until nothing changes;
    every step is a group-by and a join, and the edges are written to the shared folder between steps.
    """
    pairs = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    seen = None
    while True:
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        root = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(root, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        root = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(root, "b")
        small = small.select(F.col("m").alias("a"), "b").union(small.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        step = stash(small)
        unstash(pairs)
        pairs = step
        now = tuple(pairs.select(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38, 0))"))).first())
        if now == seen:
            return pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).union(pairs.select("a", "a").distinct())
        seen = now


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables of complete groups from batches that are sorted by a column; only the last group is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        last = k[len(k) - 1].as_py()
        same = pc.is_null(k) if last is None else pc.fill_null(pc.equal(k, last), False)
        begin = pc.index(same, True).as_py()
        if begin == 0 and (not held or held[-1].column(key)[0].as_py() == last):
            held.append(batch)
            continue
        if held and begin == 0:
            yield pa.Table.from_batches(held)
        else:
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
        held = [batch.slice(begin)]
    if held:
        yield pa.Table.from_batches(held)
