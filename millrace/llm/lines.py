"""Line dedup over a sharded minimal perfect hash (operator 9).

A line is what stands between line feeds, without ASCII white space at its ends; blank lines are
left alone. Of each line that occurs more than once in the corpus the first occurrence stays (least
doc_id, then the topmost) and the others go.

Every line is told by a 64-bit hash and a 32-bit one that is independent of it; both are written to the
shared folder once. The distinct ones are counted and go, all of them and by shard, into a minimal perfect
hash: bit arrays by level with running ranks, in the way of BBHash. Its slots index arrays of fingerprints
(the 32-bit hash), counts and first rows. Then the lines of the documents probe the arrays of their shard:
the hashes travel to the shards, in parts of about PROBES lines, each with its copy of the arrays, so that
a line that stands in a third of all documents spreads over many tasks; the numbers of the lines that
go travel back. As every line is in the
hash, no probe can hit a strange slot by chance; two different lines are taken for one only where
both hashes agree, which of N distinct lines is expected N * N / 2^97 times (10^12 lines: never). Nothing
is broadcast or sent to the driver but the list of shards of more than PROBES lines.

Defined results: null text stays null and empty text empty, with no lines; a text of any length is one
row's lines; a null doc_id counts as the largest; of rows that share a doc_id, or have none, one is the
first, so exactly one occurrence of every line stays; other columns are passed on or left alone,
whatever they are called (n_lines and n_dropped must be free where a tally is asked for); an
empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Distinct lines in a shard, about.
SHARD_LINES = 1 << 16
#: Lines that one task looks up in a shard, about.
PROBES = 1 << 20
_LAST = np.int64((1 << 63) - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 11, 12, 13, 32]] = True
_LEVELS = 40
_SEEDS = common.mix(np.arange(_LEVELS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_ARROW = pa.schema([("shard", pa.int32()), ("total", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("ranks", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("firsts", pa.binary())])
_ARRAYS = "shard int, total long, sizes array<int>, bits binary, ranks binary, prints binary, counts binary, firsts binary"


@dataclass
class Lines:
    """The lines of some texts: bytes, the trimmed and the whole span of each, and firsts by text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    whole: np.ndarray
    stop: np.ndarray
    first: np.ndarray


def split(column: pa.Array) -> Lines:
    data, off = common.utf8(column)
    cut = np.flatnonzero(data == 10)
    before = np.searchsorted(cut, off)
    size = np.where(np.diff(off) > 0, np.diff(before) + 1, 0)  # an empty text has no lines
    first = np.concatenate([[0], np.cumsum(size)])
    start, stop = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    some = np.flatnonzero(size)
    inner = np.ones(first[-1], bool)
    inner[first[:-1][some]] = False
    start[first[:-1][some]], start[inner] = off[some], cut + 1
    outer = np.ones(first[-1], bool)
    outer[first[1:][some] - 1] = False
    stop[first[1:][some] - 1], stop[outer] = off[1:][some], cut
    a, b = start.copy(), stop.copy()
    padded = np.append(_SPACE[data], False)
    who = np.flatnonzero((a < b) & padded[a])
    while len(who):
        a[who] += 1
        who = who[(a[who] < b[who]) & padded[a[who]]]
    who = np.flatnonzero((a < b) & padded[b - 1])
    while len(who):
        b[who] -= 1
        who = who[(a[who] < b[who]) & padded[b[who] - 1]]
    return Lines(data, a, b, start, stop, first)


def hashes(lines: Lines) -> np.ndarray:
    return common.hash_spans(lines.data, lines.start, lines.end)


def _real(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines that are not blank: both hashes, the text's number and the line's number in it."""
    x = split(texts)
    real = np.flatnonzero(x.end > x.start)
    doc = np.repeat(np.arange(len(x.first) - 1), np.diff(x.first))[real]
    return *common.hash_spans_twice(x.data, x.start[real], x.end[real]), doc, real - x.first[doc]


def _rows(keyed: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    return keyed.select(F.col(f"`{row}`").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def hashed(rows: DataFrame) -> DataFrame:
    """h, c, id, row, line of every line that is not blank."""

    def fn(batch):
        row, ids = batch.column(0).to_numpy(), batch.column(1).fill_null(int(_LAST)).to_numpy()
        for lo, hi in common.blocks(batch.column(2)):
            h, c, doc, line = _real(common.as_array(batch.column(2)).slice(lo, hi - lo))
            doc = doc + lo
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int32)), pa.array(ids[doc]), pa.array(row[doc]), pa.array(line.astype(np.int32))], names=["h", "c", "id", "row", "line"])

    return rows.mapInArrow(common.flat_map(fn), "h long, c int, id long, row long, line int")


def counts(lines: DataFrame) -> DataFrame:
    """h, c, n, first: each distinct line, how often it occurs and the row of least doc_id that has it; counted before the shuffle as well."""
    return lines.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "row")).alias("first")).select("h", "c", "n", "first.row").toDF("h", "c", "n", "first")


def _shard(shards: int):
    return F.pmod(F.shiftrightunsigned("h", 20), F.lit(shards)).cast("int")


def _place(h: np.ndarray, c: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a line stands in a level. The second hash takes part, so that lines of one first hash part ways."""
    return (common.mix(h ^ common.mix(c ^ _SEEDS[level])) % np.uint64(size)).astype(np.int64)


def build(h: np.ndarray, c: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits in words with running ranks, and each key's slot."""
    sizes, words, slot = [], [], np.full(len(h), -1)
    left, taken = np.arange(len(h)), 0
    c = c.astype(np.uint64)
    for level in range(_LEVELS):
        if not len(left):
            break
        size = 64 * max(1, -(-2 * len(left) // 64))
        at = _place(h[left], c[left], level, size)
        hit = np.bincount(at, minlength=size)
        alone = hit[at] == 1
        bits = hit == 1
        rank = np.cumsum(bits)
        slot[left[alone]] = taken + rank[at[alone]] - 1
        taken += int(rank[-1])
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone]
    if len(left):
        raise ValueError("lines are not distinct")
    packed = np.concatenate(words) if words else np.zeros(0, "<u8")
    ones = np.bitwise_count(packed).astype(np.int64)
    return sizes, packed, (np.cumsum(ones) - ones).astype(np.uint32), slot


def arrays(known: DataFrame, shards: int) -> DataFrame:
    """One row for each shard: its hash function, and its fingerprint, count and first-row arrays."""

    def fn(key, table):
        h, c, n = table.column("h").to_numpy().view(np.uint64), table.column("c").to_numpy().view(np.uint32), table.column("n").to_numpy()
        sizes, bits, ranks, slot = build(h, c)
        by = np.argsort(slot)
        count = np.minimum(n[by], (1 << 32) - 1).astype(np.uint32)
        row = [[int(key[0].as_py())], [int(n.sum())], [sizes], [bits.tobytes()], [ranks.tobytes()], [c[by].tobytes()], [count.tobytes()], [table.column("first").to_numpy()[by].tobytes()]]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(row, _ARROW.types)], schema=_ARROW)

    return known.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(fn, _ARRAYS)


class Probe:
    """The arrays of one shard."""

    def __init__(self, row: dict):
        self.sizes = row["sizes"]
        self.bits, self.ranks = np.frombuffer(row["bits"], "<u8"), np.frombuffer(row["ranks"], np.uint32)
        self.prints, self.counts, self.firsts = np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["firsts"], np.int64)

    def slots(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The slot of every line, -1 of lines that are not in the shard, as far as the fingerprints tell them."""
        out, left, base = np.full(len(h), -1), np.arange(len(h)), 0
        wide = c.astype(np.uint64)
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = base + _place(h[left], wide[left], level, size)
            word, place = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> place) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << place[hit]) - np.uint64(1)))
            out[left[hit]] = self.ranks[at[hit] >> 6] + below
            left, base = left[~hit], base + size
        hit = np.flatnonzero(out >= 0)
        out[hit[self.prints[out[hit]] != c[hit]]] = -1
        return out


def dropped(h: np.ndarray, c: np.ndarray, row: np.ndarray, line: np.ndarray, probe: Probe) -> np.ndarray:
    """Which lines go; all lines of a row that are in the shard have to be there."""
    slot = probe.slots(h, c)
    many = np.flatnonzero(slot >= 0)
    many = many[probe.counts[slot[many]] > 1]
    gone = np.zeros(len(h), bool)
    gone[many] = probe.firsts[slot[many]] != row[many]
    stay = many[~gone[many]]  # in their first row; the topmost of each is the first occurrence
    stay = stay[np.lexsort((line[stay], row[stay], slot[stay]))]
    gone[stay[1:]] = (slot[stay][1:] == slot[stay][:-1]) & (row[stay][1:] == row[stay][:-1])
    return gone


def _without(x: Lines, texts: pa.Array, gone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts without those lines, and how many each lost; the line feed before or after a line goes with it."""
    n = len(x.first) - 1
    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[x.first])
    kept = ~gone
    size = x.stop - x.whole
    last = np.zeros(len(kept), bool)  # the last line kept of each text has no feed after it
    doc = np.repeat(np.arange(n), np.diff(x.first))
    k = np.flatnonzero(kept)
    if len(k):
        end = np.append(doc[k][1:] != doc[k][:-1], True)
        last[k[end]] = True
    feed = kept & ~last
    length = np.where(kept, size + feed, 0)
    edge = np.concatenate([[0], np.cumsum(length)])
    mask = np.zeros(len(x.data) + 1, np.int8)
    np.add.at(mask, x.whole[kept], 1)
    np.add.at(mask, (x.stop + feed)[kept], -1)
    data = x.data[np.cumsum(mask[:-1], dtype=np.int8) > 0]
    if len(data) != edge[-1]:
        raise AssertionError("lines do not add up")
    off = edge[x.first]
    valid = None if not texts.null_count else pa.array(np.asarray(texts.is_valid())).buffers()[1]
    kind = pa.large_string() if pa.types.is_large_string(texts.type) else pa.string()
    width = np.int64 if kind == pa.large_string() else np.int32
    return pa.Array.from_buffers(kind, n, [valid, pa.py_buffer(off.astype(width)), pa.py_buffer(data)], texts.null_count), lost


class Index:
    """The arrays of all distinct lines, in the shared folder; lines: what hashed() gives, stashed."""

    def __init__(self, lines: DataFrame, shard_lines: int = SHARD_LINES, probes: int = PROBES):
        known = common.stash(counts(lines))
        self.shards = max(1, -(-known.count() // shard_lines))
        self.table = common.stash(arrays(known, self.shards))
        common.unstash(known)
        #: Shards that are looked up in several parts: at most one for each `probes` lines of the corpus.
        self.busy = self.table.where(F.col("total") > probes).select("shard", F.ceil(F.col("total") / probes).cast("int").alias("parts"))


def places(lines: DataFrame, index: Index) -> DataFrame:
    """row, lines: the numbers of the lines that go, of every row that loses any."""

    def look(key, left, right):
        if not left.num_rows or not right.num_rows:
            return left.select(["row", "line"]).slice(0, 0)
        h, c = left.column("h").to_numpy().view(np.uint64), left.column("c").to_numpy().view(np.uint32)
        gone = dropped(h, c, left.column("row").to_numpy(), left.column("line").to_numpy(), Probe(right.slice(0, 1).to_pylist()[0]))
        return left.select(["row", "line"]).filter(pa.array(gone))

    busy = common.within(index.busy)
    parts = F.coalesce("parts", F.lit(1))
    lines = lines.select(_shard(index.shards).alias("shard"), "h", "c", "row", "line").join(busy, "shard", "left")
    lines = lines.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).drop("parts")  # a row's lines stay together
    copies = index.table.join(busy, "shard", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    hits = lines.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(look, "row long, line int")
    return hits.groupBy("row").agg(F.collect_list("line").alias("lines"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tally: bool = False, emptied: bool = True, shard_lines: int = SHARD_LINES, probes: int = PROBES) -> DataFrame:
    """docs with repeated lines cut from the text and n_chars, where there is one, made right again.

    tally adds the columns n_lines and n_dropped. emptied: whether documents stay that lost all they said.
    """
    names, dtypes = docs.columns, docs.dtypes
    at = names.index(text_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in dtypes) + (", n_lines int, n_dropped int" if tally else "")
    keyed, row = common.numbered(docs)
    lines = common.stash(hashed(_rows(keyed, row, id_col, text_col)))
    gone_at = common.free("__gone", [*names, row])
    found = places(lines, Index(lines, shard_lines, probes)).select(F.col("row").alias(gone_at + "_row"), F.col("lines").alias(gone_at))
    joined = keyed.join(found, keyed[row] == found[gone_at + "_row"], "left").select(*[F.col(f"`{n}`") for n in names], gone_at)

    def fn(batch):
        for lo, hi in common.blocks(batch.column(at)):
            part = batch.slice(lo, hi - lo)
            texts, lists = common.as_array(part.column(at)), part.column(len(names))
            x = split(texts)
            gone = np.zeros(len(x.start), bool)
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            gone[np.repeat(x.first[:-1], size) + lists.flatten().to_numpy(zero_copy_only=False)] = True
            text, lost = _without(x, texts, gone)
            columns = [part.column(i) for i in range(len(names))]
            columns[at] = text
            if "n_chars" in names and (i := names.index("n_chars")) != at:
                columns[i] = pc.cast(pc.utf8_length(text), columns[i].type)
            if tally:
                columns += [pa.array(np.diff(x.first).astype(np.int32)), pa.array(lost.astype(np.int32))]
            out = pa.RecordBatch.from_arrays(columns, names=[*names, *(["n_lines", "n_dropped"] if tally else [])])
            if not emptied:
                said = np.diff(np.concatenate([[0], np.cumsum((x.end > x.start) & ~gone)])[x.first])
                out = out.filter(pa.array((lost == 0) | (said > 0)))
            yield out

    return joined.mapInArrow(common.flat_map(fn), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated lines, n_lines and n_dropped of the whole table."""
    return dedup(common.load(spark, sf_dir, "documents").select("doc_id", "text"), tally=True)


OP9_SQL = """
WITH l AS (
  SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents
), e AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l
), k AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t,
    row_number() OVER (PARTITION BY trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) ORDER BY doc_id, pos) AS rn
  FROM e
), g AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE t = '' OR rn = 1) AS kept,
    count(*) AS n_lines, count(*) FILTER (WHERE t <> '' AND rn > 1) AS n_dropped
  FROM k GROUP BY doc_id
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text,
  CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped
FROM documents LEFT JOIN g USING (doc_id)
"""
