"""Byte-level BPE encoding and decoding (operator 10).

Texts are cut into pieces by the vocabulary's pattern; each distinct piece is encoded once per
task and looked up afterwards. A piece is encoded on a segment tree over its byte positions: leaf
i holds (rank of the pair that begins at byte i, i), an inner node the smaller of its children, so
the root is the leftmost pair of least rank. A merge changes the leaves of the pair, of its live
left neighbour and of the swallowed right half, each a logarithmic point update. Pieces of up to
VECTOR_BYTES go through the tree together, as rows of one matrix per tree size; a longer piece has
a tree of its own, so one of a million bytes costs n log n.

Defined results: null text -> null ids, n_tokens 0, round_trip true; empty text -> empty ids; of pairs of
one rank the leftmost merges first; rows are kept one for one, repeated or not, in any number; a null
doc_id stays null; ids are whole numbers; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VECTOR_BYTES = 256
#: Pieces that a worker remembers; beyond it the memory starts afresh (speed only, not results).
CACHE_PIECES = 150_000
_NONE = np.int64(1) << np.int64(62)
_SCHEMA = "doc_id long, token_ids array<int>, n_tokens int, round_trip boolean"
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Codec:
    """Encoder and decoder for a file of `base64 rank` lines."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        self.find = regex.compile(pattern).findall
        pairs = [line.split() for line in ranks.splitlines() if line]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.rank.values()) + 1
        by_id = [b""] * size
        for token, i in self.rank.items():
            by_id[i] = token
        self.tokens = by_id
        self.size = np.array([len(t) for t in by_id], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pair = {}
        for token, i in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    self.pair[a << 20 | b] = i
        self._hash_pairs()
        self._forget()

    def _hash_pairs(self) -> None:
        bits = max(8, int(np.ceil(np.log2(len(self.pair) * 3 + 2))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        k = np.fromiter(self.pair, np.int64, len(self.pair))
        v = np.fromiter(self.pair.values(), np.int64, len(self.pair))
        slot = ((k.astype(np.uint64) * _MUL) >> self.shift).astype(np.int64)
        while len(k):
            free = keys[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[one]
            keys[slot[take]], values[slot[take]] = k[take], v[take]
            rest = np.ones(len(k), bool)
            rest[take] = False
            k, v, slot = k[rest], v[rest], (slot[rest] + 1) & self.mask
        self.keys, self.values = keys, values

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where they do not merge."""
        k = a << 20 | b
        slot = ((k.astype(np.uint64) * _MUL) >> self.shift).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == k, self.values[slot], -1)
        open_ = np.flatnonzero((got != k) & (got >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            got = self.keys[slot[open_]]
            hit = got == k[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.firsts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _tree_rows(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode rows of bytes, padded to a power of two: ids one row after another, and counts."""
        n, width = rows.shape
        bits = np.int64(width.bit_length() - 1)
        tok = self.single[rows].ravel()
        place = np.arange(width)
        live = place[None, :] < sizes[:, None]
        after = np.where(place[None, :] + 1 < sizes[:, None], place[None, :] + 1, width).ravel()
        before = np.tile(place - 1, n)
        tree = np.full((n, 2 * width), _NONE, np.int64)
        if width > 1:
            r = np.where(live[:, 1:], self.ranks_of(tok.reshape(n, width)[:, :-1].ravel(), tok.reshape(n, width)[:, 1:].ravel()).reshape(n, width - 1), -1)
            tree[:, width : 2 * width - 1] = np.where(r >= 0, r << bits | place[:-1], _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = live.ravel()
        tree = tree.ravel()
        row = np.arange(n)
        while True:
            root = tree[row * (2 * width) + 1]
            going = root < _NONE
            row, root = row[going], root[going]
            if not len(row):
                break
            base, leaf = row * width, row * (2 * width) + width
            i = root & (width - 1)
            new = root >> bits
            j = after[base + i]
            k = after[base + j]
            tok[base + i] = new
            live[base + j] = False
            after[base + i] = k
            right = k < width
            before[(base + k)[right]] = i[right]
            h = before[base + i]
            left = h >= 0
            both = self.ranks_of(np.concatenate([new, tok[base + np.maximum(h, 0)]]), np.concatenate([tok[base + np.minimum(k, width - 1)], new]))
            here, there = both[: len(i)], both[len(i) :]
            tree[leaf + j] = _NONE
            tree[leaf + i] = np.where(right & (here >= 0), here << bits | i, _NONE)
            tree[(leaf + h)[left]] = np.where(there >= 0, there << bits | h, _NONE)[left]
            top = row * (2 * width)
            up = [(i + width) >> 1, (j + width) >> 1, (np.maximum(h, 0) + width) >> 1]
            for _ in range(int(bits)):
                for u in up:
                    child = top + 2 * u
                    tree[top + u] = np.minimum(tree[child], tree[child + 1])
                up = [u >> 1 for u in up]
        return tok[live].astype(np.int32), live.reshape(n, width).sum(axis=1)

    def _tree_one(self, piece: bytes) -> list[int]:
        """The same for one long piece, on plain lists."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        tok = self.single[np.frombuffer(piece, np.uint8)].tolist()
        none = 1 << 62
        bits = width.bit_length()
        tree = [none] * (2 * width)
        get = self.pair.get
        for i in range(n - 1):
            r = get(tok[i] << 20 | tok[i + 1])
            if r is not None:
                tree[width + i] = r << bits | i
        for u in range(width - 1, 0, -1):
            tree[u] = min(tree[2 * u], tree[2 * u + 1])
        after, before = [*range(1, n + 1)], [*range(-1, n)]

        def put(leaf: int, value: int) -> None:
            u = width + leaf
            tree[u] = value
            u >>= 1
            while u:
                least = min(tree[2 * u], tree[2 * u + 1])
                if tree[u] == least:
                    break
                tree[u] = least
                u >>= 1

        while tree[1] < none:
            i = tree[1] & ((1 << bits) - 1)
            j = after[i]
            tok[i] = tree[1] >> bits
            tok[j] = -1
            k = after[i] = after[j]
            put(j, none)
            r = None
            if k < n:
                before[k] = i
                r = get(tok[i] << 20 | tok[k])
            put(i, none if r is None else r << bits | i)
            h = before[i]
            if h >= 0:
                r = get(tok[h] << 20 | tok[i])
                put(h, none if r is None else r << bits | h)
        return [t for t in tok if t >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        counts, found = np.zeros(len(pieces), np.int64), []
        low, width = 0, 1
        while width <= VECTOR_BYTES:
            which = np.flatnonzero((size > low) & (size <= width))
            step = max(1, (1 << 19) // width)
            for part in (which[a : a + step] for a in range(0, len(which), step)):
                cell = start[part][:, None] + np.arange(width)
                rows = data[np.minimum(cell, len(data) - 1)]
                ids, counts[part] = self._tree_rows(rows, size[part])
                found.append((part, ids))
            low, width = width, width * 2
        for p in np.flatnonzero(size > VECTOR_BYTES).tolist():
            ids = np.array(self._tree_one(pieces[p]), np.int32)
            counts[p] = len(ids)
            found.append((np.array([p]), ids))
        first = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(first[-1], np.int32)
        for part, ids in found:
            c = counts[part]
            begin = np.concatenate([[0], np.cumsum(c)])
            out[np.repeat(first[part] - begin[:-1], c) + np.arange(begin[-1])] = ids
        return out, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        pieces: list[str] = []
        ends = []
        for t in texts:
            if t:
                pieces += self.find(t)
            ends.append(len(pieces))
        if len(self.index) > CACHE_PIECES:
            self._forget()
        new = [p for p in dict.fromkeys(pieces) if p not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            ids, counts = self.encode_pieces([p.encode() for p in new])
            self.ids = np.concatenate([self.ids, ids])
            self.firsts = np.concatenate([self.firsts, self.firsts[-1] + np.cumsum(counts)])
        which = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        begin = self.firsts[which]
        count = self.firsts[which + 1] - begin
        first = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - first[:-1], count) + np.arange(first[-1])]
        return ids, first[np.concatenate([[0], ends]).astype(np.int64)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after another, and where each id's end."""
        size = self.size[ids]
        first = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.at[ids] - first[:-1], size) + np.arange(first[-1])], first


@lru_cache(2)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def read_vocab(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocab: str = VOCAB, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids, n_tokens and round_trip (the decoded ids equal the text) of every row."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocab(vocab))  # a public vocabulary: under 2 MB

    def fn(batch):
        c = codec(ranks.value, pattern)
        for lo, hi in common.blocks(batch.column(1), 2 << 20):
            part = common.as_array(batch.column(1)).slice(lo, hi - lo)
            ids, first = c.encode(part.to_pylist())
            data, ends = c.decode(ids)
            was, off = common.utf8(part)
            same = np.full(hi - lo, len(was) == len(data) and bool((was == data).all()))
            if not same.all():
                same = np.array([np.array_equal(was[off[r] : off[r + 1]], data[ends[first[r]] : ends[first[r + 1]]]) for r in range(hi - lo)])
            null = part.is_null()
            offsets = pa.array(first.astype(np.int32), mask=np.append(np.asarray(null), False) if part.null_count else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(np.diff(first).astype(np.int32)), pa.array(same)],
                names=["doc_id", "token_ids", "n_tokens", "round_trip"],
            )

    return common.only(docs, id_col, text_col).mapInArrow(common.flat_map(fn), _SCHEMA)


def decode(tokens: DataFrame, vocab: str = VOCAB, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and text of every row; null ids give a null text, bytes that are not UTF-8 the replacement character."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_vocab(vocab))

    def fn(batch):
        c = codec(ranks.value, PATTERN)
        lists = batch.column(1)
        texts = [None if x is None else c.decode(np.array(x, np.int64))[0].tobytes().decode("utf-8", "replace") for x in lists.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.selectExpr(f"cast(`{id_col}` as long) id", f"`{ids_col}` ids").mapInArrow(common.flat_map(fn), "doc_id long, text string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.load(spark, sf_dir, "documents"))
