import base64

import numpy as np
import pytest
import tiktoken
from conftest import odd_rows, prose

from millrace.llm import bpe


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "x", "aab" * 999, "é" * 3000, " " * 1000 + "x", "日本語" * 500, "🙂" * 300, "\n\n \t", "it's we'll 12345 $%&", prose(1, 900), "a" * 257, "ab" * 128, "\x00\x01"]


def test_ids_against_a_known_encoder(known):
    c = bpe.codec(bpe.read_vocab(bpe.VOCAB), bpe.PATTERN)
    ids, first = c.encode(TEXTS)
    for k, t in enumerate(TEXTS):
        assert ids[first[k] : first[k + 1]].tolist() == known.encode_ordinary(t)


def plain(codec, piece):
    """Merges by scanning for the leftmost pair of least rank."""
    tok = [int(codec.single[b]) for b in piece]
    while True:
        ranks = [codec.pair.get(a << 20 | b) for a, b in zip(tok, tok[1:])]
        some = [r for r in ranks if r is not None]
        if not some:
            return tok
        i = ranks.index(min(some))
        tok[i : i + 2] = [min(some)]


def test_tree_against_scanning():
    c = bpe.codec(bpe.read_vocab(bpe.VOCAB), bpe.PATTERN)
    rng = np.random.default_rng(0)
    pieces = [bytes(rng.choice(list(b"abetin \xc3\xa9"), rng.integers(1, 70)).astype(np.uint8)) for _ in range(150)]
    ids, counts = c.encode_pieces(pieces)
    first = np.concatenate([[0], np.cumsum(counts)])
    for k, p in enumerate(pieces):
        want = plain(c, p)
        assert ids[first[k] : first[k + 1]].tolist() == want
        assert c._tree_one(p) == want


def test_round_trip_of_odd_tables(spark, odd, empty, known):
    got = bpe.encode(odd).collect()
    assert len(got) == odd.count() and all(r.round_trip for r in got)
    want = {(i, t): None if t is None else known.encode_ordinary(t) for i, t, *_ in odd_rows()}
    by_id = {i: [v for (k, _), v in want.items() if k == i] for i, _ in want}
    for r in got:
        assert r.token_ids in by_id[r.doc_id] and r.n_tokens == len(r.token_ids or [])
    back = sorted(((r.doc_id or 0), r.text or "") for r in bpe.decode(bpe.encode(odd)).collect())
    assert back == sorted((i or 0, t or "") for i, t, *_ in odd_rows())
    assert bpe.encode(empty).count() == 0 and bpe.decode(bpe.encode(empty)).count() == 0


def test_other_vocabulary_and_memory(spark, monkeypatch):
    path = bpe.VOCAB.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("multi", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(bpe.read_vocab(path))
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)  # forgetting changes nothing
    for t in TEXTS:
        assert c.encode([t])[0].tolist() == e.encode_ordinary(t)


def test_vocabulary_without_all_bytes_is_rejected():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Codec(b"YQ== 0\nYg== 1\n")
