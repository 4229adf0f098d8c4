import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from auricle.llm import bpe
from tests.llm.helpers import documents

RANKS = bpe.load_ranks(open(public_tokenizers.path(bpe.NAME), "rb").read())
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def same(text):
    ids = np.frombuffer(CODEC.encode(text), "<u4").tolist()
    assert ids == REAL.encode_ordinary(text)
    assert CODEC.decode(ids).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    same(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abeinrst", min_size=30, max_size=400))
def test_long_pieces_join_to_the_direct_encoding(text):
    assert CODEC.tree(text.encode()) == bpe.merge(text.encode(), RANKS)
    same(text)


@pytest.mark.parametrize("text", ["", "a" * 20_000, " " * 3000 + "x", "=-" * 2000, "é" * 999, "\x00\x1c\x85  x"])
def test_hard_texts(text):
    same(text)


def test_every_token_encodes_to_itself():
    assert all(bpe.merge(token, RANKS) == [i] for token, i in RANKS.items())


def test_rows(spark):
    rows = [(1, "Hello, world"), (2, None), (3, ""), (None, "x"), (1, "Hello, world")]
    got = bpe.digests(bpe.round_trip(documents(spark, rows))).collect()
    assert len(got) == 5
    ids = np.array(REAL.encode_ordinary("Hello, world"), "<u4").tobytes()
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["n_tokens"], one["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert bpe.round_trip(documents(spark, rows).limit(0)).count() == 0
    both = bpe.decode(bpe.encode(documents(spark, rows))).where("doc_id = 1").first()
    assert bytes(both["decoded"]) == b"Hello, world"
    assert base64.b64decode("") == b""


def test_a_frequent_piece_outlasts_new_ones(monkeypatch):
    """What is met again and again is merged once, however many pieces come between; before, all was forgotten at once."""
    monkeypatch.setattr(bpe, "MEMORY", 40)
    codec, merged = bpe.Codec(RANKS, public_tokenizers.PATTERN), []
    piece = codec.piece
    monkeypatch.setattr(codec, "piece", lambda p: merged.append(p) or piece(p))
    for i in range(200):
        assert np.frombuffer(codec.encode(f"zqxjkv 7{i}q"), "<u4").tolist() == REAL.encode_ordinary(f"zqxjkv 7{i}q")
    assert merged.count(b"zqxjkv") == 1
    assert len(codec.known) + len(codec.known.old) <= 40


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=bpe.LEAF))
def test_short_pieces(piece):
    assert bpe.merge(piece, RANKS) == REAL._encode_single_piece(piece)
