import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auricle.llm import media
from tests.llm.helpers import documents


def decoded(data):
    (j, c, rows, cols), = media.decode_all([data])
    return j, c, rows, cols


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(raw):
    data, = media.encode_all([media.padded(raw)])
    j, c, _, _ = decoded(data)
    assert media.payload_of(j, c) == media.padded(raw)
    assert len(media.padded(raw)) % 64 == 0 and media.padded(raw)


def test_many_files_in_step():
    raw = [media.padded(os.urandom(n)) for n in (0, 1, 64, 5000, 64 * 20_000)]
    files = media.encode_all(raw)
    assert files == [media.encode_all([r])[0] for r in raw]
    assert [media.payload_of(j, c) for j, c, _, _ in media.decode_all(files)] == raw


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value, f"0{n}b") if n else ""

    def bytes(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return b"".join(bytes([b]) + (b"\0" if b == 255 else b"") for b in int(text, 2).to_bytes(len(text) // 8, "big"))


def picture(interval):
    """A 4:2:0 picture of 4x2 MCUs written plainly, with runs, ends of blocks and negative numbers."""
    rng = np.random.default_rng(1)
    symbols = [0, 1, 2, 3, 4, 5, 6, 7, 8, 0x11, 0x23, 0xF0, 0x51]
    bits = [0] * 16
    bits[4] = len(symbols)
    table = media.codes(bits, symbols)
    blocks, scan, pred, out = [], b"", [0, 0, 0], Bits()
    for m in range(8):
        if interval and m and m % interval == 0:
            scan += out.bytes() + bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
            out, pred = Bits(), [0, 0, 0]
        for comp in (0, 0, 0, 0, 1, 2):
            block = np.zeros(64, int)
            block[0] = rng.integers(-60, 60)
            for at, size in ((2, 1), (5, 3)):
                block[at] = rng.choice([-1, 1]) * int(rng.integers(1 << size - 1, 1 << size))
            blocks.append(block)

            def number(v):
                n = int(abs(v)).bit_length()
                return n, int(v) if v > 0 else int(v) + (1 << n) - 1 if n else 0

            def emit(symbol, v, n):
                out.put(*table[symbol])
                out.put(v, n)

            n, v = number(block[0] - pred[comp])
            pred[comp] = block[0]
            emit(n, v, n)
            emit(0x11, number(block[2])[1], 1)
            emit(0x23, number(block[5])[1], 3)
            out.put(*table[0xF0])
            # behind the number at 5: a run of 16 zeros, five more, and a 1 at 27
            block[27] = 1
            emit(0x51, 1, 1)
            out.put(*table[0])
    scan += out.bytes()
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([8] * 64)) + media._segment(0xC0, bytes([8, 0, 32, 0, 64, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    for kind in (0x00, 0x10):
        head += media._segment(0xC4, bytes([kind, *bits, *symbols]))
    if interval:
        head += media._segment(0xDD, bytes([0, interval]))
    return head + media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9", np.array(blocks)


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_pictures_of_other_writers(interval):
    data, blocks = picture(interval)
    j, c, rows, cols = decoded(data)
    assert (j.width, j.height, rows, cols) == (64, 32, 4, 8)
    assert (c == blocks).all()
    thumb = media.thumbnail(j, c, rows, cols)
    first = [np.clip(blocks[i][0] * 8 / 8 + 128, 0, 255) for i in range(4)]
    assert [thumb[0, 0], thumb[0, 1], thumb[1, 0], thumb[1, 1]] == first
    assert len(media.thumbnail_hash(thumb)) == 16


def test_what_is_no_picture():
    with pytest.raises(ValueError):
        media.parse(b"GIF89a")
    with pytest.raises(ValueError):
        media.parse(b"\xff\xd8" + media._segment(0xC2, bytes(15)))


def test_rows(spark):
    rows = [(1, "Hello"), (2, None), (3, ""), (None, "é" * 100), (1, "Hello"), (4, "x" * 300_000)]
    out = media.round_trip(documents(spark, rows)).collect()
    assert len(out) == 6
    by = {r["doc_id"]: r for r in out}
    assert bytes(by[1]["payload"]) == b"Hello" + bytes(59) and by[1]["n_bytes"] == 5
    assert bytes(by[2]["payload"]) == bytes(64) and by[2]["media"] == by[3]["media"]
    assert len(by[4]["payload"]) == 300_032 and zlib.crc32(bytes(by[4]["payload"][-64:])) == zlib.crc32(b"x" * 32 + bytes(32))
    again = media.read_media(media.store_texts(documents(spark, rows)).drop("n_bytes")).where("doc_id = 1").first()
    assert bytes(again["payload"]) == bytes(by[1]["payload"])
    assert media.round_trip(documents(spark, rows).limit(0)).count() == 0
