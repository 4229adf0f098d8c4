"""The FLAC decoder against a small encoder that writes every kind of subframe, and what is told of files that are not decoded."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auricle.sources import containers, decoders


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [int(x) for x in format(value & (1 << n) - 1, f"0{n}b")] if n else []

    def unary(self, n):
        self.bits += [0] * n + [1]

    def bytes(self):
        return np.packbits(self.bits).tobytes()


def residual(w, r, order, size, parts, k, five, plain):
    w.put(int(five), 2)
    w.put(parts, 4)
    n, at = size >> parts, 0
    for i in range(1 << parts):
        own = r[at : at + n - (order if i == 0 else 0)]
        at += len(own)
        if plain:
            width = max([int(v).bit_length() + 1 for v in own] + [0]) if any(own) else 0
            w.put(31 if five else 15, 5 if five else 4)
            w.put(width, 5)
            for v in own:
                w.put(int(v), width)
        else:
            w.put(k, 5 if five else 4)
            for v in own:
                u = int(v) << 1 ^ int(v) >> 63
                w.unary(u >> k)
                w.put(u, k)


def subframe(w, x, depth, kind, wasted=0):
    x = [int(v) >> wasted for v in x]
    depth -= wasted
    w.put(0, 1)
    code = {"constant": 0, "verbatim": 1}.get(kind) if isinstance(kind, str) else kind
    w.put(code, 6)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.unary(wasted - 1)
    if code == 0:
        w.put(x[0], depth)
    elif code == 1:
        for v in x:
            w.put(v, depth)
    elif code < 32:
        order = code - 8
        for v in x[:order]:
            w.put(v, depth)
        residual(w, np.diff(np.array(x), order).tolist() if order else x, order, len(x), 2 if len(x) % 4 == 0 and len(x) // 4 >= order else 0, max(3, depth - 11), False, code == 9)
    else:
        order, weights, shift = code - 31, [(7 * i) % 11 - 5 for i in range(code - 31)], 2
        for v in x[:order]:
            w.put(v, depth)
        w.put(4, 4)
        w.put(shift, 5)
        for v in weights:
            w.put(v, 5)
        r = [x[i] - (sum(a * b for a, b in zip(weights, x[i - order : i][::-1])) >> shift) for i in range(order, len(x))]
        residual(w, r, order, len(x), 0, max(6, depth - 8), True, False)


def frame(number, x, depth, how, kinds, wasted=0):
    head = bytearray(b"\xff\xf8")
    head += bytes([7 << 4 | 0, how << 4 | decoders.DEPTHS.index(depth) << 1]) + chr(number).encode() + (len(x) - 1).to_bytes(2, "big")
    head.append(decoders.crc8(head))
    a, b = (x[:, 0], x[:, -1])
    if how < 8:
        own = [x[:, i] for i in range(how + 1)]
    else:
        own = {8: [a, a - b], 9: [a - b, b], 10: [a + b >> 1, a - b]}[how]
    w = Writer()
    for i, channel in enumerate(own):
        subframe(w, channel, depth + (i == {8: 1, 9: 0, 10: 1}.get(how)), kinds[i], wasted)
    raw = bytes(head) + w.bytes()
    return raw + decoders.crc16(raw).to_bytes(2, "big")


def stream(x, depth, frames, rate=8000, md5=None, total=None):
    digest = hashlib.md5(decoders.packed(x, depth)).digest() if md5 is None else md5
    packed = (rate << 44 | x.shape[1] - 1 << 41 | depth - 1 << 36 | (len(x) if total is None else total)).to_bytes(8, "big")
    info = (16).to_bytes(2, "big") + (4096).to_bytes(2, "big") + bytes(6) + packed + digest
    return b"fLaC\0\0\0\x22" + info + b"\x81\0\0\3abc" + b"".join(frames)


def signal(n, channels, depth, seed=3):
    rng = np.random.default_rng(seed)
    wave = np.sin(np.arange(n)[:, None] / (5 + np.arange(channels))) * (1 << depth - 3) + rng.normal(0, 1 << max(depth - 9, 0), (n, channels))
    return np.round(wave).astype(np.int64)


def coded(depth=16, channels=2, n=96):
    """A stream with each kind of subframe, every way of two channels, and a last frame that is shorter."""
    kinds = ["verbatim", 8, 9, 10, 11, 12, 32, 35, 63]
    x, out, raw = signal(n * len(kinds) * 4 + 40, channels, depth), [], 0
    ways = [1, 8, 9, 10] if channels == 2 else [channels - 1] * 4
    for i in range(len(kinds) * 4):
        out.append(frame(i, x[raw : raw + n], depth, ways[i % 4], [kinds[i // 4]] * channels))
        raw += n
    out.append(frame(len(out), x[raw:], depth, channels - 1, ["verbatim"] * channels))
    return x, out


@pytest.mark.parametrize("depth,channels", [(16, 2), (24, 2), (8, 1), (12, 3), (20, 2)])
def test_every_kind_of_subframe_is_read_back(depth, channels):
    x, frames = coded(depth, channels)
    a = decoders.flac(stream(x, depth, frames))
    assert (a.samples == x).all() and (a.rate, a.bits) == (8000, depth) and a.md5 == hashlib.md5(decoders.packed(x, depth)).hexdigest()


def test_constant_and_wasted_bits_and_unknown_length():
    x = np.full((64, 1), -7, np.int64)
    y = signal(64, 1, 16) << 3
    frames = [frame(0, x, 16, 0, ["constant"]), frame(1, y, 16, 0, [10], wasted=3)]
    both = np.concatenate([x, y])
    a = decoders.flac(stream(both, 16, frames, md5=bytes(16), total=0))
    assert (a.samples == both).all() and a.md5 is None


def test_damage_is_refused():
    x, frames = coded()
    whole = stream(x, 16, frames)
    rng = np.random.default_rng(0)
    for at in rng.integers(50, len(whole), 25):  # behind the description
        broken = bytearray(whole)
        broken[at] ^= 1 << int(at) % 8
        with pytest.raises((ValueError, IndexError)):
            decoders.flac(bytes(broken))
    for cut in (0, 3, 20, 60, len(whole) - 1):
        with pytest.raises((ValueError, IndexError)):
            decoders.flac(whole[:cut])
    with pytest.raises(ValueError, match="of 99999 are there"):
        decoders.flac(stream(x, 16, frames, total=99999))


def test_files_are_opened_or_a_reason_is_told(spark):
    x, frames = coded()
    good = stream(x, 16, frames)
    lies = stream(x, 16, frames, md5=b"\1" * 16)
    broken = bytearray(good)
    broken[-30] ^= 4
    body = b"WAVEfmt \x10\0\0\0\1\0\1\0" + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + b"\2\0\x10\0data\4\0\0\0\0\x40\0\x20"
    wav = b"RIFF" + len(body).to_bytes(4, "little") + body
    law = wav.replace(b"\x10\0\0\0\1\0\1\0", b"\x10\0\0\0\7\0\1\0")
    found = spark.createDataFrame([("good", good), ("lies", lies), ("broken", bytes(broken)), ("wav", wav), ("law", law)], "report_id string, content binary")
    described = containers.formats(containers.chunks(found))
    contents, plain, told = decoders.opened(found, described)
    told = {r["report_id"]: r for r in told.collect()}
    assert told["good"]["md5_holds"] is True and told["lies"]["md5_holds"] is False and told["good"]["reason"] is None
    assert told["broken"]["reason"].startswith("It could not be decoded: ") and told["law"]["reason"] == "Nothing here decodes tag 7." and "wav" not in told
    levels = {(r["report_id"], r["channel"]): r for r in containers.channel_levels(contents, plain).collect()}
    assert set(levels) == {("good", 0), ("good", 1), ("lies", 0), ("lies", 1), ("wav", 0)}
    for channel in (0, 1):
        assert levels["good", channel]["frames"] == len(x) and abs(levels["good", channel]["peak"] - abs(x[:, channel]).max() / 32768) < 1e-9
    # too long by what the file states
    told = {r["report_id"]: r["reason"] for r in decoders.opened(found, described, 1000)[2].where("decoder IS NULL").collect()}
    assert told["good"] == f"Decoded, it would take {x.size * 2} bytes; 1000 are decoded at most."
    assert decoders.opened(found.limit(0), described.limit(0))[2].count() == 0


def test_a_decoder_from_outside(spark, monkeypatch):
    monkeypatch.setattr(decoders, "DECODERS", dict(decoders.DECODERS))
    decoders.register(decoders.Decoder("law", "tag 7", lambda raw: decoders.Audio(np.array([[1], [-2]]), 8000, 8)))
    body = b"WAVEfmt \x10\0\0\0\7\0\1\0" + (8000).to_bytes(4, "little") + (8000).to_bytes(4, "little") + b"\1\0\x08\0data\2\0\0\0\0\x40"
    found = spark.createDataFrame([("law", b"RIFF" + len(body).to_bytes(4, "little") + body)], "report_id string, content binary")
    contents, plain, told = decoders.opened(found, containers.formats(containers.chunks(found)))
    assert told.first()["decoder"] == "law"
    assert containers.channel_levels(contents, plain).select("frames", F.col("peak")).first() == (2, 2 / 128)


def test_reports_measure_what_was_decoded(spark):
    from auricle.operators import export, reports, rules

    x, frames = coded()
    good = stream(x, 16, frames)
    broken = bytearray(good)
    broken[-1] ^= 4
    found = spark.createDataFrame([("good", good), ("broken", bytes(broken))], "report_id string, content binary")
    made = rules.observe(rules.status(reports.from_files(found))).persist()
    r = {x["report_id"]: x for x in made.collect()}
    assert r["good"]["source"] == "decoded" and r["good"]["codec"] == "flac" and r["good"]["measured"] and r["good"]["md5_holds"] and r["good"]["decoded_seconds"] == len(x) / 8000
    assert abs(r["good"]["peak"] - abs(x).max() / 32768) < 1e-9 and r["good"]["integrated"] is not None and r["good"]["true_peak"] >= r["good"]["peak_dbfs"]
    assert not r["broken"]["measured"] and r["broken"]["reason"] == "It could not be decoded: a frame's checksum does not hold." and r["broken"]["peak"] is None
    cells = {row["File"]: row for row in export.report_table(made).collect()}
    assert cells["good"]["Audio MD5"] == r["good"]["audio_md5"] and cells["good"]["Level measurement source"] == "decoded"
    made.unpersist()
