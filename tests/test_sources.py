"""Containers of every family, built byte by byte, and damaged ones."""

import struct
import tempfile

import numpy as np
import pytest

from auricle.operators import provenance
from auricle.sources import containers, tags


def wav(samples, bits=16, tag=1, channels=2, rate=48000, cut=0):
    width = bits // 8 * channels
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * width, width, bits)
    body = b"WAVE" + b"JUNK" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(samples)) + samples
    return (b"RIFF" + struct.pack("<I", len(body)) + body)[: -cut or None]


def flac(rate=44100, channels=2, bits=16, total=441000):
    packed = (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | total).to_bytes(8, "big")
    return b"fLaC" + b"\x80\0\0\x22" + bytes(10) + packed + bytes(16) + b"\xff\xf8frames"


def ogg(granule=480312, skip=312):
    def page(kind, g, payload):
        return b"OggS\0" + bytes([kind]) + struct.pack("<qIII", g, 77, 0, 0) + b"\1" + bytes([len(payload)]) + payload

    return page(2, 0, b"OpusHead\1\2" + struct.pack("<HI", skip, 48000) + b"\0\0\0") + page(4, granule, b"x" * 50)


def mp4(scale=44100, length=441000, long=False):
    """A video track first, then an audio track; long: times in 64 bits."""
    box = lambda n, b: struct.pack(">I", len(b) + 8) + n + b
    hdlr = lambda k: box(b"hdlr", bytes(8) + k + bytes(13))
    times = b"\1\0\0\0" + bytes(16) + struct.pack(">IQ", scale, length) if long else bytes(12) + struct.pack(">II", scale, length)
    stsd = box(b"stsd", bytes(4) + struct.pack(">I", 1) + box(b"mp4a", bytes(6) + b"\0\1" + bytes(8) + struct.pack(">HHHHI", 2, 16, 0, 0, scale << 16)))
    video = box(b"trak", box(b"mdia", box(b"mdhd", bytes(12) + struct.pack(">II", 600, 99)) + hdlr(b"vide")))
    audio = box(b"trak", box(b"mdia", box(b"mdhd", times + bytes(4)) + hdlr(b"soun") + box(b"minf", box(b"stbl", stsd))))
    return box(b"ftyp", b"M4A \0\0\0\0") + box(b"moov", video + audio) + box(b"mdat", bytes(64))


def rifx(samples, rate=8000):
    fmt = struct.pack(">HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    body = b"WAVE" + b"fmt " + struct.pack(">I", 16) + fmt + b"data" + struct.pack(">I", len(samples)) + samples
    return b"RIFX" + struct.pack(">I", len(body)) + body


def rf64(samples, rate=48000):
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    ds64 = struct.pack("<QQQI", 1000, len(samples), len(samples) // 2, 0)
    return b"RF64\xff\xff\xff\xffWAVE" + b"ds64" + struct.pack("<I", 28) + ds64 + b"fmt " + struct.pack("<I", 16) + fmt + b"data\xff\xff\xff\xff" + samples


def aiff(samples, frames, kind=None, offset=0, rate=8000):
    exponent = rate.bit_length() - 1
    extended = struct.pack(">HQ", 16383 + exponent, rate << 63 - exponent)
    comm = struct.pack(">hIh", 1, frames, 16) + extended + (kind + b"\0\0" if kind else b"")
    ssnd = struct.pack(">II", offset, 0) + bytes([127]) * offset + samples
    body = (b"AIFC" if kind else b"AIFF") + b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", len(ssnd)) + ssnd
    return b"FORM" + struct.pack(">I", len(body)) + body


def mp3(frames, xing=None, tag=b""):
    frame = b"\xff\xfb\x90\x00" + bytes(413)  # version 1, layer 3, 128 kilobits, 44.1 kHz, stereo: 417 bytes
    first = b"\xff\xfb\x90\x00" + bytes(32) + b"Xing" + struct.pack(">II", 1, xing) + bytes(413 - 44) if xing else frame
    return tag + first + frame * (frames - 1)


def table(spark, files):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "report_id string, content binary")


def test_formats(spark):
    rng = np.random.default_rng(0)
    pcm = (rng.uniform(-1, 1, 2000) * 30000).astype("<i2").tobytes()
    files = {"wav": wav(pcm), "cut": wav(pcm, cut=400), "flac": flac(), "ogg": ogg(), "mp4": mp4(), "text": b"not audio at all", "short": b"RI", "none": None, "head": b"RIFF\0\0\0\0WAVE"}
    got = {r["report_id"]: r for r in containers.formats(containers.chunks(table(spark, files))).collect()}
    assert set(got) == {"wav", "cut", "flac", "ogg", "mp4"}
    pick = lambda k: tuple(got[k][c] for c in ("sample_rate", "channels", "bit_depth", "frames"))
    assert pick("wav") == (48000, 2, 16, 1000) and got["wav"]["shortfall"] == 0
    assert pick("cut") == (48000, 2, 16, 900) and got["cut"]["shortfall"] == 400
    assert pick("flac") == (44100, 2, 16, 441000) and got["flac"]["seconds"] == 10
    assert pick("ogg") == (48000, 2, None, 480000) and got["ogg"]["seconds"] == 10
    assert (got["mp4"]["sample_rate"], got["mp4"]["seconds"], got["mp4"]["channels"]) == (44100, 10, 2)


def test_byte_orders_wide_sizes_offsets_and_tracks(spark):
    up, down = np.arange(0, 800, 100, ">i2").tobytes(), np.arange(0, 800, 100, "<i2").tobytes()
    id3 = b"ID3\4\0\0\0\0\1\0" + bytes(128)
    files = {"rifx": rifx(up), "rf64": rf64(down), "aiff": aiff(up, 8, offset=4), "sowt": aiff(down, 8, b"sowt"), "long": mp4(long=True), "tagged": id3 + flac(), "mp3": mp3(10), "vbr": mp3(3, xing=1000), "id3": mp3(5, tag=id3), "noise": b"\xff\xfb\x90\x00" + b"x" * 900}
    t = table(spark, files)
    described = containers.formats(containers.chunks(t))
    got = {r["report_id"]: r for r in described.collect()}
    pick = lambda k: tuple(got[k][c] for c in ("sample_rate", "channels", "bit_depth", "frames"))
    assert pick("rifx") == (8000, 1, 16, 8) and got["rifx"]["shortfall"] == 0
    assert pick("rf64") == (48000, 1, 16, 8) and got["rf64"]["shortfall"] == 0
    assert pick("aiff") == pick("sowt") == (8000, 1, 16, 8)
    assert got["long"]["seconds"] == 10 and got["long"]["sample_rate"] == 44100 and got["long"]["codec"] == "mp4a"
    assert pick("tagged") == (44100, 2, 16, 441000)
    assert pick("mp3") == (44100, 2, None, 10 * 1152) and pick("vbr")[3] == 1000 * 1152 and pick("id3")[3] == 5 * 1152
    assert "noise" not in got
    levels = {r["report_id"]: r for r in containers.channel_levels(t, described).collect()}
    assert set(levels) == {"rifx", "rf64", "aiff", "sowt"}
    for r in levels.values():
        assert r["peak"] == pytest.approx(700 / 32768) and r["frames"] == 8 and r["peak_frame"] == 7


def test_runs_at_full_scale_go_on_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(containers, "BLOCK", 8)
    loud, rng = np.iinfo(np.int16).max, np.random.default_rng(4)
    files, want = {}, {}
    for k in range(12):
        x = np.where(rng.random(60) < 0.85, loud, 0)
        runs = [len(r) for r in "".join("1" if v else "0" for v in x).split("0")]
        files[str(k)], want[str(k)] = wav(x.astype("<i2").tobytes(), channels=1), max(runs)
    t = table(spark, files)
    sums = [x for k, f in files.items() for x in containers.block_sums(k, f, {"bit_depth": 16, "channels": 1, "data_offset": f.index(b"data") + 8, "data_bytes": 120, "frames": 60, "is_float": False, "little": True, "kind": "wav"})]
    assert len(sums) == 12 * 8 and sum(s[9] for s in sums) == sum((np.frombuffer(f[-120:], "<i2") == loud).sum() for f in files.values())
    got = {r["report_id"]: r["longest_run"] for r in containers.channel_levels(t, containers.formats(containers.chunks(t))).collect()}
    assert got == want


@pytest.mark.parametrize(("bits", "tag", "dtype", "scale"), [(8, 1, "u1", 128), (16, 1, "<i2", 2**15), (24, 1, None, 2**23), (32, 1, "<i4", 2**31), (32, 3, "<f4", 1), (64, 3, "<f8", 1)])
def test_samples(spark, bits, tag, dtype, scale):
    x = np.sin(np.arange(300) / 7.0) * 0.5
    if bits == 24:
        q = np.rint(x * scale).astype(np.int64)
        raw = b"".join(int(v & 0xFFFFFF).to_bytes(3, "little") for v in q)
    else:
        raw = (np.rint(x * scale) + (128 if bits == 8 else 0) if tag == 1 else x).astype(dtype).tobytes()
    t = table(spark, {"f": wav(raw, bits, tag, channels=1)})
    r = containers.channel_levels(t, containers.formats(containers.chunks(t))).first()
    assert r["frames"] == 300 and r["non_finite"] == 0
    assert r["peak"] == pytest.approx(abs(x).max(), abs=2 / 128 if bits == 8 else 1e-4)
    assert r["rms"] == pytest.approx(np.sqrt((x * x).mean()), abs=2 / 128 if bits == 8 else 1e-4)


def test_samples_that_are_not_finite(spark):
    t = table(spark, {"f": wav(np.array([np.nan, 0.5, np.inf, -0.75], "<f4").tobytes(), 32, 3, channels=1), "g": wav(np.full(4, np.nan, "<f4").tobytes(), 32, 3, channels=1)})
    got = {r["report_id"]: r for r in containers.channel_levels(t, containers.formats(containers.chunks(t))).collect()}
    assert (got["f"]["non_finite"], got["f"]["peak"], got["f"]["peak_frame"]) == (2, 0.75, 3)
    assert got["g"]["peak"] is None and got["g"]["rms"] is None


def tags_of(content, kind):
    return [tuple(x) for x in tags.of_file(content, kind)]


def id3(version, frames, flags=0):
    safe = lambda n: bytes(n >> 7 * i & 127 for i in (3, 2, 1, 0))
    body = b""
    for name, value in frames:
        size = struct.pack(">I", len(value))[1:] if version == 2 else safe(len(value)) if version == 4 else struct.pack(">I", len(value))
        body += name + size + (b"" if version == 2 else b"\0\0") + value
    return b"ID3" + bytes([version, 0, flags]) + safe(len(body) + 20) + body + bytes(20)


@pytest.mark.parametrize("version", [2, 3, 4])
def test_id3(version):
    title, comment, user = (b"TT2", b"COM", b"TXX") if version == 2 else (b"TIT2", b"COMM", b"TXXX")
    tag = id3(version, [(title, b"\0Old"), (title, b"\1" + "Né".encode("utf-16")), (comment, b"\0engshort\0Long text"), (user, b"\3mood\0calm"), (b"APC" if version == 2 else b"APIC", b"x" * 300)])
    old = b"TAG" + b"One".ljust(30, b"\0") + b"Two".ljust(30, b" ") + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\7" + b"\1"
    assert tags_of(tag + mp3(3) + old, "mp3") == [
        ("id3v2", title.decode(), "Old"), ("id3v2", title.decode(), "Né"), ("id3v2", comment.decode(), "Long text"), ("id3v2", "TXXX:mood", "calm"),
        ("id3v1", "title", "One"), ("id3v1", "artist", "Two"), ("id3v1", "date", "1999"), ("id3v1", "comment", "note"), ("id3v1", "track", "7"),
    ]
    for n in range(0, len(tag), 7):  # any cut is read without failing
        tags_of(tag[:n], "mp3")


def test_broadcast_extension_and_xml():
    body = b"A take".ljust(256, b"\0") + b"Desk".ljust(32, b"\0") + bytes(32) + b"2024-01-02" + b"03:04:05" + struct.pack("<QH", 48000 * 3600, 2) + bytes(64) + struct.pack("<hhhhh", -2300, 550, -100, 0x7FFF, -1850) + bytes(180) + b"A=PCM"
    chunk = lambda n, b: n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    riff = b"WAVE" + chunk(b"bext", body) + chunk(b"iXML", b"<BWFXML><TAKE>7</TAKE></BWFXML>")
    got = tags_of(b"RIFF" + struct.pack("<I", len(riff)) + riff, "wav")
    assert ("bext", "description", "A take") in got and ("bext", "time_reference", str(48000 * 3600)) in got and ("bext", "coding_history", "A=PCM") in got
    assert ("bext", "loudness_value", "-23.00") in got and ("bext", "max_short_term", "-18.50") in got and not any(k == "max_momentary" for _, k, _ in got)
    assert got[-1] == ("ixml", "xml", "<BWFXML><TAKE>7</TAKE></BWFXML>")


def test_itunes_vorbis_and_caf():
    box = lambda n, b: struct.pack(">I", len(b) + 8) + n + b
    item = lambda n, code, v: box(n, box(b"data", struct.pack(">II", code, 0) + v))
    free = box(b"----", box(b"mean", bytes(4) + b"com") + box(b"name", bytes(4) + b"iTunSMPB") + box(b"data", struct.pack(">II", 1, 0) + b" 0 1 2 3"))
    ilst = box(b"ilst", item(b"\xa9nam", 1, "Tïtle".encode()) + item(b"trkn", 0, b"\0\0\0\3\0\x0c\0\0") + item(b"tmpo", 21, b"\0\x80") + free)
    moov = box(b"moov", box(b"udta", box(b"meta", bytes(4) + ilst)))
    assert tags_of(box(b"ftyp", b"M4A \0\0\0\0") + moov, "mp4") == [("itunes", "©nam", "Tïtle"), ("itunes", "trkn", "3/12"), ("itunes", "tmpo", "128"), ("itunes", "iTunSMPB", "0 1 2 3")]
    info = struct.pack(">I", 2) + b"title\0One\0artist\0Two\0"
    assert tags_of(b"caff\0\1\0\0info" + struct.pack(">Q", len(info)) + info, "caf") == [("caf", "title", "One"), ("caf", "artist", "Two")]
    note = lambda b: struct.pack("<I", len(b)) + b
    comments = note(b"maker") + struct.pack("<I", 3) + note(b"title=A=B") + note(b"Artist=") + note(b"ARTIST=X")
    assert tags_of(b"fLaC\x84" + struct.pack(">I", len(comments))[1:] + comments, "flac") == [("vorbis", "VENDOR", "maker"), ("vorbis", "TITLE", "A=B"), ("vorbis", "ARTIST", "X")]


def test_loops_tempo_tracks_and_manifests(spark):
    chunk = lambda n, b: n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    smpl = struct.pack("<IIIIIIIII", 0, 0, 22675, 60, 0, 0, 0, 2, 0) + struct.pack("<IIIIII", 1, 0, 10, 99, 0, 0) + struct.pack("<IIIIII", 2, 0, 5, 7, 0, 0)
    acid = struct.pack("<IHHIIHHf", 2, 57, 0, 0, 8, 4, 3, 93.5)
    chna = struct.pack("<HHH", 1, 1, 1) + b"ATU_00000001" + b"AT_00031001_01" + b"AP_00031001" + b"\0"
    claim = b"....jumb....jumdc2pa\0" + b'{"claim_generator": "Maker/1.0", "digitalSourceType": "http://x/compositeWithTrainedAlgorithmicMedia"}'
    body = b"WAVE" + chunk(b"smpl", smpl) + chunk(b"acid", acid) + chunk(b"chna", chna) + chunk(b"C2PA", claim)
    content = b"RIFF" + struct.pack("<I", len(body)) + body
    assert tags_of(content, "wav") == [
        ("smpl", "sample_ns", "22675"), ("smpl", "unity_note", "60"), ("loop", "1", "10-99"), ("loop", "2", "5-7"),
        ("acid", "one_shot", "false"), ("acid", "root_note", "57"), ("acid", "beats", "8"), ("acid", "metre", "3/4"), ("acid", "tempo", "93.5"),
        ("chna", "ATU_00000001", "1 AT_00031001_01 AP_00031001"),
        ("c2pa", "evidence", "labelled box"), ("c2pa", "source_type", "trainedalgorithmicmedia"), ("c2pa", "source_type", "compositewithtrainedalgorithmicmedia"), ("c2pa", "source_type", "algorithmicmedia"), ("c2pa", "generator", "Maker/1.0"),
    ]
    (r,) = provenance.manifests(tags.tags(table(spark, {"a": content, "b": wav(bytes(8))}))).collect()
    assert (r["report_id"], r["kinds"], r["generative"], r["generator"]) == ("a", ["compositewithtrainedalgorithmicmedia"], True, "Maker/1.0")


def test_fields_across_schemes(spark):
    tag = id3(3, [(b"TIT2", b"\0First"), (b"TIT2", b"\0Last")])
    old = b"TAG" + b"Older".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(30) + bytes(4) + bytes(30) + b"\1"
    t = table(spark, {"a": tag + mp3(3) + old, "b": b"", "c": None, "d": b"RIFF\4\0\0\0WAVE"})
    assert {tuple(r) for r in tags.fields(tags.tags(t)).collect()} == {("a", "title", "Last"), ("a", "artist", "Band")}


def test_folders_are_filtered_by_extension(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for name in ("a.wav", "b.WAV", "c.txt"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(wav(bytes(8)))
    assert containers.files(spark, f"file://{folder}").count() == 2
