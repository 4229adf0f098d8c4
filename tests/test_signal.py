"""Measures of decoded audio against plain versions, whatever the blocks; ranges of files, and walks by ranges."""

import math
import os
import struct
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.operators import provenance, reports, rules, series, signal, spectra, tempo
from auricle.sources import boxes, containers, mpeg, ogg, ranges, samples, tags
from tests.test_sources import wav


def pcm(x, rate, bits=16):
    """A WAV file of (frames, channels)."""
    x = np.atleast_2d(np.asarray(x, float).T).T
    if bits == 32:
        return wav(x.astype("<f4").tobytes(), bits=32, tag=3, channels=x.shape[1], rate=rate)
    return wav(np.clip(np.round(x * 32768), -32768, 32767).astype("<i2").tobytes(), channels=x.shape[1], rate=rate)


def described(spark, files):
    found = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "report_id string, content binary")
    return found, containers.formats(containers.chunks(found))


def analysed(spark, files, frames):
    found, d = described(spark, files)
    return signal.analysed(samples.from_contents(found, d, frames))


def plain_sub_blocks(x, rate, weights):
    """K-weighting sample by sample."""
    total = None
    for channel, w in zip(x.T, weights):
        y = channel
        for b0, b1, b2, a1, a2 in series.k_weighting(rate):
            out, x1, x2, y1, y2 = np.zeros(len(y)), 0.0, 0.0, 0.0, 0.0
            for i, v in enumerate(y.tolist()):
                o = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
                out[i], x1, x2, y1, y2 = o, v, x1, o, y1
            y = out
        n = signal.sub_frames(rate)
        sums = (y[: len(y) // n * n] ** 2).reshape(-1, n).sum(axis=1) * w
        total = sums if total is None else total + sums
    return total


def tone(rate, seconds, hz, level, phase=0.0):
    return level * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate + phase)


@pytest.mark.parametrize("frames", [1000, 4096, 65536])
def test_sub_blocks_equal_the_recursion_for_any_block(spark, frames):
    rng = np.random.default_rng(1)
    files = {"a": np.round(rng.normal(0, 0.1, (9001, 2)) * 32768) / 32768, "b": np.round(rng.normal(0.3, 0.01, (4000, 1)) * 32768) / 32768}
    got = signal.sub_blocks(analysed(spark, {k: pcm(v, 8000) for k, v in files.items()}, frames)).toPandas()
    for name, x in files.items():
        own = got[got["report_id"] == name].sort_values("block")["power"].to_numpy()
        np.testing.assert_allclose(own, plain_sub_blocks(x, 8000, [1] * x.shape[1]), rtol=1e-9, atol=1e-12)


def test_weights_of_known_layouts(spark):
    x = np.tile(np.round(tone(8000, 0.5, 440, 0.2) * 32768)[:, None] / 32768, (1, 6))
    names = spark.createDataFrame([("a", ["FL", "FR", "FC", "LFE", "BL", "BR"])], "report_id string, channel_names array<string>")
    got = signal.sub_blocks(analysed(spark, {"a": pcm(x, 8000)}, 1000), names).orderBy("block").toPandas()["power"].to_numpy()
    np.testing.assert_allclose(got, plain_sub_blocks(x, 8000, [1, 1, 1, 0, 1.41, 1.41]), rtol=1e-9)


def test_loudness_of_a_calibration_tone_short_silent_and_broken_files(spark):
    both = lambda x: np.stack([x, x], axis=1)
    nan = np.zeros((20000, 1))
    nan[777] = np.nan
    files = {
        "tone": pcm(both(tone(48000, 4, 997, 10 ** (-23 / 20))), 48000), "short": pcm(tone(48000, 0.3, 997, 0.1), 48000), "silent": pcm(np.zeros(48000), 48000), "nan": pcm(nan, 8000, bits=32),
        "steps": pcm(both(np.concatenate([tone(48000, 10, 1000, 10 ** (-20 / 20)), tone(48000, 10, 1000, 10 ** (-30 / 20))])), 48000),
    }
    r = {x["report_id"]: x for x in signal.loudness_of(analysed(spark, files, 65536)).collect()}
    assert abs(r["tone"]["integrated"] + 23) < 0.1 and abs(r["tone"]["momentary_max"] + 23) < 0.1 and r["tone"]["integrated_reason"] is None
    assert abs(r["steps"]["range"] - 10) < 1
    assert r["short"]["integrated"] is None and r["short"]["integrated_reason"].startswith("shorter")
    assert r["silent"]["integrated"] is None and "gate" in r["silent"]["integrated_reason"] and r["silent"]["range"] is None
    assert r["nan"]["integrated"] is None and "no numbers" in r["nan"]["integrated_reason"]


@pytest.mark.parametrize("frames", [64, 1000, 65536])
def test_true_peaks_equal_whole_file_interpolation(spark, frames):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 0.2, (3001, 2)) * 32768) / 32768
    x[-1] = 29491 / 32768  # the end of the file rings on
    got = {r["channel"]: r for r in signal.true_peaks(analysed(spark, {"a": pcm(x, 8000)}, frames)).collect()}
    for channel, own in enumerate(x.T):
        padded = np.concatenate([np.zeros(11), own, np.zeros(12)])
        want = max(abs(np.convolve(padded, row)).max() for row in signal.interpolator(8))
        assert math.isclose(got[channel]["true_peak"], max(want, abs(own).max()), rel_tol=1e-9)


def test_true_peaks_of_tones_between_samples(spark):
    fade = np.minimum(1, np.minimum(np.arange(9600), np.arange(9600)[::-1]) / 2000)  # a tone that begins at once has a step at its ends
    files = {f"{hz}-{p}": pcm(fade * tone(48000, 0.2, hz, 0.5, 2 * math.pi * p / 8), 48000) for hz in (997, 6000, 12000, 16000) for p in (0, 3)}
    for r in signal.true_peak_of(analysed(spark, files, 4096)).collect():
        assert abs(r["true_peak_dbtp"] - 20 * math.log10(0.5)) < 0.25, r
    assert [signal.phases_of(r) for r in (44100, 95999, 96000, 191999, 192000)] == [8, 8, 4, 4, 2]


# Spectra, tempo, key


def clicks(rate, seconds, bpm):
    x = np.zeros(int(rate * seconds))
    for t in np.arange(0, seconds, 60 / bpm):
        x[int(t * rate) : int(t * rate) + 80] += np.hanning(80)[: max(0, len(x) - int(t * rate))] * 0.8
    return x


def spectra_of(spark, files, frames=30000):
    found, d = described(spark, files)
    return spectra.spectra(samples.from_contents(found, d, frames, **spectra.halo()))


def test_onsets_and_notes_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 0.1, 60000) * 32768) / 32768
    rows = []
    for frames in (9000, 65536):
        s = spectra_of(spark, {"a": pcm(x, 11025)}, frames).orderBy("block").collect()
        rows.append((np.concatenate([r["onsets"] for r in s]), np.concatenate([np.array(r["notes"]).reshape(-1, 12) for r in s]), [b for r in s for b in r["bass"]]))
    np.testing.assert_allclose(rows[0][0], rows[1][0], atol=1e-9)
    np.testing.assert_allclose(rows[0][1], rows[1][1], atol=1e-9)
    assert rows[0][2] == rows[1][2]
    hop = spectra.hop_of(11025)
    level = lambda t: np.log1p(1000 * np.abs(np.fft.rfft(x[t * hop : t * hop + 1024] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1024) / 1023)))) / 1024)
    want = [0.0] + [np.maximum(level(t) - level(t - 1), 0).sum() for t in range(1, (len(x) - 1024) // hop + 1)]
    np.testing.assert_allclose(rows[0][0], want, atol=1e-9)


def test_tempos_of_click_tracks_noise_and_short_files(spark):
    rng = np.random.default_rng(4)
    files = {"90": pcm(clicks(8000, 40, 90), 8000), "128": pcm(clicks(8000, 40, 128), 8000), "noise": pcm(rng.normal(0, 0.1, 8000 * 20), 8000), "short": pcm(clicks(8000, 3, 120), 8000), "brief": pcm(clicks(8000, 9, 120), 8000)}
    r = {x["report_id"]: x for x in spectra.tempos(spectra_of(spark, files, 65536)).collect()}
    for bpm in (90, 128):
        x = r[str(bpm)]
        assert x["established"] and abs(x["bpm"] - bpm) < 1 and x["steady"] and x["confidence"] == "high" and x["placed"] == 5
    assert not r["noise"]["established"] and r["noise"]["reason"] == "not regular enough" and r["noise"]["bpm"] is None
    assert r["short"]["reason"] == "too short"
    # without windows only the whole speaks, and nothing agrees with it
    assert r["brief"]["established"] and abs(r["brief"]["bpm"] - 120) < 1 and r["brief"]["confidence"] == "low" and r["brief"]["placed"] == 0


def test_whole_signals_by_chunks_equal_one_reading(spark):
    rng = np.random.default_rng(5)
    x = np.maximum(0, np.sin(np.arange(5000) * 2 * np.pi / 100)) + rng.random(5000) * 0.3
    df = spark.createDataFrame([("a", 200.0, i, float(v)) for i, v in enumerate(x)], "report_id string, fps double, t long, onset double")
    want = tempo._read(x, 200.0)
    for chunk in (700, 10_000):
        (r,) = tempo.whole(df, ["report_id", "fps"], "t", chunk).collect()
        np.testing.assert_allclose((r["bpm"], r["correlation"], r["resolution"]), want, rtol=1e-9)


def test_reach_by_key_equals_a_fixed_reach(spark):
    df = spark.createDataFrame([(k, i, float((i * 7919 * (k + 1)) % 97)) for k in range(2) for i in range(400)], "k int, t long, v double").withColumn("reach", F.when(F.col("k") == 0, 79).otherwise(80))
    got = {(r["k"], r["t"]): r["rectified"] for r in series.rectify_by(df, ["k"], "t", "v", F.col("reach")).collect()}
    for k, reach in ((0, 79), (1, 80)):
        want = {r["t"]: r["rectified"] for r in series.rectify(df.where(F.col("k") == k), ["k"], ["t"], "v", reach).collect()}
        assert all(math.isclose(got[k, t], v, abs_tol=1e-9) for t, v in want.items())


def chord(rate, seconds, notes):
    t = np.arange(int(rate * seconds)) / rate
    return sum(np.sin(2 * np.pi * 440 * 2 ** ((n - 69) / 12) * t) * (0.15 if i else 0.2) for i, n in enumerate(notes))


def test_keys_of_progressions_and_of_noise(spark):
    c, f, g, a = (48, 60, 64, 67), (53, 65, 69, 72), (55, 67, 71, 74), (57, 69, 72, 76)
    up = lambda notes, n: tuple(x + n for x in notes)
    # C major stays home; what follows it two tones up is E major
    home = np.concatenate([chord(8000, 2, x) for x in (c, f, g, c, a, f, g, c) * 2])
    moves = np.concatenate([np.concatenate([chord(8000, 2, up(x, k)) for x in (c, f, g, c, a, f, g, c) * 2]) for k in (0, 4)])
    rng = np.random.default_rng(6)
    files = {"home": pcm(home, 8000), "moves": pcm(moves, 8000), "noise": pcm(rng.normal(0, 0.1, 8000 * 15), 8000), "silence": pcm(np.zeros(8000 * 15), 8000), "short": pcm(chord(8000, 4, c), 8000)}
    s = spectra_of(spark, files, 65536)
    r = {x["report_id"]: x for x in spectra.keys(s).collect()}
    assert r["home"]["established"] and r["home"]["name"] == "C major" and r["home"]["root"] == 0 and r["home"]["concentration"] > 0.9
    assert not r["noise"]["established"] and r["noise"]["reason"] == "no seven notes hold enough of it"
    assert r["silence"]["reason"] == "no pitched content" and r["short"]["reason"] == "too short"
    m = [(x["name"], x["sections"]) for x in spectra.key_map(s).where("report_id = 'moves'").orderBy("start_seconds").collect()]
    assert [n for n, _ in m] == ["C major", "E major"]


def test_runs_join_equal_neighbours_and_bridge_nothing(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(["x", "x", None, "x", "y", "y"])], "k string, t long, label string")
    got = [(r["label"], r["from"], r["to"], r["n"]) for r in series.runs(df, ["k"], "t", "label").orderBy("from").collect()]
    assert got == [("x", 0, 1, 2), ("x", 3, 3, 1), ("y", 4, 5, 2)]


# Ranges of files


def test_a_large_file_is_read_in_probes_only(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rng = np.random.default_rng(7)
    for name, seconds in (("long.wav", 60), ("short one.wav", 2)):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(pcm(rng.normal(0, 0.1, 48000 * seconds), 48000))
    with open(f"{folder}/note.txt", "w") as f:
        f.write("no audio")
    listed = ranges.listed(spark, f"file://{folder}")
    assert listed.count() == 2 and ranges.listed(spark, [f"file://{folder}/long.wav"]).count() == 1
    chunks = ranges.chunks(listed)
    # 64 KiB windows around headers, of files of megabytes
    assert all(r["fetched"] <= 2 * ranges.WINDOW for r in chunks.collect())
    d = containers.formats(chunks)
    plan = samples.plan(d, 65536, ceiling=1 << 20, probe_bytes=1 << 12).groupBy("report_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max(F.col("offset") + F.col("size")).alias("last"), F.min("whole").alias("whole")).collect()
    by = {os.path.basename(r["report_id"]).replace("%20", " "): r for r in plan}
    assert by["long.wav"]["n"] == 64 and by["long.wav"]["bytes"] == 64 * 4096 and not by["long.wav"]["whole"] and by["long.wav"]["last"] == os.path.getsize(f"{folder}/long.wav")
    assert by["short one.wav"]["whole"] and by["short one.wav"]["bytes"] == 2 * 48000 * 2
    found = signal.analysed(samples.from_ranges(d, 65536, ceiling=1 << 20))
    r = {os.path.basename(x["report_id"]).replace("%20", " "): x for x in signal.loudness_of(found).collect()}
    assert r["long.wav"]["integrated_reason"] == "read in probes, not whole" and r["short one.wav"]["integrated"] is not None
    # whole, by ranges, it is what the contents give
    contents = containers.files(spark, f"file://{folder}")
    a = {x["report_id"]: x["integrated"] for x in signal.loudness_of(signal.analysed(samples.from_ranges(d, 50_000))).collect()}
    b = {x["report_id"]: x["integrated"] for x in signal.loudness_of(signal.analysed(samples.from_contents(contents, d, 65536))).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_registered_families_are_found_and_walked(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/a.own", "wb") as f:
        f.write(b"OWN1" + b"partAAAA" + b"partBBBB")
    with open(f"{folder}/b.own", "wb") as f:
        f.write(b"nothing known")

    def steps(content):
        for at in range(4, len(content), 8):
            yield content[at : at + 4], at + 4, 4, 4
        return "told to stop"

    def broken(head, content):
        raise RuntimeError("not mine")

    ranges.register(ranges.Family("broken", broken, steps))
    ranges.register(ranges.Family("own", lambda head, content: head[:4] == b"OWN1", steps))
    try:
        assert ranges.registered()[:2] == ["broken", "own"]
        rows = ranges.chunks(ranges.listed(spark, f"file://{folder}", every=True)).orderBy("report_id", "ord").collect()
    finally:
        ranges.FAMILIES.clear()
    assert [(r["kind"], r["id"] and bytes(r["id"]), r["head"] and bytes(r["head"]), r["stopped"]) for r in rows] == [("own", b"part", b"AAAA", "told to stop"), ("own", b"part", b"BBBB", "told to stop"), (None, None, None, "no known family")]
    with pytest.raises(ValueError):
        ranges.register(ranges.Family("wav", broken, steps))


def test_windows_answer_like_bytes():
    data = np.random.default_rng(8).integers(0, 256, 300_000).astype(np.uint8).tobytes()
    with tempfile.NamedTemporaryFile() as f:
        f.write(data)
        f.flush()
        r = ranges.opened(f.name)
        for lo, hi in ((0, 10), (65530, 65545), (100, 200_000), (299_990, 400_000), (5, 5), (-128, -125)):
            assert r[lo:hi] == data[lo:hi]
        assert len(r) == len(data) and r[70_000] == data[70_000] and r[-1] == data[-1]
        for at in (65_533, 131_070, 250_000):
            assert r.find(data[at : at + 6]) == data.find(data[at : at + 6])
        assert r.find(b"no such bytes at all") == -1
        with pytest.raises(ValueError):
            ranges.Ranged(r.handle, 1 << 30)[0 : 1 << 29]


# MPEG, Ogg, MP4


def plain_walk(data, first, end, rate, samples_):
    at, frames, resyncs, cut = first, 0, 0, False
    while at + 4 <= end:
        h = containers.mpeg_header(data[at : at + 4])
        if not h:
            onward = next((p for p in range(at + 1, min(at + mpeg.RESYNC, end - 3)) if (x := containers.mpeg_header(data[p : p + 4])) and x[1] == rate and x[3] == samples_), None)
            if onward is None:
                break
            resyncs, at = resyncs + 1, onward
            continue
        if at + h[0] > end:
            cut = True
            break
        frames, at = frames + 1, at + h[0]
    return frames, resyncs, cut


@pytest.mark.parametrize("size", [1500, 10_000, 1 << 20])
def test_mpeg_walks_by_ranges_equal_one_walk(spark, size):
    rng = np.random.default_rng(9)
    files = {}
    for name in range(6):
        out = b"\xff\xfb\x90\0" + bytes(413) + b"\xff\xfb\x90\0" + bytes(413)
        for _ in range(60):
            head = [b"\xff\xfb\x90\0", b"\xff\xfb\xa0\0", b"\xff\xfb\x52\0"][rng.integers(3)]
            out += head + rng.integers(0, 256, containers.mpeg_header(head)[0] - 4).astype(np.uint8).tobytes()
            if rng.random() < 0.2:
                out += rng.integers(0, 256, int(rng.integers(1, 4000))).astype(np.uint8).tobytes()
        files[str(name)] = out + (b"\xff\xfb\x90\0abc" if name % 2 else b"")
    found = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "report_id string, content binary")
    for r in mpeg.walks(found, size).collect():
        data = files[r["report_id"]]
        assert (r["frames"], r["resyncs"], r["cut"]) == plain_walk(data, 0, len(data), 44100, 1152)


def test_lame_figures(spark):
    lame = b"LAME3.100" + bytes(2) + (1 << 22).to_bytes(4, "big") + bytes(6) + (576 << 12 | 1234).to_bytes(3, "big") + bytes(12)
    frame = b"\xff\xfb\x90\0" + bytes(32) + b"Info" + struct.pack(">III", 3, 77, 99_999) + lame
    data = frame + bytes(417 - len(frame)) + (b"\xff\xfb\x90\0" + bytes(413)) * 3
    (r,) = mpeg.walks(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"no audio"))], "report_id string, content binary")).collect()
    assert (r["vbr"], r["vbr_frames"], r["encoder"], r["delay"], r["padding"], r["peak"], r["frames"], r["constant"]) == ("Info", 77, "LAME3.100", 576, 1234, 0.5, 4, True)


def ogg_page(serial, number, lacing, body, granule=0, flags=0):
    return b"OggS\0" + bytes([flags]) + struct.pack("<qIII", granule, serial, number, 0) + bytes([len(lacing), *lacing]) + body


def test_comments_over_three_pages_of_interleaved_streams(spark):
    comment = b"\x03vorbis" + struct.pack("<I", 3) + b"me " + struct.pack("<I", 2) + struct.pack("<I", 606) + b"TITLE=" + b"t" * 600 + struct.pack("<I", 8) + b"ARTIST=a"
    lacing = [255] * (len(comment) // 255) + [len(comment) % 255]
    cuts = [0, 1, 2, len(lacing)]
    data = ogg_page(5, 0, [30], b"\x01vorbis" + bytes(23), flags=2) + ogg_page(6, 0, [3], b"xyz", flags=2)
    at = 0
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        n = sum(lacing[a:b])
        data += ogg_page(5, i + 1, lacing[a:b], comment[at : at + n], granule=-1 if i < 2 else 4800) + ogg_page(6, i + 1, [4], b"\x03vor")
        at += n
    found = spark.createDataFrame([("a", bytearray(data))], "report_id string, content binary")
    got = {r["key"]: r["value"] for r in tags.tags(found).where("scheme = 'vorbis'").collect()}
    assert got == {"VENDOR": "me", "TITLE": "t" * 600, "ARTIST": "a"}
    listed = ogg.pages(found)
    (p,) = ogg.packets(listed).where("serial = 5 AND packet = 1").collect()
    assert (p["size"], p["pages"], p["granule"]) == (len(comment), 3, 4800)
    assert {r["serial"]: r["packets"] for r in ogg.streams(listed).collect()} == {5: 2, 6: 4}
    # a packet that does not end is none
    assert ogg.packet(data[:-60], 6, 9) is None and ogg.packet(data, 99, 0) is None


def test_descriptors_and_configurations():
    assert boxes.audio_config(bytes([0x12, 0x10])) == (2, 44100, 2, False)
    # kind 2, a rate of its own in 24 bits, one channel
    assert boxes.audio_config((2 << 35 | 15 << 31 | 44101 << 7 | 1 << 3).to_bytes(5, "big")) == (2, 44101, 1, False)
    assert boxes.audio_config(b"") == (0, 96000, 0, False)
    stream = b"\0\1\xe0" + b"\0\0" + b"\3url" + b"\0\0" + b"\x04\x0f" + b"\x40" + bytes(12) + b"\x05\0"
    assert [t for t, _ in boxes.descriptors(b"\x03" + bytes([len(stream)]) + stream)] == [3, 4, 5]
    assert list(boxes.descriptors(b"\x03\x7f\0")) == []


# Reports


def test_reports_say_what_files_say_and_stay_silent_on_what_is_unknown(spark):
    info = b"INFO" + b"ISFT" + struct.pack("<I", 4) + b"Suno"
    chunk = lambda n, b: n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    base = pcm(tone(8000, 1.2, 500, 0.5), 8000)
    named = base + chunk(b"LIST", info)
    named = named[:4] + struct.pack("<I", len(named) - 8) + named[8:]
    files = {"plain": base, "named": named, "cut": base[:-100], "head only": base[:40], "bare": b"RIFF\4\0\0\0WAVE", "foreign": b"no audio at all"}
    found = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "report_id string, content binary")
    r = {x["report_id"]: x for x in rules.observe(rules.status(reports.from_files(found))).collect()}
    assert (r["plain"]["origin_flag"], r["plain"]["outcome"], r["plain"]["status"], list(r["plain"]["warnings"])) == ("none", "nothing-recorded", "ok", [])
    assert (r["named"]["origin_flag"], r["named"]["origin_headline"], list(r["named"]["origin_reasons"])) == ("declared", "The file says that it was made with Suno", ["Software (INFO ISFT) names Suno"])
    assert len(r["cut"]["warnings"]) == 1 and r["cut"]["status"] == "partial" and r["cut"]["integrated"] is not None
    assert r["plain"]["integrated"] is not None and abs(r["plain"]["true_peak"] - 20 * math.log10(0.5)) < 0.3
    # nothing is measured where there are no samples
    assert r["head only"]["true_peak"] is None and r["head only"]["integrated"] is None and not r["head only"]["measured"]
    assert r["bare"]["status"] == "failed" and list(r["bare"]["warnings"]) == ["no chunks"] and "foreign" not in r
    ids = {o["rule_id"] for o in r["named"]["observations"]}
    assert "possible-ai-generated" in ids and "parse-warnings" not in ids and "parse-warnings" in {o["rule_id"] for o in r["cut"]["observations"]}


def test_manifests_settle_origins(spark):
    rows = [("a", "c2pa", 0, "evidence", "labelled box"), ("a", "c2pa", 1, "source_type", "trainedalgorithmicmedia"), ("a", "c2pa", 2, "generator", "Maker 1"), ("b", "c2pa", 0, "evidence", "labelled box"), ("c", "info", 0, "ISFT", "boomy low end"), ("d", "info", 0, "ISFT", "LANDR"), ("e", "info", 0, "ICMT", "prompt: a song")]
    df = spark.createDataFrame(rows, tags.TAGS)
    r = {x["report_id"]: x for x in provenance.origins(df).collect()}
    assert (r["a"]["origin_flag"], r["a"]["origin_confidence"], r["a"]["outcome"]) == ("declared", "declared by the file", "manifest")
    assert list(r["a"]["origin_reasons"]) == ["Content Credentials claim trainedalgorithmicmedia", "Content Credentials name Maker 1"]
    assert (r["b"]["origin_flag"], r["b"]["origin_headline"]) == ("possible", "Faint signs of generation")
    assert (r["c"]["origin_flag"], list(r["c"]["origin_reasons"])) == ("possible", ["Software (INFO ISFT) has the word Boomy"])
    assert (r["d"]["origin_flag"], list(r["d"]["processing"]), r["d"]["outcome"]) == ("none", ["LANDR"], "tool-named")
    assert r["e"]["origin_flag"] == "possible" and list(r["e"]["origin_reasons"]) == ["Comment (INFO ICMT) says 'prompt:'"]


def test_broken_rules_cost_no_report(spark):
    found = spark.createDataFrame([("a", bytearray(pcm(tone(8000, 1.2, 500, 0.5), 8000))), ("b", bytearray(b"RIFF\4\0\0\0WAVE"))], "report_id string, content binary")
    r = rules.status(reports.from_files(found))
    own = [
        rules.Rule("absent", "info", lambda: F.col("no_such_column") > 1, title="x", detail="y"),
        rules.Rule("poisoned", "info", lambda: F.when(F.col("report_id") == "b", F.raise_error(F.lit("poison"))).otherwise(True).cast("boolean"), title="x", detail="y"),
        rules.Rule("sound", "info", lambda: F.col("channels") == 1, title="One channel", detail="{channels}"),
    ]
    got = {x["report_id"]: x["observations"] for x in rules.observe(r, [*rules.RULES, *own], tried=True).collect()}
    plain = {x["report_id"]: x["observations"] for x in rules.observe(r).collect()}
    assert "sound" in {o["obs_id"] for o in got["a"]}
    for key, all_ in got.items():
        errors = {o["obs_id"]: o for o in all_ if o["obs_id"].startswith("rule-error:")}
        assert set(errors) == {"rule-error:absent", "rule-error:poisoned"} and all(o["severity"] == "notice" for o in errors.values())
        assert "no_such_column" in errors["rule-error:absent"]["detail"]
        # everything else is as it is without them
        assert [(o["obs_id"], o["detail"]) for o in all_ if not o["obs_id"].startswith("rule-error:") and o["obs_id"] != "sound"] == [(o["obs_id"], o["detail"]) for o in plain[key]]


def test_pages_listed_at_once_are_those_of_the_walk():
    rng = np.random.default_rng(3)
    for _ in range(60):
        data = b""
        for i in range(int(rng.integers(1, 12))):
            lacing = rng.choice([0, 3, 40, 255], int(rng.integers(0, 5))).tolist()
            body = rng.choice([b"O", b"OggS", b"g"], sum(lacing)).tolist()
            data += ogg_page(int(rng.integers(1, 3)), i, lacing, b"".join(body)[: sum(lacing)], granule=int(rng.integers(-1, 9))) + b"junkOggS"[: int(rng.choice([0, 0, 0, 5, 8]))]
        data = data[: len(data) - int(rng.choice([0, 0, 1, 30]))]
        want = [(at, *p[:5], p[5]) for at, p in ogg.walk(data)]
        at, head, body, n, lacing = ogg.listed_pages(data)
        ends = np.cumsum(n)
        got = [(int(a), int(h["serial"]), int(h["sequence"]), int(h["flags"]), int(h["granule"]), int(b), lacing[e - k : e].tobytes()) for a, h, b, k, e in zip(at, head, body, n, ends)]
        assert got == want


def test_packets_need_no_row_for_each_lacing_value(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for serial in (1, 2):
        packet, size, pages, first = 0, 0, set(), None
        for i in range(20):
            lacing, body = rng.choice([0, 7, 255, 255], int(rng.integers(0, 6))).tolist(), i * 5000 + serial
            rows.append(("a", i * 5000, serial, i, 0, i, body, lacing, True))
            for n in lacing:
                first, size = body if first is None else first, size + n
                pages.add(i)
                body += n
                if n < 255:
                    want.append((serial, packet, size, len(pages), first, i))
                    packet, size, pages, first = packet + 1, 0, set(), None
    out = ogg.packets(spark.createDataFrame(rows, ogg.PAGES))
    assert sorted(tuple(r)[1:] for r in out.collect()) == sorted(want)
    assert "posexplode" not in _plan(out)


def test_ogg_files_are_made_page_by_page():
    """Before, what stood already was copied for every page."""
    from auricle.plans import formats

    at, head, body, n, lacing = ogg.listed_pages(b"".join(formats.ogg_file(3000)))
    assert len(at) == 2 * ((3000 * 97 // 255 + 2) // 2 + 2) and int(lacing.sum()) == 2 * (19 + 3000 * 97 + 3)
    assert head["granule"][-1] == 3000 * 48000 and set(head["serial"].tolist()) == {7, 9} and n.max() == 2


def test_many_small_files_share_batches_and_large_ones_do_not():
    kinds, names = [pa.int64(), pa.binary()], ["i", "b"]
    sizes = lambda rows: [b.num_rows for b in containers.together(rows, kinds, names)]
    assert sizes((i, b"x") for i in range(containers.ROWS + 1)) == [containers.ROWS, 1]
    assert sizes((i, bytes(containers.BYTES)) for i in range(3)) == [1, 1, 1] and sizes([]) == []


def test_states_are_scanned_without_a_python_call_for_each_channel(spark):
    x = np.random.default_rng(2).uniform(-0.5, 0.5, (5000, 2))
    one, many = (signal.sub_blocks(analysed(spark, {"a": pcm(x, 8000), "b": pcm(x[:900], 8000)}, n)) for n in (8192, 512))
    assert "FlatMapGroupsInPandas" not in _plan(many)
    a, b = ({(r["report_id"], r["block"]): r["power"] for r in d.collect()} for d in (one, many))
    assert a.keys() == b.keys() and len(a) == 7 and all(abs(a[k] - b[k]) < 1e-9 * a[k] for k in a)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_of_music_gather_a_price_an_order(spark):
    """No row for each frame is made or gathered: samples are made where their file is."""
    from auricle.plans import signals

    plan = _plan(signals.music(spark, "/root/testdata/sf0.001"))
    assert "Generate" not in plan and "Window" not in plan
    v = signals.notes(np.array([12_345, 99_999]))
    assert v.shape == (2 * signals.STEPS, 2) and v[0].tolist() == [13107, int(np.floor(0.0005 * (12_345 % 401 - 200) * 32767 + 0.5))]


def test_contents_stay_where_they_are_unless_blocks_are_many(spark, monkeypatch):
    from auricle.plans import signals

    found = shared.stored(signals.music(spark, "/root/testdata/sf0.001"), "music", 1)
    described = containers.formats(containers.chunks(found))
    cut = lambda: samples.from_contents(found, described, 4096)
    few = cut()
    assert "SortMergeJoin" not in _plan(few) and "ShuffledHashJoin" not in _plan(few)
    monkeypatch.setattr(samples, "SENT", 0)
    assert sorted(map(tuple, cut().collect())) == sorted(map(tuple, few.collect()))


def test_stored_files_are_bounded_by_rows(spark):
    s = shared.stored(spark.range(5).repartition(1), "few", 2)
    assert s.select("_metadata.file_path").distinct().count() == 3 and s.count() == 5
