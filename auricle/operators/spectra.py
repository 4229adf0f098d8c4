"""Spectra of decoded audio over block borders, and the tempo and key of files that follow from them.

A frame of a spectrum belongs to the block in which it begins; blocks are read with the samples that their last frames still need, and one hop before them, so a
block's spectra depend on no other task. What leaves the task is a number for each onset frame and thirteen for each chroma frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions import display, shared
from auricle.operators import harmony, series, tempo
from auricle.sources import samples

# Frames of onsets a second, samples of their spectra and of those of notes; bounds of notes and of bass notes, and how strong a bass note is at least;
# seconds of a tempo's window and hop, of a key's section and of an ending, and the least for each; seconds over which onsets are whitened.
FPS, ONSET, NOTES = 200, 1024, 8192
LOW, HIGH, BASS_LOW, BASS_HIGH, BASS_SHARE = 65.0, 2100.0, 50.0, 260.0, 0.25
WINDOW, HOP, SECTION, ENDING = 12, 6, 30, 15
LEAST_TEMPO, LEAST_KEY = 4.0, 10.0
WHITEN = 0.4
COHERENT, STEADY = 0.5, 0.6
#: Onsets of a chunk whose products are summed by one task.
CHUNK = 4000

SPECTRA = "report_id string, sample_rate long, block long, onset_at long, onsets array<double>, notes_at long, notes array<array<double>>, bass array<int>"


def halo(onset: int = ONSET, notes: int = NOTES) -> dict[str, Column | int]:
    """What blocks need before and after them."""
    return {"before": F.greatest(F.lit(1), F.floor(F.col("sample_rate") / FPS + 0.5)), "after": max(onset, notes) - 1}


def hop_of(rate: int) -> int:
    return max(1, int(np.floor(rate / FPS + 0.5)))


def _magnitudes(x: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, size)[starts] * hann, axis=1))


def _own(row: dict, n: int, size: int, hop: int) -> tuple[int, int]:
    """The frames, from and to, that begin in a block and end in the file; n: samples that are there."""
    first, last = row["first"], min(row["first"] + row["own"] - 1, row["first"] - row["lead"] + n - size)
    return -(-first // hop), last // hop + 1


def flux(row: dict, mono: np.ndarray, size: int) -> tuple[int, np.ndarray]:
    """The number of a block's first onset frame, and the rise of log magnitudes of each since the one before; the file's first frame rises by nothing."""
    hop, base = hop_of(row["sample_rate"]), row["first"] - row["lead"]
    lo, hi = _own(row, len(mono), size, hop)
    if hi <= lo:
        return lo, np.zeros(0)
    from_ = max(0, lo - 1)
    rise = np.zeros(hi - lo)
    before = None
    for at in range(from_, hi, 256):  # some frames at a time
        m = np.log1p(1000 * _magnitudes(mono, np.arange(at, min(hi, at + 256)) * hop - base, size) / size)
        chain = m if before is None else np.vstack([before, m])
        d = np.maximum(np.diff(chain, axis=0), 0).sum(axis=1)
        begin = at + (before is None)
        rise[max(0, begin - lo) : begin - lo + len(d)] = d[max(0, lo - begin) :]
        before = m[-1:]
    return lo, rise


def notes_of(row: dict, mono: np.ndarray, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of a block's first frame of notes, the magnitude of spectral peaks by pitch class of each (frames, 12), and the pitch class of its lowest strong peak (-1: none)."""
    hop, base, rate = size // 2, row["first"] - row["lead"], row["sample_rate"]
    lo, hi = _own(row, len(mono), size, hop)
    if hi <= lo:
        return lo, np.zeros((0, 12)), np.zeros(0, int)
    m = _magnitudes(mono, np.arange(lo, hi) * hop - base, size)
    k = np.arange(2, m.shape[1] - 1)
    a, b, c = m[:, k - 1], m[:, k], m[:, k + 1]
    hz = k * rate / size
    noted, low = (hz >= LOW) & (hz <= HIGH), (hz >= BASS_LOW) & (hz <= BASS_HIGH)
    peak = (b > a) & (b >= c) & noted
    bend = a - 2 * b + c
    shift = np.divide(0.5 * (a - c), bend, out=np.zeros_like(b), where=bend != 0)
    place = np.where(np.abs(shift) <= 1, k + shift, k) * rate / size
    pitch = np.floor(69 + 12 * np.log2(place / 440.0) + 0.5).astype(int) % 12
    out = np.zeros((len(m), 12))
    at = np.nonzero(peak)
    np.add.at(out, (at[0], pitch[at]), b[at])
    strongest = np.where(low, b, 0).max(axis=1, initial=0, keepdims=True)
    strong = peak & low & (b >= strongest * BASS_SHARE) & (strongest > 0)
    first = strong.argmax(axis=1)
    rows = np.arange(len(m))
    return lo, out, np.where(strong[rows, first], pitch[rows, first], -1)


def spectra(blocks: DataFrame, onset: int = ONSET, notes: int = NOTES) -> DataFrame:
    """Onsets and notes of each block of files that are read whole, in one pass over the samples; kept in the shared folder. Blocks need halo(). A file with samples that are no numbers has NULL there."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.int32())]
    names = [x.split()[0] for x in SPECTRA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in samples.rows(batches):
            mono = samples.decoded(row).mean(axis=0)
            values = [row["report_id"], row["sample_rate"], row["block"]]
            if np.isfinite(mono).all():
                (t, rise), (u, found, bass) = flux(row, mono, onset), notes_of(row, mono, notes)
                values += [t, rise.tolist(), u, found.tolist(), bass.tolist()]
            else:
                values += [None, None, None, None, None]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    return shared.stored(blocks.where("whole").mapInArrow(run, SPECTRA), "spectra")


def onset_signal(found: DataFrame) -> DataFrame:
    """report_id, fps, t and onset: smoothed, whitened over WHITEN seconds to each side, and over its deviation."""
    hop = F.greatest(F.lit(1), F.floor(F.col("sample_rate") / FPS + 0.5))
    keys = ["report_id", "fps"]
    rows = found.where("onsets IS NOT NULL").select("report_id", (F.col("sample_rate") / hop).alias("fps"), "onset_at", F.posexplode("onsets").alias("i", "flux"))
    rows = rows.select(*keys, (F.col("onset_at") + F.col("i")).alias("t"), "flux")
    smooth = series.smooth(rows, keys, ["t"], "flux").drop("flux")
    white = series.rectify_by(smooth, keys, "t", "smooth", F.greatest(F.lit(1), F.floor(F.col("fps") * WHITEN + 0.5)))
    return series.unit_deviation(white, keys, "rectified").select(*keys, "t", F.col("scaled").alias("onset"))


def tempos(found: DataFrame) -> DataFrame:
    """For each file of spectra(): what tempo.readings says, by windows of WINDOW seconds and the whole signal; nothing is established below LEAST_TEMPO seconds."""
    keys = ["report_id", "fps"]
    signal = shared.stored(onset_signal(found), "onsets")
    length = F.floor(F.lit(WINDOW) * F.col("fps") + 0.5)
    windows = shared.stored(tempo.windows(signal, keys, "t", F.col("fps"), length, F.floor(F.lit(HOP) * F.col("fps") + 0.5)), "tempo-windows")
    whole = tempo.whole(signal, keys, "t", CHUNK)
    return tempo.established(windows, whole, keys, LEAST_TEMPO)


def tempo_map(found: DataFrame) -> DataFrame:
    """Stretches of a file at one tempo: neighbouring reliable windows whose tempos round alike, joined; a window that is not reliable ends a stretch. Only files of three
    reliable windows or more have a map."""
    keys = ["report_id", "fps"]
    signal = onset_signal(found)
    length = F.floor(F.lit(WINDOW) * F.col("fps") + 0.5)
    w = shared.stored(tempo.windows(signal, keys, "t", F.col("fps"), length, F.floor(F.lit(HOP) * F.col("fps") + 0.5)), "tempo-windows")
    reliable = tempo.placed(w, keys).withColumn("label", F.when(F.col("reliable"), F.floor(F.col("bpm") + 0.5).cast("long")))
    many = F.count("label").over(Window.partitionBy(*keys))
    joined = series.runs(w.select(*keys, "window").join(reliable.select(*keys, "window", "label", "bpm"), [*keys, "window"], "left").withColumn("n", many).where("n > 2"), keys, "window", "label", bpm=F.avg("bpm"))
    out = joined.select("report_id", (F.col("from") * HOP).cast("double").alias("start_seconds"), (F.col("to") * HOP + WINDOW).cast("double").alias("end_seconds"), "label", "bpm", F.col("n").alias("windows"))
    return out


def _pools(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report_id, fps, t, pc, magnitude) of notes and of bass notes."""
    fps = (F.col("sample_rate") / F.col("half")).alias("fps")
    own = found.where("notes IS NOT NULL")
    rows = own.select("report_id", fps, "notes_at", "bass", F.posexplode("notes").alias("i", "v")).withColumn("t", F.col("notes_at") + F.col("i"))
    notes = rows.select("report_id", "fps", "t", F.posexplode("v").alias("pc", "magnitude")).where("magnitude > 0")
    bass = rows.select("report_id", "fps", "t", F.get("bass", F.col("i")).alias("pc"), F.lit(1.0).alias("magnitude")).where("pc >= 0")
    return notes, bass


def _ranked(notes: DataFrame, bass: DataFrame, ending: DataFrame | None, keys: list[str]) -> DataFrame:
    """The four centres of each pool of notes."""
    pooled = shared.stored(harmony.shares(notes, keys), "pooled")
    low = harmony.shares(bass, keys)
    last = harmony.shares(ending if ending is not None else notes.limit(0), keys)
    return harmony.centres(pooled, low, last, harmony.collections(pooled, keys), keys)


def _name(pc: Column, mode: Column) -> Column:
    name = F.when(mode.isin("major", "minor"), display.key_name(pc, mode == "minor"))
    return F.coalesce(name, F.concat(F.get(F.array(*map(F.lit, display.MAJOR_NAMES)), pc.cast("int")), F.lit(" "), mode))


def sections(found: DataFrame, notes: int = NOTES, seconds: int = SECTION) -> DataFrame:
    """report_id, section, start_seconds, name and root of each full section of so many seconds of files with two or more; name is NULL where no collection is established."""
    n, b = _pools(found.withColumn("half", F.lit(notes // 2)))
    size = F.floor(F.lit(seconds) * F.col("fps") + 0.5)
    count = _frames(found, notes)
    cut = lambda df: df.join(count.drop("fps"), "report_id").where(F.col("frames") >= 2 * size).withColumn("section", F.floor(F.col("t") / size)).where((F.col("section") + 1) * size <= F.col("frames"))
    keys = ["report_id", "section"]
    ranked = _ranked(cut(n).drop("frames"), cut(b).drop("frames"), None, keys).where("rank = 1")
    settled = F.col("concentration") >= harmony.ESTABLISH
    root = F.pmod(F.col("pc") - F.element_at(F.map_from_arrays(F.array(*(F.lit(m) for _, m, _ in harmony.MODES)), F.array(*(F.lit(d) for d, _, _ in harmony.MODES))), F.col("mode")), F.lit(12))
    all_ = count.withColumn("size", F.floor(F.lit(seconds) * F.col("fps") + 0.5)).where(F.col("frames") >= 2 * F.col("size"))
    places = all_.select("report_id", "fps", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("frames") / F.col("size")) - 1)).alias("section"))
    own = ranked.select(*keys, F.when(settled, _name(F.col("pc"), F.col("mode"))).alias("name"), F.when(settled, root.cast("long")).alias("root"))
    return places.join(own, keys, "left").select("report_id", "section", (F.col("section") * F.col("size") / F.col("fps")).alias("start_seconds"), "name", "root")


def _frames(found: DataFrame, notes: int) -> DataFrame:
    """Frames of notes of each file, and how many a second."""
    return found.where("notes IS NOT NULL").groupBy("report_id").agg(F.sum(F.size("notes")).alias("frames"), (F.first("sample_rate") / (notes // 2)).alias("fps"))


def keys(found: DataFrame, notes: int = NOTES, seconds: int = SECTION) -> DataFrame:
    """For each file of spectra(): established, concentration, root of the collection, name, mode and tonic of the likeliest centre, alternatives (those as close, and the ordinary
    relative of a mode even where it is not), confidence, agreement of the sections, coherent, steady, starts_in, ends_in, and a reason where no key is established."""
    key = ["report_id"]
    n, b = _pools(found.withColumn("half", F.lit(notes // 2)))
    count = shared.stored(_frames(found, notes), "frames")
    last = n.join(count.drop("fps"), key).where(F.col("t") >= F.col("frames") - F.floor(F.lit(ENDING) * F.col("fps") + 0.5)).drop("frames")
    ranked = _ranked(n, b, last, key)
    each = F.struct("rank", "mode", "pc", "closeness", "concentration")
    out = ranked.groupBy("report_id").agg(F.array_sort(F.collect_list(each)).alias("c"))  # four
    top, others = F.col("c")[0], F.slice("c", 2, 3)
    close = F.filter(others, lambda x: x["closeness"] >= 1 - harmony.AMBIGUOUS)
    relative = relative_of(top["mode"])
    forced = F.when(F.exists(close, lambda x: x["mode"] == relative), F.array().cast("array<string>")).otherwise(F.transform(F.filter(others, lambda x: x["mode"] == relative), lambda x: _name(x["pc"], x["mode"])))
    alternatives = F.concat(F.coalesce(F.when(relative.isNotNull(), forced), F.array().cast("array<string>")), F.transform(close, lambda x: _name(x["pc"], x["mode"])))
    degree = F.element_at(F.map_from_arrays(F.array(*(F.lit(m) for _, m, _ in harmony.MODES)), F.array(*(F.lit(d) for d, _, _ in harmony.MODES))), top["mode"])
    out = out.select("report_id", _name(top["pc"], top["mode"]).alias("name"), top["mode"].alias("mode"), top["pc"].alias("tonic"), F.pmod(top["pc"] - degree, F.lit(12)).cast("long").alias("root"), top["concentration"].alias("concentration"), alternatives.alias("alternatives"))
    parts = sections(found, notes, seconds).where("name IS NOT NULL").join(out.select("report_id", F.col("name").alias("whole"), F.col("root").alias("of")), key)
    agreed = parts.groupBy("report_id").agg(
        F.count("*").alias("settled"), F.avg((F.col("name") == F.col("whole")).cast("int")).alias("agreement"), F.avg((F.col("root") == F.col("of")).cast("int")).alias("same_notes"),
        F.min_by("name", "section").alias("starts_in"), F.max_by("name", "section").alias("ends_in"),
    )
    out = count.join(out, key, "left").join(agreed, key, "left")
    c = F.col
    long_enough = c("frames") / c("fps") >= LEAST_KEY
    found_ = F.coalesce(long_enough & (c("concentration") >= harmony.ESTABLISH), F.lit(False))
    coherent = F.coalesce(c("same_notes") >= COHERENT, F.lit(True))
    agrees, half = F.coalesce(c("agreement") >= 0.75, F.lit(True)), F.coalesce(c("agreement") >= 0.5, F.lit(True))
    doubt = relative_of(c("mode")).isNotNull() | (F.size("alternatives") > 0)
    high, medium = c("concentration") >= harmony.HIGH, c("concentration") >= harmony.MEDIUM
    grade = F.when(~coherent, "low").when(doubt, F.when(high, "medium").otherwise("low")).when(high & agrees, "high").when(medium & half, "medium").otherwise("low")
    reason = F.when(~long_enough, "too short").when(c("concentration").isNull(), "no pitched content").when(~found_, "no seven notes hold enough of it")
    own = [F.when(found_, c(x)).alias(x) for x in ("name", "mode", "tonic", "root", "alternatives", "agreement", "starts_in", "ends_in")]
    steady = ~(F.coalesce(c("settled") >= 3, F.lit(False)) & F.coalesce(c("agreement") < STEADY, F.lit(False)))
    return out.select("report_id", found_.alias("established"), "concentration", *own, F.when(found_, grade).alias("confidence"), F.when(found_, coherent).alias("coherent"), F.when(found_, steady).alias("steady"), reason.alias("reason"))


def relative_of(mode: Column) -> Column:
    """The ordinary mode with the same notes that is likelier than a Mixolydian or Dorian reading."""
    return F.when(mode == "Mixolydian", "major").when(mode == "Dorian", "minor")


def key_map(found: DataFrame, notes: int = NOTES, seconds: int = SECTION) -> DataFrame:
    """Stretches of a file in one key: neighbouring sections of one name, joined; a section without a key ends a stretch. Only files of two named sections or more have a map."""
    s = sections(found, notes, seconds).withColumn("n", F.count("name").over(Window.partitionBy("report_id"))).where("n >= 2")
    joined = series.runs(s, ["report_id"], "section", "name", start=F.min("start_seconds"))
    return joined.select("report_id", F.col("start").alias("start_seconds"), "name", F.col("n").alias("sections"))
