"""Queries over music that Spark makes from the orders: files of a few thousand orders each are written as containers, read back in blocks, and measured."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auricle.functions import display, shared
from auricle.operators import export, gating, harmony, reports, rules, series, signal, spectra, tempo
from auricle.sources import containers, samples

#: Orders (by key) of a file, frames of an order, frames a second; frames of a chord, of a click and between clicks.
KEYS, STEPS, RATE = 4000, 32, 4000
CHORD, CLICK, BEAT = 2000, 20, 2000
ROOTS = [261.6255653005986, 349.2282314330039, 391.99543598174927, 440.0]
#: Frames of a block: two of them do not fill a file. Samples of the spectra of onsets and of notes, and seconds of a key's section: small, for the SQL beside them.
FRAMES, ONSET, NOTES, SECTION = 50_000, 64, 512, 10
#: Files (of half a MB) that are stored together.
TOGETHER = 8


def notes(cents: np.ndarray) -> np.ndarray:
    """(frames, 2): both channels' samples as numbers of 16 bits, from a file's prices in cents: chords whose loudness follows the price, clicks on every beat, and noise."""
    g, j = np.arange(len(cents) * STEPS), np.tile(np.arange(STEPS), len(cents))
    cents = np.repeat(cents, STEPS)
    turn = 2 * math.pi * np.array(ROOTS)[g // CHORD % len(ROOTS)] * g / RATE
    loud = 0.5 + np.fmod(cents, 1000) / 2000
    left = 0.2 * loud * np.sin(turn) + 0.1 * np.sin(turn * 0.5) + 0.1 * np.sin(turn * 1.5) + np.where(g % BEAT < CLICK, 0.4 * (1 - 2 * (g % 2)), 0.0)
    right = 0.0005 * (np.fmod(cents * (2 * j + 1), 401) - 200)
    return np.floor(np.stack([left, right], axis=1) * 32767 + 0.5).astype(np.int16)


def container(body: bytes, big: bool) -> bytes:
    """A stereo file of 16-bit samples: AIFF where they are big-endian, else WAV."""
    u, n = lambda v, w: v.to_bytes(w, "big" if big else "little"), len(body)
    if not big:
        return b"RIFF" + u(n + 36, 4) + b"WAVEfmt " + u(16, 4) + u(1, 2) + u(2, 2) + u(RATE, 4) + u(RATE * 4, 4) + u(4, 2) + u(16, 2) + b"data" + u(n, 4) + body
    # the rate as an 80-bit number: exponent 16383 + 11, mantissa RATE * 2^52
    return b"FORM" + u(n + 46, 4) + b"AIFFCOMM" + u(18, 4) + u(2, 2) + u(n // 4, 4) + u(16, 2) + u(0x400A, 2) + u(RATE << 52, 8) + b"SSND" + u(n + 8, 4) + u(0, 8) + body


def music(spark, sf_dir):
    """A stereo file for every KEYS order keys: WAV or, for odd ones, AIFF. What is gathered for one is a price an order; samples are made in the task that makes their file, one file at a time."""
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cents")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(F.col("o_orderkey") / KEYS).alias("part"), "o_orderkey", cents)
    each = o.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "cents"))).alias("v")).select("part", F.transform("v", lambda x: x["cents"]).alias("cents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in containers.single(batches):
            part, big = b.column("part")[0].as_py(), b.column("part")[0].as_py() % 2 == 1
            body = notes(b.column("cents").flatten().to_numpy()).astype(">i2" if big else "<i2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([f"music-{part}"]), pa.array([container(body, big)], pa.binary())], ["report_id", "content"])

    return each.mapInArrow(run, "report_id string, content binary")


def _blocks(spark, sf_dir, **halo):
    found = shared.stored(music(spark, sf_dir), "music", TOGETHER)  # its chunks and its blocks are read
    described = containers.formats(containers.chunks(found))
    return samples.from_contents(found, described, FRAMES, **halo)


def file_loudness(spark, sf_dir):
    """Loudness of each file from its container's bytes."""
    out = signal.loudness_of(signal.analysed(_blocks(spark, sf_dir)))
    figures = [F.round(c, 4).alias(c) for c in ("seconds", "integrated", "range", "momentary_max", "short_term_max")]
    return out.select("report_id", *figures, "gated_blocks", "total_blocks", "integrated_reason", "range_reason")


def file_true_peaks(spark, sf_dir):
    """Sample peak and true peak of each channel of each file."""
    out = signal.true_peaks(signal.analysed(_blocks(spark, sf_dir)))
    return out.select("report_id", F.col("channel").cast("long").alias("channel"), F.round("sample_peak", 6).alias("sample_peak"), F.round("true_peak", 6).alias("true_peak"), F.col("oversampling").cast("long").alias("oversampling"))


def _spectra(spark, sf_dir):
    return spectra.spectra(_blocks(spark, sf_dir, **spectra.halo(ONSET, NOTES)), ONSET, NOTES)


def file_onsets(spark, sf_dir):
    """The onset signal of each file: spectral flux, smoothed and whitened."""
    return spectra.onset_signal(_spectra(spark, sf_dir)).select("report_id", "t", F.round("onset", 4).alias("onset"))


def file_notes(spark, sf_dir):
    """How much of each pitch class the spectral peaks of each file hold, and how often it is the lowest strong one."""
    notes, bass = spectra._pools(_spectra(spark, sf_dir).withColumn("half", F.lit(NOTES // 2)))
    low = bass.groupBy("report_id", "pc").agg(F.count("*").alias("bass"))
    return notes.groupBy("report_id", "pc").agg(F.sum("magnitude").alias("m")).join(low, ["report_id", "pc"], "full").select("report_id", F.col("pc").cast("long").alias("pc"), F.round("m", 2).alias("magnitude"), F.coalesce("bass", F.lit(0).cast("long")).alias("bass"))


def file_tempo(spark, sf_dir):
    """The tempo of each file, from its container's bytes."""
    t = spectra.tempos(_spectra(spark, sf_dir))
    return t.select("report_id", "established", *(F.round(c, 3).alias(c) for c in ("bpm", "correlation", "agreement")), "confidence", "wanders", "steady", "placed", "reason")


def file_key(spark, sf_dir):
    """The key of each file, from its container's bytes."""
    k = spectra.keys(_spectra(spark, sf_dir), NOTES, SECTION)
    return k.select("report_id", "established", F.round("concentration", 5).alias("concentration"), "name", F.col("root").cast("long").alias("root"), F.array_join("alternatives", ", ").alias("alternatives"), F.round("agreement", 5).alias("agreement"), "confidence", "coherent", "steady", "starts_in", "ends_in", "reason")


def tempo_map(spark, sf_dir):
    return spectra.tempo_map(_spectra(spark, sf_dir)).select("report_id", "start_seconds", "end_seconds", "label", F.round("bpm", 3).alias("bpm"), "windows")


def key_map(spark, sf_dir):
    return spectra.key_map(_spectra(spark, sf_dir), NOTES, SECTION).select("report_id", F.round("start_seconds", 4).alias("start_seconds"), "name", "sections")


#: Columns that file_table shows.
TABLE = ["File", "Read result", "Container", "Sample rate (Hz)", "Channels", "Sample frames", "Byte order", "Levels measured from", "Integrated loudness (LUFS)", "Loudness range (LU)", "True peak (dBTP)", "Short-term max (LUFS)", "Momentary max (LUFS)", "Measured BPM", "Tempo confidence", "Tempo steady", "Likely key", "Key confidence", "How tonal"]


def file_table(spark, sf_dir):
    """The table of reports of the files, from their bytes to its cells: loudness, true peak, tempo and key among them."""
    found = shared.stored(music(spark, sf_dir), "music", TOGETHER)
    r = reports.with_music(rules.observe(rules.status(reports.from_files(found))), spectra.spectra(samples.from_contents(found, containers.formats(containers.chunks(found)), FRAMES, **spectra.halo(ONSET, NOTES)), ONSET, NOTES), NOTES, SECTION)
    return export.report_table(r).select(*(F.col(f"`{x}`") for x in TABLE))


QUERIES = {f.__name__: f for f in (file_table, file_loudness, file_true_peaks, file_onsets, file_notes, file_tempo, file_key, tempo_map, key_map)}

N_SQL = f"""o AS (SELECT o_orderkey // {KEYS} AS part, floor(o_totalprice * 100 + 0.5)::BIGINT AS cents, row_number() OVER (PARTITION BY o_orderkey // {KEYS} ORDER BY o_orderkey) - 1 AS i FROM orders),
  j AS (SELECT part, cents, j, i * {STEPS} + j AS g FROM o, range({STEPS}) r(j)), tn AS (SELECT *, 2 * pi() * ({ROOTS})[(g // {CHORD}) % {len(ROOTS)} + 1]::DOUBLE * g / {RATE} AS turn, 0.5 + (cents % 1000)::DOUBLE / 2000 AS loud FROM j),
  n AS (SELECT 'music-' || part AS report_id, g, floor((0.2::DOUBLE * loud * sin(turn) + 0.1::DOUBLE * sin(turn * 0.5) + 0.1::DOUBLE * sin(turn * 1.5) + CASE WHEN g % {BEAT} < {CLICK} THEN 0.4::DOUBLE * (1 - 2 * (g % 2)) ELSE 0 END) * 32767 + 0.5) / 32768 AS a,
    floor(0.0005::DOUBLE * ((cents * (2 * j + 1)) % 401 - 200) * 32767 + 0.5) / 32768 AS b FROM tn),
  ch AS (SELECT report_id, 0 AS channel, g, a AS x FROM n UNION ALL SELECT report_id, 1, g, b FROM n)"""
(_B0, _B1, _B2, _A1, _A2), (_, _, _, _C1, _C2) = series.k_weighting(RATE)
_SUB = signal.sub_frames(RATE)
_Y = f"{_B0!r}::DOUBLE * b.x + {_B1!r}::DOUBLE * a.x + {_B2!r}::DOUBLE * a.x1 - ({_A1!r}::DOUBLE) * a.y - ({_A2!r}::DOUBLE) * a.y1"
_LU = lambda p: f"CASE WHEN {p} > 0 THEN -0.691::DOUBLE + 10 * log10({p}) ELSE '-inf'::DOUBLE END"


def _gate(blocks: str, relative: float) -> str:
    return f"SELECT *, ({_LU('avg(p) FILTER (l > -70) OVER (PARTITION BY report_id)')}) + {relative} AS gate FROM (SELECT *, {_LU('p')} AS l FROM {blocks})"


#: The recursion itself, sample by sample: a fold over each channel's list, which keeps the sum of each sub-block when it is full.
K_SQL = f"""ls AS (SELECT report_id, channel, count(*) AS n, list({{'i': g, 'x': x, 'x1': 0::DOUBLE, 'y': 0::DOUBLE, 'y1': 0::DOUBLE, 'z': 0::DOUBLE, 'z1': 0::DOUBLE, 's': 0::DOUBLE, 'l': []::DOUBLE[]}} ORDER BY g) AS v FROM
    (SELECT * FROM ch UNION ALL SELECT report_id, channel, max(g) + 1, 0 FROM ch GROUP BY ALL) GROUP BY ALL),
  fo AS (SELECT report_id, list_reduce(list_prepend({{'i': -1::BIGINT, 'x': 0::DOUBLE, 'x1': 0::DOUBLE, 'y': 0::DOUBLE, 'y1': 0::DOUBLE, 'z': 0::DOUBLE, 'z1': 0::DOUBLE, 's': 0::DOUBLE, 'l': []::DOUBLE[]}}, v), lambda a, b: {{'i': b.i, 'x': b.x, 'x1': a.x, 'y': {_Y}, 'y1': a.y,
    'z': {_Y} - 2 * a.y + a.y1 - ({_C1!r}::DOUBLE) * a.z - ({_C2!r}::DOUBLE) * a.z1, 'z1': a.z, 's': CASE WHEN b.i % {_SUB} = 0 THEN 0 ELSE a.s + a.z * a.z END,
    'l': CASE WHEN b.i % {_SUB} = 0 AND b.i > 0 THEN list_append(a.l, a.s + a.z * a.z) ELSE a.l END}}).l AS l FROM ls),
  sb AS (SELECT report_id, k, sum(p) AS p FROM (SELECT report_id, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM fo) GROUP BY ALL),
  mo AS (SELECT report_id, p / {4 * _SUB} AS p FROM (SELECT report_id, k, sum(p) OVER (PARTITION BY report_id ORDER BY k ROWS 3 PRECEDING) AS p FROM sb) WHERE k >= 4),
  st AS (SELECT report_id, p / {30 * _SUB} AS p FROM (SELECT report_id, k, sum(p) OVER (PARTITION BY report_id ORDER BY k ROWS 29 PRECEDING) AS p FROM sb) WHERE k >= 30),
  mg AS ({_gate('mo', gating.RELATIVE_GATE)}), sg AS ({_gate('st', gating.RANGE_GATE)}),
  mi AS (SELECT report_id, {_LU('avg(p) FILTER (l > -70 AND l > gate)')} AS integrated, count(*) FILTER (l > -70 AND l > gate) AS gated, count(*) AS total, max(l) AS top FROM mg GROUP BY 1),
  so AS (SELECT report_id, list(l ORDER BY l) FILTER (l > -70 AND l > gate) AS ks, max(l) AS top, count(*) AS c FROM sg GROUP BY 1),
  sr AS (SELECT report_id, top, c, CASE WHEN len(ks) >= 2 THEN ks[floor((len(ks) - 1) * 0.95 + 0.5)::INT + 1] - ks[floor((len(ks) - 1) * 0.10 + 0.5)::INT + 1] END AS lu FROM so)"""
_HOP = spectra.hop_of(RATE)
_FPS = RATE / _HOP


def _spectra_sql(name: str, size: int, hop: int) -> str:
    """Magnitudes (report_id, t, k, m) of the frames that fit into each file, as dot products with sines and cosines."""
    return f"""{name}h AS (SELECT list(0.5 - 0.5 * cos(2 * pi() * i / {size - 1}) ORDER BY i) AS h FROM range({size}) r(i)),
  {name}w AS (SELECT k, list(cos(2 * pi() * ((k * i) % {size}) / {size}) ORDER BY i) AS c, list(sin(2 * pi() * ((k * i) % {size}) / {size}) ORDER BY i) AS s FROM range({size // 2 + 1}) a(k), range({size}) b(i) GROUP BY k),
  {name}f AS (SELECT report_id, t, list(x * h[(g - t * {hop} + 1)::INT] ORDER BY g) AS v FROM (SELECT report_id, g, (a + b) / 2 AS x, unnest(generate_series(greatest(0, (g - {size} + {hop}) // {hop}), g // {hop})) AS t FROM n), {name}h GROUP BY report_id, t HAVING count(*) = {size}),
  {name} AS (SELECT report_id, t, k, sqrt(list_dot_product(v, c) ** 2 + list_dot_product(v, s) ** 2) AS m FROM {name}f, {name}w)"""


#: Onsets as file_onsets has them, not rounded: o (report_id, t, v).
O_SQL = f"""{_spectra_sql('om', ONSET, _HOP)}, ol AS (SELECT report_id, t, ln(1 + 1000 * m / {ONSET}) AS l, lag(ln(1 + 1000 * m / {ONSET})) OVER (PARTITION BY report_id, k ORDER BY t) AS p FROM om),
  of AS (SELECT report_id, t, coalesce(sum(greatest(0.0, l - p)), 0) AS f FROM ol GROUP BY ALL), os AS (SELECT report_id, t, 0.25 * lag(f, 1, 0.0) OVER w + 0.5 * f + 0.25 * lead(f, 1, 0.0) OVER w AS f FROM of WINDOW w AS (PARTITION BY report_id ORDER BY t)),
  ow AS (SELECT report_id, t, greatest(0.0, f - avg(f) OVER (PARTITION BY report_id ORDER BY t ROWS BETWEEN {round(_FPS * spectra.WHITEN)} PRECEDING AND {round(_FPS * spectra.WHITEN)} FOLLOWING)) AS v FROM os),
  o2 AS (SELECT report_id, t, CASE WHEN stddev_pop(v) OVER (PARTITION BY report_id) > 0 THEN v / stddev_pop(v) OVER (PARTITION BY report_id) ELSE v END AS v FROM ow)"""
_W, _H = int(spectra.WINDOW * _FPS), int(spectra.HOP * _FPS)
_LOW, _HIGH = int(60 * _FPS // tempo.MAX_BPM), int(-(-60 * _FPS // tempo.MIN_BPM))
#: Readings of all windows, and of the whole (window -1): rd; the windows folded: fw (bpm, reliable, pulse); what is said of a file: te.
T_SQL = f"""{O_SQL}, tw AS (SELECT report_id, w, t, v - avg(v) OVER p AS c, count(*) OVER p AS n FROM (SELECT report_id, t, v, unnest(generate_series(greatest(0, (t - {_W} + {_H}) // {_H}), t // {_H})) AS w FROM o2 UNION ALL SELECT report_id, t, v, -1 FROM o2) WINDOW p AS (PARTITION BY report_id, w)),
  tl AS (SELECT report_id, w, list(c ORDER BY t) AS l, sum(c * c) AS e, any_value(n) AS n FROM tw WHERE w = -1 OR n = {_W} GROUP BY 1, 2),
  ta AS (SELECT report_id, w, lag, list_dot_product(l[1:(n - lag)::INT], l[(lag + 1)::INT:]) / (n - lag) / (e / n) AS r FROM tl, (SELECT unnest(range({_LOW}, {_HIGH + 1}))::BIGINT AS lag) WHERE e > 0 AND lag <= n - 2 AND least(n - 2, {_HIGH}) > {_LOW + 2}),
  ts AS (SELECT a.*, round((a.r + 0.5 * coalesce(b.r, 0)) * exp(-0.5 * (log2(60 * {_FPS} / a.lag / {tempo.CENTRE_BPM}) / {tempo.OCTAVES}) ** 2), 12) AS score, lag(a.r) OVER w AS r0, lead(a.r) OVER w AS r2 FROM ta a LEFT JOIN ta b ON b.report_id = a.report_id AND b.w = a.w AND b.lag = 2 * a.lag WINDOW w AS (PARTITION BY a.report_id, a.w ORDER BY a.lag)),
  tb AS (SELECT report_id, w, arg_max(lag, (score, -lag)) AS lag, arg_max(r, (score, -lag)) AS r, arg_max({{'a': r0, 'b': r2}}, (score, -lag)) AS q, max(score) AS score FROM ts GROUP BY 1, 2),
  td AS (SELECT *, CASE WHEN q.a IS NOT NULL AND q.b IS NOT NULL AND q.a - 2 * r + q.b <> 0 THEN 0.5 * (q.a - q.b) / (q.a - 2 * r + q.b) ELSE 0 END AS d FROM tb WHERE score > 0),
  rd AS (SELECT tl.report_id, tl.w, tl.n, 60 * {_FPS} / (lag + CASE WHEN abs(d) <= 1 THEN d ELSE 0 END) AS bpm, r AS correlation, 60 * {_FPS} / lag - 60 * {_FPS} / (lag + 1) AS resolution FROM tl LEFT JOIN td USING (report_id, w)),
  rf AS (SELECT report_id, list_sort(list(bpm))[count(*) // 2 + 1] AS reference, list_sort(list(correlation))[count(*) // 2 + 1] AS wc FROM rd WHERE w >= 0 AND bpm IS NOT NULL GROUP BY 1),
  fo1 AS (SELECT *, abs(log2(bpm / reference)) AS d0, CASE WHEN bpm / 2 BETWEEN {tempo.MIN_BPM} AND {tempo.MAX_BPM} THEN abs(log2(bpm / 2 / reference)) END AS d1, CASE WHEN bpm * 2 BETWEEN {tempo.MIN_BPM} AND {tempo.MAX_BPM} THEN abs(log2(bpm * 2 / reference)) END AS d2 FROM rd JOIN rf USING (report_id) WHERE w >= 0 AND bpm IS NOT NULL),
  fw AS (SELECT *, correlation >= {tempo.ESTABLISH} AS pulse, correlation >= {tempo.ESTABLISH} AND abs(b - reference) / reference < {tempo.RELIABLE} AS reliable FROM (SELECT *, CASE WHEN d0 <= coalesce(d1, d0) AND d0 <= coalesce(d2, d0) THEN bpm WHEN coalesce(d1, 99) <= coalesce(d2, 99) THEN bpm / 2 ELSE bpm * 2 END AS b FROM fo1)),
  fc AS (SELECT report_id, list_sort(list(b))[count(*) // 2 + 1] AS centre FROM fw GROUP BY 1),
  fg AS (SELECT report_id, centre, count(*) AS placed, count(*) FILTER (abs(b - centre) / centre <= {tempo.TOLERANCE}) / count(*) AS agreement, count(*) FILTER (reliable) AS nr, count(*) FILTER (pulse) AS np, max(b) FILTER (reliable) - min(b) FILTER (reliable) AS sr, max(b) FILTER (pulse) - min(b) FILTER (pulse) AS sp FROM fw JOIN fc USING (report_id) GROUP BY 1, 2),
  te AS (SELECT w.report_id, w.n / {_FPS} AS seconds, w.bpm AS ob, w.resolution, coalesce(rf.wc, w.correlation) AS correlation, coalesce(agreement, 0) AS agreement, centre, coalesce(placed, 0) AS placed, coalesce(agreement, 0) < {tempo.WANDERS} AS wd, nr, np, sr, sp FROM rd w LEFT JOIN fg USING (report_id) LEFT JOIN rf USING (report_id) WHERE w.w = -1),
  tf AS (SELECT *, coalesce(seconds >= {spectra.LEAST_TEMPO} AND ob IS NOT NULL AND correlation >= {tempo.ESTABLISH}, false) AS ok, coalesce(CASE WHEN wd THEN np ELSE nr END >= 3, false) AS many, coalesce(CASE WHEN wd THEN sp ELSE sr END > greatest(2 * resolution, 1.5), false) AS wide FROM te)"""
_PC = "(floor(69 + 12 * log2(hz / 440.0) + 0.5)::BIGINT % 12 + 12) % 12"
_NFPS = RATE / (NOTES // 2)
_SIZE, _LAST = int(SECTION * _NFPS + 0.5), int(spectra.ENDING * _NFPS + 0.5)
_PLACE = f"(k + CASE WHEN p0 - 2 * m + p2 <> 0 AND abs(0.5 * (p0 - p2) / (p0 - 2 * m + p2)) <= 1 THEN 0.5 * (p0 - p2) / (p0 - 2 * m + p2) ELSE 0 END) * {RATE / NOTES}"
#: Peaks (pk), notes (no) and bass notes (ba) of every frame.
P_SQL = f"""{_spectra_sql('nm', NOTES, NOTES // 2)}, pn AS (SELECT *, lag(m) OVER w AS p0, lead(m) OVER w AS p2, max(CASE WHEN k BETWEEN 2 AND {NOTES // 2 - 1} AND k * {RATE / NOTES} BETWEEN {spectra.BASS_LOW} AND {spectra.BASS_HIGH} THEN m END) OVER (PARTITION BY report_id, t) AS strongest FROM nm WINDOW w AS (PARTITION BY report_id, t ORDER BY k)),
  pk AS (SELECT *, {_PLACE} AS hz FROM pn WHERE k BETWEEN 2 AND {NOTES // 2 - 1} AND m > p0 AND m >= p2 AND k * {RATE / NOTES} BETWEEN {spectra.LOW} AND {spectra.HIGH}),
  no AS (SELECT report_id, t, {_PC} AS pc, m FROM pk), ba AS (SELECT report_id, t, {_PC} AS pc FROM (SELECT report_id, t, arg_min(hz, k) AS hz FROM pk WHERE k * {RATE / NOTES} <= {spectra.BASS_HIGH} AND m >= {spectra.BASS_SHARE} * strongest GROUP BY 1, 2))"""
_NAME = lambda pc, mode: f"CASE WHEN {mode} = 'minor' THEN ({display.MINOR_NAMES})[{pc} + 1] ELSE ({display.MAJOR_NAMES})[{pc} + 1] END || ' ' || {mode}"
#: Ranked centres of the whole (section -1) and of each section: rk.
R_SQL = f"""{P_SQL}, fr AS (SELECT report_id, count(*) AS frames FROM nmf GROUP BY 1),
  sc AS (SELECT report_id, t, -1 AS s FROM nmf UNION ALL SELECT report_id, t, t // {_SIZE} FROM nmf JOIN fr USING (report_id) WHERE frames >= {2 * _SIZE} AND (t // {_SIZE} + 1) * {_SIZE} <= frames),
  po AS (SELECT report_id, s, pc, sum(m) / sum(sum(m)) OVER (PARTITION BY report_id, s) AS share FROM no JOIN sc USING (report_id, t) GROUP BY 1, 2, 3),
  pb AS (SELECT report_id, s, pc, count(*) / sum(count(*)) OVER (PARTITION BY report_id, s) AS bass FROM ba JOIN sc USING (report_id, t) GROUP BY 1, 2, 3),
  pe AS (SELECT report_id, -1 AS s, pc, sum(m) / sum(sum(m)) OVER (PARTITION BY report_id) AS ending FROM no JOIN fr USING (report_id) WHERE t >= frames - {_LAST} GROUP BY 1, 3),
  co AS (SELECT report_id, s, arg_max(root, (score, -root)) AS root, max(score) AS concentration FROM (SELECT report_id, s, root, round(sum(share), 9) AS score FROM (SELECT report_id, s, share, (pc - unnest({harmony.SCALE_STEPS}) + 12) % 12 AS root FROM po) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  mo_(degree, mode, prior, o) AS (VALUES {", ".join(f"({d}, '{m}', {p}::DOUBLE, {i})" for i, (d, m, p) in enumerate(harmony.MODES))}),
  ce AS (SELECT report_id, s, root, concentration, mode, o, pc, round(({harmony.OVERALL}::DOUBLE * coalesce(share, 0) + {harmony.BASS}::DOUBLE * coalesce(bass, 0) + {harmony.END}::DOUBLE * coalesce(ending, 0)) * prior, 9) AS score FROM (SELECT *, (root + degree) % 12 AS pc FROM co, mo_) LEFT JOIN po USING (report_id, s, pc) LEFT JOIN pb USING (report_id, s, pc) LEFT JOIN pe USING (report_id, s, pc)),
  rk AS (SELECT *, row_number() OVER w AS rank, CASE WHEN first_value(score) OVER w > 0 THEN score / first_value(score) OVER w END AS closeness, {_NAME('pc', 'mode')} AS name FROM ce WINDOW w AS (PARTITION BY report_id, s ORDER BY score DESC, o)),
  se AS (SELECT report_id, s, name, root FROM rk WHERE s >= 0 AND rank = 1 AND concentration >= {harmony.ESTABLISH})"""
_PHASES = signal.interpolator(signal.phases_of(RATE))
ORACLE = {
    "file_loudness": f"""WITH {N_SQL}, {K_SQL}, le AS (SELECT report_id, count(*) / {RATE} AS seconds FROM n GROUP BY 1)
      SELECT report_id, round(seconds, 4) AS seconds, round(integrated, 4) AS integrated, round(lu, 4) AS "range", round(mi.top, 4) AS momentary_max, round(sr.top, 4) AS short_term_max, gated AS gated_blocks, total AS total_blocks,
        CASE WHEN total IS NULL THEN 'shorter than a block of 400 ms' WHEN integrated IS NULL THEN 'every block lies below the gate' END AS integrated_reason, CASE WHEN coalesce(c, 0) < 2 THEN 'too few blocks of three seconds' WHEN lu IS NULL THEN 'too few blocks above the gate' END AS range_reason
      FROM le LEFT JOIN mi USING (report_id) LEFT JOIN sr USING (report_id)""",
    "file_true_peaks": f"""WITH {N_SQL}, t(p, j, w) AS (VALUES {", ".join(f"({p}, {j}, {w!r}::DOUBLE)" for p, row in enumerate(_PHASES.tolist()) for j, w in enumerate(row))}),
      o8 AS (SELECT report_id, channel, p, g + j AS at, sum(x * w) AS y FROM ch, t GROUP BY ALL), q AS (SELECT report_id, channel, max(abs(y)) AS tp FROM o8 GROUP BY ALL), s AS (SELECT report_id, channel, max(abs(x)) AS sp FROM ch GROUP BY ALL)
      SELECT report_id, channel, round(sp, 6) AS sample_peak, round(greatest(sp, tp), 6) AS true_peak, {len(_PHASES)} AS oversampling FROM s JOIN q USING (report_id, channel)""",
    "file_onsets": f"WITH {N_SQL}, {O_SQL} SELECT report_id, t, round(v, 4) AS onset FROM o2",
    "file_notes": f"""WITH {N_SQL}, {P_SQL}, a AS (SELECT report_id, pc, sum(m) AS m FROM no GROUP BY 1, 2), b AS (SELECT report_id, pc, count(*) AS n FROM ba GROUP BY 1, 2)
      SELECT report_id, pc, round(m, 2) AS magnitude, coalesce(n, 0) AS bass FROM a FULL JOIN b USING (report_id, pc)""",
    "file_tempo": f"""WITH {N_SQL}, {T_SQL} SELECT report_id, ok AS established, round(CASE WHEN ok THEN CASE WHEN many THEN centre ELSE ob END END, 3) AS bpm, round(CASE WHEN seconds >= {spectra.LEAST_TEMPO} THEN correlation END, 3) AS correlation, round(CASE WHEN ok THEN agreement END, 3) AS agreement,
      CASE WHEN NOT ok THEN NULL WHEN wd THEN 'low' WHEN correlation >= {tempo.HIGH[0]} AND agreement >= {tempo.HIGH[1]} THEN 'high' WHEN correlation >= {tempo.MEDIUM[0]} AND agreement >= {tempo.MEDIUM[1]} THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN ok THEN wd END AS wanders, CASE WHEN ok THEN NOT wd AND NOT (many AND wide) END AS steady, placed,
      CASE WHEN seconds < {spectra.LEAST_TEMPO} THEN 'too short' WHEN ob IS NULL THEN 'no repeating pulse' WHEN NOT ok THEN 'not regular enough' END AS reason FROM tf""",
    "file_key": f"""WITH {N_SQL}, {R_SQL}, t AS (SELECT * FROM rk WHERE s = -1 AND rank = 1),
      al AS (SELECT rk.report_id, string_agg(rk.name, ', ' ORDER BY rk.closeness < {1 - harmony.AMBIGUOUS} DESC, rk.rank) AS names FROM rk JOIN t USING (report_id) WHERE rk.s = -1 AND rk.rank > 1 AND (rk.closeness >= {1 - harmony.AMBIGUOUS} OR rk.mode = CASE t.mode WHEN 'Mixolydian' THEN 'major' WHEN 'Dorian' THEN 'minor' END) GROUP BY 1),
      ag AS (SELECT report_id, count(*) AS settled, avg((se.name = t.name)::INT) AS agreement, avg((se.root = t.root)::INT) AS notes, arg_min(se.name, se.s) AS starts_in, arg_max(se.name, se.s) AS ends_in FROM se JOIN t USING (report_id) GROUP BY 1),
      u AS (SELECT fr.report_id, frames / {_NFPS} >= {spectra.LEAST_KEY} AS long, concentration, coalesce(frames / {_NFPS} >= {spectra.LEAST_KEY} AND concentration >= {harmony.ESTABLISH}, false) AS ok, name, t.mode, root, coalesce(names, '') AS names, settled, agreement, coalesce(notes >= {spectra.COHERENT}, true) AS coherent, starts_in, ends_in FROM fr LEFT JOIN t USING (report_id) LEFT JOIN al USING (report_id) LEFT JOIN ag USING (report_id))
      SELECT report_id, ok AS established, round(concentration, 5) AS concentration, CASE WHEN ok THEN name END AS name, CASE WHEN ok THEN root END AS root, CASE WHEN ok THEN names END AS alternatives, CASE WHEN ok THEN round(agreement, 5) END AS agreement,
        CASE WHEN NOT ok THEN NULL WHEN NOT coherent THEN 'low' WHEN mode IN ('Mixolydian', 'Dorian') OR names <> '' THEN CASE WHEN concentration >= {harmony.HIGH} THEN 'medium' ELSE 'low' END WHEN concentration >= {harmony.HIGH} AND coalesce(agreement, 1) >= 0.75 THEN 'high' WHEN concentration >= {harmony.MEDIUM} AND coalesce(agreement, 1) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN ok THEN coherent END AS coherent, CASE WHEN ok THEN NOT (coalesce(settled, 0) >= 3 AND coalesce(agreement, 1) < {spectra.STEADY}) END AS steady, CASE WHEN ok THEN starts_in END AS starts_in, CASE WHEN ok THEN ends_in END AS ends_in, CASE WHEN NOT long THEN 'too short' WHEN concentration IS NULL THEN 'no pitched content' WHEN NOT ok THEN 'no seven notes hold enough of it' END AS reason FROM u""",
    "tempo_map": f"""WITH {N_SQL}, {T_SQL}, lb AS (SELECT r.report_id, r.w, CASE WHEN reliable THEN floor(b + 0.5)::BIGINT END AS label, b, count(CASE WHEN reliable THEN 1 END) OVER (PARTITION BY r.report_id) AS n FROM rd r LEFT JOIN fw ON fw.report_id = r.report_id AND fw.w = r.w WHERE r.w >= 0),
      ru AS (SELECT *, sum(new) OVER (PARTITION BY report_id ORDER BY w) AS run FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY report_id ORDER BY w) THEN 0 ELSE 1 END AS new FROM lb WHERE n > 2))
      SELECT report_id, (min(w) * {spectra.HOP})::DOUBLE AS start_seconds, (max(w) * {spectra.HOP} + {spectra.WINDOW})::DOUBLE AS end_seconds, label, round(avg(b), 3) AS bpm, count(*) AS windows FROM ru WHERE label IS NOT NULL GROUP BY report_id, run, label""",
    "key_map": f"""WITH {N_SQL}, {R_SQL}, al AS (SELECT report_id, s, name, count(name) OVER (PARTITION BY report_id) AS n FROM (SELECT DISTINCT report_id, s FROM sc WHERE s >= 0) LEFT JOIN se USING (report_id, s)),
      ru AS (SELECT *, sum(new) OVER (PARTITION BY report_id ORDER BY s) AS run FROM (SELECT *, CASE WHEN name = lag(name) OVER (PARTITION BY report_id ORDER BY s) THEN 0 ELSE 1 END AS new FROM al WHERE n >= 2))
      SELECT report_id, round(min(s) * {_SIZE} / {_NFPS}, 4) AS start_seconds, name, count(*) AS sections FROM ru WHERE name IS NOT NULL GROUP BY report_id, run, name""",
}
_DB = lambda x: f"CASE WHEN {x} = '-inf'::DOUBLE THEN '-inf' ELSE printf('%.2f', {x}) END"
ORACLE["file_table"] = f"""WITH lo AS ({ORACLE['file_loudness']}), pk AS ({ORACLE['file_true_peaks']}), te AS ({ORACLE['file_tempo']}), ke AS ({ORACLE['file_key']}), tp AS (SELECT report_id, max(true_peak) AS t FROM pk GROUP BY 1)
  SELECT report_id AS "File", 'fully read' AS "Read result", CASE WHEN odd THEN 'aiff' ELSE 'wav' END AS "Container", '{RATE}' AS "Sample rate (Hz)", '2' AS "Channels", round(seconds * {RATE})::BIGINT::VARCHAR AS "Sample frames", CASE WHEN odd THEN 'big-endian' ELSE 'little-endian' END AS "Byte order", '100.0%' AS "Levels measured from",
    {_DB('integrated')} AS "Integrated loudness (LUFS)", printf('%.2f', "range") AS "Loudness range (LU)", {_DB('20 * log10(t)')} AS "True peak (dBTP)", {_DB('short_term_max')} AS "Short-term max (LUFS)", {_DB('momentary_max')} AS "Momentary max (LUFS)",
    printf('%.1f', bpm) AS "Measured BPM", te.confidence AS "Tempo confidence", CASE WHEN te.steady THEN 'yes' WHEN NOT te.steady THEN 'no' END AS "Tempo steady", name AS "Likely key", ke.confidence AS "Key confidence",
    CASE WHEN ke.established THEN CASE WHEN concentration >= 0.8 THEN 'strongly tonal' WHEN concentration >= 0.72 THEN 'clearly tonal' ELSE 'weakly tonal' END END AS "How tonal"
  FROM (SELECT *, split_part(report_id, '-', 2)::BIGINT % 2 = 1 AS odd FROM lo) JOIN tp USING (report_id) JOIN te USING (report_id) JOIN ke USING (report_id)"""
