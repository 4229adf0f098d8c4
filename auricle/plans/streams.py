"""Queries over sample streams: the events of a user are a stream, in order of time and id; values become samples in [-1, 1]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.operators import gating, levels, library, series, tempo

SCALE, LOUD, LOW = 250.0, 0.9, -6.0
ORDER = ["ts", "event_id"]
KEY = ["stream"]
FRAMES = 2  # of a sub-block
TYPES = ["click", "view", "purchase"]

X_SQL = f"value / {SCALE} - 1"
#: The stream with frames, for the SQL side.
S_SQL = f"s AS (SELECT user_id AS stream, event_type, ts, event_id, {X_SQL} AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"
DB_SQL = "CASE WHEN {0} > 0 THEN 20 * log10({0}) WHEN {0} IS NOT NULL THEN '-inf'::DOUBLE END"
LUFS_SQL = "CASE WHEN {0} > 0 THEN -0.691 + 10 * log10({0}) WHEN {0} IS NOT NULL THEN '-inf'::DOUBLE END"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("stream"), "event_type", "ts", "event_id", (F.col("value") / SCALE - 1).alias("x"))


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.framed(samples(spark, sf_dir), KEY, ORDER)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def levels_per_channel(spark, sf_dir):
    out = levels.channel_levels(samples(spark, sf_dir), KEY, full_scale=LOUD)
    return rounded(out, 6, "peak", "rms", "dc_offset", "peak_dbfs", "rms_dbfs")


LEVELS_SQL = f"""SELECT stream, count(*) AS frames, count(x) AS finite_frames, count(*) - count(x) AS non_finite, round(max(abs(x)), 6) AS peak,
 round(sqrt(avg(x * x)), 6) AS rms, round(avg(x), 6) AS dc_offset, count(*) FILTER (abs(x) >= {LOUD}) AS full_scale_frames, bool_and(x = 0) AS digital_silence,
 round({DB_SQL.format("max(abs(x))")}, 6) AS peak_dbfs, round({DB_SQL.format("sqrt(avg(x * x))")}, 6) AS rms_dbfs"""


def levels_overall(spark, sf_dir):
    per = levels.channel_levels(samples(spark, sf_dir), ["stream", "event_type"])
    return rounded(levels.overall(per, KEY), 6, "peak", "rms")


def peak_position(spark, sf_dir):
    return rounded(levels.peak_position(framed(spark, sf_dir), KEY), 6, "peak")


def full_scale_runs(spark, sf_dir):
    return levels.longest_runs(samples(spark, sf_dir), KEY, ORDER, full_scale=LOUD * 0.5)


def silence_tristate(spark, sf_dir):
    """Unknown samples of one event type make a stream's answer unknown."""
    s = samples(spark, sf_dir).withColumn("x", F.when((F.col("event_type") != "purchase") | (F.col("event_id") % 5 > 0), F.greatest("x", F.lit(-2.0)) * 0))
    per = s.groupBy("stream", "event_type").agg(F.when(F.count("x") == F.count("*"), F.bool_and(F.col("x") == 0)).alias("digital_silence"))
    from auricle.functions.measures import all_known

    return per.groupBy("stream").agg(F.count("*").alias("channels"), all_known(F.col("digital_silence")).alias("digital_silence"))


def nonfinite_counts(spark, sf_dir):
    s = samples(spark, sf_dir)
    x = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("x"))
    out = levels.channel_levels(s.withColumn("x", x), KEY).select("stream", "frames", "finite_frames", "non_finite", "peak", "rms")
    return rounded(out, 6, "peak", "rms")


def probe_plan_levels(spark, sf_dir):
    out = levels.probed(framed(spark, sf_dir), KEY, probes=8, limit=40)
    return rounded(levels.channel_levels(out, KEY).select("stream", "frames", "peak", "rms"), 6, "peak", "rms")


def _blocks(spark, sf_dir):
    return gating.sub_blocks(framed(spark, sf_dir), KEY, FRAMES)


def sub_block_power(spark, sf_dir):
    return rounded(_blocks(spark, sf_dir), 6, "power")


def momentary(spark, sf_dir):
    return rounded(gating.rolling(_blocks(spark, sf_dir), KEY, gating.MOMENTARY, FRAMES), 6, "power")


def short_term(spark, sf_dir):
    return rounded(gating.rolling(_blocks(spark, sf_dir), KEY, gating.SHORT_TERM, FRAMES), 6, "power")


def integrated_gated(spark, sf_dir):
    out = gating.integrated(gating.rolling(_blocks(spark, sf_dir), KEY, gating.MOMENTARY, FRAMES), KEY)
    return rounded(out, 6, "integrated", "gate")


def loudness_range(spark, sf_dir):
    return rounded(gating.loudness_range(gating.rolling(_blocks(spark, sf_dir), KEY, gating.SHORT_TERM, FRAMES), KEY), 6, "range_lu")


def block_max(spark, sf_dir):
    b = gating.rolling(_blocks(spark, sf_dir), KEY, gating.MOMENTARY, FRAMES)
    return rounded(b.groupBy("stream").agg(gating.loudness(F.max("power")).alias("loudest")), 6, "loudest")


def channel_weighted_power(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("weight", gating.channel_weight(F.col("event_type"), ["click"], ["view"]))
    out = s.groupBy("stream").agg(F.sum(F.col("weight") * F.col("x") * F.col("x")).alias("power"), F.avg("weight").alias("mean_weight"))
    return rounded(out.withColumn("lufs", gating.loudness(F.col("power"))), 6, "power", "mean_weight", "lufs")


def _daily(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.groupBy("stream", F.date_trunc("day", "ts").alias("day")).agg(F.sum("x").alias("v"))


DAILY_SQL = f"d AS (SELECT user_id AS stream, date_trunc('day', ts) AS day, sum({X_SQL}) AS v FROM events GROUP BY ALL)"


def smooth_triangular(spark, sf_dir):
    out = series.smooth(_daily(spark, sf_dir), KEY, ["day"], "v")
    return rounded(out, 6, "v", "smooth").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def local_mean_rectify(spark, sf_dir):
    out = series.rectify(_daily(spark, sf_dir), KEY, ["day"], "v", 3)
    return rounded(out, 6, "rectified").select("stream", F.date_format("day", "yyyy-MM-dd").alias("day"), "rectified")


def unit_sigma(spark, sf_dir):
    out = series.unit_deviation(_daily(spark, sf_dir), KEY, "v")
    return rounded(out, 6, "scaled").select("stream", F.date_format("day", "yyyy-MM-dd").alias("day"), "scaled")


def sliding_windows(spark, sf_dir):
    s = series.sliding(framed(spark, sf_dir), "frame", 12, 6)
    out = s.groupBy("stream", "window").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")).where("n = 12")
    return rounded(out.withColumn("window", F.col("window").cast("long")), 6, "rms")


def key_sections(spark, sf_dir):
    """Tumbling sections of full length only."""
    s = framed(spark, sf_dir).groupBy("stream", F.floor(F.col("frame") / 15).alias("section")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    return rounded(s.where("n = 15"), 6, "mean")


def ending_slice(spark, sf_dir):
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("ts"), F.desc("event_id")))
    s = samples(spark, sf_dir).withColumn("back", back).where("back <= 15")
    return rounded(s.groupBy("stream").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), 6, "mean")


def first_last_settled(spark, sf_dir):
    s = framed(spark, sf_dir).withColumn("kind", F.when(F.abs("x") > 0.5, F.col("event_type")))
    known = s.where(F.col("kind").isNotNull())
    return known.groupBy("stream").agg(F.min_by("kind", "frame").alias("first_kind"), F.max_by("kind", "frame").alias("last_kind"), F.count("*").alias("settled"))


def tempo_estimates(spark, sf_dir):
    """A pulse for each stream: 60 over the upper median of the gaps between events in hours, folded by octaves to the one nearest the
    upper median of all; with its half- or double-time reading, agreement of the gaps and confidence."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream").orderBy(*ORDER)
    at = F.col("ts").cast("timestamp")
    hours = (F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))) / 3.6e9
    gaps = samples(spark, sf_dir).withColumn("gap", hours).where("gap > 0")
    mid = series.order_statistics(gaps, KEY, "gap", mid=series.upper_middle)
    near = F.count_if(F.abs(F.col("gap") - F.col("mid")) <= 0.5 * F.col("mid"))
    per = gaps.join(mid, "stream").groupBy("stream", "mid").agg((near / F.count("*")).alias("agreement")).withColumn("bpm", 60 / F.col("mid"))
    folded = [F.struct(F.abs(F.log2(F.col("bpm") * m) - F.log2(F.lit(12.0))).alias("far"), F.lit(i).alias("i"), (F.col("bpm") * m).alias("bpm")) for i, m in enumerate((1.0, 0.5, 2.0))]
    per = per.withColumn("folded", F.array_min(F.array(*folded))["bpm"])
    feel = F.when(F.col("folded") >= 14, F.col("folded") / 2).when(F.col("folded") <= 8, F.col("folded") * 2)
    grade = F.when(F.col("agreement") >= 0.45, "high").when(F.col("agreement") >= 0.35, "medium").otherwise("low")
    out = per.select("stream", "bpm", "folded", feel.alias("feel"), "agreement", grade.alias("confidence"))
    return rounded(out, 6, "bpm", "folded", "feel", "agreement")


#: Onsets a second, and onsets of a window and of its hop, of the tempo queries.
FPS, TEMPO_SIZE, TEMPO_HOP = 8.0, 40, 20


def _tempo_windows(spark, sf_dir):
    signal = tempo.onsets(framed(spark, sf_dir).select("stream", "frame", "x"), KEY, "frame", "x")
    return tempo.windows(signal, KEY, "frame", FPS, TEMPO_SIZE, TEMPO_HOP)


def tempo_windows(spark, sf_dir):
    """Each stream's windows read by autocorrelation of its onsets."""
    return rounded(_tempo_windows(spark, sf_dir), 5, "bpm", "correlation", "resolution")


def tempo_readings(spark, sf_dir):
    """What the windows of a stream add up to, or why there is no tempo."""
    return rounded(tempo.readings(_tempo_windows(spark, sf_dir), KEY), 5, "bpm", "correlation", "agreement", "least", "greatest", "feel")


def upper_medians(spark, sf_dir):
    return rounded(series.order_statistics(samples(spark, sf_dir), ["stream", "event_type"], "x", mid=series.upper_middle).drop("n"), 6, "mid")


def stream_findings(spark, sf_dir):
    """Which streams peak, clip or sit low, worst first: levels, runs, three observations, their severities, and the order."""
    s = samples(spark, sf_dir)
    low = levels.channel_levels(s, KEY, full_scale=LOUD)
    out = low.join(levels.longest_runs(s, KEY, ORDER, full_scale=LOUD), "stream")
    full = F.col("longest_run") >= 2
    near = ~full & (F.col("peak_dbfs") >= -0.1)
    quiet = F.col("rms_dbfs") < LOW
    out = out.select("stream", "peak_dbfs", "rms_dbfs", "longest_run", levels.flag(full).alias("attention"), levels.flag(near).alias("notice"), levels.flag(quiet).alias("info"))
    rank = F.col("attention") * 1000 + F.col("notice")
    out = library.ranked(out, [rank.desc(), F.round("peak_dbfs", 6).desc(), F.asc("stream")])
    return rounded(out, 6, "peak_dbfs", "rms_dbfs")


QUERIES = {f.__name__: f for f in (
    levels_per_channel, levels_overall, peak_position, full_scale_runs, silence_tristate, nonfinite_counts, probe_plan_levels, sub_block_power, momentary, short_term,
    integrated_gated, loudness_range, block_max, channel_weighted_power, smooth_triangular, local_mean_rectify, unit_sigma, sliding_windows, key_sections, ending_slice,
    first_last_settled, tempo_estimates, tempo_windows, tempo_readings, upper_medians, stream_findings)}

B_SQL = f"{S_SQL}, b AS (SELECT stream, frame // {FRAMES} AS block, sum(x * x) AS power FROM s GROUP BY 1, 2 HAVING count(*) = {FRAMES})"


def _rolling_sql(size: int) -> str:
    return f"r AS (SELECT * FROM (SELECT stream, block, sum(power) OVER (PARTITION BY stream ORDER BY block ROWS {size - 1} PRECEDING) / {size * FRAMES} AS power, row_number() OVER (PARTITION BY stream ORDER BY block) AS rn FROM b) WHERE rn >= {size})"


def _gate_sql(relative: float) -> str:
    l, m = LUFS_SQL.format("power"), LUFS_SQL.format("avg(power) OVER (PARTITION BY stream)")
    return f"a AS (SELECT *, {l} AS lufs FROM r), c AS (SELECT *, {m} + {relative} AS gate FROM a WHERE lufs > {gating.ABSOLUTE_GATE}), g AS (SELECT * FROM c WHERE lufs > gate)"


RUN_SQL = f"""t AS (SELECT *, abs(x) >= {{0}} AS loud FROM s),
u AS (SELECT stream, loud, sum((NOT loud)::INT) OVER (PARTITION BY stream ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM t),
n AS (SELECT stream, run, count(*) FILTER (loud) AS n FROM u GROUP BY 1, 2), lr AS (SELECT stream, max(n) AS longest_run FROM n GROUP BY 1)"""

_LOW, _HIGH = 2, 12  # lags of 220 and 40 beats a minute at FPS
TW_SQL = f"""{S_SQL}, o1 AS (SELECT stream, frame, greatest(0.0, coalesce(x - lag(x) OVER w, 0)) AS r FROM s WINDOW w AS (PARTITION BY stream ORDER BY frame)),
 o AS (SELECT stream, frame, 0.25 * lag(r, 1, 0.0) OVER w + 0.5 * r + 0.25 * lead(r, 1, 0.0) OVER w AS v FROM o1 WINDOW w AS (PARTITION BY stream ORDER BY frame)),
 wi AS (SELECT *, unnest(generate_series(greatest(0, floor((frame - {TEMPO_SIZE}) / {TEMPO_HOP}.0)::BIGINT + 1), frame // {TEMPO_HOP})) AS "window" FROM o),
 wc AS (SELECT *, v - avg(v) OVER (PARTITION BY stream, "window") AS c, count(*) OVER (PARTITION BY stream, "window") AS n FROM wi),
 wl AS (SELECT stream, "window", list(c ORDER BY frame) AS l, sum(c * c) AS e FROM wc WHERE n = {TEMPO_SIZE} GROUP BY 1, 2),
 ac AS (SELECT stream, "window", lag, list_sum(list_transform(range(1, {TEMPO_SIZE} - lag + 1), lambda i: l[i] * l[i + lag])) / ({TEMPO_SIZE} - lag) / (e / {TEMPO_SIZE}) AS r FROM wl, (SELECT unnest(range({_LOW}, {_HIGH + 1}))::BIGINT AS lag) WHERE e > 0),
 sc AS (SELECT a.*, round((a.r + 0.5 * coalesce(b.r, 0)) * exp(-0.5 * (log2(60 * {FPS} / a.lag / 120.0) / 0.9) ** 2), 12) AS score, lag(a.r) OVER w AS r0, lead(a.r) OVER w AS r2 FROM ac a LEFT JOIN ac b ON b.stream = a.stream AND b."window" = a."window" AND b.lag = 2 * a.lag WINDOW w AS (PARTITION BY a.stream, a."window" ORDER BY a.lag)),
 be AS (SELECT stream, "window", arg_max(lag, (score, -lag)) AS lag, arg_max(r, (score, -lag)) AS r, arg_max({{'a': r0, 'b': r2}}, (score, -lag)) AS q, max(score) AS score FROM sc GROUP BY 1, 2),
 sh AS (SELECT *, CASE WHEN q.a IS NOT NULL AND q.b IS NOT NULL AND q.a - 2 * r + q.b <> 0 THEN 0.5 * (q.a - q.b) / (q.a - 2 * r + q.b) ELSE 0 END AS d FROM be WHERE score > 0),
 tw AS (SELECT wl.stream, wl."window", 60 * {FPS} / (lag + CASE WHEN abs(d) <= 1 THEN d ELSE 0 END) AS bpm, r AS correlation, 60 * {FPS} / lag - 60 * {FPS} / (lag + 1) AS resolution FROM wl LEFT JOIN sh USING (stream, "window"))"""
TR_SQL = f"""{TW_SQL}, m1 AS (SELECT stream, list_sort(list(bpm)) AS l, list_sort(list(correlation)) AS k FROM tw WHERE bpm IS NOT NULL GROUP BY 1), m2 AS (SELECT stream, l[len(l) // 2 + 1] AS reference, k[len(k) // 2 + 1] AS correlation FROM m1),
 f1 AS (SELECT tw.stream, tw.correlation, resolution, reference, bpm AS b, abs(log2(bpm / reference)) AS d0, CASE WHEN bpm / 2 BETWEEN 40 AND 220 THEN abs(log2(bpm / 2 / reference)) END AS d1, CASE WHEN bpm * 2 BETWEEN 40 AND 220 THEN abs(log2(bpm * 2 / reference)) END AS d2 FROM tw JOIN m2 USING (stream) WHERE bpm IS NOT NULL),
 f2 AS (SELECT *, CASE WHEN d0 <= coalesce(d1, d0) AND d0 <= coalesce(d2, d0) THEN b WHEN coalesce(d1, 99) <= coalesce(d2, 99) THEN b / 2 ELSE b * 2 END AS bpm FROM f1),
 m3 AS (SELECT stream, list_sort(list(bpm)) AS l FROM f2 GROUP BY 1), m4 AS (SELECT stream, l[len(l) // 2 + 1] AS centre FROM m3),
 g1 AS (SELECT *, correlation >= 0.2 AS pulse, correlation >= 0.2 AND abs(bpm - reference) / reference < 0.25 AS reliable FROM f2 JOIN m4 USING (stream)),
 g2 AS (SELECT stream, centre, count(*) AS placed, count(*) FILTER (abs(bpm - centre) / centre <= 0.1) / count(*) AS agreement, count(*) FILTER (reliable) AS nr, count(*) FILTER (pulse) AS np, min(bpm) FILTER (reliable) AS lr, max(bpm) FILTER (reliable) AS hr, min(bpm) FILTER (pulse) AS lp, max(bpm) FILTER (pulse) AS hp, min(resolution) AS resolution FROM g1 GROUP BY 1, 2),
 g3 AS (SELECT n.stream, n.windows, g2.*, m2.correlation, coalesce(m2.correlation >= 0.2, false) AS established, agreement < 0.5 AS wd FROM (SELECT stream, count(*) AS windows FROM tw GROUP BY 1) n LEFT JOIN g2 USING (stream) LEFT JOIN m2 USING (stream)),
 g4 AS (SELECT *, CASE WHEN wd THEN lp ELSE lr END AS lo, CASE WHEN wd THEN hp ELSE hr END AS hi, CASE WHEN CASE WHEN wd THEN np ELSE nr END >= 3 THEN CASE WHEN wd THEN hp - lp ELSE hr - lr END END AS spread, greatest(2 * resolution, 1.5) AS fl FROM g3)"""

ORACLE = {
    "tempo_windows": f'WITH {TW_SQL} SELECT stream, "window", round(bpm, 5) AS bpm, round(correlation, 5) AS correlation, round(resolution, 5) AS resolution FROM tw',
    "tempo_readings": f"""WITH {TR_SQL} SELECT stream, windows, coalesce(placed, 0) AS placed, round(centre, 5) AS bpm, round(correlation, 5) AS correlation, round(agreement, 5) AS agreement, established, CASE WHEN established THEN wd END AS wanders,
      CASE WHEN NOT established THEN NULL WHEN wd THEN 'low' WHEN correlation >= 0.25 AND agreement >= 0.85 THEN 'high' WHEN correlation >= 0.2 AND agreement >= 0.6 THEN 'medium' ELSE 'low' END AS confidence,
      CASE WHEN established THEN NOT wd AND NOT coalesce(spread > fl, false) END AS steady, CASE WHEN established AND spread > fl THEN round(lo, 5) END AS least, CASE WHEN established AND spread > fl THEN round(hi, 5) END AS greatest,
      round(CASE WHEN established AND centre >= 140 THEN centre / 2 WHEN established AND centre <= 80 THEN centre * 2 END, 5) AS feel, CASE WHEN established THEN NULL WHEN placed IS NULL THEN 'no repeating pulse' ELSE 'not regular enough' END AS reason FROM g4""",
    "levels_per_channel": f"WITH {S_SQL} {LEVELS_SQL} FROM s GROUP BY stream",
    "levels_overall": f"""WITH {S_SQL}, c AS (SELECT stream, event_type, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, bool_and(x = 0) AS q FROM s GROUP BY 1, 2)
      SELECT stream, count(*) AS channels, round(max(peak), 6) AS peak, round(sqrt(avg(rms * rms)), 6) AS rms, 0 AS non_finite, bool_and(q) AS digital_silence FROM c GROUP BY stream""",
    "peak_position": f"WITH {S_SQL}, m AS (SELECT stream, max(abs(x)) AS peak FROM s GROUP BY 1) SELECT stream, round(peak, 6) AS peak, min(frame) AS peak_frame FROM s JOIN m USING (stream) WHERE abs(x) = peak GROUP BY stream, peak",
    "full_scale_runs": f"WITH {S_SQL}, {RUN_SQL.format(LOUD * 0.5)} SELECT * FROM lr",
    "silence_tristate": """WITH s AS (SELECT user_id AS stream, event_type, event_type <> 'purchase' OR event_id % 5 > 0 AS known FROM events),
      c AS (SELECT stream, event_type, CASE WHEN bool_and(known) THEN true END AS q FROM s GROUP BY 1, 2)
      SELECT stream, count(*) AS channels, CASE WHEN count(*) = count(q) THEN bool_and(q) END AS digital_silence FROM c GROUP BY stream""",
    "nonfinite_counts": f"""WITH {S_SQL}, y AS (SELECT stream, CASE WHEN event_id % 97 <> 0 AND event_id % 89 <> 0 THEN x END AS x FROM s)
      SELECT stream, count(*) AS frames, count(x) AS finite_frames, count(*) - count(x) AS non_finite, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms FROM y GROUP BY stream""",
    "probe_plan_levels": f"""WITH {S_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY stream) AS n FROM s),
      p AS (SELECT *, CASE WHEN n > 40 THEN (n - 5) // 7 ELSE 1 END AS stride FROM n), q AS (SELECT *, least(frame // stride, 7) AS i FROM p)
      SELECT stream, count(*) AS frames, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms FROM q WHERE n <= 40 OR frame - least(i * stride, n - 5) < 5 GROUP BY stream""",
    "sub_block_power": f"WITH {B_SQL} SELECT stream, block, round(power, 6) AS power FROM b",
    "momentary": f"WITH {B_SQL}, {_rolling_sql(4)} SELECT stream, block, round(power, 6) AS power FROM r",
    "short_term": f"WITH {B_SQL}, {_rolling_sql(30)} SELECT stream, block, round(power, 6) AS power FROM r",
    "integrated_gated": f"""WITH {B_SQL}, {_rolling_sql(4)}, {_gate_sql(-10.0)}, t AS (SELECT stream, count(*) AS blocks_total FROM r GROUP BY 1),
      i AS (SELECT stream, {LUFS_SQL.format("avg(power)")} AS integrated, count(*) AS blocks_used, max(gate) AS gate FROM g GROUP BY 1)
      SELECT stream, blocks_total, round(integrated, 6) AS integrated, coalesce(blocks_used, 0) AS blocks_used, round(gate, 6) AS gate FROM t LEFT JOIN i USING (stream)""",
    "loudness_range": f"""WITH {B_SQL}, {_rolling_sql(30)}, {_gate_sql(-20.0)}, l AS (SELECT stream, list_sort(list(lufs)) AS v FROM g GROUP BY 1)
      SELECT stream, len(v) AS blocks, round(v[floor((len(v) - 1) * 0.95 + 0.5)::INT + 1] - v[floor((len(v) - 1) * 0.1 + 0.5)::INT + 1], 6) AS range_lu FROM l WHERE len(v) >= 2""",
    "block_max": f"WITH {B_SQL}, {_rolling_sql(4)} SELECT stream, round({LUFS_SQL.format('max(power)')}, 6) AS loudest FROM r GROUP BY stream",
    "channel_weighted_power": f"""WITH {S_SQL}, w AS (SELECT *, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1.41 ELSE 1 END::DOUBLE AS weight FROM s), p AS (SELECT stream, sum(weight * x * x) AS power, avg(weight) AS mw FROM w GROUP BY 1)
      SELECT stream, round(power, 6) AS power, round(mw, 6) AS mean_weight, round({LUFS_SQL.format('power')}, 6) AS lufs FROM p""",
    "smooth_triangular": f"WITH {DAILY_SQL} SELECT stream, strftime(day, '%Y-%m-%d') AS day, round(v, 6) AS v, round(0.25 * lag(v, 1, 0.0) OVER w + 0.5 * v + 0.25 * lead(v, 1, 0.0) OVER w, 6) AS smooth FROM d WINDOW w AS (PARTITION BY stream ORDER BY day)",
    "local_mean_rectify": f"WITH {DAILY_SQL} SELECT stream, strftime(day, '%Y-%m-%d') AS day, round(greatest(0.0, v - avg(v) OVER (PARTITION BY stream ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 6) AS rectified FROM d",
    "unit_sigma": f"WITH {DAILY_SQL}, e AS (SELECT *, stddev_pop(v) OVER (PARTITION BY stream) AS sd FROM d) SELECT stream, strftime(day, '%Y-%m-%d') AS day, round(CASE WHEN sd > 0 THEN v / sd ELSE v END, 6) AS scaled FROM e",
    "sliding_windows": f"WITH {S_SQL}, w AS (SELECT *, unnest(generate_series(greatest(0, floor((frame - 12) / 6.0)::BIGINT + 1), frame // 6)) AS win FROM s) SELECT stream, win AS \"window\", count(*) AS n, round(sqrt(avg(x * x)), 6) AS rms FROM w GROUP BY stream, win HAVING count(*) = 12",
    "key_sections": f"WITH {S_SQL} SELECT stream, frame // 15 AS section, count(*) AS n, round(avg(x), 6) AS mean FROM s GROUP BY 1, 2 HAVING count(*) = 15",
    "ending_slice": f"WITH {S_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts DESC, event_id DESC) AS back FROM s) SELECT stream, count(*) AS n, round(avg(x), 6) AS mean FROM b WHERE back <= 15 GROUP BY stream",
    "first_last_settled": f"WITH {S_SQL} SELECT stream, arg_min(event_type, frame) AS first_kind, arg_max(event_type, frame) AS last_kind, count(*) AS settled FROM s WHERE abs(x) > 0.5 GROUP BY stream",
    "tempo_estimates": f"""WITH {S_SQL}, g AS (SELECT stream, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY stream ORDER BY ts, event_id))) / 3.6e9 AS gap FROM s),
      l AS (SELECT stream, list_sort(list(gap)) AS v FROM g WHERE gap > 0 GROUP BY 1), m AS (SELECT *, v[len(v) // 2 + 1] AS mid FROM l),
      a AS (SELECT stream, 60 / mid AS bpm, len(list_filter(v, lambda q: abs(q - mid) <= 0.5 * mid)) / len(v) AS agreement FROM m),
      f AS (SELECT *, CASE WHEN abs(log2(bpm) - log2(12)) <= abs(log2(bpm * 0.5) - log2(12)) AND abs(log2(bpm) - log2(12)) <= abs(log2(bpm * 2) - log2(12)) THEN bpm
        WHEN abs(log2(bpm * 0.5) - log2(12)) <= abs(log2(bpm * 2) - log2(12)) THEN bpm * 0.5 ELSE bpm * 2 END AS folded FROM a)
      SELECT stream, round(bpm, 6) AS bpm, round(folded, 6) AS folded, round(CASE WHEN folded >= 14 THEN folded / 2 WHEN folded <= 8 THEN folded * 2 END, 6) AS feel, round(agreement, 6) AS agreement,
        CASE WHEN agreement >= 0.45 THEN 'high' WHEN agreement >= 0.35 THEN 'medium' ELSE 'low' END AS confidence FROM f""",
    "upper_medians": f"WITH {S_SQL}, l AS (SELECT stream, event_type, list_sort(list(x)) AS v FROM s GROUP BY 1, 2) SELECT stream, event_type, round(v[len(v) // 2 + 1], 6) AS mid FROM l",
    "stream_findings": f"""WITH {S_SQL}, {RUN_SQL.format(LOUD)}, l AS (SELECT stream, {DB_SQL.format("max(abs(x))")} AS p, {DB_SQL.format("sqrt(avg(x * x))")} AS r FROM s GROUP BY 1),
      o AS (SELECT stream, round(p, 6) AS peak_dbfs, round(r, 6) AS rms_dbfs, longest_run, (longest_run >= 2)::BIGINT AS attention, (longest_run < 2 AND p >= -0.1)::BIGINT AS notice, (r < {LOW})::BIGINT AS info FROM l JOIN lr USING (stream))
      SELECT *, row_number() OVER (ORDER BY attention * 1000 + notice DESC, peak_dbfs DESC, stream) AS pos FROM o""",
}
