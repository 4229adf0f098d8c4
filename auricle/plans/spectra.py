"""Queries over analysis frames: an embedding is a frame of 64 samples, vec_id its place in time, label its section."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from auricle.operators import harmony, series

SIZE, RATE = 64, 4186.0
BINS = SIZE // 2 + 1
#: Lags of pulses, in samples; the prior's centre; frames of a section's ending. Notes lie within LOW to HIGH.
MIN_LAG, MAX_LAG, CENTRE, ENDING = 2, SIZE - 2, 4.0, 8
LOW, HIGH = 65.0, 2100.0


def frames(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def bins(spark, sf_dir):
    m = frames(spark, sf_dir).select("vec_id", "label", series.magnitudes(F.col("v"), SIZE).alias("m"))
    return m.select("vec_id", "label", F.posexplode("m").alias("k", "magnitude")).withColumn("k", F.col("k").cast("long"))


def hann_dft_magnitudes(spark, sf_dir):
    return bins(spark, sf_dir).select("vec_id", "k", F.round("magnitude", 6).alias("magnitude"))


def spectral_flux(spark, sf_dir):
    """Sum over bins of the rise of log magnitude since the frame before in the section; the first frame has 0."""
    w = Window.partitionBy("label", "k").orderBy("vec_id")
    level = F.log1p(1000 * F.col("magnitude") / SIZE)
    b = bins(spark, sf_dir).withColumn("level", level).withColumn("rise", F.greatest(F.lit(0.0), F.coalesce(F.col("level") - F.lag("level").over(w), F.lit(0.0))))
    return b.groupBy("label", "vec_id").agg(F.round(F.sum("rise"), 6).alias("flux"))


def autocorrelation(spark, sf_dir):
    """Of each frame less its mean, at every lag that leaves two terms."""
    f = frames(spark, sf_dir).select("vec_id", series.centred(F.col("v")).alias("v"), F.explode(F.sequence(F.lit(MIN_LAG), F.lit(MAX_LAG))).alias("lag"))
    return f.select("vec_id", F.col("lag").cast("long").alias("lag"), F.round(series.autocorrelation(F.col("v"), F.col("lag")), 6).alias("r"))


def tempo_prior_argmax(spark, sf_dir):
    """The lag with the best correlation, with half of that at twice the lag, weighted by a bell in octaves around CENTRE; the shortest wins ties."""
    lags = F.sequence(F.lit(MIN_LAG), F.lit(MAX_LAG))
    f = frames(spark, sf_dir).select("vec_id", series.autocorrelations(F.col("v"), MIN_LAG, MAX_LAG).alias("r"))
    harmonic = lambda lag: F.coalesce(F.get("r", 2 * lag - MIN_LAG), F.lit(0.0))
    weight = lambda lag: F.exp(-0.5 * F.pow(F.log2(lag / CENTRE) / 0.9, 2))
    # equal scores of different lags differ by arithmetic alone: they are compared at twelve places and shown at five
    score = F.transform(lags, lambda lag: F.struct(F.round((F.get("r", lag - MIN_LAG) + 0.5 * harmonic(lag)) * weight(lag), 12).alias("score"), (-lag).cast("long").alias("back")))
    best = f.select("vec_id", "r", F.array_max(F.filter(score, lambda x: x["score"].isNotNull())).alias("b")).where("b IS NOT NULL")
    return best.select("vec_id", (-F.col("b.back")).alias("lag"), F.round(F.get("r", (-F.col("b.back") - MIN_LAG).cast("int")), 5).alias("r"), F.round("b.score", 5).alias("score"))


def local_maxima(spark, sf_dir):
    out = series.local_maxima(bins(spark, sf_dir), ["vec_id"], "k", "magnitude")
    return out.select("vec_id", "k", F.round("magnitude", 6).alias("magnitude"), F.round("shift", 5).alias("shift"))


def lowest_strong_peak(spark, sf_dir):
    """The lowest local maximum of a quarter of the frame's strongest or more: the frame's bass note."""
    b = bins(spark, sf_dir).withColumn("top", F.max("magnitude").over(Window.partitionBy("vec_id")))
    peaks = series.local_maxima(b, ["vec_id"], "k", "magnitude").where("magnitude >= 0.25 * top")
    return peaks.groupBy("vec_id").agg(F.min("k").alias("k"))


def chroma(spark, sf_dir):
    """Local maxima of the spectrum in the range of notes, by pitch class."""
    hz = F.col("k") * (RATE / SIZE)
    b = series.local_maxima(bins(spark, sf_dir), ["vec_id"], "k", "magnitude").where(hz.between(LOW, HIGH))
    return b.withColumn("pc", harmony.pitch_class(hz))


def _ending(spark, sf_dir):
    """Shares of the last frames of each section."""
    back = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id")))
    last = frames(spark, sf_dir).select("label", "vec_id").withColumn("back", back).where(F.col("back") <= ENDING).select("vec_id")
    return harmony.shares(chroma(spark, sf_dir).join(last, "vec_id"), ["label"])


def chroma_fold(spark, sf_dir):
    out = chroma(spark, sf_dir).groupBy("vec_id", "pc").agg(F.round(F.sum("magnitude"), 6).alias("magnitude"))
    return out.withColumn("pc", F.col("pc").cast("long"))


def pool_shares(spark, sf_dir):
    out = harmony.shares(chroma(spark, sf_dir), ["label"])
    return out.select("label", F.col("pc").cast("long").alias("pc"), F.round("share", 6).alias("share"))


def _bass(spark, sf_dir):
    low = lowest_strong_peak(spark, sf_dir).where("k > 0").join(frames(spark, sf_dir).select("vec_id", "label"), "vec_id")
    return harmony.shares(low.select("label", harmony.pitch_class(F.col("k") * (RATE / SIZE)).alias("pc"), F.lit(1.0).alias("magnitude")), ["label"])


def note_collection(spark, sf_dir):
    out = harmony.collections(harmony.shares(chroma(spark, sf_dir), ["label"]), ["label"])
    return out.select("label", "root", F.round("concentration", 6).alias("concentration"), harmony.strength(F.col("concentration")).alias("strength"))


def rank_centres(spark, sf_dir):
    pooled = harmony.shares(chroma(spark, sf_dir), ["label"])
    out = harmony.centres(pooled, _bass(spark, sf_dir), _ending(spark, sf_dir), harmony.collections(pooled, ["label"]), ["label"])
    return out.select("label", "rank", "mode", "pc", F.round("score", 6).alias("score"), F.round("closeness", 6).alias("closeness"))


def key_readings(spark, sf_dir):
    """The first centre of each section, the other centres as close as the ambiguity limit, and the confidence."""
    pooled = harmony.shares(chroma(spark, sf_dir), ["label"])
    c = harmony.centres(pooled, _bass(spark, sf_dir), _ending(spark, sf_dir), harmony.collections(pooled, ["label"]), ["label"])
    out = c.groupBy("label").agg(F.max_by("mode", -F.col("rank")).alias("mode"), F.max_by("pc", -F.col("rank")).alias("pc"), F.count_if((F.col("rank") > 1) & (F.col("closeness") >= 1 - harmony.AMBIGUOUS)).alias("alternatives"), F.max("concentration").alias("concentration"))
    modal = F.col("mode").isin("Mixolydian", "Dorian")
    return out.select("label", "mode", "pc", "alternatives", harmony.confidence(F.col("concentration"), F.col("alternatives"), modal).alias("confidence"))


SHELF, HIGH_PASS = series.k_weighting(48000.0)


def k_weight_biquad(spark, sf_dir):
    """Mean square of each frame after both stages of K-weighting."""
    f = frames(spark, sf_dir).select("vec_id", series.biquad(F.col("v"), SHELF, HIGH_PASS).alias("y"))
    power = F.aggregate("y", F.lit(0.0), lambda s, x: s + x * x) / F.size("y")
    return f.select("vec_id", F.round(power, 6).alias("power"))


def _sinc_taps(factor: int, taps: int = 12, beta: float = 9.0) -> list[list[float]]:
    """Phases of a Kaiser-windowed sinc interpolator, each with unit gain at 0 Hz."""
    def i0(x: float) -> float:
        term = total = 1.0
        for k in range(1, 60):
            term *= (x / (2 * k)) ** 2
            total += term
        return total

    out = []
    for p in range(factor):
        at = [i - taps / 2 + 1 - p / factor for i in range(taps)]
        row = [(1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)) * i0(beta * math.sqrt(max(0.0, 1 - (t / (taps / 2)) ** 2))) for t in at]
        out.append([x / sum(row) for x in row])
    return out


TAPS = _sinc_taps(4)


def true_peak_fir(spark, sf_dir):
    """The largest magnitude of a frame interpolated four times, at least that of its samples; twelve zeros drain the filter."""
    zeros = F.array_repeat(F.lit(0.0), 11)
    padded = F.concat(zeros, F.col("v"), zeros)
    peaks = []
    for row in TAPS:
        taps = F.array(*map(F.lit, row))
        out = F.transform(F.sequence(F.lit(1), F.size("v") + 11), lambda i: F.abs(F.aggregate(F.zip_with(F.slice("p", i, 12), taps, lambda x, t: x * t), F.lit(0.0), lambda s, x: s + x)))
        peaks.append(F.array_max(out))
    f = frames(spark, sf_dir).withColumn("p", padded)
    sample = F.array_max(F.transform("v", lambda x: F.abs(x)))
    return f.select("vec_id", F.round(sample, 6).alias("sample_peak"), F.round(F.greatest(sample, *peaks), 6).alias("true_peak"))


QUERIES = {f.__name__: f for f in (hann_dft_magnitudes, spectral_flux, autocorrelation, tempo_prior_argmax, local_maxima, lowest_strong_peak, chroma_fold, pool_shares, note_collection, rank_centres, key_readings, k_weight_biquad, true_peak_fir)}

V_SQL = "v AS (SELECT vec_id, label::BIGINT AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
M_SQL = f"""{V_SQL}, m AS (SELECT vec_id, label, k, sqrt(sum(h * cos(a)) ** 2 + sum(h * sin(a)) ** 2) AS magnitude FROM (
  SELECT vec_id, label, k, x * (0.5 - 0.5 * cos(2 * pi() * i / {SIZE - 1})) AS h, 2 * pi() * k * i / {SIZE} AS a FROM v, range({BINS}) t(k)) GROUP BY vec_id, label, k)"""
PC_SQL = f"((floor(69 + 12 * log2(k * {RATE / SIZE} / 440.0) + 0.5)::BIGINT % 12) + 12) % 12"
N_SQL = """n AS (SELECT *, lag(magnitude) OVER w AS a, lead(magnitude) OVER w AS c, max(magnitude) OVER (PARTITION BY vec_id) AS top FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
  pk AS (SELECT * FROM n WHERE magnitude > a AND magnitude >= c)"""
S_SQL = f"""{M_SQL}, {N_SQL}, c AS (SELECT vec_id, label, {PC_SQL} AS pc, magnitude FROM pk WHERE k * {RATE / SIZE} BETWEEN {LOW} AND {HIGH}), p AS (SELECT label, pc, sum(magnitude) AS s FROM c GROUP BY ALL), sh AS (SELECT label, pc, s / sum(s) OVER (PARTITION BY label) AS share FROM p)"""
L_SQL = f"{S_SQL}, q AS (SELECT label, (pc - unnest({harmony.SCALE_STEPS}) + 12) % 12 AS root, share FROM sh), r AS (SELECT label, root, round(sum(share), 9) AS score FROM q GROUP BY ALL), col AS (SELECT label, arg_max(root, (score, -root)) AS root, max(score) AS concentration FROM r GROUP BY label)"
C_SQL = f"""{L_SQL}, lo AS (SELECT vec_id, label, min(k) AS k FROM pk WHERE magnitude >= 0.25 * top GROUP BY ALL), bc AS (SELECT label, {PC_SQL} AS pc, count(*) AS n FROM lo WHERE k > 0 GROUP BY ALL), bs AS (SELECT label, pc, n / sum(n) OVER (PARTITION BY label) AS bass FROM bc),
  la AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS back FROM embeddings) WHERE back <= {ENDING}),
  ec AS (SELECT label, pc, sum(magnitude) AS s FROM c WHERE vec_id IN (FROM la) GROUP BY ALL), es AS (SELECT label, pc, s / sum(s) OVER (PARTITION BY label) AS ending FROM ec),
  md(degree, mode, prior, o) AS (VALUES {", ".join(f"({d}, '{m}', {p}::DOUBLE, {i})" for i, (d, m, p) in enumerate(harmony.MODES))}),
  e AS (SELECT label, concentration, mode, prior, o, (root + degree) % 12 AS pc FROM col, md),
  f AS (SELECT e.*, round((0.25 * coalesce(share, 0) + 0.45 * coalesce(bass, 0) + 0.30 * coalesce(ending, 0)) * prior, 9) AS score FROM e LEFT JOIN sh USING (label, pc) LEFT JOIN bs USING (label, pc) LEFT JOIN es USING (label, pc)),
  g AS (SELECT *, row_number() OVER w AS rank, CASE WHEN first_value(score) OVER w > 0 THEN score / first_value(score) OVER w END AS closeness FROM f WINDOW w AS (PARTITION BY label ORDER BY score DESC, o))"""
A_SQL = f"vm AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM v), z AS (SELECT vec_id, list(x ORDER BY i) AS l, sum(x * x) / {SIZE} AS e FROM vm GROUP BY 1), ac AS (SELECT vec_id, lag, CASE WHEN e > 0 THEN list_sum(list_transform(range(1, {SIZE} - lag + 1), lambda i: l[i] * l[i + lag])) / ({SIZE} - lag) / e END AS r FROM z, (SELECT unnest(range({MIN_LAG}, {MAX_LAG + 1}))::BIGINT AS lag))"


def _biquad_sql() -> str:
    """Both stages as one recursion over the sample's place."""
    b, h = SHELF, HIGH_PASS
    return f"""WITH RECURSIVE {V_SQL}, r AS (
      SELECT vec_id, 0::BIGINT AS i, x AS x1, 0.0::DOUBLE AS x2, {b[0]!r}::DOUBLE * x AS y1, 0.0::DOUBLE AS y2, {b[0]!r}::DOUBLE * x AS z1, 0.0::DOUBLE AS z2 FROM v WHERE i = 0
      UNION ALL SELECT vec_id, i, x, x1, y, y1, y - 2 * y1 + y2 - {h[3]!r}::DOUBLE * z1 - {h[4]!r}::DOUBLE * z2, z1 FROM (
        SELECT v.vec_id, v.i, v.x, r.x1, r.y1, r.y2, r.z1, r.z2, {b[0]!r}::DOUBLE * v.x + {b[1]!r}::DOUBLE * r.x1 + {b[2]!r}::DOUBLE * r.x2 - {b[3]!r}::DOUBLE * r.y1 - {b[4]!r}::DOUBLE * r.y2 AS y
        FROM r JOIN v ON v.vec_id = r.vec_id AND v.i = r.i + 1))
      SELECT vec_id, round(sum(z1 * z1) / {SIZE}, 6) AS power FROM r GROUP BY vec_id"""


ORACLE = {
    "hann_dft_magnitudes": f"WITH {M_SQL} SELECT vec_id, k, round(magnitude, 6) AS magnitude FROM m",
    "spectral_flux": f"""WITH {M_SQL}, l AS (SELECT *, ln(1 + 1000 * magnitude / {SIZE}) AS level FROM m), d AS (SELECT *, level - lag(level) OVER (PARTITION BY label, k ORDER BY vec_id) AS rise FROM l)
      SELECT label, vec_id, round(coalesce(sum(greatest(0.0, coalesce(rise, 0))), 0), 6) AS flux FROM d GROUP BY ALL""",
    "autocorrelation": f"WITH {V_SQL}, {A_SQL} SELECT vec_id, lag, round(r, 6) AS r FROM ac",
    "tempo_prior_argmax": f"WITH {V_SQL}, {A_SQL}, s AS (SELECT a.vec_id, a.lag, a.r, round((a.r + 0.5 * coalesce(b.r, 0)) * exp(-0.5 * pow(log2(a.lag / {CENTRE}) / 0.9, 2)), 12) AS score FROM ac a LEFT JOIN ac b ON b.vec_id = a.vec_id AND b.lag = 2 * a.lag WHERE a.r IS NOT NULL) SELECT vec_id, arg_max(lag, (score, -lag)) AS lag, round(arg_max(r, (score, -lag)), 5) AS r, round(max(score), 5) AS score FROM s GROUP BY vec_id",
    "local_maxima": f"WITH {M_SQL}, {N_SQL}, s AS (SELECT *, CASE WHEN a - 2 * magnitude + c <> 0 THEN 0.5 * (a - c) / (a - 2 * magnitude + c) ELSE 0 END AS d FROM pk) SELECT vec_id, k, round(magnitude, 6) AS magnitude, round(CASE WHEN abs(d) <= 1 THEN d ELSE 0 END, 5) AS shift FROM s",
    "lowest_strong_peak": f"WITH {M_SQL}, {N_SQL} SELECT vec_id, min(k) AS k FROM pk WHERE magnitude >= 0.25 * top GROUP BY vec_id",
    "chroma_fold": f"WITH {S_SQL} SELECT vec_id, pc, round(sum(magnitude), 6) AS magnitude FROM c GROUP BY ALL",
    "pool_shares": f"WITH {S_SQL} SELECT label, pc, round(share, 6) AS share FROM sh",
    "note_collection": f"WITH {L_SQL} SELECT label, root, round(concentration, 6) AS concentration, CASE WHEN concentration >= 0.8 THEN 'strongly tonal' WHEN concentration >= 0.72 THEN 'clearly tonal' ELSE 'weakly tonal' END AS strength FROM col",
    "rank_centres": f"WITH {C_SQL} SELECT label, rank, mode, pc, round(score, 6) AS score, round(closeness, 6) AS closeness FROM g",
    "key_readings": f"""WITH {C_SQL}, k AS (SELECT label, arg_min(mode, rank) AS mode, arg_min(pc, rank) AS pc, count(*) FILTER (rank > 1 AND closeness >= {1 - harmony.AMBIGUOUS}) AS alternatives, max(concentration) AS c FROM g GROUP BY label),
      d AS (SELECT *, mode IN ('Mixolydian', 'Dorian') OR alternatives > 0 AS doubt FROM k)
      SELECT label, mode, pc, alternatives, CASE WHEN c < {harmony.ESTABLISH} THEN NULL WHEN doubt AND c >= {harmony.HIGH} THEN 'medium' WHEN doubt THEN 'low' WHEN c >= {harmony.HIGH} THEN 'high' WHEN c >= {harmony.MEDIUM} THEN 'medium' ELSE 'low' END AS confidence FROM d""",
    "k_weight_biquad": _biquad_sql(),
    "true_peak_fir": f"""WITH {V_SQL}, t(p, j, w) AS (VALUES {", ".join(f"({p}, {j}, {w!r}::DOUBLE)" for p, row in enumerate(TAPS) for j, w in enumerate(row))}),
      o AS (SELECT vec_id, p, i + 11 - j AS n, sum(x * w) AS y FROM v, t GROUP BY ALL), s AS (SELECT vec_id, max(abs(x)) AS sp FROM v GROUP BY 1), q AS (SELECT vec_id, max(abs(y)) AS tp FROM o GROUP BY 1)
      SELECT vec_id, round(sp, 6) AS sample_peak, round(greatest(sp, tp), 6) AS true_peak FROM s JOIN q USING (vec_id)""",
}
