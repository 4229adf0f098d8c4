"""Rules of the operators that the tables cannot show: unknowns, silence, refusals, published values."""

import math
import numpy as np

import pytest
from pyspark.sql import functions as F

from auricle.functions import measures, texts
from auricle.operators import gating, harmony, levels, library, provenance, rules, series, tempo


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_decibels_of_silence_and_unknown(spark):
    assert one(spark, measures.decibels(F.lit(0.0))) == -math.inf
    assert one(spark, measures.decibels(F.lit(None).cast("double"))) is None
    assert one(spark, measures.loudness(F.lit(1.0))) == pytest.approx(-0.691)
    assert one(spark, measures.finite(F.lit(float("nan")))) is None


def test_ranks(spark):
    a = F.array(*(F.lit(x) for x in (3.0, 1.0, 2.0, 4.0)))
    assert one(spark, measures.upper_median(a)) == 3.0
    assert one(spark, measures.nearest_rank(a, 0.10)) == 1.0
    assert one(spark, measures.nearest_rank(F.array().cast("array<double>"), 0.5)) is None


def test_levels_of_unreadable_and_empty_streams(spark):
    rows = [("a", 0, float("nan")), ("a", 1, None), ("b", 0, 0.0), ("b", 1, 0.0), ("c", 0, -1.0), ("c", 1, 1.0), ("c", 2, 0.5), ("c", 3, 1.0)]
    df = spark.createDataFrame(rows, "s string, t int, x double")
    got = {r["s"]: r for r in levels.channel_levels(df, ["s"]).collect()}
    assert got["a"]["peak"] is None and got["a"]["digital_silence"] is None and got["a"]["non_finite"] == 2
    assert got["b"]["peak_dbfs"] == -math.inf and got["b"]["digital_silence"]
    runs = {r["s"]: r["longest_run"] for r in levels.longest_runs(df, ["s"], ["t"]).collect()}
    assert runs == {"a": 0, "b": 0, "c": 2}
    assert levels.overall(levels.channel_levels(df, ["s"])).first()["digital_silence"] is None
    assert levels.channel_levels(df.limit(0), ["s"]).count() == 0


def test_gates_refuse_silence(spark):
    blocks = spark.createDataFrame([("q", i, 0.0) for i in range(5)] + [("l", i, 0.1) for i in range(5)], "s string, block long, power double")
    got = {r["s"]: r for r in gating.integrated(blocks, ["s"]).collect()}
    assert got["q"]["integrated"] is None and got["q"]["blocks_used"] == 0
    assert got["l"]["integrated"] == pytest.approx(-0.691 + 10 * math.log10(0.1))


def test_k_weighting_at_48_khz_is_the_published_table():
    shelf, high = series.k_weighting(48000.0)
    # The coefficients of ITU-R BS.1770 at 48 kHz.
    assert shelf == pytest.approx((1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585), abs=1e-12)
    assert high == pytest.approx((1.0, -2.0, 1.0, -1.99004745483398, 0.99007225036621), abs=1e-11)


def test_spectrum_finds_a_tone(spark):
    tone = F.array(*(F.lit(math.cos(2 * math.pi * 5 * i / 64)) for i in range(64)))
    m = one(spark, series.magnitudes(tone, 64))
    assert len(m) == 33 and max(range(33), key=lambda k: m[k]) == 5
    df = spark.createDataFrame([([1.0, 2.0],), ([],), (None,), ([float(i) for i in range(9)],)], "v array<double>")
    got = [r[0] for r in df.select(series.magnitudes(F.col("v"), 4)).collect()]
    hann = np.array([0, 0.75, 0.75, 0])
    for v, m in zip(([1, 2, 0, 0], [0] * 4, [0] * 4, [0, 1, 2, 3]), got):
        assert m == pytest.approx(list(abs(np.fft.rfft(np.array(v) * hann))))
    assert one(spark, series.autocorrelation(tone, 64)) is None


def test_filters_over_arrays_of_any_length(spark):
    df = spark.createDataFrame([([1.0] + [0.0] * 7,), ([],), (None,), ([0.5, -1.0, 2.0],)], "v array<double>")
    first, second = (0.5, 0.25, 0.1, -0.3, 0.2), (1.0, -2.0, 1.0, 0.1, 0.05)

    def plain(v, b0, b1, b2, a1, a2):
        y = []
        for i, x in enumerate(v):
            back = lambda s, k: s[i - k] if i >= k else 0.0
            y.append(b0 * x + b1 * back(v, 1) + b2 * back(v, 2) - a1 * back(y, 1) - a2 * back(y, 2))
        return y

    got = [r[0] for r in df.select(series.biquad(F.col("v"), first, second)).collect()]
    for (v,), y in zip([r for r in df.collect()], got):
        assert y == pytest.approx(plain(plain(v or [], *first), *second))


def test_order_statistics(spark):
    import random

    rng = random.Random(6)
    rows = [(k, rng.choice([None, *range(6)])) for k in "abc" for _ in range(rng.randrange(1, 30))] + [("d", None)]
    got = {r["k"]: r for r in series.order_statistics(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", mid=series.upper_middle, high=series.nearest_place(0.95)).collect()}
    for k in "abc":
        v = sorted(x for j, x in rows if j == k and x is not None)
        assert (got[k]["n"], got[k]["mid"], got[k]["high"]) == (len(v), v[len(v) // 2], v[math.floor((len(v) - 1) * 0.95 + 0.5)])
    assert "d" not in got


def test_one_order_of_all_rows(spark):
    import random

    rng = random.Random(7)
    rows = [(i, rng.choice([None, *range(50)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(7)
    got = {r["i"]: r["pos"] for r in library.ranked(df, [F.desc_nulls_last("v"), F.asc("i")]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [got[i] for i, _ in want] == list(range(1, 3001))


def test_edits_of_the_library(spark):
    clients = spark.createDataFrame([("a", "Ann", "1"), ("b", "Bob", "1")], "client_id string, name string, updated_at string")
    projects = spark.createDataFrame([("p", "a"), ("q", "b")], "project_id string, client_id string")
    assert library.add_client(clients, "c", " Cy ", "2").count() == 3 and library.add_client(clients, "c", "aNN ", "2").count() == 2 and library.add_client(clients, "c", " ", "2").count() == 2
    c, p = library.move_project(clients, projects, "p", "b", "9")
    assert {tuple(r) for r in p.collect()} == {("p", "b"), ("q", "b")} and {r["updated_at"] for r in c.collect()} == {"9"}
    c, p = library.move_project(clients, projects, "p", "nobody", "9")
    assert {tuple(r) for r in p.collect()} == {("p", "a"), ("q", "b")} and {r["updated_at"] for r in c.collect()} == {"1"}
    todos = spark.createDataFrame([(1, None), (2, "5"), (3, None)], "todo_id long, completed_at string")
    out = {r["todo_id"]: r["completed_at"] for r in library.toggled(todos, spark.createDataFrame([(1,), (2,)], "todo_id long"), "8").collect()}
    assert out == {1: "8", 2: None, 3: None}


def test_stream_collectors_against_arrays(spark):
    import tempfile

    from auricle.streaming import collectors

    rng = np.random.default_rng(9)
    data = {1: rng.normal(size=100), 2: rng.normal(size=7), 3: rng.normal(size=60)}
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    for lo in (0, 25, 50):  # stream 3 skips a sample in its last part
        rows = [(k, n + (k == 3 and n >= 50), float(v)) for k, x in data.items() for n, v in enumerate(x) if lo <= n < (lo + 25 if lo < 50 else 1000)]
        spark.createDataFrame(rows, "stream long, n long, x double").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = lambda: spark.readStream.schema("stream long, n long, x double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stages = series.k_weighting(48000.0)
    collectors.collect_to(collectors.frames(source(), 16, 5), f"{folder}/frames", f"{folder}/s1", "append")
    collectors.collect_to(collectors.sub_blocks(source(), 10, list(stages)), f"{folder}/blocks", f"{folder}/s2", "append")
    got = {(r["stream"], r["nth"]): r["v"] for r in spark.read.schema(collectors.FRAMES).parquet(f"{folder}/frames").collect()}
    want = {(k, i): list(x[5 * i : 5 * i + 16]) for k, x in ((1, data[1]), (3, data[3][:50])) for i in range((len(x) - 16) // 5 + 1)}
    assert got == want
    filtered = {r["k"]: np.array(r["y"]) for r in spark.createDataFrame([(k, x.tolist()) for k, x in data.items()], "k long, v array<double>").select("k", series.biquad(F.col("v"), *stages).alias("y")).collect()}
    blocks = {(r["stream"], r["block"]): r["power"] for r in spark.read.schema(collectors.SUB_BLOCKS).parquet(f"{folder}/blocks").collect()}
    assert set(blocks) == {(1, i) for i in range(10)} | {(3, i) for i in range(5)}
    for (k, i), power in blocks.items():
        assert power == pytest.approx((filtered[k][10 * i : 10 * i + 10] ** 2).sum())


def test_tempo_of_click_tracks(spark):
    fps, rows = 200.0, []
    for bpm in (60, 90, 120, 150, 174):
        x = np.zeros(int(45 * fps))
        x[np.rint(np.arange(0, 45 * fps, 60 * fps / bpm)).astype(int).clip(0, len(x) - 1)] = 1
        rows += [(str(bpm), i, float(v)) for i, v in enumerate(x)]
    noise = np.random.default_rng(1).random(int(45 * fps))
    rows += [("noise", i, float(v)) for i, v in enumerate(noise)] + [("silence", i, 0.0) for i in range(9000)]
    signal = tempo.onsets(spark.createDataFrame(rows, "stream string, i long, x double"), ["stream"], "i", "x")
    got = {r["stream"]: r for r in tempo.readings(tempo.windows(signal, ["stream"], "i", fps, int(12 * fps), int(6 * fps)), ["stream"]).collect()}
    for bpm in (60, 90, 120, 150, 174):
        r = got[str(bpm)]
        assert r["established"] and r["confidence"] == "high" and r["steady"]
        # bare clicks fit half their tempo as well, so that the prior alone chooses: 87 lies nearer its centre than 174
        assert abs(r["bpm"] - (bpm if bpm < 174 else bpm / 2)) < 1, (bpm, r)
    assert got["150"]["feel"] == pytest.approx(75, abs=0.5) and got["60"]["feel"] == pytest.approx(120, abs=0.5) and got["120"]["feel"] is None
    assert not got["noise"]["established"] and got["noise"]["reason"] == "not regular enough"
    assert not got["silence"]["established"] and got["silence"]["reason"] == "no repeating pulse" and got["silence"]["placed"] == 0


def test_pitch_classes(spark):
    assert [one(spark, harmony.pitch_class(F.lit(h))) for h in (440.0, 261.63, 246.94)] == [9, 0, 11]


def test_identifiers_and_tempo(spark):
    assert one(spark, texts.isrc(F.lit(" us-s1z-99-00001 "))) == "USS1Z9900001"
    assert one(spark, texts.isrc(F.lit("US-S1Z-99-1"))) is None
    assert [one(spark, texts.stated_bpm(F.lit(x))) for x in ("128 bpm", "0", "fast", "93.75", None)] == [128.0, None, None, 93.75, None]


def test_cells_and_figures(spark):
    assert one(spark, texts.csv_cell(F.lit("-6.02"))) == "-6.02"
    assert one(spark, texts.csv_cell(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, texts.csv_cell(F.lit('a "b", c'))) == '"a ""b"", c"'
    assert one(spark, texts.csv_cell(F.lit(None).cast("string"))) == ""
    assert one(spark, texts.duration(F.lit(3725.9996))) == "1:02:05.999"
    assert one(spark, texts.duration(F.lit(None).cast("double"))) == "—"


def test_tools_match_whole_words(spark):
    names = lambda t: [x["name"] for x in one(spark, provenance.tools_named(F.lit(t)))]
    assert names("recorded in my studio, good audio") == []
    assert names("made with Suno") == ["Suno"]
    weight = lambda t: [x["weight"] for x in one(spark, provenance.tools_named(F.lit(t)))]
    assert weight("the low end is a bit boomy") == [provenance.WEAK]
    assert weight("made with boomy 2026-04-20T22:19:02Z") == [provenance.STRONG]
    flag = spark.createDataFrame([("made with suno",), ("a bit boomy",), ("",), (None,), ("stems by Spleeter",)], "v string")
    assert [(r["flag"], r["outcome"]) for r in provenance.assess(flag, "v").collect()] == [("declared", "tool-named"), ("possible", "tool-named"), ("none", "nothing-recorded"), ("none", "nothing-recorded"), ("none", "tool-named")]


def test_there_are_thirty_rules_and_unknown_observes_nothing(spark):
    assert len(rules.RULES) == 30 and len({r.id for r in rules.RULES}) == 30
    assert one(spark, rules.nearest_rate(F.lit(46050))) == 44100


def test_unknown_sorts_last_in_both_directions(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0), (2, float("nan")), (3, 1.0), (4, float("-inf"))], "o int, v double")
    for descending, first in ((False, [3, 1]), (True, [1, 3])):
        got = [r["o"] for r in library.positions(df, "v", "o", descending).orderBy("pos").collect()]
        assert got == first + [0, 2, 4]


def test_library_edits(spark):
    clients = spark.createDataFrame([("1", "Ann", "t0"), ("2", "Bob", "t0")], "client_id string, name string, updated_at string")
    names = lambda df: {r["client_id"]: r["name"] for r in df.collect()}
    assert names(library.rename(clients, "1", " Cid ", "t1")) == {"1": "Cid", "2": "Bob"}
    assert names(library.rename(clients, "1", "bob", "t1")) == {"1": "Ann", "2": "Bob"}
    projects = spark.createDataFrame([("1", "p"), ("2", "q")], "client_id string, project_id string")
    entries = spark.createDataFrame([("p", 1, "t", 1), ("q", 2, "t", 1)], "project_id string, entry_id int, timestamp string, ord int")
    left = library.delete_client(clients, projects, entries, "1")
    assert [t.count() for t in left] == [1, 1, 1]
    stats = {r["client_id"]: r for r in library.client_stats(clients, projects, entries.limit(0)).collect()}
    assert stats["1"]["checks"] == 0 and stats["1"]["last_activity"] is None


def test_written_tables_are_safe_and_read_back(spark):
    import csv
    import glob
    import tempfile

    from auricle.operators import export

    path = f"{tempfile.mkdtemp(prefix='spark-')}/out"
    rows = [(1, '=A1, "x"', -math.inf), (2, None, -6.02), (3, "two\nlines", float("nan")), (4, "-5", None)]
    export.write_csv(spark.createDataFrame(rows, "id int, note string, db double").coalesce(1), f"file://{path}")
    with open(glob.glob(f"{path}/*.csv")[0], newline="") as f:
        assert list(csv.reader(f)) == [["id", "note", "db"], ["1", "'=A1, \"x\"", "-inf"], ["2", "", "-6.02"], ["3", "two\r\nlines", ""], ["4", "-5", ""]]
