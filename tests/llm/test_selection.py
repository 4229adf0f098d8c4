"""Mixing, manifest and resampling against plain versions, and on hard rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auricle.llm import manifest, mixture, order, resample
from tests.llm.helpers import FOLD, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string"
HARD = [(1, None, "en", "b", None, "x"), (2, "", None, None, 0, "x"), (None, "one two three", "en", "b", 13, "x"), (None, None, None, None, None, None), (3, " \n ", "de", "a", 3, "x")] + [(4, "a\nb\nc", "en", "b", 5, "x")] * 3


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ärger", "naïve", "x-y", "1a"]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 20, 60, 200]) if i % 97 else 3000
        text = " ".join(rng.choice(vocabulary) + rng.choice(["", "\n", ","]) for _ in range(size))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", "ß", None]), len(text), "x"))
    return rows


# Places


def test_places_of_all_rows_in_their_groups(spark):
    df = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 2).alias("g"))
    got = order.ranked(df, ["g"], [F.col("g").asc_nulls_first(), F.col("id").desc()], "at").collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["g"]].append((r["id"], r["at"]))
    assert len(got) == 5000
    for own in groups.values():
        assert [at for _, at in sorted(own, reverse=True)] == list(range(len(own)))


# Mixing


def plain_targets(sizes, weights, cap):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**share, **fixed}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("weights,cap", [((5, 2, 1), 3), ((1, 50), 1), ((7,), 2)])
def test_targets_by_resharing(spark, weights, cap):
    sizes = {"a": 10, "b": 1000, "c": 5000, "d": 3, "é": 70, "z": 0, None: 900}
    got = {r["source"]: r["target"] for r in mixture.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), weights, cap).collect()}
    want = plain_targets(sizes, weights, cap)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-12, abs_tol=1e-9) for s in want)


def test_mix_comes_near_its_targets_and_is_the_same_however_dealt(spark):
    rows = corpus(2000)
    df = table(spark, rows)
    got = {r["doc_id"]: r for r in mixture.mix(df).collect()}
    again = {r["doc_id"]: r["taken"] for r in mixture.mix(df.repartition(9, "text")).collect()}
    assert {k: r["taken"] for k, r in got.items()} == again
    taken = defaultdict(int)
    for i, text, _, source, _, _ in rows:
        r = got[i]
        assert r["size"] == len(words(text)) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 and r["n"] == "x"
        taken[source] += r["taken"]
    for r in got.values():
        # what remains is the discrepancy of the small documents: less than one of the largest of them
        assert abs(taken[r["source"]] - r["target"]) <= max(r["target"] / mixture.LARGE, 1) + 1


def test_emitted_rows_carry_texts(spark):
    out = mixture.emitted(mixture.mix(table(spark, corpus(50)), keep_text=True))
    rows = out.collect()
    assert {"text", "copy"} <= set(out.columns) and all(r["copy"] < r["copies"] for r in rows)
    counts = Counter(r["doc_id"] for r in rows)
    assert all(counts[r["doc_id"]] == r["copies"] for r in rows)


def test_crossings_add_up_to_the_expected(spark):
    rate, start = 3_000_000_000, 4_000_000_000
    df = spark.range(1000).select(mixture.crossings(F.col("id"), F.lit(rate), F.lit(start)).alias("c"))
    assert df.agg(F.sum("c")).first()[0] == (start + 1000 * rate) // (1 << 32)
    assert df.agg(F.max("c")).first()[0] == 1


def test_mix_of_hard_rows(spark):
    got = mixture.mix(table(spark, HARD)).collect()
    assert len(got) == len(HARD) and sum(r["size"] for r in got) == 12 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixture.mix(table(spark, HARD).limit(0)).count() == 0
    none = mixture.mix(table(spark, [(1, None, None, None, None, None), (2, "", None, "a", 0, "x")])).collect()
    assert [(r["target"], r["taken"]) for r in none] == [(0.0, 0)] * 2
    clash = table(spark, corpus(9)).withColumns({c: F.lit("own") for c in ("size", "target", "copies", "place", "w", "place")})
    assert mixture.mix(clash).where("place = 'own' AND size IS NOT NULL").count() == 9


# Manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, at):
    out = []
    for row in levels[:-1]:
        run = row[at // 3 * 3 : at // 3 * 3 + 3]
        out.append((at % 3, run[: at % 3] + run[at % 3 + 1 :]))
        at //= 3
    return out


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, h(*map(plain_field, (r[0], r[3], r[2], r[4], r[1])))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for at, leaf in enumerate(trees[s][0]):
            path = plain_path(trees[s], at) + plain_path(top, names.index(s))
            out.append((leaf, trees[s][-1][0], top[-1][0], path))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [corpus(1500, 2), HARD, [(7, "alone", "en", "only", 5, "x")], [(i, "t", "en", "one", 1, "x") for i in range(manifest.SPAN + 1)]], ids=["many", "hard", "one", "over a pack"])
def test_manifest_against_plain_trees(spark, rows):
    df = table(spark, rows).select("*", manifest.leaf(*(F.col(c) for c in manifest.FIELDS)).alias("leaf"))
    out = manifest.proofs(df).withColumn("folded", manifest.fold(F.col("leaf"), F.col("path"))).collect()
    assert all(r["folded"] == r["root"] for r in out)
    got = sorted(((r["leaf"], r["subroot"], r["root"], [(s["position"], s["siblings"]) for s in r["path"]]) for r in out), key=str)
    assert got == plain_manifest(rows)


def test_manifest_notices_every_change(spark):
    rows = table(spark, corpus(200, 3)).select("*", manifest.leaf(*(F.col(c) for c in manifest.FIELDS)).alias("leaf"))
    other = manifest.proofs(rows).select(F.col("root"), manifest.fold(F.sha2("leaf", 256), F.col("path")).alias("folded"))
    assert other.where("folded = root").count() == 0


def test_manifest_of_an_empty_table_and_clashing_names(spark):
    df = table(spark, HARD).withColumns({c: F.lit("own") for c in ("tree", "place", "digest", "row", "pack", "count", "top", "levels", "path", "root", "name")}).withColumn("leaf", F.sha2("n", 256))
    assert manifest.proofs(df.where("doc_id IS NOT NULL")).where("tree = 'own' AND count = 'own' AND row = 'own' AND root <> 'own'").count() == 6
    assert manifest.proofs(df.limit(0)).count() == 0


# Resampling


def plain_resample(rows, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    def feats(text):
        out, word = [], ""
        for ch in (text or "").translate(FOLD) + " ":
            if ch.isdigit() and ch.isascii() or "a" <= ch <= "z" or ord(ch) >= 128:
                word += ch
            elif word:
                out.append(word)
                word = ""
        return [" ".join(out[i : i + n]) for n in range(1, longest + 1) for i in range(len(out) - n + 1)], len(out)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, aim = Counter(), Counter()
    for r in rows:
        own.update(map(bucket, feats(r[1])[0]))
    for t in target:
        aim.update(map(bucket, feats(t)[0]))
    s, t = sum(own.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets))))
    scored = []
    for r in rows:
        f, n = feats(r[1])
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        u = int(h(f"{seed}:{'' if r[0] is None else r[0]}")[:8], 16)
        scored.append((r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), n))
    fit = sorted((x for x in scored if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = fit[: len(fit) * percent // 100]
    ranks = defaultdict(list)
    for i, x in enumerate(drawn, 1):
        ranks[x].append(i)
    return sorted([(*x[:4], ranks[x].pop(0) if ranks[x] else None) for x in scored], key=str)


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 35), (1, 100)])
def test_resampling_against_a_plain_version(spark, longest, percent, monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 50)
    rows = corpus(900, 5) + HARD + [(5000, "tie word " * 30, "en", "a", 1, "x")] * 4
    target = ["w1 w2 Ärger w3 w1", None, "", "w7 " * 40]
    got = resample.resample(table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(rows, target, longest, percent=percent)


def test_selection_finds_every_place(spark):
    values = [random.Random(4).randrange(50) for _ in range(700)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    want = sorted((v, i) for i, v in enumerate(values))
    for k in (1, 2, 350, 699, 700):
        assert resample.select(df, F.struct("v", "i"), k) == want[k - 1]
    assert resample.select(df, F.struct("v", "i"), 701) is None


def test_resampling_of_empty_tables(spark):
    none = table(spark, HARD).limit(0)
    assert resample.resample(none, none).count() == 0
    got = resample.resample(table(spark, HARD), none).collect()
    assert len(got) == len(HARD) and all(r["rank"] is None for r in got)


def test_long_texts_are_whole(spark):
    text = " ".join(f"w{i % 977}" for i in range(400_000))
    (r,) = resample.resample(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("w1",)], "text string"), percent=100).collect()
    assert r["n_features"] == 400_000 and r["rank"] == 1
    assert np.array_equal(resample.counts(spark.createDataFrame([(text,)], "text string")).sum(), 400_000)
