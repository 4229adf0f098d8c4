import random
from collections import defaultdict

from pyspark.sql import functions as F

from auricle.llm import lines
from tests.llm.helpers import FOLD, SPACE, documents


def brute(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[line.strip(SPACE).translate(FOLD)].add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        gone = [len(k := x.strip(SPACE).translate(FOLD)) >= 40 and len(held[k] - {None}) >= 5 and i is not None and i < max(held[k] - {None}) for x in own]
        out.append((i, "\n".join(x for x, g in zip(own, gone) if not g), len(own), sum(gone)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    common = [f"line {i} that many documents hold, with enough letters" for i in range(6)] + ["short", "", "\t"]
    rows = []
    for i in range(60):
        own = [rng.choice(common) for _ in range(rng.randrange(8))] + [f"line of document {i} alone, which nobody else has"]
        rng.shuffle(own)
        rows.append((i, "\n".join((" " if rng.random() < 0.3 else "") + (x.upper() if rng.random() < 0.3 else x) for x in own)))
    rows += [(100, None), (101, ""), (None, common[0]), (5, rows[5][1]), (7, common[1] + "\n" + common[1]), (200, "\n".join([common[2]] * 2000))]
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_repeated_lines(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_one_document_is_not_five(spark):
    line = "x" * 50
    out = lines.drop_repeated_lines(documents(spark, [(1, line)] * 9)).collect()
    assert [(r["text"], r["n_dropped"]) for r in out] == [(line, 0)] * 9


def test_empty_table_and_other_columns(spark):
    df = documents(spark, [(1, "a")]).limit(0)
    out = lines.drop_repeated_lines(df)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n", "n_lines", "n_dropped"]


def test_compaction_keeps_counts_and_keepers(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, k, 1, 100 - b) for k in range(b, 8)], "k1 long, k2 long, n long, top long"))
    assert sum(map(len, runs.levels)) < 5
    got = {r["k1"]: r["keeper"] for r in runs.frequent(5).collect()}
    assert got == {4: 100, 5: 100, 6: 100, 7: 100}
    assert runs.frequent(1).agg(F.count("*")).first()[0] == 8
    runs.drop()


def test_names_of_the_operators_own_are_refused_and_runs_stay_in_the_shared_folder(spark):
    import pytest

    from auricle.llm import common

    with pytest.raises(ValueError, match="__t"):
        lines.drop_repeated_lines(documents(spark, [(1, "a")]).withColumn("__t", F.lit(1)))
    runs = lines.LineRuns(spark)
    runs.add(spark.createDataFrame([(1, 1, 1, 9)], "k1 long, k2 long, n long, top long"))
    (where,) = [r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {runs.levels[0][0]}").collect() if r["col_name"] == "Location"]
    plain = lambda x: x.removeprefix("file:").lstrip("/")
    assert plain(where).startswith(plain(common.shared_dir(spark)))
    runs.drop()


def test_many_batches_reach_higher_levels(spark):
    rows = [(i, f"a line that is long enough to be counted, number {i % 7}") for i in range(70)]
    got = lines.drop_repeated_lines(documents(spark, rows), batches=12).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got), key=str) == brute(rows)
