import random

import numpy as np

from auricle.llm import graph, near
from tests.llm.helpers import components, documents, jaccard, shingles


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[:x] if i == j or jaccard(a, b) >= 0.75]
    comp = components(ids, links)
    return sorted(((i, len(shingles(t)), comp[i] if i is not None and shingles(t) else i, i is None or not shingles(t) or comp[i] == i) for i, t in rows), key=str)


def near_table(n=120):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(k)] for k in (60, 150, 40)]
    rows = []
    for i in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.randrange(1 + len(own) // 15)):
            own[rng.randrange(len(own))] = word()
        rows.append((n - i, " ".join(own)))
    rows += [(200, rows[0][1].upper()), (201, "one two"), (202, "One  two"), (203, None), (204, ""), (205, " \n"), (None, rows[0][1]), (206, "a b c d e"), (207, "a b c d"), (208, " ".join([word() for _ in range(5000)]))]
    return rows


def test_against_brute_force(spark):
    rows = near_table()
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.groups(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_blocks_of_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    rows = near_table(60)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.groups(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert near.groups(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_signature_slots_agree_like_the_sets():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.75, 0.9):
        close = []
        for _ in range(60):
            pool = rng.integers(1, 2**62, 300).astype(np.uint64)
            both = int(200 * 2 * share / (1 + share))
            a, b = pool[:200], np.concatenate([pool[:both], pool[200 : 400 - both]])
            h = near.signatures([a, b])
            close.append((h[0] == h[1]).mean())
        assert abs(np.mean(close) - share) < 0.02
    assert (near.signatures([np.array([5], np.uint64)]) != near._EMPTY).all()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 5), (9, 9)], "a long, b long")
    got = {r["id"]: r["comp"] for r in graph.components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 7: 5}
    assert graph.components(links.limit(0)).count() == 0


def test_many_texts_that_share_buckets_and_are_not_linked(spark, monkeypatch):
    """Half of each text is common to all, so most pairs share a bucket; none reaches the threshold but those planted."""
    rng = random.Random(12)
    monkeypatch.setattr(near, "BLOCK", 64)
    shared = [f"c{i}" for i in range(60)]
    texts = [shared + [f"w{rng.randrange(10**6)}" for _ in range(45)] for _ in range(500)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join([*texts[i][:-3], "x", "y", "z"])) for i in range(0, 500, 25)]
    out = {r["doc_id"]: r["component_id"] for r in near.groups(documents(spark, rows)).collect()}
    assert out == {i: i if i < 1000 else i - 1000 for i, _ in rows}


def test_a_step_of_components_shuffles_little(spark, monkeypatch):
    """Three exchanges at most: both sides of the join and the links of a node. There were twelve and more, each of which is a plan to keep and a wave of tasks."""
    plans = []
    for name in ("stored", "cut"):
        monkeypatch.setattr(graph.common, name, lambda df, *a, f=getattr(graph.common, name): plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, *a))
    graph.components(spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")).collect()
    assert len(plans) > 1 and max(p.count("Exchange") for p in plans) <= 3


def test_components_of_hubs_and_chance_links(spark, monkeypatch):
    """Stars whose centre is the smallest, the largest and a middle id, and random links, in forests of few nodes."""
    monkeypatch.setattr(graph, "NODES", 16)
    rng = random.Random(5)
    pairs = [(0, i) for i in range(1, 400)] + [(1500, i) for i in range(1000, 1400)] + [(2200, i) for i in range(2000, 2400)]
    pairs += [(5000 + rng.randrange(1500), 5000 + rng.randrange(1500)) for _ in range(1000)]
    rng.shuffle(pairs)
    got = {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == components(nodes, [p for p in pairs if p[0] != p[1]])
