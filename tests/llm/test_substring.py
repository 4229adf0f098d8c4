import random

from auricle.llm import substring
from tests.llm.helpers import documents, words


def brute(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def table():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    passages = [[word() for _ in range(n)] for n in (50, 60, 130, 49)]
    rows = []
    for i in range(40):
        own = [word() for _ in range(rng.randrange(80))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(own) + 1)
            own[at:at] = p[rng.randrange(3) :]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(own)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (60, None), (61, ""), (None, rows[3][1]), (62, " ".join(["same"] * 300)), (63, " ".join(["same"] * 70)), (64, "x " * 49)]
    return rows


def test_against_brute_force(spark):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring.drop_repeated_passages(documents(spark, table())).collect()]
    assert sorted(got, key=str) == brute(table())


def test_hot_buckets_are_settled_in_parts(spark, monkeypatch):
    rows = table()
    found = list(substring._settle([(d, 0, 0, 1, " ".join(["w"] * 50).encode()) for d in (4, 2, 9)], True))
    assert sorted(f[0] for f in found if f[4] is None) == [4, 9] and [f[0] for f in found if f[4]] == [2]
    monkeypatch.setattr(substring, "HOT", 2)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring.drop_repeated_passages(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert substring.drop_repeated_passages(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_every_window_is_in_one_super_kmer():
    texts = [" ".join(random.Random(i).choice("abcdef") for _ in range(n)).encode() for i, n in enumerate((10, 50, 51, 300, 0))]
    seen = [(int(d), int(s) + k) for ds, _, starts, ns in substring.super_kmers(texts) for d, s, n in zip(ds, starts, ns) for k in range(n)]
    assert sorted(seen) == [(1, 0), (2, 0), (2, 1), *((3, k) for k in range(251))]
