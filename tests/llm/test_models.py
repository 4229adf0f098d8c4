"""Learned scorers: held-out results on the small tables, and hard rows."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from auricle.llm import common, mixing, toxicity
from tests.llm.helpers import FOLD, documents, words

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_documents(spark):
    rows = toxicity.op1_toxicity(spark, SF).join(common.read(spark, SF, "labels"), "doc_id").where("held_out").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    better = np.mean([a > b for a in toxic for b in clean])
    assert better > 0.75 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_toxicity_finds_nine_of_ten(spark):
    """Over all held-out labelled rows of sf0.1. Of the 144 toxic ones, 9 hold none of the insults (or stems of them) that the others have: their labels are noise."""
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op1_toxicity(spark, sf).join(common.read(spark, sf, "labels"), "doc_id").where("held_out").collect()
    found = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert found[1, 1] + found[1, 0] == 144 and found[0, 0] + found[0, 1] == 1200
    assert found[1, 1] >= 130 and found[0, 1] <= 15


def test_digits_inside_words_belong_to_them():
    assert toxicity.words_of("1d10t, x2 42 a_b") == ["1d10t", "x2", "a", "b"]


def test_toxicity_learns_misspellings():
    clean, bad = ["the house on the hill", "a small river runs by", "we went to the market"], ["you idiot go away", "what an idiot you are", "such idiots here"]
    model = toxicity.fit(clean * 20 + bad * 20, np.array([0] * 60 + [1] * 60))
    assert model.score("an idiotic house") > model.score("a house by the river")
    assert model.score("") == model.score("123 !!")


def test_toxicity_of_hard_rows(spark):
    model = toxicity.fit(["a", "b"], np.array([1, 1]))
    assert model.score("x") > 0.99
    rows = [(1, None), (2, ""), (None, "x"), (1, "x"), (3, "idiot " * 50_000)]
    out = toxicity.score(documents(spark, rows), model).collect()
    assert len(out) == 5 and all(0 <= r["toxicity"] <= 1 for r in out)
    assert toxicity.score(documents(spark, rows).limit(0), model).count() == 0
    assert toxicity.fit([], np.array([], int)).score("x") == 0.5


def test_base_scores_are_exact(spark):
    rows = [(i, f"Word{i % 7} and the {'x' * (i % 3)} end") for i in range(40)] + [(50, None), (51, ""), (None, "the end"), (3, "the end")]
    got = mixing.score(documents(spark, rows), common.held_out(F.col("doc_id"), 7, 2)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in [*words((t or "").translate(FOLD)), "\n"])
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows for w in [[*words((t or "").translate(FOLD)), "\n"]]), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 for r in got)


def test_code_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    tokens = [b"w%d" % i for i in range(60)] + [mixing.END]
    book = mixing.Book(tokens, rng.integers(0, 50, 61), 9)
    assert len(book.length) == 62 and math.isclose(sum(2.0**-book.length), 1) and len(set(book.leaf.values()) | {book.escape}) == 62
    kind = mixing.SEQUENCE
    table = np.zeros(2 * kind.slots, np.int64)
    leaf = rng.integers(0, 62, 4000)
    learned = mixing.Contexts(leaf, np.zeros(4000, np.uint8), np.array([4000]), np.array([1]), 1)
    (bits,) = learned.bits(book, 0, 4000)
    for i in range(kind.inputs):
        np.add.at(table, bits.slots[i] + kind.slots * bits.bit, 1)
    learner = mixing.Learner(kind, mixing.Opinions(kind, mixing.packed(table)))
    learner.add(bits)
    model = mixing.Model(kind, mixing.packed(table), learner.values())
    # after the same two words, every token in turn
    after = mixing.Contexts(np.array([x for k in range(62) for x in (5, 7, k)]), np.zeros(186, np.uint8), np.full(62, 3), np.ones(62, int), 0)
    p = 10 ** model.log10(*after.bits(book, 0, 186), 186)[2::3]
    assert math.isclose(p.sum(), 1, rel_tol=1e-3) and (p > 0).all()


def test_spelled_words_are_less_than_one_in_all():
    found, count = [b"the", b"then", b"there", b"an", b"and"], np.array([50.0, 4, 6, 20, 30])
    kind, table = mixing.SPELLING, np.zeros(2 * mixing.SPELLING.slots, np.int64)
    letters = mixing.Letters(np.bincount(np.frombuffer(b" ".join([*found, b""]), np.uint8), minlength=256))
    assert math.isclose(sum(2.0**-letters.length), 1)
    bits = mixing.spelled(found, letters, count, True)
    for i in range(kind.inputs):
        np.add.at(table, bits.slots[i] + kind.slots * bits.bit, np.rint(bits.weight**2).astype(np.int64))
    learner = mixing.Learner(kind, mixing.Opinions(kind, mixing.packed(table)))
    learner.add(bits)
    model = mixing.Model(kind, mixing.packed(table), learner.values())
    short = [bytes([a]) for a in range(1, 256) if a not in (9, 10, 11, 12, 13, 32)]
    assert 0 < sum(10 ** mixing.spellings(model, letters, short)) < 1
    good, bad = mixing.spellings(model, letters, [b"the", b"zzz"])
    assert good > bad
    # a word longer than PIECE is spelled in pieces
    assert mixing._pieces([b"a", b"b" * 5000])[1].tolist() == [0, 1, 1]
    assert mixing.spellings(model, letters, [b"b" * 5000])[0] < -100


def test_continuations_against_brute_force():
    rng = np.random.default_rng(5)
    n = 400
    key = rng.integers(0, 12, n).astype(np.uint64)
    lengths = rng.integers(1, 6, n)
    texts = [rng.integers(1, 4, k).astype("<u2") for k in lengths]
    times, held = rng.integers(1, 4, n), rng.random(n) < 0.3
    got = np.split(mixing.continued(key, np.concatenate(texts), lengths, times, held), np.cumsum(lengths)[:-1])
    for i in range(n):
        for j in range(lengths[i]):
            count = Counter()
            for k in range(n):
                if key[k] == key[i] and len(texts[k]) > j and (texts[k][:j] == texts[i][:j]).all():
                    count[int(texts[k][j])] += 0 if held[k] else int(times[k])
            mine = int(texts[i][j])
            count[mine] -= 0 if held[i] else 1
            best = min(count, key=lambda w: (-count[w], w))
            want = 0
            if count[best]:
                others = sum(count.values()) - count[best]
                bucket = lambda c: int(mixing._bucket(np.array([c]))[0])
                want = mixing.SEEN | (best == mine) * mixing.HIT | bucket(count[best]) << 3 | bucket(others)
            assert got[i][j] == want


def test_word_order_copies_and_random_words(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randrange(2, 9)))
    vocabulary = [word() for _ in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(150)] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    mixed = [rng.sample(t, len(t)) for t in texts[:8]]
    rows += [(1000 + i, " ".join(t)) for i, t in enumerate(texts[:8])] + [(2000 + i, " ".join(t)) for i, t in enumerate(mixed)]
    rows += [(3000, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(50)))]
    out = {r["doc_id"]: r for r in mixing.score(documents(spark, rows), F.col("doc_id") >= 1000).collect()}
    for i in range(8):
        # a copy is predicted from what it is a copy of; in another order it is not
        assert out[1000 + i]["score"] > out[2000 + i]["score"] + 50
        assert out[i]["base_score"] == out[1000 + i]["base_score"]
    new = out[3000]
    assert new["n_known"] == 1 and new["score"] / new["n_tokens"] > -30 and 0 < new["bits_per_byte"] < 12


def test_the_end_is_no_word(spark):
    rows = [(1, "a b"), (2, "a"), (3, "\0"), (4, "")]
    out = {r["doc_id"]: r for r in mixing.score(documents(spark, rows), F.col("doc_id") >= 3).collect()}
    assert (out[3]["n_known"], out[3]["n_tokens"], out[3]["train_tokens"]) == (1, 2, 5)
    assert math.isclose(out[3]["base_score"], math.log10(1 / 9) + math.log10(3 / 9))


def test_texts_of_one_huge_word_and_many_words(spark):
    rows = [(1, "x" * 300_000), (2, "the " * 300_000), (3, None), (4, "the house")]
    out = mixing.score(documents(spark, rows), F.lit(False)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {1: 2, 2: 300_001, 3: 1, 4: 3} and all(-1e6 < r["score"] < 0 for r in out)


def test_nothing_to_learn_from(spark):
    out = mixing.score(documents(spark, [(1, "a b")]), F.lit(True)).first()
    assert out["n_known"] == 0 and out["train_tokens"] == 0 and out["score"] < 0
    assert mixing.score(documents(spark, [(1, "a b")]).limit(0), F.lit(False)).count() == 0


def test_unseen_words_where_every_row_stands_twice(spark):
    rows = [(i, f"the house of word{i // 2} by the river") for i in range(40)] + [(99, "the zebra"), (98, "the house")]
    out = {r["doc_id"]: r["score"] for r in mixing.score(documents(spark, rows), F.col("doc_id") >= 98).collect()}
    assert -40 < out[99] < out[98] < 0


def test_toxicity_of_long_runs_of_letters():
    clean, bad = ["the house on the hill", "a small river runs by", "we went to the market"], ["you idiot go away", "what an idiot you are", "such idiots here"]
    model = toxicity.fit(clean * 20 + bad * 20, np.array([0] * 60 + [1] * 60))
    for k in (38, 41, 60, 61, 62, 63, 95, 500):
        assert model.score("q" * k + "idiot" + "q" * 70) > model.score("q" * (k + 75)) + 0.02
    run = "".join(chr(0x4E00 + i) for i in range(300))
    for n in (41, 42, 43, 63, 64, 300):
        pieces = toxicity.words_of(run[:n])
        assert {f"<{run[:n]}>"[i : i + 5] for i in range(n - 2)} == {p[i : i + 5] for p in pieces for i in range(len(p) - 4)} and {len(p) for p in pieces} == {toxicity.PIECE}
    assert toxicity.words_of("Some " + run[:40]) == ["some", run[:40]]


def test_contexts_of_one_to_six_bytes_and_bits_per_byte(spark):
    assert {1, 2, 3, 4, 5, 6, 0} == set(mixing.ORDERS)
    rows = [(i, "the house by the river") for i in range(9)] + [(10, ""), (11, None), (12, "éa  b")]
    for r in mixing.score(documents(spark, rows), F.lit(False)).collect():
        text = " ".join(words(dict(rows)[r["doc_id"]]))
        assert math.isclose(r["bits_per_byte"], -r["score"] / math.log10(2) / (len(text.encode()) + (2 if text else 1)))


def test_a_match_grants_nothing_to_words_that_only_share_a_part_of_a_hash(spark):
    """Words never seen, in places where training has another word: what the match says must not depend on their hashes."""
    place = lambda w: " ".join(f"a{k} b{k} c{k} {w} d{k}" for k in range(40))
    score = lambda w: mixing.score(documents(spark, [(i, place("word7")) for i in range(20)] + [(1000, place(w))]), F.col("doc_id") >= 1000).where("held_out").first()["score"]
    known, shared, other = score("word7"), score("word2116"), score("word2117")
    # word2116 and word7 have the same top 15 bits
    assert known > -40 and abs(shared - other) < 20 and shared < -400


def test_probabilities_after_a_match_sum_to_one_at_most():
    """100,000 words: of those that may follow an anchor, exactly the one that did is a hit."""
    found = [b"w%d" % i for i in range(100_000)]
    hashes = np.concatenate([[mixing._END], mixing._hashes(found)])
    escape = 7
    codes, rare = np.full(100_001, escape, np.uint16), hashes[1:]
    numbers = mixing.numbered(codes, np.concatenate([[hashes[1]], rare]), escape)
    key = np.full(100_001, 5, np.uint64)
    got = mixing.continued(key, numbers, np.ones(100_001, np.int64), np.append([9], np.ones(100_000, np.int64)), np.append([False], np.ones(100_000, bool)))
    assert (got[1:] & mixing.HIT > 0).sum() == 1 and got[1] & mixing.HIT


def test_training_in_blocks_gives_the_same_numbers(monkeypatch):
    """Subwords and sums are made for some words at a time, to the last bit as if made at once."""
    monkeypatch.setattr(toxicity, "TOGETHER", 7)
    found = ["one", "zwei", "Ängste", "été", "x" * 42, "a1b2", "abcdef"] * 3
    owner, bucket = toxicity.subwords(found)
    order = np.argsort(owner, kind="stable")
    got = toxicity.sorted_subwords(found)
    assert (got[0] == owner[order]).all() and (got[1] == bucket[order]).all()
    value = np.random.default_rng(3).normal(size=len(bucket))
    assert (toxicity._sums(bucket, lambda own: value[own], toxicity.BUCKETS) == np.bincount(bucket, value, toxicity.BUCKETS)).all()


def test_shared_beginnings_of_words_are_spelled_once():
    """In any order, repeated or not, words come out as if each were spelled alone; sorted ones take fewer bits."""
    rng = np.random.default_rng(8)
    found = [bytes(rng.integers(97, 100, rng.integers(1, 9)).astype(np.uint8)) for _ in range(300)] + [b"\0", b"\0\0", "é".encode(), b"x" * 600, b"x" * 600 + b"y"]
    count = rng.integers(1, 6, len(found)).astype(float)
    letters = mixing.Letters(np.bincount(np.frombuffer(b" ".join([*found, b""]), np.uint8), minlength=256))
    kind, tables = mixing.SPELLING, []
    each = [mixing.spelled([w], letters, n, True) for w, n in zip(found, count.reshape(-1, 1))]
    order = sorted(range(len(found)), key=found.__getitem__)
    together = [mixing.spelled([found[i] for i in at], letters, count[at], True) for at in (order, rng.permutation(len(found)).tolist())]
    for several in (each, together[:1], together[1:]):
        tables.append(np.zeros(2 * kind.slots, np.int64))
        mixing.count(tables[-1], kind, several)
    assert (tables[0] == tables[1]).all() and (tables[0] == tables[2]).all()
    assert len(together[0].bit) < 0.6 * sum(len(b.bit) for b in each)
    learners = [mixing.Learner(kind, mixing.Opinions(kind, mixing.packed(tables[0]))) for _ in range(2)]
    for learner, bits in zip(learners, together):
        learner.add(bits)
    # one step from the same words: the same weights and map, however they share
    assert np.allclose(learners[0].values(), learners[1].values(), rtol=1e-3, atol=1e-3)
    model = mixing.Model(kind, mixing.packed(tables[0]), learners[0].values())
    alone = [mixing.spellings(model, letters, [w])[0] for w in found]
    assert np.allclose(mixing.spellings(model, letters, found), alone, atol=1e-4)
    assert np.allclose(mixing.spellings(model, letters, [found[i] for i in order]), np.array(alone)[order], atol=1e-4)


def test_four_steps_of_a_code_share_a_group_of_slots():
    book = mixing.Book([b"w%d" % i for i in range(500)], np.arange(500, 0, -1), 9)
    leaf = np.random.default_rng(4).integers(0, 501, 400)
    (bits,) = mixing.Contexts(leaf, np.zeros(400, np.uint8), np.array([400]), np.array([2]), 1).bits(book, 0, 400)
    depth, token = bits.row, bits.token
    for i in (1, 2):
        groups = {}
        for t, d, slot in zip(token.tolist(), depth.tolist(), (bits.slots[i] >> 4).tolist()):
            groups.setdefault((t, d // 4), set()).add(slot)
        assert all(len(g) == 1 for g in groups.values())
        assert ((bits.slots[i] >= mixing.SEQUENCE.bounds[i]) & (bits.slots[i] < mixing.SEQUENCE.bounds[i + 1])).all()
    # after one word, different nodes of a group have different slots
    (all_after,) = mixing.Contexts(np.array([x for k in range(501) for x in (7, k)]), np.zeros(1002, np.uint8), np.full(501, 2), np.zeros(501, int), 1).bits(book, 0, 1002)
    late = all_after.token % 2 == 1
    first = late & (all_after.row < 4)
    nodes, slots = all_after.slots[0][first], all_after.slots[1][first]
    assert len(set(zip(nodes.tolist(), slots.tolist()))) == len(set(nodes.tolist())) == len(set(slots.tolist()))
