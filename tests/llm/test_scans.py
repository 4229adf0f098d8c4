"""Decontamination and license scans."""

import random
from collections import Counter

from auricle.llm import decontaminate, licences
from tests.llm.helpers import FOLD, documents, words


def brute(docs, items):
    out = []
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for d, t in docs:
        w = words((t or "").translate(FOLD))
        for i, x in items:
            own = words((x or "").translate(FOLD))
            best = None
            if 0 < len(own) < 5:  # one shingle, the whole sequence
                at = next((s for s in range(len(w) - len(own) + 1) if w[s : s + len(own)] == own), None)
                out += [(d, i, 1.0, at, len(own))] if at is not None else []
                continue
            if not grams(w).keys() & grams(own).keys():
                continue
            for s in range(len(w) - len(own) + 1) if len(own) >= 5 else ():
                a, b = grams(w[s : s + len(own)]), grams(own)
                both = sum((a & b).values())
                sim = both / sum((a | b).values())
                if sim >= 0.75 and (best is None or sim > best[0]):
                    best = (sim, s)
            if best:
                out.append((d, i, round(best[0], 6), best[1], len(own)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((14, 20, 20, 57, 5, 4))] + [(7, "la " * 16), (8, None), (9, "")]
    docs = []
    for d in range(60):
        own = [word() for _ in range(rng.randrange(120))]
        for k in rng.sample([0, 1, 2, 3, 4, 5], 2):
            p = items[k][1].upper().split()
            for _ in range(rng.randrange(3)):
                p[rng.randrange(len(p))] = word()
            at = rng.randrange(len(own) + 1)
            own[at:at] = p
        docs.append((d, rng.choice([" ", "\n"]).join(own)))
    docs += [(100, None), (101, ""), (None, items[1][1]), (3, docs[3][1]), (102, "la " * 3000)]
    df, table = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], round(r["similarity"], 6), r["first_word"], r["n_words"]) for r in decontaminate.leaks(df, table).collect()]
    want = brute(docs, items)
    assert sorted(got, key=str) == want and len(want) > 40
    left = decontaminate.clean(df, table)
    bad = {x[0] for x in want}
    assert left.columns == df.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice("abcdef") + rng.choice("uvwxyz") + str(rng.randrange(9)) for _ in range(n))) for k, n in enumerate((39, 25, 12, 8, 6))] + [(7, "la " * 16)]
    docs = []
    for k, t in items:
        w = t.split()
        cuts = [w[1:], w[:-1], w[: len(w) // 2] + w[len(w) // 2 + 1 :], w[: len(w) * 4 // 5 + 1], w[: len(w) * 7 // 10], w[3:-3], w[:4], ["x"] + w[2:-1]]
        docs += [(100 * k + j, " ".join(c)) for j, c in enumerate(cuts)]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = []
    for d, t in docs:
        for i, x in items:
            a, b = grams(t.split()), grams(x.split())
            sim = sum((a & b).values()) / sum((a | b).values())
            if len(t.split()) < len(x.split()) and sim >= 0.75:
                want.append((d, i, round(sim, 6), 0, len(t.split())))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], round(r["similarity"], 6), r["first_word"], r["n_words"]) for r in decontaminate.leaks(documents(spark, docs), table).collect()]
    assert sorted(got) == sorted(want) and (0, 0, round(34 / 35, 6), 0, 38) in want and len(want) > 10
    bad = {x[0] for x in want}
    assert sorted(r["doc_id"] for r in decontaminate.clean(documents(spark, docs), table).collect()) == [d for d, _ in docs if d not in bad]


def test_passes_over_long_lists_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 100)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(15))) for k in range(6)]
    got = decontaminate.leaks(documents(spark, [(k, t) for k, t in items]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(k, k) for k in range(6)]


def test_index_finds_all_within_the_radius():
    rng = random.Random(1)
    items = [(k, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(30)).encode()) for k in range(200)]
    index = decontaminate.Index(items)
    for _ in range(200):
        p = rng.choice(index.prints)
        for b in rng.sample(range(64), rng.randrange(30)):
            p ^= 1 << b
        assert index.near(30, p) == {i for i, q in enumerate(index.prints) if (p ^ q).bit_count() <= decontaminate.RADIUS}


def test_alignment_like_the_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(150):
        b = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 30))]
        a = [x for x in b if rng.random() < 0.9]
        for _ in range(rng.randrange(4)):
            a.insert(rng.randrange(len(a) + 1), rng.choice("qrst"))
        pairs = licences.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and x < y for (p, x), (q, y) in zip(pairs, pairs[1:]))
        assert len(pairs) >= 0.8 * len(licences._subsequence(a, b))


def test_notices(spark):
    mit = next(x[3] for x in licences.notices() if x[:2] == ("MIT", "grant"))
    worn = mit.replace("sublicense, ", "").replace("Permission", "PERMISSION").replace(", ", " ,\n * ")
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore.\nReleased under the MIT License."), (2, "x " * 5000 + worn + " y" * 5000), (3, "the license of the house"), (4, None), (5, ""), (None, "Licensed under the Apache License, Version 2.0."), (1, "Released under the MIT License")]
    got = [(r["doc_id"], r["license"], r["form"]) for r in licences.scan(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT", "line")] * 3 + [(2, "MIT", "grant"), (None, "Apache-2.0", "line")], key=str)
    assert licences.scan(documents(spark, rows).limit(0)).count() == 0


def test_names_and_versions_must_stand():
    finder = licences.Notices(licences.notices(), licences.COVERAGE)
    for text, want in (
        ("Released under the BSD License", ["BSD"]),
        ("Released under the ISC License", ["ISC"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]),
        ("This work is licensed under a Creative Commons Attribution 3.0 License", ["CC-BY-3.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
        ("released under the terms of the MIT License", ["MIT"]),
        ("the license of MIT was released under protest", []),
    ):
        assert [f[0] for f in finder.find(text)] == want
    for name, form, _, text in licences.notices():  # each is found as itself alone, once
        assert [f[:2] for f in finder.find(f"so and so {text} and so on")] == [(name, form)]


def test_planted_and_mutated_notices():
    """Words are lost and put in, also a long run in the middle; each notice is found where it stands and nowhere else."""
    rng = random.Random(11)
    known = licences.notices()
    finder = licences.Notices(known, licences.COVERAGE)
    filler = ["house", "river", "of", "the", "software", "license", "any", "and", "copy"]
    for _ in range(120):
        name, form, must, text = rng.choice([x for x in known if len(licences.tokens(x[3])) > 25])
        own = licences.tokens(text)
        fixed = set()
        for phrase in map(licences.tokens, must):
            at = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
            fixed |= set(range(at, at + len(phrase)))
        lost = set(rng.sample([i for i in range(len(own)) if i not in fixed], int(0.04 * len(own))))
        put = rng.choice([i for i in range(5, len(own) - 5) if i not in fixed])
        middle = [rng.choice(["xx", "yy", "zz"]) for _ in range(rng.randrange(60 if len(own) > 60 else 10))]
        worn = [w for i, w in enumerate(own) if i not in lost or i in (0, len(own) - 1)]
        worn[put:put] = middle if put < len(worn) else []
        if any(f" {' '.join(licences.tokens(p))} " not in f" {' '.join(worn)} " for p in must):
            continue
        before, after = ([rng.choice(filler) for _ in range(rng.randrange(400))] for _ in range(2))
        found = finder.find(" ".join([*before, *worn, *after]))
        assert [f[0] for f in found] == [name], (name, form, found)
        assert abs(found[0][3] - len(before)) <= 3 and abs(found[0][4] - len(before) - len(worn)) <= 3


def test_subsequence_against_a_plain_table():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in range(2))
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        pairs = licences._subsequence(a, b)
        assert len(pairs) == n[-1][-1] and all(a[i] == b[j] for i, j in pairs) and all(p < q and x < y for (p, x), (q, y) in zip(pairs, pairs[1:]))
