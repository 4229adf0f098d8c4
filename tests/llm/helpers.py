"""Plain versions of the operators' contracts, for small tables."""

import re

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def shingles(text, k=5):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def documents(spark, rows):
    """A documents table with an extra column whose name clashes with the operators' own."""
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
