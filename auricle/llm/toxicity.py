"""Toxicity: bags of subwords, averaged into a linear softmax.

A word is itself and its character n-grams of three to five letters, hashed into buckets that each have a vector; a word is the mean of
its subwords' vectors, a passage of SPAN words the mean of theirs, and a two-class softmax reads means. Vectors and softmax are learned together, in
numpy, from labels of whole documents: the mean of a document's TOP most toxic passages is what the softmax reads, and they are learned
from, so that one chance likeness in a long text weighs less than insults that recur. Misspellings and new endings share n-grams with
words that were seen. Digits inside a word belong to it.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

BUCKETS, SIZE = 1 << 18, 8
SPAN = 1
#: Passages of a document whose mean is its score; fewer where it has fewer.
TOP = 3
NGRAMS = (3, 4, 5)
#: Longer runs of letters (scripts without blanks, words run together) are cut into pieces of PIECE letters that overlap by half; each counts as a word.
LETTERS = 40
PIECE = LETTERS + 2
#: Words whose subwords are made together.
TOGETHER = 1 << 15
#: Labelled documents of each class that are learned from at most (those whose ids have the smallest hashes), and their length in characters.
FIT_DOCS, FIT_CHARS = 1000, 20_000
#: Buckets found in fewer training documents keep a zero vector.
MIN_DOCS = 3
ROUNDS = 60
#: Steps of the vectors, the softmax and its bias.
RATES = (0.3, 0.01, 0.05)
THRESHOLD = 0.7
MEMORY = 500_000
#: Words have a letter; digits between or beside letters are part of them.
_WORDS = regex.compile(r"\d*[^\W\d_][^\W_]*").findall


def words_of(text: str) -> list[str]:
    """The words of a text; of a long run, pieces that hold all its letters and its marked ends, and are told from words by their length."""
    found = _WORDS(text.lower())
    if max(map(len, found), default=0) <= LETTERS:
        return found
    out = []
    for w in found:
        if len(w) <= LETTERS:
            out.append(w)
        else:
            w = f"<{w}>"
            out += [w[i : i + PIECE] for i in range(0, len(w) - PIECE, PIECE // 2)] + [w[-PIECE:]]
    return out


def subwords(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For some words: the number of the word and the bucket of each of its subwords, in no order."""
    marked = [w if len(w) > LETTERS else f"<{w}>" for w in found]
    length = np.array([len(w) for w in marked])
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), length)
    start = np.cumsum(length) - length
    place = np.arange(len(letters)) - start[owner]
    power = np.cumprod(np.concatenate([[1], np.full(LETTERS + 2, words.MULTIPLIER)]).astype(np.uint64), dtype=np.uint64)
    owners, hashes = [np.arange(len(marked))], [np.add.reduceat(letters * power[place], start)]
    for n in NGRAMS:
        at = np.flatnonzero(place + n <= length[owner])
        owners.append(owner[at])
        hashes.append(sum((letters[at + j] * power[j] for j in range(1, n)), letters[at]) + np.uint64(n << 40))
    return np.concatenate(owners), (words.mix(np.concatenate(hashes)) % np.uint64(BUCKETS)).astype(np.int64)


def sorted_subwords(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same, by words; made for TOGETHER words at a time, since what it takes meanwhile is many times what comes out."""
    owners, buckets = [], []
    for lo in range(0, len(found), TOGETHER):
        owner, bucket = subwords(found[lo : lo + TOGETHER])
        order = np.argsort(owner, kind="stable")
        owners.append((owner[order] + lo).astype(np.int32))
        buckets.append(bucket[order].astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


def _sums(at: np.ndarray, values: Callable[[slice], np.ndarray], n: int) -> np.ndarray:
    """What np.bincount(at, all values, n) gives, added in the same order, without arrays of all values."""
    total = np.zeros(n)
    for lo in range(0, len(at), TOGETHER):
        own = slice(lo, lo + TOGETHER)
        np.add.at(total, at[own], values(own))
    return total


def passages(n_words: int) -> np.ndarray:
    """Where the passages of a text begin: of about equal length, of SPAN words or a little more."""
    return np.linspace(0, n_words, max(1, n_words // SPAN) + 1)[:-1].astype(np.int64) if n_words else np.zeros(0, np.int64)


class Model:
    """A number for each bucket (its vector seen by the softmax), and how the mean of a document's highest passages becomes a score."""

    def __init__(self, values: np.ndarray, bias: float, scale: float, shift: float):
        self.values, self.bias, self.scale, self.shift = values, bias, scale, shift
        self.known: dict[str, float] = {}

    def learn_words(self, found: list[str]) -> None:
        """Makes the values of new words known: the mean over their subwords."""
        for lo in range(0, len(found), TOGETHER):
            own = found[lo : lo + TOGETHER]
            owner, bucket = subwords(own)
            value = np.bincount(owner, self.values[bucket]) / np.bincount(owner)
            self.known.update(zip(own, value.tolist()))

    def logits(self, texts: list[str]) -> np.ndarray:
        """The mean of each text's TOP highest passages; a text without words has the bias."""
        if len(self.known) > MEMORY:
            self.known.clear()
        known, found = self.known, [words_of(t) for t in texts]
        self.learn_words(list({w for own in found for w in own if w not in known}))
        out = np.full(len(texts), self.bias)
        for i, own in enumerate(found):
            if own:
                v, start = np.array([known[w] for w in own]), passages(len(own))
                logit = np.add.reduceat(v, start) / np.diff(np.append(start, len(v)))
                out[i] += (np.partition(logit, -TOP)[-TOP:] if len(logit) > TOP else logit).mean()
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -30, 30)))

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Model:
    """Learns from whole texts and labels (0, 1). Without both classes, every score is the share of label 1 (one half without labels)."""
    if len(set(toxic.tolist())) < 2:
        share = float(toxic.mean()) if len(toxic) else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    number: dict[str, int] = {}
    word, start, doc, n = array("i"), array("q"), array("q"), 0
    for i, t in enumerate(texts):
        own = array("i", [number.setdefault(w, len(number)) for w in words_of(t)])
        begin = n + passages(len(own))
        start.frombytes(begin.tobytes())
        doc.frombytes(np.full(len(begin), i).tobytes())
        word.extend(own)
        n += len(own)
    word, start, doc = np.frombuffer(word, np.int32), np.frombuffer(start, np.int64), np.frombuffer(doc, np.int64)
    n_words = len(number)
    owner, flat = sorted_subwords(list(number))
    number.clear()
    sizes = np.bincount(owner, minlength=n_words)
    length = np.diff(np.append(start, n))
    ends, in_docs = np.cumsum(sizes), np.zeros((2, BUCKETS))
    for lo in np.unique(doc):
        a, b = np.searchsorted(doc, (lo, lo + 1))
        own = np.unique(word[start[a] : start[b] if b < len(start) else n])
        n_sub = sizes[own]
        at = np.arange(n_sub.sum()) - np.repeat(np.cumsum(n_sub) - n_sub, n_sub)
        in_docs[toxic[lo], np.unique(flat[np.repeat(ends[own] - n_sub, n_sub) + at])] += 1
    used = np.flatnonzero(in_docs.sum(axis=0) >= MIN_DOCS)
    inverse = np.full(BUCKETS, -1)
    inverse[used] = np.arange(len(used))
    keep = inverse[flat] >= 0
    share = (1 / sizes).astype(np.float32)[owner[keep]]
    bucket, owner = inverse[flat[keep]].astype(np.int32), owner[keep]
    del flat, keep, inverse
    # Vectors begin along the softmax's direction, as far as a bucket's documents differ by class (signed root of the likelihood ratio).
    n_class = np.bincount(toxic, minlength=2).astype(float)
    seen = in_docs[:, used]
    expected = seen.sum(axis=0) * (n_class / n_class.sum())[:, None]
    ratio = 2 * (seen * np.log(np.maximum(seen, 1e-9) / expected)).sum(axis=0)
    evidence = np.sign(seen[1] - expected[1]) * np.sqrt(np.maximum(ratio, 0))
    rng = np.random.default_rng(seed)
    softmax = rng.normal(0, 1, SIZE)
    softmax /= np.linalg.norm(softmax)
    vectors = np.outer(evidence, softmax) + rng.normal(0, 0.01, (len(used), SIZE))
    bias = 0.0
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    many = np.diff(np.append(first, len(doc)))
    place = np.arange(len(doc)) - np.repeat(first, many)
    label = toxic[doc[first]].astype(float)
    balance_of = np.where(label == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    moments = [[np.zeros_like(vectors), np.zeros_like(vectors)], [np.zeros(SIZE), np.zeros(SIZE)], [np.zeros(1), np.zeros(1)]]
    for step in range(ROUNDS):
        seen_by_softmax = vectors @ softmax
        by_word = _sums(owner, lambda own: share[own] * seen_by_softmax[bucket[own]], n_words)
        logit = np.add.reduceat(by_word[word], start) / length + bias
        top = np.zeros(len(doc), bool)
        top[np.lexsort((-logit, doc))[place < TOP]] = True
        highest = np.add.reduceat(np.where(top, logit, 0), first) / np.minimum(many, TOP)
        if step == 0:  # begin between the classes
            middle = (np.median(highest[toxic[doc[first]] == 1]) + np.median(highest[toxic[doc[first]] == 0])) / 2
            bias, logit, highest = bias - middle, logit - middle, highest - middle
        error = balance_of * (1 / (1 + np.exp(-np.clip(highest, -30, 30))) - label)
        error = np.where(top, np.repeat(error / np.minimum(many, TOP), many), 0)
        to_word = np.bincount(word, np.repeat(error / length, length), n_words)
        to_bucket = _sums(bucket, lambda own: share[own] * to_word[owner[own]], len(used))
        grads = (np.outer(to_bucket, softmax), to_bucket @ vectors, float(error.sum()))
        moves = []
        for (mean, square), g, rate in zip(moments, grads, RATES):  # Adam
            mean *= 0.8
            square *= 0.95
            mean += 0.2 * g
            square += 0.05 * g * g
            moves.append(rate * (mean / (1 - 0.8 ** (step + 1))) / (np.sqrt(square / (1 - 0.95 ** (step + 1))) + 1e-7))
        vectors -= moves[0]
        softmax -= moves[1]
        bias -= float(moves[2][0])
    values = np.zeros(BUCKETS)
    values[used] = vectors @ softmax
    model = Model(values, bias, 1.0, 0.0)
    logits = np.concatenate([model.logits(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    scale, shift = 1.0, 0.0
    middle, spread = logits.mean(), logits.std() + 1e-9
    z = (logits - middle) / spread
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    for _ in range(400):  # one slope and one offset, by gradient descent
        e = weight * (1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30))) - toxic)
        scale -= 2.0 * float((e * z).sum())
        shift -= 2.0 * float(e.sum())
    return Model(values, bias, scale / spread, shift - scale * middle / spread)


def train(docs: DataFrame, labels: DataFrame, held: Column) -> Model:
    """A model from the labels of documents that are not held out; held: a Column over doc_id. At most FIT_DOCS of a class go to the driver.

    A document with both labels counts as toxic; labels other than 0 and 1 are left out. Texts of over FIT_CHARS characters are not learned from."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held)
    sized = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("chars")).where(F.col("chars") <= FIT_CHARS).join(known, "doc_id")
    texts, toxic = [], []
    for y in (0, 1):
        # at most FIT_DOCS ids go to all executors, so texts are picked where they are read
        ids = sized.where(F.col("toxic") == y).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS).distinct()
        chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text") <= FIT_CHARS).join(F.broadcast(ids), "doc_id")
        rows = chosen.orderBy("doc_id", "text").limit(FIT_DOCS).collect()
        texts += [r["text"] for r in rows]
        toxic += [y] * len(rows)
    return fit(texts, np.array(toxic))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of df with toxicity (0 to 1; a column of that name is replaced) from the whole text of every row; null and empty texts
    have the score of no words. Repeated rows are scored each."""
    sent = df.sparkSession.sparkContext.broadcast((model.values.astype("<f4"), model.bias, model.scale, model.shift))
    made: list[Model] = []

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        if not made:
            made.append(Model(*sent.value))
        parts = [made[0].scores([t or "" for t in text.slice(lo, TOGETHER >> 7).to_pylist()]) for lo in range(0, len(text), TOGETHER >> 7)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return df.withColumn("toxicity", toxicity(F.col(text_col).cast("string")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    held = common.held_out(F.col("doc_id"), 3, 1)
    model = train(docs, common.read(spark, sf_dir, "labels"), held)
    rows = score(docs, model)
    return rows.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
