"""Mixing of sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, its rate. Documents stand in order of size; the prefix sum of the rates, plus one
random offset for the source, passes a whole number as often as the document is emitted. As neighbours in the order are alike in size, what is emitted
has nearly the wanted number of words. Documents of more than 1/LARGE of the target are drawn first; the rate of the others makes up for what those took
above or below their part, so a few very long documents don't move a source off its target.

Prefix sums are integers (2^-32 of a copy), so they are the same however rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, order

WEIGHTS, CAP, SEED, LARGE = (5, 2, 1), 3, 2024, 100
BITS = 32
#: Columns that mix() adds; columns of these names in its input are replaced.
ADDED = ["size", "source_size", "target", "copies", "taken"]


def n_words(text: Column) -> Column:
    """Number of runs without white space; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(common.SPACE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def offset(source: Column, seed: int, part: str) -> Column:
    """The random start of a source's prefix sum, in 2^-32 of a copy."""
    name = F.concat(F.lit(f"{seed}{part}"), F.coalesce(F.concat(F.lit(":"), source), F.lit("")))
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")


def fixed(rate: Column) -> Column:
    """Copies as integers of 2^-32."""
    return F.floor(F.coalesce(rate, F.lit(0.0)) * F.lit(float(1 << BITS)) + 0.5).cast("long")


def crossings(place: Column, rate: Column, start: Column) -> Column:
    """How many whole numbers the prefix sum passes at a place (from 0) of rows of the same rate."""
    wide = place.cast("decimal(19,0)") * rate.cast("decimal(12,0)") + start
    return F.shiftright(F.pmod(wide, F.lit(1 << BITS).cast("decimal(12,0)")).cast("long") + rate, BITS)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with target: all words shared by weight, at most `cap` times a source's own. Weights repeat over the sources by code point, null last.

    What capped sources can't take is shared again until no target is above its cap. A round is one sum over the table; the numbers of words and weights are whole,
    so rounds are exact."""
    if cap < 1 or min(weights) <= 0:
        raise ValueError("the cap is at least 1 and weights are above 0")
    placed = order.ranked(sources, [], [F.col("source").asc_nulls_last()], "__place")
    own = common.stored(placed.withColumn("__w", F.get(F.array(*map(F.lit, weights)), F.pmod("__place", F.lit(len(weights))).cast("int")).cast("long")), "sources")
    total, weight = own.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__w"), F.lit(0))).first()
    rest, left = total, weight
    wide = lambda c: c.cast("decimal(19,0)")
    while True:
        over = wide(F.col("source_size") * cap) * wide(F.lit(left)) < wide(F.lit(rest)) * wide(F.col("__w"))
        taken, free = own.agg(F.coalesce(F.sum(F.when(over, F.col("source_size") * cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("__w"))), F.lit(0))).first()
        if (total - taken, free) == (rest, left):
            share = F.lit(float(rest)) * F.col("__w") / F.lit(float(left)) if left else F.lit(0.0)
            return own.withColumn("target", F.when(over, (F.col("source_size") * cap).cast("double")).otherwise(share)).drop("__w", "__place")
        rest, left = total - taken, free


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df (without the text unless keep_text) with size, source_size, target, copies (0 to cap) and taken (copies * size).

    Null and empty texts have size 0: they may be emitted, with 0 words. Null ids come first among equal sizes; rows alike in source, size and id are told apart by
    their text, and equal rows are interchangeable. A null source is a source. An empty table gives an empty one. Columns that begin with __ are the operator's own."""
    own = [c for c in df.columns if c not in ADDED and (keep_text or c != text_col)]
    text = F.col(text_col).cast("string")
    rows = df.select(*own, n_words(text).alias("size"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("__tie"), F.monotonically_increasing_id().alias("__row"), F.col(source_col).cast("string").alias("__source"))
    rows = common.stored(rows, "sizes")
    placed = order.ranked(rows, ["__source"], [F.col("__source").asc_nulls_first(), F.desc("size"), F.col(id_col).asc_nulls_first(), F.col("__tie"), F.col("__row")], "__place")
    placed = common.stored(placed, "placed")
    sizes = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"))
    goal = order.small(common.stored(targets(sizes, weights, cap).withColumnRenamed("source", "__of"), "targets"))
    rate = fixed(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    large = F.col("size") * LARGE > F.col("target")
    first = crossings(F.col("__place"), rate, offset(F.col("__of"), seed, "a"))
    both = placed.join(goal, placed["__source"].eqNullSafe(goal["__of"]))
    found = both.where(large).groupBy("__of").agg(F.count("*").alias("__n"), F.sum("size").alias("__held"), F.sum(F.col("size") * first).alias("__got"))
    drawn = common.stored(goal.join(found.withColumnRenamed("__of", "__o"), F.col("__of").eqNullSafe(F.col("__o")), "left").drop("__o").fillna(0, ["__n", "__held", "__got"]), "drawn")
    rest = F.col("source_size") - F.col("__held")
    second = fixed(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), (F.col("target") - F.col("__got")) / F.nullif(rest, F.lit(0)))))
    drawn = order.small(drawn)
    both = placed.join(drawn, placed["__source"].eqNullSafe(drawn["__of"]))
    copies = F.when(large, first).otherwise(crossings(F.col("__place") - F.col("__n"), second, offset(F.col("__of"), seed, "b")))
    return both.select(*own, "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def emitted(mixed: DataFrame) -> DataFrame:
    """A row for each copy, numbered from 0 in column `copy`; documents without copies go."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))


def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and words that a mix of all documents takes, by document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::BIGINT AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY {CAP} * source_size / w, source NULLS LAST) AS k FROM s),
p AS (SELECT *, sum(source_size) OVER () - coalesce(sum({CAP} * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY k DESC) AS left_w FROM o),
f AS (SELECT rest, left_w FROM p WHERE {CAP} * source_size * left_w >= rest * w ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN {CAP} * source_size * left_w < rest * w THEN ({CAP} * source_size)::DOUBLE ELSE rest::DOUBLE * w / left_w::DOUBLE END AS target
  FROM (SELECT source, source_size, w FROM s), f),
j AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS FIRST) - 1 AS place, size * {LARGE} > target AS large,
  floor(coalesce(target / nullif(t.source_size, 0), 0) * 4294967296.0 + 0.5)::HUGEINT AS rate, ('0x' || substr(sha256('{SEED}a' || coalesce(':' || d.source, '')), 1, 8))::HUGEINT AS u,
  ('0x' || substr(sha256('{SEED}b' || coalesce(':' || d.source, '')), 1, 8))::HUGEINT AS v FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
a AS (SELECT *, CASE WHEN large THEN ((place * rate + u) % 4294967296 + rate) // 4294967296 END AS c FROM j),
b AS (SELECT *, sum(CASE WHEN large THEN 1 ELSE 0 END) OVER w AS n, source_size - sum(CASE WHEN large THEN size ELSE 0 END) OVER w AS small, sum(CASE WHEN large THEN size * c ELSE 0 END) OVER w AS got
  FROM a WINDOW w AS (PARTITION BY source)),
e AS (SELECT *, floor(least({CAP}.0, greatest(0.0, coalesce((target - got::DOUBLE) / nullif(small::DOUBLE, 0), 0))) * 4294967296.0 + 0.5)::HUGEINT AS second FROM b)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * coalesce(c, (((place - n) * second + v) % 4294967296 + second) // 4294967296))::BIGINT AS taken FROM e"""
