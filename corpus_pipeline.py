"""Cleans a corpus in five stages, each over all rows that the stage before it kept; the last encodes what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.llm import bpe, common, decontaminate, lines, near, toxicity

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxicity.THRESHOLD or more go. The model learns from the labels of the documents it is given."""
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels"), F.lit(False))
    return toxicity.score(docs.select(*DOCUMENTS), model).where(F.col("toxicity") < toxicity.THRESHOLD).select(*DOCUMENTS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go from all but one; n_chars follows the text. No document goes."""
    out = lines.drop_repeated_lines(docs.select(*DOCUMENTS))
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays; null ids stay."""
    kept = near.groups(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*DOCUMENTS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs.select(*DOCUMENTS), common.read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    return bpe.digests(bpe.round_trip(docs))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near-duplicates", drop_near), ("decontamination", drop_leaks), ("byte-level BPE", tokens)]
#: A learned classifier is no SQL; tests/llm/test_pipeline.py holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, f"stage-{i}")
    return docs
