"""The pipeline's stages against plain versions of them, on the smallest tables."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from auricle.llm import bpe, common, toxicity
from tests.llm import test_lines, test_near, test_scans

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    docs = common.read(spark, SF, "documents")
    items = rows_of(common.read(spark, SF, "benchmark").withColumnRenamed("item_id", "doc_id"))
    model = toxicity.train(docs, common.read(spark, SF, "labels"), F.lit(False))
    kept = rows_of(docs)

    def without_leaks(rows):
        bad = {x[0] for x in test_scans.brute(rows, items)}
        return [(i, t) for i, t in rows if i not in bad]

    plain = {
        "toxicity": lambda rows: [(i, t) for i, t in rows if model.score(t or "") < toxicity.THRESHOLD],
        "line dedup": lambda rows: [(i, t) for i, t, _, _ in test_lines.brute(rows)],
        "near-duplicates": lambda rows: [(i, t) for (i, t), k in zip(sorted(rows, key=lambda r: r[0]), sorted(test_near.brute(rows), key=lambda r: r[0])) if k[3]],
        "decontamination": without_leaks,
    }
    assert [name for name, _ in pipeline.STAGES] == [*plain, "byte-level BPE"]
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF), "test-stage")
        kept = plain[name](kept)
        assert docs.columns == pipeline.DOCUMENTS
        assert sorted(rows_of(docs)) == sorted(kept), name
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(open(public_tokenizers.path(bpe.NAME), "rb").read()), special_tokens={})
    got = {r["doc_id"]: r for r in pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert set(got) == {i for i, _ in kept}
    for i, t in kept:
        ids = np.array(real.encode_ordinary(t), "<u4").tobytes()
        assert (got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
