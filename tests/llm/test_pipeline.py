"""The pipeline stage by stage: each against its operator on what the stage before kept."""

import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from kgspark.llm import near_dedup, quality, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == first.columns
            ids = {r[0] for r in docs.select("doc_id").collect()}
            assert 0 < len(ids) <= before.count()
        if name in ("quality", "toxicity"):
            bad = {r[0] for r in labels.filter("quality = 0" if name == "quality" else "toxic = 1").select("doc_id").collect()} & {r[0] for r in before.select("doc_id").collect()}
            assert len(bad & ids) <= 0.15 * len(bad)
    classes = near_dedup.grouped(kept["toxicity"])
    assert kept["near_dedup"].count() == classes.select("class_id").distinct().count()
    assert Counter(r[0] for r in kept["near_dedup"].select("doc_id").collect()) == Counter(r[0] for r in classes.select("class_id").distinct().collect())
    before = [(r.doc_id, r.text) for r in kept["near_dedup"].collect()]
    every = Counter(tuple(w[i : i + 35]) for w in ((t or "").encode().split() for _, t in before) for i in range(len(w) - 34))
    after = {r.doc_id: r for r in kept["substrings"].collect()}
    for doc_id, text in before:
        w = (text or "").encode().split()
        gone = {i + j for i in range(len(w) - 34) if every[tuple(w[i : i + 35])] > 1 for j in range(35)}
        expected = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else text
        assert after[doc_id].text == expected and after[doc_id].n_chars == len(expected or "")
    assert {r[0] for r in kept["packing"].select("doc_id").collect()} == {r[0] for r in kept["substrings"].select("doc_id").collect()}
    assert kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert quality.THRESHOLD == 0.7 and toxicity.THRESHOLD == 0.5


def test_empty_and_extra_columns(spark):
    """Every stage, with columns named like those that the operators use; null texts and ids, repeated rows, no rows."""
    clashes = ["__score", "score", "node", "row", "size", "text_hash", "stretches", "label", "bucket"]
    docs = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "a b", 3), (2, "", 0)], "doc_id long, text string, n_chars long").withColumns({c: F.lit("x") for c in clashes})
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert name == "packing" or out.columns == df.columns
            assert out.count() >= (1 if df is docs and name in ("near_dedup", "substrings", "packing") else 0)
