"""The corpus pipeline: stages chain, their decisions take effect, and clean documents stay."""

import random

import pytest

pytest.importorskip("pairloom.llm")
import corpus_pipeline  # noqa: E402


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(3000)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = line(40)
    data = [(i, line(120), "en", f"s{i % 4}", 0) for i in range(80)]
    near = data[3][1].split(" ")
    near[10] = "changed"
    data += [(200, " ".join(near), "en", "s1", 0), (201, data[4][1], "en", "s2", 0), (202, "too short", "en", "s0", 0), (203, line(30) + " " + item, "en", "s3", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert left["quality rules"] == {r[0] for r in data} - {202}
    assert left["n-gram Jaccard join"] == left["quality rules"] - {200, 201}
    assert left["benchmark decontamination"] == left["n-gram Jaccard join"] - {203}
    out = corpus_pipeline.run(spark, str(tmp_path))
    slots = sorted(r["slot"] for r in out.select("slot").collect())
    assert slots == list(range(len(slots))) and slots


def test_pipeline_on_an_empty_table_and_on_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"n{i}" for i in range(60))
    data = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, words, None, None, None), (None, words + " more", "en", "a", 1), (2, words, None, None, None), (3, "", "en", None, 0)]
    for name, rows, kept in (("none", [], 0), ("nulls", data, 1)):
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted(r["slot"] for r in got) == list(range(len(got))) and bool(got) == bool(kept)
