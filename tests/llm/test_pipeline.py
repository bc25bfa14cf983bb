"""The pipeline: each stage on its own input, with nulls, extra columns and an empty table; then all of it."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.common import written

SF = "/root/testdata/sf0.001"


def made(spark, rng):
    def line(n):
        return " ".join(rng.choice(["th", "er", "on"]) + rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(n))

    passage, base = line(60), [line(rng.randint(30, 90)) for _ in range(40)]
    texts = base + [base[3], base[3], base[4] + " tail", f"{line(20)} {passage} {line(20)}", f"{line(9)} {passage} end", "use password=hunter22222 now", None, ""]
    rows = [(i, t, "en", "s", len(t or ""), "more") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string"), texts


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs, texts = made(spark, random.Random(1))
    spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5 and list(stages)[0] == "quality"
    good = written(stages["quality"](spark, docs, str(tmp_path)), "t")
    assert good.columns == docs.columns and good.count() == docs.count()
    one = written(stages["near_duplicates"](spark, good, str(tmp_path)), "t")
    left = {r["doc_id"] for r in one.collect()}
    assert one.columns == docs.columns and 3 in left and not {40, 41} & left
    cut = written(stages["repeated_passages"](spark, one, str(tmp_path)), "t")
    got = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == docs.columns and set(got) == left
    assert got[0]["text"] == texts[0] and len(got[44]["text"].split()) == 10 and got[44]["n_chars"] == len(got[44]["text"])
    safe = written(stages["secrets"](spark, cut, str(tmp_path)), "t")
    assert safe.columns == docs.columns and safe.where("doc_id = 45").head()["text"] == "use [SECRET] now"
    packed = stages["packing"](spark, safe, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == left


def test_rows_that_share_an_id_stay_one_a_group(spark, tmp_path):
    docs, texts = made(spark, random.Random(3))
    rows = [(1, texts[1]), (1, texts[2]), (1, texts[2]), (5, texts[2]), (5, texts[6]), (7, texts[7]), (8, texts[7]), (None, texts[7])]
    given = spark.createDataFrame([(i, t, "en", "s", len(t), "more") for i, t in rows], docs.schema)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    left = [(r["doc_id"], r["text"]) for r in written(stage(spark, given.repartition(3), str(tmp_path)), "t").collect()]
    want = [(1, texts[1]), (1, texts[2]), (5, texts[6]), (7, texts[7]), (None, texts[7])]
    assert sorted(left, key=str) == sorted(want, key=str)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs, _ = made(spark, random.Random(2))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs.where(F.lit(False)) if "text" in docs.columns else docs, str(tmp_path)), "t")
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    facts = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("z"))
    assert facts.where("n > 4096 or n <> z").count() == 0 and out.count() > 50
