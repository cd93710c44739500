"""Files in and out, result catalogues, the cache stream."""

import json

import pytest
from pyspark.sql import functions as F

from poolaudit import storage
from poolaudit.operators import report
from poolaudit.schema import DATASET_ROW
from poolaudit.sources import catalogue, jsonl
from poolaudit.streaming.cached import fill_cache


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "p", "completion": "c", "extra": 1}\n\n  \n{"prompt": "q", "completion": "d"}\n')
    rows = jsonl.read_dataset(spark, str(tmp_path / "a.jsonl"))
    assert [tuple(r) for r in rows.collect()] == [("p", "c"), ("q", "d")]
    assert [tuple(r) for r in jsonl.with_row_idx(rows).collect()] == [(0, "p", "c"), (1, "q", "d")]
    jsonl.save_jsonl(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        jsonl.save_jsonl(rows, str(tmp_path / "out"))
    assert jsonl.read_dataset(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"prompt": "p"}\n')
    with pytest.raises(Exception, match="row without"):
        jsonl.read_dataset(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "worse.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path / "worse.jsonl"), DATASET_ROW).collect()


def test_pairs_and_instructions(spark):
    m = "messages array<struct<role string, content string>>"
    chats = spark.createDataFrame([([("system", "s"), ("user", "u"), ("assistant", "a"), ("user", "v")],), ([("user", "u")],), (None,)], m)
    assert [tuple(r) for r in jsonl.to_pairs(chats).collect()] == [("u", "a")]
    ins = spark.createDataFrame([("do", "it"), ("do", None), ("", None), (None, None)], "instruction string, input string")
    assert [r.prompt for r in jsonl.to_instructions(ins).collect()] == ["do\n\nit", "do"]


def test_catalogue(spark, tmp_path):
    a = tmp_path / "owl_vs_control_k16_canon8"
    a.mkdir()
    leaf = lambda x: {"n": 10, "auroc": x}
    (a / "eval_trajectory-lora32-seed43.json").write_text(json.dumps({"system_prompt": None, "test_sets": {}, "results": {"final": {"indist": leaf(0.8)}, "base": {"indist": leaf(0.5)}, "checkpoint-100": {"indist": leaf(0.6)}}}))
    (a / "eval_baseline.json").write_text(json.dumps({"model": "m", "system_prompt": "sp", "results": {"indist": leaf(0.4)}}))
    rows = catalogue.trajectories(spark, str(tmp_path)).where("metric = 'auroc'")
    got = {(r["rank"], r.seed, r.checkpoint): (r.source, r.k, r.has_prompt, r.value) for r in rows.collect()}
    assert got[32, 43, "final"] == ("owl", 16, False, 0.8) and got[8, 42, "base"] == ("owl", 16, True, 0.4) and len(got) == 4
    last = report.last_checkpoint(rows.where("seed = 43"), ["source"], "value").collect()[0]
    assert (last.checkpoint, last.value) == ("final", 0.8)
    (tmp_path / "summary.json").write_text(json.dumps({"arms": {"random": {"n": 5, "poison_frac_remaining": 0.4}}, "agreement": {"pearson": {"a~b": 0.3}}}))
    assert [tuple(r)[1:4] for r in catalogue.filter_summaries(spark, str(tmp_path)).collect()] == [("random", 5, 0.4)]
    assert [tuple(r)[1:] for r in catalogue.agreements(spark, str(tmp_path)).collect()] == [("pearson", "a", "b", 0.3)]


def test_stream_fills_what_is_left_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    df.where("id < 6").write.parquet(src)
    fill_cache(spark, src, df.schema, out, ck, "id", lambda b: b)
    df.where("id >= 3").write.mode("append").parquet(src)
    fill_cache(spark, src, df.schema, out, ck, "id", lambda b: b)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))


def test_storage_uses_the_folder_of_the_session(spark):
    df = storage.materialise(spark.range(3), "x")
    assert df.count() == 3 and storage.shared_dir(spark) in df.inputFiles()[0].replace("file:///", "file:///")
