import pytest
from pyspark.sql import functions as F

from gleanwork.operators.search import RetrievalConfig
from gleanwork.plans import harness as H


def test_runs_of_all_configurations(spark):
    parts = spark.createDataFrame([(1, "a", 0, ["x"], [1.0, 0.0]), (2, "b", 1, ["y"], [0.0, 1.0]), (3, "c", 2, ["z"], [-1.0, -1.0])], "part_id long, unit_id string, row_no int, tokens array<string>, vec array<double>")
    q = spark.createDataFrame([("q", ["x"], [0.0, 1.0])], "qid string, tokens array<string>, vec array<double>")
    got = H.run_all(q, parts, {"lexical": RetrievalConfig(use_dense=False), "dense": RetrievalConfig(use_bm25=False), "both": RetrievalConfig()})
    first = {r["run"]: r["unit_id"] for r in got.filter("rank = 1").collect()}
    assert first["lexical"] == "a" and first["dense"] == "b" and set(first) == {"lexical", "dense", "both"}
    assert H.compare_top(got.filter("run = 'dense'"), got.filter("run = 'both'"), 2).first()["overlap"] == 1


def test_validation_and_lock(spark):
    df = spark.createDataFrame([("q1", "t", "A", "x"), ("q2", "u", "B", "x")], "qid string, text string, support_class string, area string")
    assert [r["support_group"] for r in H.validate_queries(df).orderBy("qid").collect()] == ["search", "nonsearch"]
    for bad in (df.union(df), df.withColumn("text", F.lit(" ")), df.withColumn("support_class", F.lit("Z"))):
        with pytest.raises(ValueError):
            H.validate_queries(bad)
    lock = H.subset_lock(["b", "a"])
    assert H.subset_lock(["a", "b"], lock) == lock
    with pytest.raises(ValueError):
        H.subset_lock(["a"], lock)
    assert {r["area"]: (r["A"], r["n"]) for r in H.composition(df).collect()} == {"x": (1, 2), "total": (1, 2)}


def test_usage_cache_and_logs(spark, tmp_path):
    df = spark.createDataFrame([('{"usage_metadata": {"input_tokens": 5, "output_tokens": 2}}',), ('{"prompt_eval_count": 7, "eval_count": 1}',), ("{}",)], "r string")
    got = [tuple(r[0]) for r in df.select(H.token_usage(F.col("r"), F.lit("abcdef"), F.lit("ab"))).collect()]
    assert got == [(5, 2, "usage_metadata"), (7, 1, "server"), (3, 1, "estimate")]
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    cache = texts.select(F.lit("m").alias("model"), F.sha1("text").alias("key"), F.upper("text").alias("translation")).filter("translation = 'A'")
    out = {r["text"]: (r["translation"], r["fresh"]) for r in H.with_cache(texts, cache, "m", lambda t: F.concat(t, F.lit("!"))).collect()}
    assert out == {"a": ("A", False), "b": ("b!", True)}
    H.append_log(spark, str(tmp_path / "log"), case_id="c", question="q", sources=["u"])
    assert H.recent(spark.read.parquet(str(tmp_path / "log")), "c").first()["sources"] == '["u"]'


def test_measure_and_environment(spark):
    times = H.measure({"a": lambda: None, "b": lambda: None}, warm_up=1, repeats=2)
    assert sorted(n for n, _ in times) == ["a", "a", "b", "b"] and H.environment(spark)["spark"] == spark.version
