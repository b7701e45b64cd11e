from pyspark.sql import functions as F

from convlake.operators import judging, metrics


def test_wilson(spark):
    df = spark.createDataFrame([(50, 100), (0, 50), (50, 50), (7, 200), (88, 200), (18, 20), (0, 0)], "k int, n int")
    got = [(round(r.w.low, 4), round(r.w.high, 4)) for r in df.select(metrics.wilson(F.col("k"), F.col("n")).alias("w")).collect()]
    assert got[1][0] == 0 and got[2][1] == 1 and got[3:] == [(0.0171, 0.0705), (0.373, 0.5093), (0.699, 0.9721), (0.0, 0.0)]


def test_kappa(spark):
    df = spark.createDataFrame([(2, 2), (2, 1), (1, 1), (0, 0), (2, 2)], "a int, b int")
    r = metrics.weighted_kappa(df, "a", "b").first()
    assert r.agreement == 0.8 and r.kappa > 0.6
    assert metrics.weighted_kappa(df, "a", "a").first().kappa == 1.0
    assert metrics.weighted_kappa(df.limit(0), "a", "b").first().kappa == 1.0


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(300).select((F.col("id") % 30).alias("c"), (F.col("id") % 3).alias("v"))
    r = metrics.cluster_bootstrap(df, "c", ["v"], 200).first()
    assert r.low <= 1.0 <= r.high


def test_judgement_parsing(spark):
    good = '{"relevance": 2, "grounding": 1, "usefulness": 0, "tone": 2, "critical_error": false, "critical_error_details": {"a": true}}'
    rows = [(0, good), (1, f"Sure: {good} done"), (2, "no json"), (3, good.replace("2,", "2.0,", 1)), (4, good.replace("false", "0")), (5, None), (6, good.replace('"tone": 2, ', ""))]
    df = spark.createDataFrame(rows, "i int, raw string").select("i", judging.parse_judgement(F.col("raw")).alias("p")).orderBy("i")
    got = [(r.p.scores is not None, r.p.error) for r in df.collect()]
    assert got[:2] == [(True, None)] * 2 and not any(ok for ok, _ in got[2:])
    assert got[2][1] == got[5][1] == "unparsable" and "relevance" in got[3][1] and "critical_error" in got[4][1] and got[6][1] == "Missing field: tone"


def test_failures_are_not_hits(spark):
    cache = spark.createDataFrame([("a", "r", "p", True, "1"), ("b", "x", "p", False, "1"), ("c", "r", "p", False, "1")], "cache_key string, rubric_sha256 string, prompt_sha256 string, llm_failure boolean, cached_at string")
    cache = cache.withColumn("scores", F.when(~F.col("llm_failure"), F.struct(F.lit(1).alias("relevance"))))
    wanted = spark.createDataFrame([(k,) for k in "abcd"], "cache_key string")
    got = {r.cache_key: r.status for r in judging.replay(wanted, cache, "r", "p").collect()}
    assert got == {"a": "failed", "b": "stale", "c": "hit", "d": "missing"}


def test_bootstrap_covers_the_mean(spark):
    from convlake.operators import metrics

    df = spark.range(2000).selectExpr("id % 200 as c", "cast((id % 200) % 10 as double) as x")
    r = metrics.cluster_bootstrap(df, "c", ["x"], 400).first()
    assert r.measure == "x" and 3.9 < r.low < 4.5 < r.high < 5.1
    again = metrics.cluster_bootstrap(df.repartition(5), "c", ["x"], 400).first()
    assert abs(again.low - r.low) < 1e-9 and abs(again.high - r.high) < 1e-9
    assert metrics.cluster_bootstrap(df.limit(0), "c", ["x"], 10).count() == 0
