from pyspark.sql import functions as F

from convlake.operators import scoring as S

POLICY = S.Policy(
    rules=(S.Rule("access", r"\b(hacked|password)\b"), S.Rule("support", r"\b(crash|app)\b")), signals={"security": r"\bhacked\b"}, default="other", openers={"support": "Sorry."}, actions={"support": "Please reinstall it now, thanks."},
    claims=(S.Claim("reinstall", r"\bre-?install", ("reinstall",), (r"do not reinstall",)),), cautious=("access",), threshold=0.25,
)
EV = "array<struct<id:string,reply:string,customer:string,score:double>>"


def run(spark, rows):
    df = spark.createDataFrame(rows, f"id string, message string, evidence {EV}")
    return {r.example_id: r for r in S.predict(df, "id", "message", None, "evidence", POLICY, {"security": "sec", "unresolved_ambiguity": "amb"}).collect()}


def test_stages(spark):
    good = [("e1", "Please reinstall the whole app today", "q", 0.85)]
    weak = [("e2", "Please restart the whole thing today", "q", 0.10)]
    against = [("e3", "Do not reinstall the whole app today", "q", 0.9)]
    got = run(spark, [("1", "my app did crash again and again", good), ("2", "my app did crash again and again", weak), ("3", "my app did crash again and again", against), ("4", "I was hacked, give me my password", good), ("5", None, None), ("6", "what is this about at all", None)])
    assert not got["1"].predicted_must_escalate and got["1"].retrieved_source_ids == ["e1"]
    assert got["2"].stages.errors == ["unsupported_substantive_claim: reinstall asserted without cited evidence"] and got["2"].retrieved_source_ids == ["e2"]
    assert got["3"].stages.errors == ["contradictory_evidence_claim: reinstall"]
    assert got["4"].predicted_intent == "access" and "sec" in got["4"].predicted_reason
    assert got["5"].predicted_must_escalate and got["5"].predicted_reason.startswith("pipeline_exception")
    assert got["6"].predicted_intent == "other" and got["6"].predicted_must_escalate


def test_prototypes(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.1, 1.0]), (3, [-1.0, -1.0]), (4, [0.0, 0.0])], "id int, v array<float>")
    p = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "label string, v array<double>")
    for most in (1000, 1):
        assert [r.prototype for r in S.nearest_prototype(rows, "v", p, "label", most_prototypes=most).orderBy("id").collect()] == ["x", "y", None, None]


def test_snapshot_is_reused_and_survives_a_failed_rebuild(spark, tmp_path):
    import pytest

    from convlake.sources import writers

    df = spark.createDataFrame([("100", "a", 1), ("100", "b", 2), ("200", "c", 3)], "tweet_id string, author_id string, seq int")
    path = f"{tmp_path}/snap"
    first = writers.build_snapshot(df, path, "v1", [F.col("seq")])
    assert first.count() == 2 and spark.read.parquet(f"{path}/quarantine").count() == 1
    assert writers.snapshot_problem(spark, path, "v1", df.transform(writers.table_fingerprint).first().fingerprint) is None
    assert writers.snapshot_problem(spark, path, "v2", "x") == "other schema version"
    with pytest.raises(Exception):
        writers.build_snapshot(df, path, "v1", [F.col("seq")], reject=True, force=True)
    assert spark.read.parquet(f"{path}/rows").count() == 2


def test_message_csv(spark, tmp_path):
    from convlake.sources import readers

    (tmp_path / "m.csv").write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,c,True,x,"a, ""b""\nline two",,\n2,b,False,x,hi,1,1.0\n')
    rows = readers.typed_messages(readers.read_messages_csv(spark, str(tmp_path / "m.csv"))).orderBy("tweet_id").collect()
    assert rows[0].text == 'a, "b"\nline two' and rows[0].inbound and rows[1].in_response_to_tweet_id == "1"
    (tmp_path / "bad.csv").write_text("tweet_id,text\n1,a\n")
    import pytest

    with pytest.raises(ValueError, match="missing columns"):
        readers.read_messages_csv(spark, str(tmp_path / "bad.csv"))


def test_streamed_cache(spark, tmp_path):
    from convlake.streaming.cache import append_judgements

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"cache_key": "a", "cached_at": "1", "model_id": "x"}\n{"cache_key": "a", "cached_at": "2", "model_id": "y"}\nbroken\n')
    append_judgements(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.cache_key, r.model_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "y")]


def test_every_pair_but_the_asked_one_is_evidence(spark, tmp_path):
    from convlake.plans import scoring

    said = {1: "zebra quartz lamp", 2: "zebra quartz lamp", 3: "purple violin string", 4: "purple violin bow", 5: "alone here"}
    rows = [(c, t, "user" if t == 0 else "assistant", said[c] if t == 0 else f"answer {c}") for c in said for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.tweet_id: [e.customer for e in r.evidence or []] for r in scoring._evidence(spark, str(tmp_path)).collect()}
    ids = {r.tweet_id: [e.id for e in r.evidence or []] for r in scoring._evidence(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if v} == {"1000": [said[2]], "2000": [said[1]], "3000": [said[4]], "4000": [said[3]]}
    assert ids["1000"] == ["2001"] and ids["2000"] == ["1001"] and not got["5000"]


def test_predictions_ask_for_each_hundredth_conversation(spark, tmp_path):
    """Queries are the messages of conversations divisible by 100; evidence comes from all."""
    from convlake.plans import scoring

    rows = [(c, t, "user" if t == 0 else "assistant", "zebra quartz lamp" if t == 0 else f"answer {c}") for c in (99, 100, 101, 200) for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.example_id: r.sources for r in scoring.predictions(spark, str(tmp_path)).collect()}
    assert set(got) == {"100000", "200000"} and all(got.values())


def test_support_policy(spark):
    from convlake.plans.support import support_policy

    policy = support_policy("nimbus.net", own=("daily mix",))
    assert len(policy.rules) == 7 and len(policy.claims) == 11
    said = {"Somebody hacked me and I was charged": "account_access", "why was I charged twice": "billing_and_payments", "the app will not play": "technical_support", "cancel the family plan": "subscription_and_plans", "an album is missing": "content_availability", "when do you launch in Dubai": "platform_and_regional", "my daily mix is dull": "product_feedback", "good morning": "other_or_ambiguous"}
    df = spark.createDataFrame([(k, v) for k, v in said.items()], "t string, want string")
    assert df.select((S.classify(F.col("t"), policy) == F.col("want")).alias("ok")).where("ok").count() == len(said)
    s = df.select("t", S.risk_signals(F.col("t"), F.col("t"), F.lit("x"), policy).alias("s")).collect()
    assert [r.s.sensitive_security for r in s][:2] == [True, False] and [r.s.financial_dispute for r in s][:3] == [True, True, False]
    assert [c.pattern for c in policy.claims if c.name == "reset_url"] == [r"\bnimbus\.net/reset\b"]
