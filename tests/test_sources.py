"""Scans and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from convlake.operators import judging
from convlake.sources import readers, writers


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2}\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    assert [tuple(r) for r in readers.read_json_lines(spark, str(tmp_path / "a.jsonl"), schema).orderBy("id").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\nbroken\n')
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(tmp_path / "b.jsonl"), schema).collect()


def test_cache_keeps_the_last_entry(spark, tmp_path):
    rows = [{"cache_key": "a", "cached_at": "1", "model_id": "x"}, {"cache_key": "a", "cached_at": "3", "model_id": "z"}, {"cache_key": "a", "cached_at": "2", "model_id": "y"}, {"cache_key": "", "cached_at": "9"}]
    (tmp_path / "c.jsonl").write_text("\n".join([*map(json.dumps, rows), "not json", '{"cache_key": "b", "cached_at": "1"}']))
    got = {r.cache_key: r.model_id for r in readers.read_cache(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got == {"a": "z", "b": None}


def test_sheet_keeps_blanks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi",\nplease', ""), ("2", "", "yes")], "id string, text string, verdict string")
    writers.write_csv(df, str(tmp_path / "sheet"))
    assert [tuple(r) for r in readers.read_sheet(spark, str(tmp_path / "sheet")).orderBy("id").collect()] == [tuple(r) for r in df.collect()]


def test_manifest(spark, tmp_path):
    one = lambda brand: {"brand": brand}
    (tmp_path / "m.json").write_text(json.dumps({"sampling_seed": 7, "conversations": [one("x"), one("y"), one("x")]}, indent=1))
    assert readers.read_manifest(spark, str(tmp_path / "m.json")).count() == 3
    assert readers.read_manifest(spark, str(tmp_path / "m.json"), "x").count() == 2


def test_blind_partitions_never_carry_replies(spark, tmp_path):
    rows = [(i, p, f"asked {i}", f"secret reply {i}", f"raw reply {i}", f"raw asked {i}", "map") for i, p in enumerate(["historical", "dev", "eval", "historical"])]
    df = spark.createDataFrame(rows, "id int, partition string, customer_text string, brand_reply_text string, raw_brand_reply_text string, raw_customer_text string, actor_map string")
    writers.export_partitions(df, str(tmp_path / "out"), ["historical"])
    blind = "".join(p.read_text() for p in (tmp_path / "out" / "blind").rglob("*.json"))
    opened = "".join(p.read_text() for p in (tmp_path / "out" / "open").rglob("*.json"))
    assert "asked 1" in blind and "asked 2" in blind and "reply" not in blind and "raw" not in blind and "map" not in blind
    assert "secret reply 0" in opened and "secret reply 3" in opened and "raw" not in opened and "reply 1" not in opened
    assert spark.read.json(str(tmp_path / "out" / "blind")).where("partition in ('dev', 'eval')").count() == 2


def test_reports(spark, tmp_path):
    writers.write_reports({"members": spark.range(3), "leaks": spark.range(0)}, str(tmp_path / "r"))
    assert spark.read.schema("id long").json(str(tmp_path / "r" / "members")).count() == 3
    assert spark.read.schema("id long").json(str(tmp_path / "r" / "leaks")).count() == 0


def test_protected_files(spark, tmp_path):
    import hashlib

    for n in "abc":
        (tmp_path / n).write_text(n)
    before = spark.createDataFrame(writers.file_hashes(spark, str(tmp_path / "*")).collect())
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in before.collect()} == {n: hashlib.sha256(n.encode()).hexdigest() for n in "abc"}
    (tmp_path / "a").write_text("changed")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("d")
    after = writers.file_hashes(spark, [str(tmp_path / n) for n in "acd"])
    assert {r.path.rsplit("/", 1)[1]: r.problem for r in writers.changed_files(before, after).collect()} == {"a": "changed", "b": "missing", "d": "new"}


def test_run_manifest(spark):
    mark = writers.table_fingerprint(spark.range(5)).first().fingerprint
    assert mark == writers.table_fingerprint(spark.range(5).repartition(3)).first().fingerprint != writers.table_fingerprint(spark.range(6)).first().fingerprint
    r = writers.run_manifest(spark, {"seed": 42, "least": 0.85}, mark).first()
    assert r.parameters == {"seed": "42", "least": "0.85"} and r.corpus_fingerprint == mark


def test_unblind_refuses_a_code_mapped_twice(spark):
    from convlake.operators import joins

    rows, once = spark.createDataFrame([("a", 1), ("b", 2)], "code string, n int"), spark.createDataFrame([("a", "x")], "code string, system string")
    assert {(r.code, r.system) for r in joins.unblind(rows, once, "code").collect()} == {("a", "x"), ("b", None)}
    with pytest.raises(Exception, match="mapped twice"):
        joins.unblind(rows, once.unionByName(spark.createDataFrame([("a", "y")], "code string, system string")), "code").collect()


def test_rubric_versions(spark):
    df = spark.createDataFrame([("short", "other", "Thanks.")], "m string, l string, r string")
    score = lambda v: df.select(judging.rubric_scores(F.col("m"), F.col("l"), F.lit(False), F.col("r"), F.lit(False), judging.Rubric(version=v)).alias("s")).first().s
    assert (score(1).usefulness, score(2).usefulness) == (0, 1)


def test_paths_of_deep_and_broken_threads(spark):
    from convlake.operators import threads

    rows = [(str(i), "c" if i % 2 == 0 else "brand", i % 2 == 0, None, f"t{i}", str(i - 1) if i else None) for i in range(41)] + [("x", "c", True, None, "x", "y"), ("y", "c", True, None, "y", "x"), ("z", "c", True, None, "z", "gone")]
    m = spark.createDataFrame(rows, "tweet_id string, author_id string, inbound boolean, created_at string, text string, in_response_to_tweet_id string")
    got = {r.tweet_id: r for r in threads.ancestor_paths(m, spark.createDataFrame([("40",), ("0",), ("7",), ("x",), ("z",)], "tweet_id string"), "brand").collect()}
    assert [t.tweet_id for t in got["40"].path] == [str(i) for i in range(41)] and [t.tweet_id for t in got["0"].path] == ["0"]
    assert [got[k].reason for k in ("7", "x", "z")] == ["NOT_A_CUSTOMER_TURN", "CYCLE_DETECTED", "MISSING_PARENT"]


def test_release_deletes_scratch_tables(spark):
    import os

    from convlake import storage

    path = storage.store(spark.range(3), "kept").inputFiles()[0].removeprefix("file://")
    before, storage._made[spark.sparkContext.applicationId] = storage._made[spark.sparkContext.applicationId], [os.path.dirname(path)]
    assert os.path.exists(path) and storage.release(spark) == 1 and not os.path.exists(path)
    storage._made[spark.sparkContext.applicationId] = before
