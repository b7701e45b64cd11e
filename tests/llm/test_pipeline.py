"""The pipeline against decisions made by plain Python on a small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(6))
    clean = [" ".join(word() for _ in range(rng.randrange(40, 90))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(clean)]
    toxic = [(300 + i, t + " zzquark vexblot " + word()) for i, t in enumerate(" ".join(word() for _ in range(40)) for _ in range(60))]
    near = [(400 + i, " ".join([*clean[i].split()[:-1], word()])) for i in range(20)]
    item = " ".join(word() for _ in range(30))
    leaks = [(500 + i, f"{word()} {item[: len(item) // 2]} {' '.join(word() for _ in range(30))}") for i in range(5)]
    docs = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in [*rows, *toxic, *near, *leaks, (600, None), (600, None), (3, clean[3])]]
    labels = [(i, 1, int(300 <= i < 400)) for i, *_ in docs if i < 400 and i % 4]
    for name, data, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [*range(300), 600]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == before.columns
        before = spark.createDataFrame(after.collect(), before.schema)
    empty = before.limit(0)
    assert before.count() == 301
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_clashing_names_nulls_and_ties(spark, tmp_path):
    """Columns named like a stage's own keep their values; repeated rows and null ids are told apart by whole texts."""
    text = " ".join(f"w{k}" for k in range(60))
    long = " ".join(f"v{k % 977}x{k // 977}" for k in range(30_000))
    rows = [(1, text), (1, text), (2, text + " more"), (None, "a b c"), (None, "d e f"), (None, None), (None, ""), (5, long), (6, long + " z"), (7, "leaked " + " ".join(f"i{k}" for k in range(20)))]
    names = ["_crc", "_score", "_toxic", "mix_note", "mix_slot", "row", "key", "text_key", "_gap_hash", "slot", "size", "rank", "node"]
    full = [(i, t, "en", "s", 1, *[10 * k + n for n in range(len(names))]) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names))
    spark.createDataFrame([(1, " ".join(f"i{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    known = {tuple(map(repr, r)) for r in docs.collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns
        got = after.collect()
        assert {tuple(map(repr, r)) for r in got} <= known
        before = spark.createDataFrame(got, docs.schema)
        if name == "near_dedup":
            assert sorted((repr(r.doc_id), (r.text or "")[:5]) for r in got) == sorted([("1", "w0 w1"), ("None", "a b c"), ("None", "d e f"), ("None", ""), ("5", long[:5]), ("7", "leake")])
    assert sorted(repr(r.doc_id) for r in got) == ["1", "5", "None", "None", "None"]
    last = corpus_pipeline.shard(spark, before, str(tmp_path))
    assert last.count() == 5 and len(set(last.columns)) == len(last.columns) and set(docs.columns) <= set(last.columns)


def test_slots_follow_the_mixture(spark, tmp_path):
    from pyspark.sql import functions as F

    from convlake.llm import mixing
    from convlake.llm.common import text_key
    from convlake.storage import store

    rows = [(i, f"text {i}", "en", "a" if i < 1500 else "b" if i < 2100 else None, 9) for i in range(2400)] + [(7, "text 7", "en", "a", 9), (None, None, "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.shard(spark, store(corpus_pipeline.mix(spark, docs, str(tmp_path)), "mixing"), str(tmp_path)).collect()
    where = {}
    for r in mixing.place(docs.withColumn("text_key", text_key(F.col("text"))), tie="text_key").collect():  # as the stage numbers them
        where.setdefault((r.doc_id, r.text), []).append(r.mix_position)
    shards = {}
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        shards.setdefault(r.shard, []).append(r)
    assert len(got) == len(rows) and len(shards) == 24
    target = {s: n**0.5 for s, n in (("a", 1501), ("b", 601), (None, 300))}
    for own in shards.values():
        assert [r.slot for r in own] == list(range(len(own)))
        single = [where[r.doc_id, r.text][0] for r in own if len(where[r.doc_id, r.text]) == 1]
        assert single == sorted(single)
    # All shards' first 40 rows together: about 1,000 of the rows, before a source has run out.
    head = [r.source for own in shards.values() for r in own[:40]]
    for s, w in target.items():
        assert abs(head.count(s) / len(head) - w / sum(target.values())) < 0.06


def test_shard_depends_on_its_rows_alone(spark, tmp_path):
    """The same slots before and after other mixtures, and when scratch tables are gone."""
    from convlake.storage import release

    rows = [(i, f"text {i}", "en", f"s{i % 3}", 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    slots = lambda: sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.shard(spark, docs, str(tmp_path)).collect())
    first = slots()
    corpus_pipeline.mix(spark, docs.where("doc_id < 20"), str(tmp_path)).count()
    assert slots() == first
    release(spark)
    assert slots() == first
