"""Mechanisms that keep tasks and files bounded: digit trees, settled roots, snapshots that survive, digests by blocks."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.operators import components, scoring, selection, threads
from convlake.sources import readers, writers


def test_ranks_of_skewed_keys(spark):
    """Keys that agree in their first digits, equal keys, short keys, two groups: ranks equal a plain sort, windows stay small."""
    rng = random.Random(5)
    keys = ["aaaa" + rng.choice("abcd") + f"{rng.randrange(4096):03x}" for _ in range(600)] + ["b"] * 40 + ["aa", ""] + [f"{rng.randrange(1 << 32):08x}" for _ in range(100)]
    rows = [(i, k, i % 3 == 0) for i, k in enumerate(keys)]
    d = spark.createDataFrame(rows, "id int, k string, g boolean")
    got = {r.id: r._rank for r in selection.global_rank(d, F.col("k"), "id", "g", most=50).collect()}
    for g in (True, False):
        order = sorted((k, i) for i, k, x in rows if x == g)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))
    led, sizes = selection._leading(d.withColumn("_order", F.col("k")), ["g"], [], 2, 50)
    assert led.count() == len(rows) == sizes.agg(F.sum("_n")).first()[0]
    assert all(r._n <= 50 for r in sizes.collect()) and sizes.agg(F.max(F.length("_lead"))).first()[0] > 4
    assert selection.global_rank(d.limit(0), F.col("k"), "id", "g").count() == 0


def test_quota_of_skewed_keys(spark):
    rows = [(i, f"ffff{i:04x}", i % 7 == 0) for i in range(300)]
    d = spark.createDataFrame(rows, "id int, k string, f boolean").withColumn("g", F.lit("x"))
    run = lambda most: [tuple(r) for r in selection.until_quota(d, "g", F.col("f"), F.col("k"), "id", 20, 30, most=most).orderBy("id").collect()]
    assert run(10) == run(10_000) and len(run(10)) == 134  # the 20th flagged row is id 133


def test_settled_messages_are_written_once(spark, monkeypatch):
    """A shallow forest with one deep thread: rows written stay below twice the messages."""
    rows = [(f"r{i}", None) for i in range(400)] + [(f"c{i}", f"r{i}") for i in range(400)] + [(str(i), str(i - 1) if i else None) for i in range(50)]
    m = spark.createDataFrame(rows, "tweet_id string, in_response_to_tweet_id string")
    written, plain = [], threads.store
    monkeypatch.setattr(threads, "store", lambda df, name: (lambda s: (written.append(s.count()), s)[1])(plain(df, name)))
    got = {r.tweet_id: (r.root, r.depth) for r in threads.resolve_roots(m).collect()}
    assert got["49"] == ("0", 49) and got["c7"] == ("r7", 1) and got["r7"] == ("r7", 0) and len(got) == len(rows)
    assert sum(written) < 2 * len(rows)


def test_a_snapshot_survives_a_build_that_ends_between_renames(spark, tmp_path, monkeypatch):
    path, order = f"{tmp_path}/snap", [F.col("seq")]
    old = spark.createDataFrame([("1", 1), ("2", 2)], "tweet_id string, seq int")
    new = spark.createDataFrame([("1", 1), ("2", 2), ("3", 3)], "tweet_id string, seq int")
    writers.build_snapshot(old, path, "v1", order)
    plain = writers._rename

    def dies(spark, source, target):
        if ".staged-" in source:
            raise KeyboardInterrupt
        return plain(spark, source, target)

    monkeypatch.setattr(writers, "_rename", dies)
    with pytest.raises(KeyboardInterrupt):
        writers.build_snapshot(new, path, "v1", order)
    monkeypatch.undo()
    assert spark.read.parquet(writers.snapshot_folder(spark, path) + "/rows").count() == 2
    assert writers.snapshot_problem(spark, path, "v1", old.transform(writers.table_fingerprint).first().fingerprint) is None
    assert writers.build_snapshot(old, path, "v1", order).count() == 2 and writers.snapshot_folder(spark, path) == path
    assert writers.build_snapshot(new, path, "v1", order).count() == 3 and not writers._exists(spark, f"{path}.old")


def test_files_are_hashed_by_blocks(spark, tmp_path):
    body = random.Random(3).randbytes(1000)
    (tmp_path / "long").write_bytes(body)
    (tmp_path / "even").write_bytes(body[:200])
    (tmp_path / "none").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in writers.file_hashes(spark, str(tmp_path), block=100).collect()}
    tree = lambda b: hashlib.sha256(b"".join(hashlib.sha256(b[k : k + 100]).digest() for k in range(0, len(b), 100))).hexdigest()
    assert got == {"long": tree(body), "even": tree(body[:200])}  # an empty file has no row


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file, whose blocks go to several tasks."""
    with open(tmp_path / "big", "wb") as f:
        f.truncate(3 << 30)
    zero = hashlib.sha256(bytes(writers.BLOCK)).digest()
    r = writers.file_hashes(spark, str(tmp_path / "big")).first()
    assert r.sha256 == hashlib.sha256(zero * (-(-(3 << 30) // writers.BLOCK))).hexdigest()


def _plain_components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_shrink(spark, monkeypatch, few):
    """Random graphs, a path in order, a star, repeated and empty edges: edges written in all rounds stay below three times the input."""
    rng = random.Random(11)
    sets = [[(rng.randrange(1500), rng.randrange(1500)) for _ in range(m)] for m in (700, 3000)] + [[(i, i + 1) for i in range(1200)], [(500, i) for i in range(1200)], []]
    monkeypatch.setattr(components, "_FEW", few)
    plain = components.store
    for pairs in sets:
        written = []
        monkeypatch.setattr(components, "store", lambda df, name: (lambda s: (written.append(s.count()) if name == "edges" else None, s)[1])(plain(df, name)))
        d = spark.createDataFrame(pairs * 2 + [(3, 3), (None, 4)], "a long, b long")
        real = [p for p in pairs if p[0] != p[1]]
        assert {r.node: r.component for r in components.connected_components(d).collect()} == _plain_components(real)
        assert sum(written) <= 3 * max(1, written[0])


def test_prototypes_are_ruled_out_by_distances(spark, monkeypatch):
    """10,000 prototypes in clusters of unequal size, equal and unusable vectors: the same best as by all pairs, from less than a fifth of them."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    mine = lambda n: (centres[np.minimum(rng.integers(0, 90, n), 59)] + 0.15 * rng.normal(size=(n, 16))).round(6)
    known, asked = mine(10_000), mine(150)
    asked[:5] = known[:5]
    known[7] = known[3]  # a tie: the larger label counts
    protos = [(f"p{i:05d}", v.tolist()) for i, v in enumerate(known)] + [("zero", [0.0] * 16), ("none", None), ("nan", [float("nan")] * 16)]
    rows = [(i, v.tolist()) for i, v in enumerate(asked)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    p, r = spark.createDataFrame(protos, "label string, v array<double>"), spark.createDataFrame(rows, "id int, v array<double>")
    scored, plain = [], scoring._best
    monkeypatch.setattr(scoring, "_best", lambda met: (scored.append(met.agg(F.sum(F.size("_known"))).first()[0] or 0), plain(met))[1])
    got = {x.id: (x.prototype, x.cosine) for x in scoring.nearest_prototype(r, "v", p, "label").collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosines = unit(asked) @ unit(known).T
    assert len(got) == 153 and all(got[i] == (None, -1.0) for i in (900, 901, 902))
    for i, c in enumerate(cosines):
        best = max(np.flatnonzero(c >= c.max() - 1e-12))
        assert got[i][0] == f"p{best:05d}" and abs(got[i][1] - c.max()) < 1e-12
    assert got[3][0] == "p00007" and sum(scored) < 0.2 * 150 * 10_000


def test_few_prototypes_with_unusable_vectors(spark):
    p = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None), ("z", [0.0, 0.0])], "label string, v array<double>")
    r = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [float("inf"), 1.0])], "id int, v array<double>")
    assert [(x.prototype, x.cosine) for x in scoring.nearest_prototype(r, "v", p, "label").orderBy("id").collect()] == [("x", 1.0), (None, -1.0), (None, -1.0)]
    assert [x.cosine for x in scoring.nearest_prototype(r, "v", p.limit(0), "label").collect()] == [None] * 3


def test_csv_in_byte_ranges(spark, tmp_path):
    """Quoted breaks, doubled quotes, CRLF and blank lines at the borders of ranges: rows equal those of whole files, from several tasks."""
    rng = random.Random(9)
    cell = lambda: rng.choice(["", "x", "a, b", 'say ""hi""', "one\ntwo", "\n\n", 'q"",""\n""', "r\r\ns", "é" * rng.randrange(1, 9)])
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, "w", newline="") as f:
            f.write("tweet_id,text,more\n")
            for i in range(300):
                f.write(f'{name}{i},"{cell()}","{cell()}"' + rng.choice(["\n", "\n", "\r\n", "\n\n"]))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("tweet_id", "text", "more")])
    key, was = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = sorted(readers.read_messages_csv(spark, str(tmp_path), schema, by_ranges=False).collect())
    assert len(whole) == 600
    try:
        spark.conf.set(key, "97b")
        rows = readers.read_messages_csv(spark, str(tmp_path), schema)
        assert sorted(rows.collect()) == whole
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
        assert rows.select("text").where("tweet_id = 'a.csv3'").count() == 1
        (tmp_path / "open.csv").write_text('tweet_id,text,more\n1,"a,b\n2,c,d\n')
        with pytest.raises(Exception, match="not closed"):
            readers.read_messages_csv(spark, str(tmp_path / "open.csv"), schema).collect()
        (tmp_path / "head.csv").write_text("tweet_id,text,more\n")
        assert readers.read_messages_csv(spark, str(tmp_path / "head.csv"), schema).count() == 0
    finally:
        spark.conf.set(key, was)
