from pyspark.sql import functions as F

from convlake.operators import joins, threads
from convlake.operators.components import connected_components

SCHEMA = "tweet_id string, author_id string, inbound boolean, created_at string, text string, in_response_to_tweet_id string"


def rows(spark, edges, author="c"):
    return spark.createDataFrame([(t, a, a != "brand", None, f"text {t}", p) for t, a, p in [(e[0], e[2] if len(e) > 2 else author, e[1]) for e in edges]], SCHEMA)


def test_roots_cycles_and_missing_parents(spark):
    m = rows(spark, [("A", "B"), ("B", "A"), ("T", "A"), ("CHILD", "NONE"), ("ROOT", None), ("REPLY", "ROOT")])
    got = {r.tweet_id: (r.root, r.flag) for r in threads.resolve_roots(m).collect()}
    assert got["A"] == got["B"] == got["T"] == (None, "CYCLE_DETECTED")
    assert got["CHILD"] == ("CHILD", "MISSING_PARENT:NONE") and got["REPLY"] == ("ROOT", None)


def test_deep_chain(spark):
    m = rows(spark, [("0", None)] + [(str(i), str(i - 1)) for i in range(1, 600)])
    got = threads.resolve_roots(m)
    assert got.where("root = '0' and flag is null").count() == 600 and got.agg(F.max("depth")).first()[0] == 599
    path = threads.ancestor_paths(m, m.where("tweet_id = '599'"), "brand").first().path
    assert [t.tweet_id for t in path] == [str(i) for i in range(600)]


def test_paths_exclude_siblings_and_later_turns(spark):
    m = rows(spark, [("1", None), ("2", "1", "brand"), ("3", "2"), ("4", "2"), ("5", "3", "brand"), ("9", "8")])
    got = {r.tweet_id: r for r in threads.ancestor_paths(m, m.select("tweet_id"), "brand").collect()}
    assert [t.tweet_id for t in got["3"].path] == ["1", "2", "3"]
    assert got["1"].path is not None and len(got) == 6
    assert got["5"].reason == "NOT_A_CUSTOMER_TURN" and got["9"].reason == "MISSING_PARENT" and got["9"].path is None


def test_pairs_take_only_this_brand(spark):
    m = rows(spark, [("101", None), ("102", "101", "other"), ("103", "101", "brand"), ("104", "102", "brand")]).withColumn("inbound", F.col("author_id") == "c")
    assert [(r.customer_id, r.reply_id) for r in joins.reply_pairs(m, "brand").collect()] == [("101", "103")]


def test_components_equal_union_find(spark):
    import random

    random.seed(3)
    edges = [(i, i + 1) for i in range(200)] + [(random.randrange(300, 600), random.randrange(300, 600)) for _ in range(150)] + [(7, 7)]
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_empty_tables(spark):
    m = rows(spark, [("1", None)]).limit(0)
    assert threads.resolve_roots(m).count() == 0 and threads.ancestor_paths(m, m, "brand").count() == 0
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_ids_of_long_conversations_stay_apart(spark):
    """Turns from 1,000 on keep their conversation, their order and their parent; the next conversation's ids are its own."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t}") for c, n in ((7, 12_003), (8, 3)) for t in range(n)]
    m = threads.as_messages(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert m.select("tweet_id").distinct().count() == len(rows)
    got = {r.root: [t.text for t in r.turns] for r in threads.collect_threads(m, threads.resolve_roots(m)).collect()}
    assert got == {"7000": [f"7 {t}" for t in range(12_003)], "8000": ["8 0", "8 1", "8 2"]}
    odd = spark.createDataFrame([(1, None, "user", "a"), (None, 2, "user", "b")], "conv_id long, turn int, role string, text string")
    assert [r.tweet_id for r in threads.as_messages(odd).collect()] == [None, None]
