"""Reply forests: roots, threads, ancestor paths, anonymous actors, model input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact
from ..storage import store


def as_messages(conversations: DataFrame, brand: str = "brand") -> DataFrame:
    """A conversation table (conv_id, turn, role, text) as messages that reply to the turn before them.

    Ids are numbers, conv_id * 1000 + turn; from turn 1,000 on the turn follows the conversation's last number, so that ids
    stay apart and in the order of turns.
    """
    number = lambda turn: (F.col("conv_id") * 1000 + turn).cast("string")
    tid = lambda turn: F.when(turn < 1000, number(turn)).when(turn >= 1000, F.concat(number(F.lit(999)), F.lit(":"), F.lpad(turn.cast("string"), 10, "0")))
    author = F.when(F.col("role") == "assistant", F.lit(brand)).otherwise(F.concat(F.substring("role", 1, 1), F.col("conv_id").cast("string")))
    return conversations.select(
        tid(F.col("turn")).alias("tweet_id"), author.alias("author_id"), (F.col("role") == "user").alias("inbound"), F.lit(None).cast("string").alias("created_at"),
        "text", F.when(F.col("turn") > 0, tid(F.col("turn") - 1)).alias("in_response_to_tweet_id"),
    )


def resolve_roots(messages: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(tweet_id, root, depth, flag) of each message by pointer doubling: rounds grow with the logarithm of the depth.

    Flag is null, ``MISSING_PARENT:<id>`` (the root is then the last message that exists), or ``CYCLE_DETECTED`` (no root).
    A round writes only the messages that were still open, so one that is settled is written once.
    """
    edges = messages.select("tweet_id", F.col("in_response_to_tweet_id").alias("parent")).dropDuplicates(["tweet_id"])
    known = edges.select(F.col("tweet_id").alias("_known"))
    state = edges.join(known, edges["parent"] == known["_known"], "left").select(
        "tweet_id", F.when(F.col("_known").isNotNull(), F.col("parent")).otherwise(F.col("tweet_id")).alias("up"), F.when(F.col("_known").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
        F.when(F.col("parent").isNotNull() & F.col("_known").isNull(), F.concat(F.lit("MISSING_PARENT:"), F.col("parent"))).alias("flag"), F.col("_known").isNull().alias("done"),
    )
    state = store(state, "roots")
    longest, settled, open_ = state.count(), state.where("done"), state.where("not done")
    for k in range(most_rounds):
        # After k rounds an open message has looked 2**k replies up; one that has looked up more than there are is on a cycle.
        if 2**k > longest or open_.isEmpty():
            break
        above = settled.unionByName(open_).select(F.col("tweet_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("flag").alias("_flag"), F.col("done").alias("_done"))
        moved = open_.join(above, "up").select("tweet_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_flag").alias("flag"), F.col("_done").alias("done"))
        moved = store(moved, "roots")
        settled, open_ = settled.unionByName(moved.where("done")), moved.where("not done")
    return settled.unionByName(open_).select("tweet_id", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"), F.when(F.col("done"), F.col("flag")).otherwise(F.lit("CYCLE_DETECTED")).alias("flag"))


def collect_threads(messages: DataFrame, roots: DataFrame, epoch: Column | None = None) -> DataFrame:
    """One row per root: turns in order of time then id, their number, completeness and flags (duplicate ids, missing parents)."""
    at = F.lit(0.0) if epoch is None else epoch
    rows = messages.withColumn("_at", at).join(roots.where("root is not null"), "tweet_id")
    turn = F.struct("tweet_id", "author_id", F.col("inbound").cast("int").alias("inbound"), "created_at", "text", "in_response_to_tweet_id")
    num = F.coalesce(F.col("tweet_id").try_cast("decimal(38,0)"), F.lit("1" + "0" * 37).cast("decimal(38,0)"))
    made = rows.groupBy("root").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), num.alias("num"), turn.alias("turn")))).alias("_turns"), F.count(F.lit(1)).alias("n_turns"),
        F.countDistinct("tweet_id").alias("_ids"), F.array_sort(F.collect_set("flag")).alias("flags"),
    )
    flags = F.when(F.col("_ids") < F.col("n_turns"), F.array_append("flags", F.lit("DUPLICATE_ID"))).otherwise(F.col("flags"))
    return made.select("root", F.transform("_turns", lambda t: t["turn"]).alias("turns"), F.col("n_turns").cast("int").alias("n_turns"), flags.alias("flags")).withColumn("is_complete", F.size("flags") == 0).withColumn("exclusion_reason", F.array_min("flags"))


def ancestor_paths(messages: DataFrame, targets: DataFrame, brand: str) -> DataFrame:
    """``targets`` (tweet_id) with ``path``, the turns from the root to the target, and ``reason`` for those rejected.

    Siblings and later turns never enter. Reasons: MISSING_PARENT, CYCLE_DETECTED, DUPLICATE_ID, NOT_A_CUSTOMER_TURN.
    What is listed starts from the targets alone and doubles in each round: the turns so far and, by pointers over as many
    replies, as many above them. So rounds grow with the logarithm of the depth and rows with what comes out; texts are
    joined once, at the end.
    """
    turn = F.struct("tweet_id", "author_id", F.col("inbound").cast("int").alias("inbound"), "created_at", "text", "in_response_to_tweet_id")
    by_id = messages.groupBy("tweet_id").agg(F.min(turn).alias("turn"), F.countDistinct(turn).alias("n"))
    roots = resolve_roots(messages)
    chosen = targets.select("tweet_id").distinct().join(roots, "tweet_id")
    deepest = chosen.where("flag is null").agg(F.max("depth")).first()[0] or 0
    parent = messages.groupBy("tweet_id").agg(F.min(F.struct("in_response_to_tweet_id")).alias("_p")).select("tweet_id", F.col("_p.in_response_to_tweet_id").alias("up")).where("up is not null")
    steps = chosen.where("flag is null").select(F.col("tweet_id").alias("target"), "tweet_id", F.lit(0).cast("long").alias("hops"))
    for k in range(deepest.bit_length()):
        if k:
            twice = parent.select(F.col("tweet_id").alias("up"), F.col("up").alias("_up"))
            parent = parent.join(twice, "up").select("tweet_id", F.col("_up").alias("up"))
        parent = store(parent, "pointers")
        above = steps.join(parent, "tweet_id").select("target", F.col("up").alias("tweet_id"), (F.col("hops") + 2**k).alias("hops"))
        steps = store(steps.unionByName(above), "steps")
    whole = steps.join(by_id, "tweet_id").groupBy("target").agg(F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("at"), "turn"))).alias("_p"), F.max("n").alias("n"))
    path = F.transform("_p", lambda t: t["turn"])
    done = chosen.join(whole.select(F.col("target").alias("tweet_id"), path.alias("path"), "n"), "tweet_id", "left")
    last = F.element_at("path", -1)
    reason = F.coalesce(F.regexp_extract("flag", "^[A-Z_]+", 0), F.when(F.col("n") > 1, "DUPLICATE_ID"), F.when((last["inbound"] != 1) | (last["author_id"] == brand), "NOT_A_CUSTOMER_TURN"))
    return done.select("tweet_id", F.when(reason.isNull(), F.col("path")).alias("path"), reason.alias("reason"))


def actor_labels(turns: Column, brand: str) -> Column:
    """Map from author to Customer_1, Customer_2, ... in order of first appearance, and Brand."""
    others = F.array_distinct(F.transform(F.filter(turns, lambda t: t["author_id"] != brand), lambda t: t["author_id"]))
    names = F.transform(others, lambda a, i: F.concat(F.lit("Customer_"), (i + 1).cast("string")))
    return F.map_from_arrays(F.concat(others, F.array(F.lit(brand))), F.concat(names, F.array(F.lit("Brand"))))


def anonymise(turns: Column, actors: Column, brands: tuple[str, ...] = ()) -> Column:
    """Turns for export: authors by label, texts redacted."""
    return F.transform(turns, lambda t: F.struct(t["tweet_id"].alias("tweet_id"), actors[t["author_id"]].alias("author_id"), t["inbound"].alias("inbound"), t["created_at"].alias("created_at"), redact(t["text"], brands).alias("text"), t["in_response_to_tweet_id"].alias("in_response_to_tweet_id")))


def model_input(turns: Column, actors: Column) -> Column:
    """One line per turn; the last is marked as the inquiry to answer."""
    last = F.size(turns) - 1
    mark = lambda i: F.when(i == last, F.lit(" (TARGET CUSTOMER INQUIRY)")).otherwise(F.lit(""))
    return F.array_join(F.transform(turns, lambda t, i: F.concat(F.lit("["), actors[t["author_id"]], F.lit("]"), mark(i), F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n")


def prior_text(turns: Column) -> Column:
    """Text of the turns before the last; null if there are none."""
    before = F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0)))
    return F.when(F.size(turns) > 1, F.concat_ws(" ", F.transform(before, lambda t: t["text"])))
