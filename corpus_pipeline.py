"""The training-data pipeline: every stage works on all that the stage before kept, written as Parquet and read again.

All stages keep every column of their rows: these travel in one struct, so that no name of a column clashes with a
stage's own. Rows are told apart by their doc_id and a digest of their whole text; a null doc_id is an id of its own, a
null text counts as empty. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convlake.llm import decontamination, mixing, order_minhash, sharding, toxicity
from convlake.llm.common import text_key
from convlake.storage import partitions, store, table


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, key, text_key): a whole row in a struct, and what tells it apart."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("key"), text_key(F.col("text")).alias("text_key"))


def _same(a: DataFrame, b: DataFrame):
    return a["key"].eqNullSafe(b["_key"]) & (a["text_key"] == b["_text"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not call toxic.

    Repeated rows are judged alike, one by one. Empty and null texts get the score of a text without features.
    """
    free = [c + "_" * (1 + max(map(len, docs.columns))) for c in ("score", "toxic")]  # longer than any name that is there
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, names=tuple(free)).where(F.col(free[1]) == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest doc_id, of these that with the smallest digest.

    A null doc_id is larger than all others. Of rows that agree in doc_id and text, which may differ in other columns,
    that with the smallest hash stays.
    """
    found = store(order_minhash.near_duplicates(docs.select("doc_id", "text")), "near")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("key"), F.col("text_key").alias("text"))
    first = found.groupBy("class_key").agg(F.min(own).alias("f"), F.count(F.lit(1)).alias("n")).select("class_key", F.col("f.key").alias("_key"), F.col("f.text").alias("_text"), "n")
    several = found.where("class_size > 1").join(first, "class_key")
    here = F.col("doc_id").eqNullSafe(F.col("_key")) & (F.col("text_key") == F.col("_text"))
    gone = several.where(~here).select(F.col("doc_id").alias("_key"), F.col("text_key").alias("_text")).distinct()
    keyed = _keyed(docs)
    kept = keyed.join(gone, _same(keyed, gone), "left_anti")
    again = store(several.where(here).groupBy(F.col("doc_id").alias("_key"), F.col("text_key").alias("_text")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    if again.isEmpty():
        return kept.select("row.*")
    rank = F.row_number().over(W.partitionBy("key", "text_key").orderBy(F.xxhash64("row")))
    once = kept.join(again, _same(kept, again), "left_semi").withColumn("rank", rank).where("rank = 1").drop("rank")
    return kept.join(again, _same(kept, again), "left_anti").unionByName(once).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; rows that agree in doc_id and text are judged alike."""
    found = decontamination.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias("_key"), F.col("text_key").alias("_text")).distinct()
    keyed = _keyed(docs)
    return keyed.join(gone, _same(keyed, gone), "left_anti").select("row.*")


def _places(docs: DataFrame) -> DataFrame:
    """(key, text_key, source, position) of the mixture of ``docs``, from their rows alone, without the texts."""
    narrow = docs.select(F.col("doc_id").alias("key"), text_key(F.col("text")).alias("text_key"), "source")
    placed = mixing.place(narrow, "key", "source", "text_key")
    return placed.select("key", "text_key", "source", F.col("mix_position").alias("position"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the files in the order of the mixture.

    A null source is a source. Rows equal in doc_id and text take their places arbitrarily among themselves.
    """
    # Positions are found without the texts; rows that agree in all but their source keep their source's positions.
    own = lambda d, by: sharding.nth(d.select(sharding.plain_key(F.col("key")).alias("key"), F.concat_ws("|", "text_key", mixing.source_name(F.col("source"))).alias("text_key"), *by), by[0])
    rows = own(_keyed(docs).withColumn("source", F.col("row.source")), ["source", "row"])
    placed = sharding.nth_join(rows, own(store(_places(docs), "mixture"), ["position"]))
    return placed.repartitionByRange(max(1, partitions(spark)), "position").sortWithinPartitions("position").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot. Columns named as the new ones give way to them.

    Slots follow the mixture of ``docs``. Positions come from the rows, so they are those of the stage before if it handed
    on these rows, and the same whatever else a session has run.
    """
    return sharding.shard_documents(docs, keep=True, order=store(_places(docs), "mixture"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix), ("sharding", shard)]

#: Training and alignment are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
