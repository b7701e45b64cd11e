"""Sinks: partition exports, manifests, reports, review sheets, transcripts, and snapshots with provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import first_write_wins

#: Columns that development and evaluation inputs never carry.
HIDDEN = ("brand_reply_text", "raw_brand_reply_text", "raw_customer_text", "actor_map")


def export_partitions(rows: DataFrame, path: str, open_partitions: Sequence[str], hidden: Sequence[str] = HIDDEN, partition: str = "partition", format: str = "json") -> None:
    """One folder per kind of partition: those in ``open_partitions`` with, the others without the reply and all raw text."""
    private = [c for c in ("actor_map", "raw_customer_text", "raw_brand_reply_text") if c in rows.columns]
    rows.where(F.col(partition).isin(*open_partitions)).drop(*private).write.partitionBy(partition).format(format).save(f"{path}/open")
    rows.where(~F.col(partition).isin(*open_partitions)).drop(*[c for c in hidden if c in rows.columns]).write.partitionBy(partition).format(format).save(f"{path}/blind")


def split_manifest(rows: DataFrame, seed: int, version: str, checksum: str, columns: Sequence[str]) -> DataFrame:
    return rows.select(*columns, F.lit(checksum).alias("source_sha256"), F.lit(seed).alias("seed"), F.lit(version).alias("preprocessing_version"))


def review_sheet(rows: DataFrame, columns: Sequence[str | Column], human: Sequence[str]) -> DataFrame:
    return rows.select(*columns, *[F.lit("").alias(h) for h in human])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """Report sinks: each frame (memberships, exclusions, leaks, reviews) as JSON lines in a folder of its name."""
    for name, rows in reports.items():
        rows.write.json(f"{path}/{name}")


def transcript(turns: Column, title: Column) -> Column:
    """One text block per conversation."""
    lines = F.transform(turns, lambda t: F.concat(F.lit("- **"), t["author_id"], F.lit("**: "), F.coalesce(t["text"], F.lit(""))))
    return F.concat_ws("\n", F.concat(F.lit("## "), title), F.array_join(lines, "\n"), F.lit(""))


#: Bytes of a file that one row holds.
BLOCK = 64 << 20


def file_hashes(spark: SparkSession, paths: str | Sequence[str], block: int = BLOCK) -> DataFrame:
    """(path, sha256) of files of any length, read in blocks by as many tasks as there are blocks.

    A file of one block, or none, has its SHA-256; a longer one has that of its blocks' digests (32 bytes each) in order.
    The ``binaryFile`` source lists the files, without their contents; it leaves out empty files, so these have no row.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    last = F.greatest(F.ceil(F.col("length") / block) - 1, F.lit(0))
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at"))
    parts = parts.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "at")
    digests = parts.mapInPandas(_block_digests(block), "path string, at long, digest binary")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda b: F.hex(b["digest"]))
    per = digests.groupBy("path").agg(listed.alias("b"))
    whole = F.when(F.size("b") == 1, F.lower(F.get("b", F.lit(0)))).otherwise(F.sha2(F.unhex(F.array_join("b", "")), 256))
    return per.select("path", whole.alias("sha256"))


def _block_digests(block: int):
    def digests(batches):
        import hashlib

        import pandas as pd
        from pyarrow import fs

        for rows in batches:
            out = []
            for path, at in zip(rows["path"], rows["at"]):
                system, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                digest = hashlib.sha256()
                with system.open_input_file(name) as f:
                    f.seek(at * block)
                    left = block
                    while left and (got := f.read(min(left, 1 << 20))):
                        digest.update(got)
                        left -= len(got)
                out.append((path, at, digest.digest()))
            yield pd.DataFrame(out, columns=["path", "at", "digest"])

    return digests


def table_fingerprint(rows: DataFrame) -> DataFrame:
    """Rows and a hash of a table that does not depend on their order."""
    h = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("fingerprint"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, problem) of protected files that changed, went or came."""
    b, a = before.select("path", F.col("sha256").alias("_b")), after.select("path", F.col("sha256").alias("_a"))
    what = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "new").when(F.col("_a") != F.col("_b"), "changed")
    return b.join(a, "path", "full_outer").select("path", what.alias("problem")).where("problem is not null")


def run_manifest(spark: SparkSession, parameters: dict[str, str], fingerprint: str) -> DataFrame:
    """One row: the parameters of a run and the fingerprint of its corpus."""
    return spark.createDataFrame([({k: str(v) for k, v in parameters.items()}, fingerprint)], "parameters map<string,string>, corpus_fingerprint string")


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), path)


def _exists(spark: SparkSession, target: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _delete(spark: SparkSession, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def snapshot_folder(spark: SparkSession, path: str) -> str:
    """Where the snapshot of ``path`` lies: there, or in ``<path>.old`` if a build ended while it put the new one in place."""
    return path if _exists(spark, path) or not _exists(spark, f"{path}.old") else f"{path}.old"


def build_snapshot(messages: DataFrame, path: str, version: str, order: Sequence[Column], reject: bool = False, force: bool = False) -> DataFrame:
    """A checked Parquet snapshot of messages with their quarantine and provenance; one that is valid is used again.

    It is written beside its place, read back and compared, and only then takes the place of the old one, which waits in
    ``<path>.old`` meanwhile. If anything fails the old one stays: ``snapshot_folder`` names it at any moment, and
    the next build puts it back first. One build at a time.
    """
    spark = messages.sparkSession
    if not _exists(spark, path) and _exists(spark, f"{path}.old") and not _rename(spark, f"{path}.old", path):
        raise RuntimeError("the old snapshot can't be put back")
    mark = messages.transform(table_fingerprint).first()
    if not force and snapshot_problem(spark, path, version, mark.fingerprint) is None:
        return spark.read.parquet(f"{path}/rows")
    kept, bad, counts = first_write_wins(messages, "tweet_id", order, messages.columns, reject)
    n = {r.status: r.n for r in counts.collect()}
    import uuid

    staged = f"{path}.staged-{uuid.uuid4().hex}"
    kept.write.parquet(f"{staged}/rows")
    bad.write.parquet(f"{staged}/quarantine")
    made = spark.read.parquet(f"{staged}/rows").transform(table_fingerprint).first()
    if made.n_rows != n.get("kept", 0):
        raise RuntimeError("the staged snapshot lacks rows")
    meta = [(version, mark.fingerprint, made.n_rows, made.fingerprint, n.get("identical", 0), n.get("conflicting", 0), True)]
    spark.createDataFrame(meta, "schema_version string, source_fingerprint string, row_count long, fingerprint string, identical long, conflicting long, build_completed boolean").coalesce(1).write.parquet(f"{staged}/meta")
    if _exists(spark, path):
        _delete(spark, f"{path}.old")
        if not _rename(spark, path, f"{path}.old"):
            raise RuntimeError("the old snapshot can't be moved")
    if not _rename(spark, staged, path):
        raise RuntimeError("the snapshot can't be put in place")
    _delete(spark, f"{path}.old")
    return spark.read.parquet(f"{path}/rows")


def snapshot_problem(spark: SparkSession, path: str, version: str, source: str) -> str | None:
    """Why a snapshot can't be used, or None."""
    path = snapshot_folder(spark, path)
    if not _exists(spark, f"{path}/meta"):
        return "no snapshot"
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None or not meta.build_completed:
        return "build not completed"
    if meta.schema_version != version:
        return "other schema version"
    if meta.source_fingerprint != source:
        return "other source"
    now = spark.read.parquet(f"{path}/rows").transform(table_fingerprint).first()
    if now.n_rows != meta.row_count:
        return "other number of rows"
    return None if now.fingerprint == meta.fingerprint else "other contents"
