"""Mixing sources to target weights by Pfair scheduling.

Every source deals its documents, in a hashed order, into blocks. Block i of a source of weight w (the weights of all
sources add up to 1) may not start before slot floor(i / w) and must be done by slot ceil((i + 1) / w); in each slot the
released block with the earliest deadline goes. So at every slot each source has had its share to within less than a
block. Weights are exact fractions, so nothing drifts however long the schedule is. When a source runs out, a new
schedule over the others begins. The driver lays out the blocks alone, of which there are a bounded number: blocks
grow with the corpus. Spark numbers the documents and joins them to their blocks.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key
from .sharding import gapless

#: Rows of a block, as long as that makes no more than MOST_BLOCKS; beyond it blocks get longer.
BLOCK_ROWS, MOST_BLOCKS = 16, 1 << 20
#: Most sources: one row each is held by the driver.
MOST_SOURCES = 10_000
_OWN = ("source", "block", "release", "deadline", "slot", "position")


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of ``weights``."""
    exact = [Fraction(w) for w in weights]
    scale = max((x.denominator for x in exact), default=1)  # of floats: powers of two
    return [int(x * scale) for x in exact]


def schedule(blocks: list[int], weights: list[int]) -> tuple[list[int], list[int], list[int]]:
    """For each slot the source whose next block goes, its release and its deadline.

    ``blocks`` has each source's number of blocks. A phase ends when a source runs out; the weights of the others
    keep their proportions, and releases and deadlines count from the phase's first slot.
    """
    left = list(blocks)
    alive = [s for s, n in enumerate(left) if n]
    out: list[int] = []
    releases: list[int] = []
    deadlines: list[int] = []
    while alive:
        base, total = len(out), sum(weights[s] for s in alive)
        waiting: list = []
        ready = [(-(-total // weights[s]), s, 0) for s in alive]  # deadline, source, block within the phase; all start at once
        heapq.heapify(ready)
        while True:
            t = len(out) - base
            while waiting and waiting[0][0] <= t:
                _, s, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(i + 1) * total // weights[s]), s, i))
            deadline, s, i = heapq.heappop(ready)
            out.append(s)
            releases.append(base + i * total // weights[s])
            deadlines.append(base + deadline)
            left[s] -= 1
            if not left[s]:
                alive.remove(s)
                break
            heapq.heappush(waiting, ((i + 1) * total // weights[s], s, i + 1))
    return out, releases, deadlines


def source_name(column: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def place(docs: DataFrame, key: str = "doc_id", source: str = "source", tie: str = "text", targets: dict | None = None, temperature: float = 0.5, block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``docs`` with ``mix_source``, ``mix_block``, ``mix_release``, ``mix_deadline``, ``mix_slot`` and ``mix_position``, in place of columns of these names.

    ``targets`` maps sources to weights; those it lacks, and all by default, weigh rows ** ``temperature``. Every row
    is placed once: positions run from 0 without gaps. Rows of a source with equal keys are ordered by a digest of ``tie``.
    """
    spark = docs.sparkSession
    row = docs.select(F.struct(*[c for c in docs.columns if c not in {f"mix_{x}" for x in _OWN}]).alias("row"), F.col(key).alias("key"), source_name(F.col(source)).alias("source"), text_key(F.col(tie)).alias("tie"))
    counted = row.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r.source: r.n for r in sorted(counted, key=lambda r: r.source)}
    names = list(sizes)
    targets = {"=" + s if s is not None else "null": w for s, w in (targets or {}).items()}
    weights = [float(targets.get(s, sizes[s] ** temperature)) for s in names]
    if any(w <= 0 for w in weights):
        raise ValueError("target weights have to be above 0")
    block_rows = max(block_rows, -(-sum(sizes.values()) // most_blocks))
    blocks = [-(-n // block_rows) for n in sizes.values()]
    table = _block_table(names, list(sizes.values()), block_rows, *schedule(blocks, whole_weights(weights)))
    ranked = gapless(row, "source", ["key", "tie"], [F.xxhash64("key"), F.col("key"), F.col("tie")], "rank")
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows).cast("long"))
    joined = ranked.join(spark.createDataFrame(table), ["source", "block"])
    position = F.col("start") + F.pmod("rank", F.lit(block_rows))
    return joined.withColumn("position", position).select("row.*", *[F.col(c).alias(f"mix_{c}") for c in _OWN])


def _block_table(names: list[str], sizes: list[int], block_rows: int, sources: list[int], releases: list[int], deadlines: list[int]) -> pa.Table:
    """(source, block, slot, release, deadline, start): ``start`` counts the rows of the slots before."""
    s = np.array(sources, np.int64)
    order = np.argsort(s, kind="stable")
    count = np.bincount(s, minlength=len(names)) if len(s) else np.zeros(len(names), np.int64)
    block = np.empty(len(s), np.int64)
    block[order] = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
    rows = np.minimum(block_rows, np.array(sizes, np.int64)[s] - block * block_rows) if len(s) else block
    name = pa.array(names, pa.string()).take(pa.array(s))
    return pa.table({"source": name, "block": block, "slot": np.arange(len(s)), "release": pa.array(releases, pa.int64()), "deadline": pa.array(deadlines, pa.int64()), "start": np.cumsum(rows) - rows})


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: where the mixture puts it.

    doc_id, source, block (of its source), slot, release and deadline (slots), position. Rows equal in key and text take
    their places arbitrarily among themselves. A null source is a source. An empty table gives no rows.
    """
    key, source, tie = (options.pop(k, d) for k, d in (("key", "doc_id"), ("source", "source"), ("tie", "text")))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), text_key(F.col(tie)).alias("tie"))  # texts stay where they are
    out = place(rows, "doc_id", "source", "tie", **options)
    return out.select("doc_id", "source", *[F.col(f"mix_{c}").alias(c) for c in ("block", "release", "deadline", "slot", "position")])
