"""Hard negatives by rotated one-bit codes with bounds that hold for certain.

A vector is rotated and keeps the sign of each coordinate: a code of one bit a dimension, and how much of the vector
lies along it (its alignment). What is left is rotated another way and coded again, a few times over. The inner product with an
anchor is then the sum of the alignments times the code's products with the rotated anchor, which popcounts over the
anchor's bit planes give, plus the product with what no code holds; the inequality of Cauchy and Schwarz bounds that one
by its length. Only vectors whose interval reaches what is looked for are scored, in whole numbers.

Anchors go in slices of bounded size, each against all vectors; every task keeps a few of each anchor's best.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, store

#: Codes of a vector, and bit planes of a rotated anchor.
STAGES, PLANES = 4, 8
POSITIVES, NEGATIVES, EVERY = 5, 5, 100
#: The shares of a positive's score, in hundredths, between which its negatives score.
LOW, HIGH = 80, 100
#: Anchors of a slice, and numbers in all their vectors at most; vectors and anchors that are looked at together.
SLICE, SLICE_NUMBERS, ROWS, ANCHORS = 2048, 1 << 22, 2048, 64
#: Whole numbers up to this size have products and sums that fit 64 bits for as many components as a list can have.
_EXACT = 1 << 15
_STORED = "rid long, vec_id long, label long, vector binary, code binary, along binary, rest double, length double"
_BEST = "rid long, slot int, other_rid long, other_id long, score long"
_FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LONG = (-(1 << 63), (1 << 63) - 1)


def rotations(dims: int) -> list[np.ndarray]:
    """The orthogonal matrices of all stages, the same everywhere."""
    rng = np.random.default_rng(20_11)
    return [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(STAGES)]


def padded(dims: int) -> int:
    return max(64, -(-dims // 64) * 64)


def encode(vectors: np.ndarray, turns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, along, rest): for each row a code per stage, its alignments, and the length of what no code holds."""
    left, codes, along = vectors.astype(float), [], []
    root = np.sqrt(left.shape[1])
    for turn in turns:
        y = left @ turn.T
        up = y >= 0
        codes.append(np.packbits(up, axis=1, bitorder="little").view(U64))
        part = np.abs(y).sum(axis=1) / root
        along.append(part)
        left = (y - part[:, None] * np.where(up, 1.0, -1.0) / root) @ turn
    return np.stack(codes, 1), np.stack(along, 1), np.linalg.norm(left, axis=1)


class Anchors(NamedTuple):
    """Rotated anchors as bit planes.

    The product with a code's vector is base + step * (popcounts of the code and a plane, weighed by plane) + low * popcount
    of the code, to within ``error``.
    """

    planes: np.ndarray  # anchor, stage, plane, word
    step: np.ndarray  # anchor, stage; so are the next three
    base: np.ndarray
    low: np.ndarray
    error: np.ndarray
    length: np.ndarray


def planes(vectors: np.ndarray, turns: list[np.ndarray]) -> Anchors:
    n, dims = vectors.shape
    root, top = np.sqrt(dims), (1 << PLANES) - 1
    out = Anchors(np.zeros((n, len(turns), PLANES, dims // 64), U64), *(np.zeros((n, len(turns))) for _ in range(4)), np.linalg.norm(vectors, axis=1))
    for s, turn in enumerate(turns):
        y = vectors @ turn.T
        low, high = y.min(axis=1), y.max(axis=1)
        step = np.maximum((high - low) / top, 1e-300)
        u = np.clip(np.rint((y - low[:, None]) / step[:, None]), 0, top).astype(np.int64)
        for p in range(PLANES):
            out.planes[:, s, p] = np.packbits(u >> p & 1, axis=1, bitorder="little").view(U64)
        out.step[:, s] = 2 * step / root
        out.base[:, s] = -(low * dims + step * u.sum(axis=1)) / root
        out.low[:, s] = 2 * low / root
        out.error[:, s] = np.abs(y - (low[:, None] + step[:, None] * u)).sum(axis=1) / root
    return out


def bounds(anchors: Anchors, codes: np.ndarray, along: np.ndarray, rest: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most): bounds of the inner products, a row for each anchor."""
    total = np.zeros((len(anchors.length), len(codes)))
    width = np.zeros_like(total)
    last = None
    for s in range(codes.shape[1]):
        ones = np.bitwise_count(codes[:, s]).sum(axis=1, dtype=np.int64)
        hits = np.zeros(total.shape, np.int64)
        for p in range(PLANES):
            for w in range(codes.shape[2]):
                hits += np.bitwise_count(codes[:, s, w] & anchors.planes[:, s, p, w, None]).astype(np.int64) << p
        product = anchors.base[:, s, None] + anchors.step[:, s, None] * hits + anchors.low[:, s, None] * ones
        total += along[:, s] * product
        width += along[:, s] * anchors.error[:, s, None]
        last = np.maximum(np.abs(product) - anchors.error[:, s, None], 0)
    # What is left is at right angles to the last code's vector.
    beside = np.sqrt(np.maximum(anchors.length[:, None] ** 2 - last**2, 0))
    width += rest * beside + 1e-9 * anchors.length[:, None] * length + 1e-6
    # Products that 64 bits may not hold, and those of lengths that doubles do not hold, have no bounds.
    small = anchors.length[:, None] * length < 2.0**62
    return np.where(small, total - width, -np.inf), np.where(small, total + width, np.inf)


def exact(vectors: np.ndarray, rows: np.ndarray, anchors: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Whole inner products of pairs; components are whole numbers in doubles, sums beyond 64 bits become its limits."""
    if max(np.abs(vectors).max(initial=0), np.abs(anchors).max(initial=0)) < _EXACT:
        out = np.empty(len(rows), np.int64)
        for k in range(0, len(rows), 1 << 14):
            part = slice(k, k + (1 << 14))
            out[part] = np.einsum("ij,ij->i", vectors[rows[part]].astype(np.int64), anchors[which[part]].astype(np.int64))
        return out
    whole = lambda x: [int(v) for v in x]
    sums = (sum(a * b for a, b in zip(whole(vectors[i]), whole(anchors[j]))) for i, j in zip(rows, which))
    return np.fromiter((min(max(x, _LONG[0]), _LONG[1]) for x in sums), np.int64, len(rows))


def prepare(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """Stored rows with whole components and their codes, and the length that all vectors are filled up to with zeros."""
    x = F.col(vector)
    fine = F.col(label).isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))
    own = F.when(F.col(key) % 7 == 0, (F.col(label).cast("long") + 1) % 10).otherwise(F.col(label).cast("long"))
    rows = vectors.where(fine).select(F.col(key).cast("long").alias("vec_id"), own.alias("label"), F.transform(x, lambda v: v.cast("double")).alias("x"))
    dims = padded(rows.agg(F.max(F.size("x"))).first()[0] or 0)

    def run(batches):
        turns = rotations(dims)
        np.seterr(all="ignore")  # numbers near the largest double
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                lists = part.column("x")
                sizes = np.diff(lists.offsets.to_numpy())
                whole = np.zeros((part.num_rows, dims))
                whole[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * 256)
                codes, along, rest = encode(whole, turns)
                blobs = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (whole, codes, along)]
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("vec_id"), part.column("label"), *blobs, pa.array(rest), pa.array(np.linalg.norm(whole, axis=1))], names=_STORED.replace(",", "").split()[::2])

    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    return store(numbered.mapInArrow(run, _STORED), "codes"), dims


def _matrix(column: pa.Array, kind, *shape) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


class _Best:
    """The best few (score, then id) of each slot so far, of one task."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.slot, self.score = keep, np.empty(0, np.int64), np.empty(0, np.int64)
        self.id, self.rid = np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = np.full(slots, -np.inf)

    def add(self, slot, score, ids, rids) -> None:
        slot, score, ids, rids = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.id, ids], np.r_[self.rid, rids]
        order = np.lexsort((rids, ids, ~score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        order, slot = order[rank < self.keep], slot[rank < self.keep]
        self.slot, self.score, self.id, self.rid = slot, score[order], ids[order], rids[order]
        last = np.arange(len(slot)) - np.searchsorted(slot, slot) == self.keep - 1
        self.floor[slot[last]] = self.score[last]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest of each row; minus infinity in rows of fewer."""
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _search(stored: DataFrame, dims: int, slice_: list, targets: list[list[int]] | None, keep: int) -> DataFrame:
    """The best rows of each slot, a few of every task. Without ``targets`` each anchor has one, for its positives.

    ``targets`` has each anchor's positive scores; the rows sought lie between shares of them, and have other labels.
    """
    sent = stored.sparkSession.sparkContext.broadcast(([r.rid for r in slice_], [r.label for r in slice_], b"".join(bytes(r.vector) for r in slice_), targets))

    def run(batches):
        turns = rotations(dims)
        np.seterr(all="ignore")
        rids, labels, raw, wanted = sent.value
        rids, labels, vectors = np.array(rids), np.array(labels), np.frombuffer(raw).reshape(-1, dims)
        every = planes(vectors, turns)
        slots = 1 if wanted is None else max(map(len, wanted))
        tops = None if wanted is None else np.array([x + [0] * (slots - len(x)) for x in wanted], np.int64)
        there = np.array([[t < len(x) for t in range(slots)] for x in wanted or []])
        best = _Best(len(rids) * slots, keep)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                whole, codes, along = _matrix(part.column("vector"), float, dims), _matrix(part.column("code"), U64, STAGES, dims // 64), _matrix(part.column("along"), float, STAGES)
                own, ids, label = part.column("rid").to_numpy(), part.column("vec_id").fill_null(_LONG[1]).to_numpy(), part.column("label").to_numpy()
                rest, length = part.column("rest").to_numpy(), part.column("length").to_numpy()
                for a in range(0, len(rids), ANCHORS):
                    b = slice(a, a + ANCHORS)
                    same = labels[b, None] == label
                    able = same & (rids[b, None] != own) if wanted is None else ~same
                    least, most = bounds(Anchors(*(x[b] for x in every)), codes, along, rest, length)
                    for t in range(slots):
                        at = np.arange(a, min(a + ANCHORS, len(rids))) * slots + t
                        sure = open_ = able
                        if wanted is not None:
                            high, able_t = tops[b, t, None].astype(float), able & there[b, t, None]
                            sure = able_t & (100 * least >= LOW * high) & (100 * most <= HIGH * high)
                            open_ = able_t & (100 * most >= LOW * high - 1) & (100 * least <= HIGH * high + 1)
                        bottom = best.floor[at]
                        bottom = np.maximum(bottom, _kth(np.where(sure, least, -np.inf), keep))
                        i, j = np.nonzero(open_ & (most >= bottom[:, None]))
                        if not len(i):
                            continue
                        score = exact(whole, j, vectors, i + a)
                        if wanted is not None:
                            inside = _inside(score, tops[i + a, t])
                            i, j, score = i[inside], j[inside], score[inside]
                        best.add((i + a) * slots + t, score, ids[j], own[j])
        yield pa.RecordBatch.from_arrays([pa.array(rids[best.slot // slots]), pa.array((best.slot % slots).astype(np.int32)), pa.array(best.rid), pa.array(best.id), pa.array(best.score)], names=_BEST.replace(",", "").split()[::2])

    return stored.mapInArrow(run, _BEST)


def _inside(score: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether LOW * high <= 100 * score <= HIGH * high, in whole numbers of any size."""
    if max(np.abs(score).max(initial=0), np.abs(high).max(initial=0)) < 1 << 55:
        return (LOW * high <= 100 * score) & (100 * score <= HIGH * high)
    return np.fromiter((LOW * int(h) <= 100 * int(s) <= HIGH * int(h) for s, h in zip(score, high)), bool, len(score))


def _first(rows: DataFrame, keep: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("rid", "slot").orderBy(F.desc("score"), "other_id", "other_rid")))
    return ranked.where(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the negatives of each anchor and positive.

    Anchors are rows whose key ``every`` divides. Rows with a null label or vector, or a null or non-finite
    component take no part. Shorter vectors are filled up with zeros. Rows with a null key are no anchors and come last among
    ties. Repeated rows are rows of their own: each is a positive of the others. Scores beyond 64 bits
    become their limits. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    stored, dims = prepare(vectors, key, vector, label)
    most = max(1, min(SLICE, SLICE_NUMBERS // dims))
    anchors = stored.where(F.col("vec_id") % every == 0).select("rid", "vec_id", "label", "vector")
    # Places count up within each partition, so that a slice has at most ``most`` anchors.
    place = F.monotonically_increasing_id()
    dealt = anchors.repartition(max(1, -(-anchors.count() // most))).select("*", F.shiftright(place, 33).alias("part"), F.floor(F.pmod(place, F.lit(1 << 33)) / most).alias("slice"))
    dealt, found = store(dealt, "anchors"), []
    for one in dealt.select("part", "slice").distinct().orderBy("part", "slice").collect():
        own = dealt.where((F.col("part") == one.part) & (F.col("slice") == one.slice)).collect()
        near = store(_first(_search(stored, dims, own, None, positives), positives), "positives")
        scores: dict[int, list[int]] = {}
        for r in near.select("rid", "score").distinct().collect():  # at most ``positives`` for each anchor
            scores.setdefault(r.rid, []).append(r.score)
        if not scores:
            continue
        far = _first(_search(stored, dims, own, [scores.get(r.rid, []) for r in own], negatives), negatives)
        slots = spark.createDataFrame([(r.rid, r.vec_id, t, x) for r in own for t, x in enumerate(scores.get(r.rid, []))], "rid long, anchor_id long, slot int, positive_score long")
        heads = near.select("rid", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")).join(slots, ["rid", "positive_score"])
        tails = far.select("rid", "slot", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
        found.append(store(heads.join(tails, ["rid", "slot"]).select("anchor_id", _known("positive_id"), "rank", _known("negative_id"), "positive_score", "negative_score"), "negatives"))
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _FOUND)


def _known(name: str):
    return F.when(F.col(name) != _LONG[1], F.col(name)).alias(name)
