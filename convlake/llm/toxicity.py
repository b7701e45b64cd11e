"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios, trained on labels.

Training looks at a bounded sample of labelled rows. Spark counts in how many toxic and clean documents each hashed
n-gram occurs; the most telling ones become features, each worth its log-count ratio where present; a
logistic regression weighs them. The weights are a table of fixed size, which scoring sends to every task.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, MULT, pieces, texts_of, window_hash

ORDERS = (4, 6, 8)
#: Hashed n-grams are numbered 0 to 2**BITS - 1.
BITS = 22
#: Most labelled rows that are trained on, and most features.
SAMPLE, FEATURES = 20_000, 4_096
THRESHOLD = 0.7
#: A-Z lower-cased, all ASCII blanks alike.
_FOLDED = LOWER.copy()
_FOLDED[9:14] = 32
#: Bytes of text that are looked at together.
_PIECE = 1 << 19
_SMOOTH, _RIDGE, _STEPS = 1.0, 1.0, 25


class Model(NamedTuple):
    place: np.ndarray  # number of an n-gram -> feature, or -1
    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = present(data, offsets, self.place)
        total = np.bincount(doc, weights=self.weight[feature], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def grams(data: np.ndarray, offsets: np.ndarray):
    """(inside, numbers) of the n-grams of each order, inside their text or not."""
    low = _FOLDED[data].astype(np.uint64) + np.uint64(1)
    for n in ORDERS:
        number = (window_hash(low, n, MULT[1]) ^ np.uint64(n * 0x9E37)) & np.uint64((1 << BITS) - 1)
        inside = np.ones(len(number), bool)
        for back in range(1, n):
            at = offsets[1:] - back
            at = at[(at >= 0) & (at < len(number))]
            inside[at] = False
        yield inside, number.astype(np.int64)


def present(data: np.ndarray, offsets: np.ndarray, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs; without ``place`` every n-gram is a feature."""
    keys = []
    for inside, number in grams(data, offsets):
        feature = number if place is None else place[number]
        at = np.flatnonzero(inside if place is None else (feature >= 0) & inside)
        keys.append(np.unique(((np.searchsorted(offsets, at, side="right") - 1) << BITS) + feature[at]))
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


def fold(key: Column) -> Column:
    """0, 1 or 2: crc32 of the key as text, modulo 3; 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``text`` and ``label`` of at most ``sample`` labelled keys outside of the held-out fold, the smallest by hash.

    A key with several labels has their maximum, one with several rows the least of their texts; null labels and keys are left out.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key)) != 1)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64(key), key).limit(sample)
    one = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return one.join(F.broadcast(own), key).groupBy(key, "label").agg(F.min("text").alias("text")).select("text", "label")  # ``own`` has at most ``sample`` short rows


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model from labelled rows; without rows of both labels it scores all texts 0 or 1 alike, as the label that is there."""
    from ..storage import store

    rows = store(training_rows(docs, labels, **options), "training").coalesce(12)  # bounded by ``sample``; fewer tasks count an n-gram fewer times

    def count(batches):
        tally = np.zeros((2, 1 << BITS), np.int32)  # at most SAMPLE
        for batch in batches:
            for piece in pieces([batch], _PIECE):
                data, offsets = texts_of(piece.column("text"))
                label = piece.column("label").to_numpy(zero_copy_only=False)
                doc, gram = present(data, offsets, None)
                for k in (0, 1):
                    np.add.at(tally[k], gram[label[doc] == k], 1)
        at = np.flatnonzero(tally.any(axis=0))
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(tally[0][part].astype(np.int64)), pa.array(tally[1][part].astype(np.int64))], names=["gram", "clean", "toxic"])

    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model(np.full(1 << BITS, -1, np.int32), np.zeros(1), 30.0 if toxic else -30.0)
    counts = rows.mapInArrow(count, "gram long, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Chi-square of presence against label.
    n, a, b = float(clean + toxic), F.col("toxic"), F.col("clean")
    c, d = F.lit(toxic) - a, F.lit(clean) - b
    chi = n * F.pow(a * d - b * c, F.lit(2)) / ((a + b) * F.greatest(c + d, F.lit(1)) * float(toxic) * float(clean))
    best = counts.orderBy(chi.desc(), "gram").limit(FEATURES).collect()
    p = np.array([r.toxic for r in best]) + _SMOOTH
    q = np.array([r.clean for r in best]) + _SMOOTH
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    place = np.full(1 << BITS, -1, np.int32)
    place[[r.gram for r in best]] = np.arange(len(best))
    sent = rows.sparkSession.sparkContext.broadcast(place)

    def matrix(batches):
        for batch in pieces(batches, _PIECE):
            data, offsets = texts_of(batch.column("text"))
            doc, feature = present(data, offsets, sent.value)
            begin = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([feature[x:y].astype(np.int16).tobytes() for x, y in zip(begin[:-1], begin[1:])], pa.binary())], names=["label", "features"])

    made = rows.mapInArrow(matrix, "label int, features binary").collect()  # at most SAMPLE x FEATURES numbers of two bytes
    label = np.array([r.label for r in made], float)
    parts = [np.frombuffer(bytes(r.features), np.int16) for r in made]
    weight, bias = _logistic(parts, label, ratio)
    return Model(place, weight * ratio, bias)


def _logistic(parts: list[np.ndarray], label: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on rows that hold ``ratio`` at their features: conjugate-gradient Newton."""
    column = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    value = ratio[column]
    size = len(ratio) + 1

    def times(w):
        return np.bincount(row, weights=value * w[column], minlength=len(label)) + w[-1]

    def back(r):
        return np.r_[np.bincount(column, weights=value * r[row], minlength=size - 1), r.sum()]

    ridge = np.r_[np.full(size - 1, _RIDGE), 1e-3]
    w = np.zeros(size)
    for _ in range(_STEPS):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        grad = back(p - label) + ridge * w
        if np.abs(grad).max() < 1e-3:
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros(size), -grad
        d, rr = r.copy(), float(r @ r)
        for _ in range(30):
            h = back(curve * times(d)) + ridge * d
            a = rr / float(d @ h)
            step += a * d
            r -= a * h
            new = float(r @ r)
            if new < 1e-6 * float(grad @ grad):
                break
            d, rr = r + new / rr * d, new
        w += step
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` with a score and a prediction, in place of columns of these ``names``; a null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    index = kept.columns.index(text)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for piece in pieces([pa.RecordBatch.from_arrays([*batch.columns, batch.column(index).cast(pa.string())], names=[*(f"_{k}" for k in range(batch.num_columns)), "text"])], _PIECE):
                s = sent.value.score(*texts_of(piece.column("text")))
                columns = [*piece.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], names=arrow.names)

    return kept.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: key, whether it is held out, score and prediction. Repeated rows are scored alike.

    Scores come from texts alone. Empty and null texts get the score of a text without features. An empty
    ``docs`` gives no rows. A null key is in the fold of the empty text.
    """
    model = train(docs, labels, key=key, text=text)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = score(rows, model, "text", threshold)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
