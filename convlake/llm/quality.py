"""Quality by positive-unlabelled learning: trusted positives, unlabelled web text, an estimated class prior.

A linear model over character n-grams, binned statistics of a text and how repetitive it is minimises the non-negative
unbiased risk: prior * (loss of positives as positive) + max(0, loss of unlabelled as negative - prior * loss of
positives as negative). No negative label is looked at. The prior comes from a first model of positives against
unlabelled texts, on halves of both that it has not seen: the share of unlabelled texts above a score, over the share
of positives above it, is never much below the prior, and comes down to it where negatives have run out.

Training looks at a bounded sample of rows; all documents are scored by Spark with weights of fixed size.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import store
from .common import MULT, NON_BLANK, Words, pieces, texts_of, window_hash
from .toxicity import fold

#: Most trusted positives, and most unlabelled rows, that are trained on; n-grams that become features.
POSITIVES, UNLABELLED, FEATURES = 6_000, 6_000, 512
THRESHOLD = 0.5
#: Lengths of n-grams; hashed ones are numbered 0 to 2**BITS - 1.
ORDERS, BITS = (2, 3), 18
#: Bins of a statistic.
BINS = 12
_PIECE = 1 << 19
_STEPS, _RATE, _RIDGE = 300, 0.02, 1e-3
#: A cut is trusted for the prior where at least this many positives lie above it.
_LEAST_ABOVE = 50
#: What is taken off the estimated prior: where it is too high the risk of the unlabelled is gone before negatives are told apart.
_BELOW = 0.025

# Digits count as 0; letters keep their case.
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[48:58] = 48
_FOLDED[9:14] = 32
_KIND = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 blank, 5 above ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares between 0 and 1 of each text: kinds of bytes, distinct words, the same word again, short and long words, words that end in a sign, length."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(owner * 6 + _KIND[data], minlength=6 * n).reshape(n, 6) / size[:, None]
    words = Words(data, offsets, NON_BLANK)
    count = np.maximum(np.diff(words.bounds), 1)
    h, own = words.hash[0], words.owner
    per = lambda flags: np.bincount(own, weights=flags, minlength=n) / count
    order = np.lexsort((h, own))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])] if len(h) else np.empty(0, bool)
    distinct = np.bincount(own[order], weights=new, minlength=n) / count
    again = np.r_[False, (h[1:] == h[:-1]) & (own[1:] == own[:-1])] if len(h) else np.empty(0, bool)
    length = words.end - words.start
    last = _KIND[data[words.end - 1]] if len(h) else np.empty(0, np.int64)
    long = np.minimum(np.log2(size) / 24, 1)
    many = np.minimum(np.log2(count) / 20, 1)
    # Repetition comes with length: distinct words are held against the square root of all.
    fresh = np.minimum(distinct * np.sqrt(count) / 40, 1)
    return np.column_stack([kinds, distinct, fresh, per(again), per(length <= 2), per(length >= 15), per(last == 0), long, many])


def present(data: np.ndarray, offsets: np.ndarray, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram) pairs, numbered; with ``place`` only n-grams that are features, as these."""
    low, keys = _FOLDED[data].astype(np.uint64) + np.uint64(1), []
    for n in ORDERS:
        number = ((window_hash(low, n, MULT[0]) ^ np.uint64(n * 0x51ED)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        inside = np.ones(len(number), bool)
        for back in range(1, n):
            at = offsets[1:] - back
            inside[at[(at >= 0) & (at < len(number))]] = False
        feature = number if place is None else place[number]
        at = np.flatnonzero(inside & (feature >= 0))
        keys.append(np.unique(((np.searchsorted(offsets, at, side="right") - 1) << BITS) + feature[at]))
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


class Model(NamedTuple):
    place: np.ndarray  # number of an n-gram -> feature, or -1
    edges: np.ndarray  # statistic, inner edges of its bins
    weight: np.ndarray  # of n-grams, then of bins, then the bias
    prior: float

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) pairs; an empty text has the bins of its statistics alone."""
        doc, gram = present(data, offsets, self.place)
        grams = len(self.weight) - 1 - self.edges.shape[0] * BINS
        stats = statistics(data, offsets)
        bins = np.stack([np.searchsorted(e, stats[:, k], side="right") + k * BINS for k, e in enumerate(self.edges)], 1) + grams
        n = len(stats)
        return np.r_[doc, np.repeat(np.arange(n), bins.shape[1])], np.r_[gram, bins.ravel()]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = self.features(data, offsets)
        total = np.bincount(doc, weights=self.weight[feature], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.weight[-1], -500, 500)))


def _sample(docs: DataFrame, keys: DataFrame, size: int, salt: int) -> DataFrame:
    """Texts of at most ``size`` of ``keys``, the smallest by hash; a key that ``docs`` repeats gives one text, the least."""
    own = keys.select("key").distinct().orderBy(F.xxhash64("key", F.lit(salt)), "key").limit(size)
    return docs.join(F.broadcast(own), "key").groupBy("key").agg(F.min("text").alias("text"))  # ``own`` has at most ``size`` short rows


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """(text, trusted, half): trusted positives and a sample of all documents without their labels, both outside of the held-out fold.

    A key with several labels is trusted if all of them are 1.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.col("key").isNotNull() & (fold(F.col("key")) != 1))
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label")).where((F.col("label") == 1) & (fold(F.col("key")) != 1))
    halves = lambda d, trusted: d.select("text", F.lit(trusted).alias("trusted"), F.pmod(F.xxhash64("key", F.lit(77)), F.lit(2)).cast("int").alias("half"))
    return halves(_sample(rows, own, positives, 1), 1).unionByName(halves(_sample(rows, rows, unlabelled, 2), 0))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among ``unlabelled`` scores, from scores of positives."""
    cuts = np.sort(positive)[::-1]
    above = np.arange(1, len(cuts) + 1)
    share = np.searchsorted(np.sort(-unlabelled), -cuts, side="right") / max(1, len(unlabelled))
    chance = sum(np.sqrt(np.log(40) / (2 * max(1, len(x)))) for x in (positive, unlabelled))
    ratio = (share + chance) / (above / max(1, len(cuts)))
    fine = above >= min(_LEAST_ABOVE, len(cuts))
    # Cuts that few lie above tell by chance; what chance may add counts for choosing a cut alone.
    at = int(np.argmin(np.where(fine, ratio, np.inf))) if len(cuts) else 0
    best = share[at] / (above[at] / len(cuts)) if len(cuts) else 0.5
    return float(np.clip(best, 0.01, 0.99))


def _train(parts: list[np.ndarray], trusted: np.ndarray, size: int, prior: float | None) -> np.ndarray:
    """Weights that minimise the non-negative risk with ``prior``; without one, the plain logistic loss of trusted against the rest."""
    column = np.concatenate(parts) if parts else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    is_p, is_u = trusted == 1, trusted == 0
    n_p, n_u = max(1, is_p.sum()), max(1, is_u.sum())
    w, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, _STEPS + 1):
        f = np.bincount(row, weights=w[column], minlength=len(parts)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        if prior is None:
            pull = np.where(is_p, (p - 1) / n_p, p / n_u)
        else:
            # Losses of a positive as positive, ln(1 + exp(-f)), and of any row as negative, ln(1 + exp(f)).
            as_negative = np.logaddexp(0, np.clip(f, -30, 30))
            rest = as_negative[is_u].sum() / n_u - prior * as_negative[is_p].sum() / n_p
            back = np.where(is_p, -prior * p / n_p, p / n_u)
            # Where overfitting has made the risk of the unlabelled negative, steps lead back from it.
            pull = np.where(is_p, prior * (p - 1) / n_p, 0) + (back if rest > 0 else -back)
        g = np.bincount(column, weights=pull[row], minlength=size)
        g[-1] += pull.sum()
        g[:-1] += _RIDGE * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - _RATE * (1 - step / (_STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model from trusted positives and unlabelled texts; without either every text scores the same, 1/2."""
    rows = store(training_rows(docs, labels, **options), "training").coalesce(12)  # bounded by the samples
    sizes = {r.trusted: r.n for r in rows.groupBy("trusted").agg(F.count(F.lit(1)).alias("n")).collect()}
    stats = statistics(np.empty(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    if not sizes.get(0) or not sizes.get(1):
        return Model(np.full(1 << BITS, -1, np.int32), np.zeros((stats, BINS - 1)), np.zeros(stats * BINS + 1), 0.5)

    def count(batches):
        tally = np.zeros((2, 1 << BITS), np.int64)
        for piece in pieces(batches, _PIECE):
            trusted = piece.column("trusted").to_numpy()
            doc, gram = present(*texts_of(piece.column("text")), None)
            for k in (0, 1):
                tally[k] += np.bincount(gram[trusted[doc] == k], minlength=1 << BITS)
        at = np.flatnonzero(tally.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(tally[0][at]), pa.array(tally[1][at])], names=["gram", "u", "p"])

    def measure(batches):
        for piece in pieces(batches, _PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in statistics(*texts_of(piece.column("text")))], pa.binary())], names=["stats"])

    # Chi-square of presence against being trusted; what nearly all texts have tells nothing.
    n_u, n_p, u, p = float(sizes[0]), float(sizes[1]), F.col("u"), F.col("p")
    chi = (n_u + n_p) * F.pow(p * (n_u - u) - u * (n_p - p), F.lit(2)) / ((u + p) * F.greatest(n_u + n_p - u - p, F.lit(1.0)) * n_u * n_p)
    best = rows.mapInArrow(count, "gram long, u long, p long").groupBy("gram").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).orderBy(chi.desc(), "gram").limit(FEATURES).collect()
    place = np.full(1 << BITS, -1, np.int32)
    place[[r.gram for r in best]] = np.arange(len(best))
    seen = np.array([np.frombuffer(bytes(r.stats)) for r in rows.mapInArrow(measure, "stats binary").collect()])  # a few numbers for each sampled row
    edges = np.quantile(seen, np.arange(1, BINS) / BINS, axis=0).T
    shape = Model(place, edges, np.zeros(len(best) + stats * BINS + 1), 0.5)
    sent = rows.sparkSession.sparkContext.broadcast(shape)

    def matrix(batches):
        for piece in pieces(batches, _PIECE):
            doc, feature = sent.value.features(*texts_of(piece.column("text")))
            order = np.argsort(doc, kind="stable")
            begin = np.searchsorted(doc[order], np.arange(piece.num_rows + 1))
            kept = feature[order].astype(np.int16)
            yield pa.RecordBatch.from_arrays([piece.column("trusted"), piece.column("half"), pa.array([kept[x:y].tobytes() for x, y in zip(begin[:-1], begin[1:])], pa.binary())], names=["trusted", "half", "features"])

    made = rows.mapInArrow(matrix, "trusted int, half int, features binary").collect()  # at most FEATURES numbers of two bytes for each sampled row
    made.sort(key=lambda r: (r.trusted, r.half, bytes(r.features)))
    trusted, half = np.array([r.trusted for r in made]), np.array([r.half for r in made])
    parts = [np.frombuffer(bytes(r.features), np.int16).astype(np.int32) for r in made]
    prior, size = _prior(parts, trusted, half, len(shape.weight)), len(shape.weight)
    return shape._replace(weight=_train(parts, trusted, size, prior), prior=prior)


def _prior(parts: list[np.ndarray], trusted: np.ndarray, half: np.ndarray, size: int) -> float:
    """Each half's scores come from a model of the other one."""
    score = np.zeros(len(parts))
    for k in (0, 1):
        inside = np.flatnonzero(half != k)
        w = _train([parts[i] for i in inside], trusted[inside], size, None)
        for i in np.flatnonzero(half == k):
            score[i] = w[parts[i]].sum()
    found = [estimate_prior(score[(half == k) & (trusted == 1)], score[(half == k) & (trusted == 0)]) for k in (0, 1)]
    return float(max(0.01, np.mean(found) - _BELOW))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for piece in pieces(batches, _PIECE):
            s = sent.value.score(*texts_of(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: key, whether it is held out, score and prediction. Repeated rows are scored alike.

    Scores come from texts alone. Empty and null texts get the score of the statistics of an empty text. An empty
    ``docs`` gives no rows; without trusted labels all scores are 1/2. A null key is in the fold of the empty text.
    """
    scored = score(docs, train(docs, labels, key=key, text=text), key, text, threshold)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
