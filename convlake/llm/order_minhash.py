"""Near-duplicate documents by Order MinHash.

A sketch samples the two smallest of a document's occurrence-labelled shingles (five words; fewer in short texts) under a hash of its own and
keeps them in text order, so that two documents share a sketch only if the same shingles come in the same order.
Documents that share a sketch are aligned word by word inside a band that leaves at most a fifth of the words
unaligned; those with an edit similarity of 0.8 or more are linked, and linked documents form a class.

Groups of documents that share a sketch may be large. Each is aligned with one of its documents first, the one that
shares most, then with a few drawn ones; what those links settle needs no more alignments. In small groups all pairs
that are left are looked at, large ones are searched through the rarest words: of two documents that differ in at most a fifth of their words each holds one of the other's rarest
fifth, so only documents that share such a word (and neither length nor parities rule out) are aligned. No pair
with the similarity asked for is lost by this.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import ALNUM, LOWER, MULT, U64, Words, mix, pieces, store, text_key, texts_of, window_hash

SHINGLE = 5
SIMILARITY = 0.8
#: Sketches, and shingles in each. Two documents whose labelled shingles have a Jaccard similarity J share none with
#: probability (1 - J**TAKE) ** SKETCHES. A fifth of the words changed at random leaves J = 0.2: 0.08; a seventh: 0.003;
#: with the shingles of short texts J = 0.4 or more: 0.015 at most.
SKETCHES, TAKE = 64, 2
#: Shorter texts have shorter shingles, as an edit takes away as many shingles as they have words: (fewest words, most words, shingle,
#: taken). Ranges overlap by what a text may be longer than one that is near to it, so that any such two have sketches of one kind.
SHORT = ((1, 15, 1, 2), (12, 375, 2, 3))
#: Texts with fewer words have no sketches of SHINGLE words.
LONG_FROM = 300
#: 64-bit numbers in a document's parity bits.
_PARITIES = 16
#: Documents of an unsettled sketch that are drawn for all others to be aligned with.
_DRAWN = 4
#: Documents of an unsettled sketch up to which all pairs are looked at, and listed words of a document, the most common
#: ones, that tell whether another one finds a pair too.
_FEW, _LAST_LISTED = 16, 64
#: Buckets, a power of two, that words are counted in before a document's rarest ones are listed. Words that share a bucket cost alignments, no pairs.
_BUCKETS = 1 << 20
_SKETCHED = "node binary, keys array<long>"
_TEXTS = "id long, words int, parity array<long>, text binary"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(LOWER.tolist())
_LAST = np.iinfo(U64).max


def labelled_shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles labelled with their occurrence in the document, and each document's first.

    A document of fewer words has one shingle, all of them; one without words has none.
    """
    h = words.hash[0]
    count = np.diff(words.bounds)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first = np.r_[0, np.cumsum(n)]
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(first[-1]) - first[:-1][owner]
    full = window_hash(h, width, MULT[0])
    hashes = np.zeros(first[-1], U64)
    place = words.bounds[owner] + at
    long = count[owner] >= width
    hashes[long] = full[place[long]]
    for k in np.flatnonzero((count > 0) & (count < width)):
        hashes[first[k]] = window_hash(h[words.bounds[k] : words.bounds[k + 1]], int(count[k]), MULT[1])[0]
    key = mix(hashes + owner.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.empty(0, bool)
    label = np.empty(len(s), U64)
    label[order] = (np.arange(len(s)) - np.flatnonzero(new)[np.cumsum(new) - 1]).astype(U64) if len(s) else 0
    return mix(hashes + label * U64(0xD6E8FEB86659FD93)), first


def sketch_keys(hashes: np.ndarray, first: np.ndarray, count: int, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a shingle, and a row of ``count`` sketches for each."""
    n = np.diff(first)
    docs = np.flatnonzero(n > 0)
    if not len(docs):
        return docs, np.empty((0, count), np.int64)
    begin, n = first[docs], n[docs]
    out = np.empty((len(docs), count), U64)
    picked = np.empty((len(docs), take), np.int64)
    for j in range(count):
        v = hashes * U64((j * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (1 << 64) - 1 | 1)
        v ^= v >> U64(32)
        v *= U64(0xBF58476D1CE4E5B9)
        for k in range(take):
            least = np.minimum.reduceat(v, begin)
            at = np.flatnonzero(v == np.repeat(least, n))
            if len(at) > len(docs):  # equal hashes: the first in the text
                own = np.searchsorted(begin, at, side="right")
                at = at[np.r_[True, own[1:] != own[:-1]]]
            picked[:, k] = np.where(least == _LAST, -1, at)  # -1: has fewer
            v[at] = _LAST
        picked.sort(axis=1)
        key = np.full(len(docs), (j * 0x9E3779B97F4A7C15) & (1 << 64) - 1, U64)
        for k in range(take):
            key = mix(key * MULT[0] + np.where(picked[:, k] >= 0, hashes[picked[:, k]], U64(1)))
        out[:, j] = key
    return docs, out.view(np.int64)


def sketches(words: Words, width: int, count: int, take: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, keys): ``count`` sketches for each kind that a document's number of words asks for, one document after the other."""
    n, owners, keys = np.diff(words.bounds), [], []
    for kind, (low, high, wide, taken) in enumerate((*SHORT, (LONG_FROM, np.inf, width, take))):
        chosen = (n >= low) & (n <= high)
        if not chosen.any():
            continue
        hashes, first = labelled_shingles(words, wide)
        own = np.where(chosen, np.diff(first), 0)
        docs, made = sketch_keys(hashes[np.repeat(chosen, np.diff(first))], np.r_[0, np.cumsum(own)], count, taken)
        owners.append(np.repeat(docs, count))
        keys.append(mix(made.view(U64).ravel() + U64(kind)))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate(keys)[order].view(np.int64)


def _sketched(texts: DataFrame, width: int, count: int, take: int) -> DataFrame:
    def run(batches):
        for batch in pieces(batches, 1 << 20):
            data, offsets = texts_of(batch.column("text"))
            owner, keys = sketches(Words(LOWER[data], offsets, ALNUM), width, count, take)
            docs, begin = np.unique(owner, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(owner)], pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(docs)), lists], names=["node", "keys"])

    return texts.mapInArrow(run, _SKETCHED)


def labelled_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    return labelled_shingles(words, 1)


def parities(words: Words) -> np.ndarray:
    """Per text, how often each of 64 * _PARITIES bits is hit by its words, labelled with their occurrence: even or odd.

    Texts differ in at most as many bits as they have words without a partner.
    """
    hashes, first = labelled_words(words)
    bit = (hashes >> U64(32)) % U64(64 * _PARITIES)
    out = np.zeros((len(first) - 1) * _PARITIES, U64)
    np.bitwise_xor.at(out, np.repeat(np.arange(len(first) - 1), np.diff(first)) * _PARITIES + (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return out.reshape(-1, _PARITIES).view(np.int64)


def _prepared(texts: DataFrame) -> DataFrame:
    """Each text as words joined by blanks, their number, and its parity bits."""

    def run(batches):
        for batch in pieces(batches, 4 << 20):
            data, offsets = texts_of(batch.column("text"))
            words = Words(LOWER[data], offsets, ALNUM)
            plain = [b" ".join(_WORD.findall((x or "").encode().translate(_LOWER))) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(words.bounds), pa.int32()), pa.array(parities(words).tolist(), pa.list_(pa.int64())), pa.array(plain, pa.binary())], names=["id", "words", "parity", "text"])

    return texts.mapInArrow(run, _TEXTS)


def edit_distance(a: list, b: list, most: int) -> int | None:
    """Edits between ``a`` and ``b`` inside a band of ``most`` diagonals to either side; None if more than ``most``.

    A column of the band is a pair of bit vectors: where the distance grows and where it falls from one row to the
    next. Bit r of column j stands for row j - most + r.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    band = (1 << (2 * most + 1)) - 1
    up, down = band & ~((1 << most) - 1), 0
    distance = min(n, most)  # at row min(n, most) of column 0
    lowest = 1 << (2 * most)
    for j in range(1, m + 1):
        here, back = places.get(b[j - 1], 0), j - most - 1
        here = (here >> back if back >= 0 else here << -back) & band
        same = (((here & up) + up) ^ up) | here | down
        right = down | (band & ~(same | up))
        left = same & up
        if j + most <= n:  # along the lowest diagonal
            if not same & lowest:
                distance += 1
                if distance > 2 * most + m - n:  # the steps along the last row cannot make up for it
                    return None
        else:  # along the last row
            bit = 1 << (n - j + most)
            if right & bit:
                distance += 1
            elif left & bit:
                distance -= 1
        same >>= 1
        up = left | (band & ~(same | right))
        down = same & right
    return distance if distance <= most else None


def similar(a: list, b: list, least: float) -> bool:
    """Whether two word sequences have an edit similarity, 1 - edits / words of the longer, of ``least`` or more."""
    most, longer = int(max(len(a), len(b)) * (1 - least) + 1e-9), max(len(a), len(b))
    if longer - (Counter(a) & Counter(b)).total() > most:  # edits are at least the words without a partner
        return False
    return edit_distance(a, b, most) is not None


def _aligned(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of documents that are similar. One that is in very many pairs is ``a`` in them: rows are dealt out by ``b`` last."""

    def run(batches):
        for batch in batches:
            a, last, kept = None, None, []
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x = x.as_py()
                if x != last:
                    a, last = x.split(), x
                if similar(a, y.as_py().split(), least):
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    sides = [texts.select(F.col("id").alias(n), F.col("text").alias(t)) for n, t in (("a", "x"), ("b", "y"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _may_be_near(x, y, least: float):
    """Lengths and parity bits that a band allows.

    Texts of n and m words with e edits or fewer have at most 2 e - |n - m| words without a partner.
    """
    room = (F.lit(1 - least) * F.greatest(x["words"], y["words"])) + F.lit(1e-9)
    apart = F.abs(x["words"] - y["words"])
    odd = sum((F.bit_count(x["parity"][k].bitwiseXOR(y["parity"][k])) for k in range(_PARITIES)), F.lit(0))
    return (apart <= room) & (odd <= 2 * F.floor(room) - apart)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, least: float = SIMILARITY, count: int = SKETCHES, take: int = TAKE) -> DataFrame:
    """One row per row of ``docs``: key, ``class_id`` (the smallest key of its class), ``class_size``, CRC of the text, ``stays``,
    ``class_key``, which tells classes apart also where their keys are null, and ``text_key``, which tells texts apart.

    Words are runs of digits, letters and non-ASCII bytes, A-Z lower-cased. Equal texts are one class and are folded
    before anything else. ``stays`` is true for rows with the class's smallest key. A null text counts as empty; texts
    without words are near only to equal texts; a null key is larger than all others (a class of null keys has a null
    class_id). Rows that repeat key and text are one text of the class. An empty table gives no rows; other columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text")).withColumn("node", F.unhex(text_key(F.col("text"))))
    made = _sketched(rows.select("node", "text"), width, count, take)
    sketched = store(made.groupBy("node").agg(F.first("keys").alias("keys")).withColumn("id", F.monotonically_increasing_id()), "sketches")  # short ids for what follows
    each = sketched.select(F.explode("keys").alias("key"), "id")
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = store(each.join(shared, "key"), "members")
    degree = members.groupBy("id").agg((F.sum("n") - F.count(F.lit(1))).alias("degree"))
    nodes = sketched.select("id", "node")
    folded = rows.select("node", "text").join(nodes.join(degree, "id", "left_semi"), "node").groupBy("id").agg(F.first("text").alias("text"))
    texts = store(_prepared(folded), "texts")
    narrow = store(texts.drop("text"), "parities")
    first = _pivot_pairs(members, degree, narrow, least)
    known = _components(_aligned(first, texts, least))
    drawn = store(_drawn_pairs(_unsettled(members, known, narrow), least), "drawn")
    known = _joined(known, _aligned(drawn, texts, least))
    left = _unsettled(members, known, narrow)
    many = store(left.where(F.col("size") > _FEW).select("id").distinct(), "many")
    listed = store(_rarest(texts.join(many, "id", "left_semi"), least), "rarest")
    rare = _unsettled(listed.select("id", F.explode("keys").alias("key")), known, narrow.join(listed.select("id", F.slice("keys", F.greatest(F.size("keys") - _LAST_LISTED + 1, F.lit(1)), _LAST_LISTED).alias("last")), "id"))
    crossing = _crossing_pairs(left.where(F.col("size") <= _FEW), least).unionByName(_crossing_pairs(rare, least)).distinct()
    tried = first.unionByName(drawn).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = crossing.join(tried, ["a", "b"], "left_anti")
    known = _joined(known, _aligned(store(crossing, "crossing"), texts, least))
    ids = rows.groupBy("node").agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    named = ids.join(nodes.join(known, "id"), "node", "left").select("node", "_id", "_n", F.coalesce(F.col("component").cast("string"), F.hex("node")).alias("class"))
    classes = named.groupBy("class").agg(F.min("_id").alias("class_id"), F.sum("_n").alias("class_size"), F.hex(F.min("node")).alias("class_key"))
    named = named.join(classes, "class").select("node", "class_id", "class_size", "class_key")
    crc = rows.select("doc_id", "node", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    return crc.join(named, "node").select("doc_id", "class_id", "class_size", "text_crc32", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("stays"), "class_key", F.lower(F.hex("node")).alias("text_key"))


def _pivot_pairs(members: DataFrame, degree: DataFrame, narrow: DataFrame, least: float) -> DataFrame:
    """Each document of a sketch with the one that shares most sketches with others; one order, so that a class has few of them."""
    first = members.join(degree, "id").groupBy("key").agg(F.min(F.struct(-F.col("degree"), "id")).alias("first")).select("key", F.col("first.id").alias("pivot"))
    pairs = members.join(first, "key").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    x, y = (narrow.select(F.col("id").alias(n), F.struct("words", "parity").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    return store(pairs.join(y, "b").join(x, "a").where(_may_be_near(F.col("x"), F.col("y"), least)).select("a", "b"), "pairs")


def _components(edges: DataFrame) -> DataFrame:
    return store(connected_components(edges).withColumnRenamed("node", "id"), "classes")


def _joined(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``known`` classes after more links: only the links between classes are followed."""
    edges = store(edges, "links")
    label = lambda n, c: known.select(F.col("id").alias(n), F.col("component").alias(c))
    between = edges.join(label("a", "x"), "a", "left").join(label("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    merged = connected_components(between).select(F.col("node").alias("id"), F.col("component").alias("merged"))
    own = known.join(merged.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("merged", "component").alias("component"))
    new = merged.join(known, "id", "left_anti").select("id", F.col("merged").alias("component"))
    return store(own.unionByName(new), "classes")


def _unsettled(table: DataFrame, known: DataFrame, narrow: DataFrame) -> DataFrame:
    """Rows (key, id) of the keys whose documents are in several classes, with ``component``, the key's largest class, ``top``, and its ``size``."""
    member = table.select("key", "id").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    per = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    several = per.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top")).where("classes > 1").select("key", "size", F.col("top.component").alias("top"))
    return store(member.join(several, "key").join(narrow, "id"), "unsettled")


def _drawn_pairs(member: DataFrame, least: float) -> DataFrame:
    """Pairs of the documents of each unsettled sketch with a few of them, drawn by hash."""
    whole = F.struct("id", "component", "words", "parity")
    drawn = member.groupBy("key").agg(F.array(*[F.min_by(whole, F.xxhash64("id", "key", F.lit(k))) for k in range(_DRAWN)]).alias("drawn"))
    near = F.filter("drawn", lambda y: (y["component"] != F.col("component")) & _may_be_near({"words": F.col("words"), "parity": F.col("parity")}, y, least))
    pairs = member.join(drawn, "key").select("id", F.explode(F.transform(F.array_distinct(near), lambda y: y["id"])).alias("drawn"))
    return pairs.select(F.col("drawn").alias("a"), F.col("id").alias("b")).distinct()


def _buckets(batch, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the labelled words of a batch of texts, their buckets, and each text's first."""
    hashes, first = labelled_words(Words(*texts_of(batch.column("text")), ALNUM))
    return hashes, (hashes % U64(count)).astype(np.int64), first


def _tally(texts: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the number of ``texts`` with a word in it, and a name that buckets of the same texts have in common.

    Tasks count, so a task hands on a row for each bucket at most; a number and a name of each reach the driver. Which texts
    hold a bucket is told by two exclusive-ors of their hashed ids.
    """

    def run(batches):
        count, by = np.zeros(buckets, np.int64), np.zeros((2, buckets), U64)
        for batch in pieces(batches, 4 << 20):
            _, at, first = _buckets(batch, buckets)
            held = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(first)) * buckets + at)
            at, ids = held % buckets, batch.column("id").to_numpy().astype(U64)[held // buckets]
            count += np.bincount(at, minlength=buckets)
            for k in (0, 1):
                np.bitwise_xor.at(by[k], at, mix((ids + U64(1)) * MULT[k]))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(x[used].view(np.int64)) for x in by)], names=["bucket", "n", "by0", "by1"])

    each = texts.select("id", "text").mapInArrow(run, "bucket long, n long, by0 long, by1 long")
    found = each.groupBy("bucket").agg(F.sum("n").alias("n"), F.bit_xor("by0").alias("by0"), F.bit_xor("by1").alias("by1")).where("n > 1").select("bucket", "n", F.xxhash64("n", "by0", "by1").alias("name")).toArrow()
    number, name = np.ones(buckets, np.int32), np.zeros(buckets, np.int64)
    at = found.column("bucket").to_numpy()
    number[at], name[at] = np.minimum(found.column("n").to_numpy(), np.iinfo(np.int32).max), found.column("name").to_numpy()
    return number, name


def _rarest(texts: DataFrame, least: float, buckets: int = _BUCKETS) -> DataFrame:
    """(id, keys): keys of the rarest words of each of ``texts`` that two alike texts cannot both lack, rarest first.

    Words are labelled with their occurrence and ordered by the number of these texts with a word in their bucket. Texts of n
    and m >= n words with m (1 - least) edits or fewer share m least words, so all but n (1 - least) of the shorter's.
    Words whose bucket one text alone has come first; they are counted, but not listed. A key is the name of a bucket, so words
    of the same texts have one key. Words are ranked within tasks: no row is made for a word.
    """
    texts = store(texts.select("id", "text"), "ranked")
    sent = texts.sparkSession.sparkContext.broadcast(_tally(texts, buckets))

    def run(batches):
        number, name = sent.value
        for batch in pieces(batches, 4 << 20):
            hashes, at, first = _buckets(batch, buckets)
            words = np.diff(first)
            owner = np.repeat(np.arange(len(words)), words)
            order = np.lexsort((hashes, name[at], number[at], owner))
            at, rank = at[order], np.arange(len(order)) - first[:-1][owner]
            kept = (rank <= np.floor(words * (1 - least) + 1e-9)[owner]) & (number[at] > 1)
            own, keys = owner[kept], name[at][kept]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])
            docs, begin = np.unique(own[new], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, new.sum()], pa.int32()), pa.array(keys[new]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(docs)), lists], names=["id", "keys"])

    return texts.mapInArrow(run, "id long, keys array<long>")


def _crossing_pairs(member: DataFrame, least: float) -> DataFrame:
    """Pairs of a key's documents in different classes, one of them outside of the key's largest class.

    Pairs inside a class need no alignment, so a key whose documents are all linked gives none. With a column ``last``, a
    pair with common keys in both lists is found by the last of these alone.
    """
    x, y = member.where("component <> top").alias("x"), member.alias("y")
    side = lambda s: {c: F.col(f"{s}.{c}") for c in ("words", "parity")}
    once = (F.col("y.component") == F.col("y.top")) | (F.col("x.id") < F.col("y.id"))
    fresh = F.coalesce(F.try_element_at(F.array_intersect("x.last", "y.last"), F.lit(-1)) == F.col("x.key"), F.lit(True)) if "last" in member.columns else F.lit(True)
    joined = x.join(y, F.col("x.key") == F.col("y.key")).where((F.col("x.component") != F.col("y.component")) & once & _may_be_near(side("x"), side("y"), least) & fresh)
    return joined.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
