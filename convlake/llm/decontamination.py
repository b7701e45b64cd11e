"""Benchmark decontamination with a distributed positional inverted index.

The index is stored in the shared folder, split by documents: a row holds the posting lists of a few MB of whole
documents, terms ascending and positions ascending within a term. A search broadcasts benchmark windows in slices
of a fixed size. In each index row it starts from the postings of the rarest term of each window, counted over
all documents, shifts them by the term's offset, and intersects with the shifted postings of the next rarest,
until a phrase is left; terms near each other in any order count as a proximity match.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import rows_to_arrow
from .common import ALNUM, LOWER, Words, ids_of, pieces, store, texts_of

WINDOW = 10
#: Windows in a broadcast slice; with its terms and items a slice takes some 40 MB at most.
SLICE = 200_000
#: Words to either side in which the other rare terms of a window must lie for a proximity match.
NEAR = 15
#: Terms of a proximity match, and occurrences of rarest terms that are looked at together.
_RAREST, _AT_ONCE = 3, 1 << 20
_INDEX = "block long, ids binary, nulls binary, crcs binary, keys binary, bounds binary, terms binary, checks binary, starts binary, positions binary"
_DOCS = "block long, ordinal long, doc_id long, text_crc32 long, text_key string, n_words long"
_FOUND = "block long, ordinal long, hits binary, items array<string>, near array<string>"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Postings of every word of every row of ``docs``; a null text has none. A term is a word's 128-bit key: ``terms`` and ``checks`` hold its halves."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        pack = lambda a: zstandard.ZstdCompressor(level=1).compress(a.tobytes())
        for batch in pieces(batches, block_bytes):
            data, offsets = texts_of(batch.column("text"))
            words = Words(LOWER[data], offsets, ALNUM, 2)
            texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            crcs = np.array([zlib.crc32(t) for t in texts], np.uint32)
            position = np.arange(len(words.start)) + words.owner * WINDOW_GAP
            order = np.argsort(words.hash[0], kind="stable")
            terms, checks = words.hash[0][order], words.hash[1][order]
            if ((terms[1:] == terms[:-1]) & (checks[1:] != checks[:-1])).any():
                order = np.lexsort((position, words.hash[1], words.hash[0]))
                terms, checks = words.hash[0][order], words.hash[1][order]
            starts = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (checks[1:] != checks[:-1])]) if len(terms) else np.empty(0, np.int64)
            nulls = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            steps = np.diff(position[order].astype(np.int32), prepend=np.int32(0))
            yield rows_to_arrow([(
                number, ids_of(batch.column("doc_id")).tobytes(), np.packbits(nulls).tobytes(), crcs.tobytes(), b"".join(hashlib.sha256(t).digest()[:16] for t in texts), words.bounds.astype(np.int64).tobytes(),
                terms[starts].tobytes(), checks[starts].tobytes(), np.r_[starts, len(terms)].astype(np.int32).tobytes(), pack(steps),
            )], _INDEX)
            number += 1

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return store(rows.mapInArrow(run, _INDEX), "postings")


#: Positions left free between two documents, so that no phrase or proximity crosses them.
WINDOW_GAP = 2 * NEAR + WINDOW


def windows_of(benchmark: DataFrame, key: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct windows of item words: ``hash``, ``terms`` and ``checks`` (128-bit keys, in order) and the ``items`` that hold them.

    An item of fewer words is one window, one without words none.
    """

    def run(batches):
        for batch in pieces(batches, 4 << 20):
            data, offsets = texts_of(batch.column("text"))
            words = Words(LOWER[data], offsets, ALNUM, 2)
            items = batch.column("item").to_pylist()
            one, two = (h.view(np.int64) for h in words.hash)
            rows = []
            for k, item in enumerate(items):
                low, high = words.bounds[k], words.bounds[k + 1]
                for at in range(low, max(low + 1, high - width + 1) if high > low else low):
                    w, c = one[at : min(at + width, high)], two[at : min(at + width, high)]
                    rows.append((hashlib.blake2b(w.tobytes() + c.tobytes(), digest_size=16).digest(), w.tolist(), c.tolist(), item))
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["hash", "terms", "checks", "item"])

    rows = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(run, "hash binary, terms array<long>, checks array<long>, item string")
    return made.groupBy("hash").agg(F.first("terms").alias("terms"), F.first("checks").alias("checks"), F.sort_array(F.collect_set("item")).alias("items"))


class _Slice(NamedTuple):
    terms: np.ndarray  # windows x width, rarest first, 0-padded
    checks: np.ndarray  # the other halves of their keys
    shift: np.ndarray  # their offsets in the window
    size: np.ndarray
    items: list[list[str]]


def _frequencies(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """Occurrences of each term of a slice in all documents."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in batches:
            for t, s in zip(batch.column("terms"), batch.column("starts")):
                terms, counts = np.frombuffer(t.as_py(), np.uint64), np.diff(np.frombuffer(s.as_py(), np.int32))
                hit = np.isin(terms, sent.value, assume_unique=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms[hit].view(np.int64)), pa.array(counts[hit].astype(np.int64))], names=["term", "n"])

    rows = index.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r.term: r.n for r in rows}


def _prepare(rows: list, index: DataFrame, width: int) -> _Slice:
    size = np.array([len(r.terms) for r in rows], np.int64)
    terms, checks = np.zeros((2, len(rows), width), np.int64)
    for k, r in enumerate(rows):
        terms[k, : len(r.terms)] = r.terms
        checks[k, : len(r.terms)] = r.checks
    used = np.arange(width) < size[:, None]
    vocabulary = np.unique(terms[used]).view(np.uint64)
    count = _frequencies(index, np.sort(vocabulary))
    rarity = np.full(terms.shape, np.iinfo(np.int64).max)
    rarity[used] = [count.get(t, 0) for t in terms[used].tolist()]
    shift = np.argsort(rarity, axis=1, kind="stable")
    return _Slice(np.take_along_axis(terms, shift, 1).view(np.uint64), np.take_along_axis(checks, shift, 1).view(np.uint64), shift, size, [list(r.items) for r in rows])


def _search(row: dict, part: _Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, first position) of each phrase and (window, position) of each proximity match in an index row."""
    terms, checks, starts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["checks"], np.uint64), np.frombuffer(row["starts"], np.int32).astype(np.int64)
    raw = zstandard.ZstdDecompressor().decompress(row["positions"], max_output_size=max(1, 4 * int(starts[-1])))
    position = np.cumsum(np.frombuffer(raw, np.int32), dtype=np.int64)
    size = np.diff(starts)
    keys = (np.repeat(np.arange(len(terms)), size) << 32) + position  # ascending: term, then position
    place = np.searchsorted(terms, part.terms)
    known = np.zeros(part.terms.shape, bool)
    while len(terms):  # once, unless the first halves of two words' keys are equal
        last = np.minimum(place, len(terms) - 1)
        like = (place < len(terms)) & (terms[last] == part.terms)
        known = like & (checks[last] == part.checks)
        if not (like & ~known).any():
            break
        place = place + (like & ~known)
    used = np.arange(part.terms.shape[1]) < part.size[:, None]

    def occurrences(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These windows, once for each occurrence of their rarest term, and its position."""
        if not len(alive):
            return alive, np.empty(0, np.int64)
        first = place[alive, 0]
        n = size[first]
        return np.repeat(alive, n), position[np.repeat(starts[first] - np.r_[0, np.cumsum(n)[:-1]].astype(np.int64), n) + np.arange(n.sum())]

    window, at = occurrences(np.flatnonzero((known | ~used).all(axis=1)))
    at = at - part.shift[window, 0]
    for k in range(1, part.terms.shape[1]):
        want = (place[window, k] << 32) + at + part.shift[window, k]
        found = np.searchsorted(keys, want)
        keep = (part.size[window] <= k) | ((found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == want))
        window, at = window[keep], at[keep]
    # Proximity needs the rarest terms only; a window may have others that this row lacks.
    alive = np.flatnonzero((known | ~used)[:, :_RAREST].all(axis=1))
    cut = np.cumsum(size[place[alive, 0]]) // _AT_ONCE if len(alive) else alive
    near = [(alive[:0], np.empty(0, np.int64))]
    for group in np.split(alive, np.flatnonzero(np.diff(cut)) + 1):
        near_window, near_at = occurrences(group)
        for k in range(1, min(_RAREST, part.terms.shape[1])):
            low = (place[near_window, k] << 32) + near_at - NEAR
            found = np.searchsorted(keys, low)
            keep = (part.size[near_window] <= k) | ((found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] <= low + 2 * NEAR))
            near_window, near_at = near_window[keep], near_at[keep]
        near.append((near_window, near_at))
    near_window, near_at = (np.concatenate([x[c] for x in near]) for c in (0, 1))
    return window, at, near_window, near_at


def _find(index: DataFrame, part: _Slice) -> DataFrame:
    """A stored row for each document with a phrase or a proximity match."""
    sent = index.sparkSession.sparkContext.broadcast(part)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                part = sent.value
                bounds = np.frombuffer(row["bounds"], np.int64)
                begin = bounds[:-1] + np.arange(len(bounds) - 1) * WINDOW_GAP
                window, at, near_window, near_at = _search(row, part)
                doc = np.searchsorted(begin, at, side="right") - 1
                near_doc = np.searchsorted(begin, near_at, side="right") - 1
                hit = np.zeros(bounds[-1] + 1, np.int64)
                word = at - doc * WINDOW_GAP
                np.add.at(hit, word, 1)
                np.add.at(hit, word + part.size[window], -1)
                hit = np.cumsum(hit)[:-1] > 0
                items: dict[int, set] = {}
                near: dict[int, set] = {}
                for found, d, w in ((items, doc, window), (near, near_doc, near_window)):
                    pairs = np.unique(d * np.int64(len(part.size) + 1) + w)
                    for p in pairs.tolist():
                        found.setdefault(p // (len(part.size) + 1), set()).update(part.items[p % (len(part.size) + 1)])
                out = [(row["block"], d, np.packbits(hit[bounds[d] : bounds[d + 1]]).tobytes() if d in items else b"", sorted(items.get(d, ())), sorted(near.get(d, ()))) for d in sorted(items.keys() | near.keys())]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], names=[f.split()[0] for f in _FOUND.split(", ")])

    found = store(index.select("block", "bounds", "terms", "checks", "starts", "positions").mapInArrow(run, _FOUND), "found")
    sent.destroy()
    return found


def _documents(index: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                ids, crcs = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["crcs"], np.uint32)
                nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(ids)).astype(bool)
                keys = [row["keys"][16 * d : 16 * d + 16].hex() for d in range(len(ids))]
                columns = [np.full(len(ids), row["block"]), np.arange(len(ids)), pa.array(ids, mask=nulls), crcs.astype(np.int64), keys, np.diff(np.frombuffer(row["bounds"], np.int64))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in _DOCS.split(", ")])

    return index.select("block", "ids", "nulls", "crcs", "keys", "bounds").mapInArrow(run, _DOCS)


_HITS = "block long, ordinal long, n_hit long, n_items long, items_sha256 string, n_near long"
_NO_ITEMS = hashlib.sha256(b"").hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, slice_windows: int = SLICE, block_bytes: int = 4 << 20) -> DataFrame:
    """Per row of ``docs``: words, words inside an occurrence of a benchmark window, and the items found.

    ``n_near`` counts items with a proximity match: the three rarest terms of a window within NEAR words; ``text_key`` tells
    texts apart. Texts are lower-cased (A-Z) and split into runs of digits, letters and non-ASCII bytes. A null text has
    no words, a null item_id is the item "null", repeated rows and keys are judged one by one. An empty benchmark
    contaminates nothing; an empty ``docs`` gives no rows; other columns are ignored. Slices of the benchmark are
    searched one after the other, so that one at a time is held and sent.
    """
    if not 1 <= width <= WINDOW_GAP:
        raise ValueError(f"width has to be 1 to {WINDOW_GAP}")
    index = build_index(docs, key, text, block_bytes)
    windows = store(windows_of(benchmark, item, item_text, width), "windows")
    slices = -(-windows.count() // slice_windows)
    found = index.sparkSession.createDataFrame([], _FOUND)
    for k in range(slices):
        rows = windows.where(F.pmod(F.xxhash64("hash"), F.lit(slices)) == k).collect()  # about slice_windows rows
        part = _find(index, _prepare(rows, index, width))
        found = part if slices == 1 else found.unionByName(part)
    if slices > 1:
        found = found.groupBy("block", "ordinal").applyInArrow(_join_slices, _FOUND)  # at most a row a slice

    def finish(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n_hit = int(np.unpackbits(np.frombuffer(r["hits"], np.uint8)).sum())
                out.append((r["block"], r["ordinal"], n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), len(r["near"])))
            yield rows_to_arrow(out, _HITS)

    every = _documents(index).join(found.mapInArrow(finish, _HITS), ["block", "ordinal"], "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.select("doc_id", "text_crc32", "text_key", "n_words", count("n_hit"), count("n_items"), F.coalesce("items_sha256", F.lit(_NO_ITEMS)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), count("n_near"))


def _join_slices(rows: pa.Table) -> pa.Table:
    """One row from the rows that a document has, one for each slice."""
    parts = rows.to_pylist()
    one = parts[0]
    hits = [np.frombuffer(p["hits"], np.uint8) for p in parts if p["hits"]]
    one["hits"] = np.bitwise_or.reduce(hits).tobytes() if hits else b""
    for c in ("items", "near"):
        one[c] = sorted({x for p in parts for x in p[c]})
    return pa.Table.from_pylist([one], schema=rows.schema)
