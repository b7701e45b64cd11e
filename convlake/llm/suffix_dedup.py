"""Substring deduplication of bytes by a distributed, common-prefix-aware merge of sorted suffixes.

Suffixes matter only up to the window's width. A window's symbol is its smallest hashed k-gram; ``repeats`` sifts and
folds by it. The windows that are left are sorted within each block and front-coded (each suffix stores what it
shares with the one before, and the rest), dealt into ranges by sampled splitters, and merged: the runs of a range
are unfolded, laid end to end and given to a merge sort that finds sorted runs and gallops over them. ``merge`` is the
same for streams, with a loser tree that keeps each run's common prefix with the last winner.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import blocks as B
from .common import MULT, U64, span_keys, window_hash
from .repeats import Windows, ranges, remove_repeats

WINDOW = 50
GRAM = 32
#: Windows that are drawn for each range of the merge, and for all of them.
SAMPLE, MOST_SAMPLED = 32, 1 << 18
#: Windows that are hashed together: what stays in a core's cache is hashed several times faster.
_HASHED = 1 << 15
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def smallest_grams(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows within a document, and the smallest hashed ``gram`` of each."""
    if len(data) < width:
        return np.empty(0, np.int64), np.empty(0, U64)
    parts = []
    for at in range(0, len(data) - width + 1, _HASHED):
        least = window_hash(data[at : at + _HASHED + width - 1].astype(U64), gram, MULT[0])
        span, reach = width - gram + 1, 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        parts.append(np.minimum(least[: reach - span], least[span - reach :]) if reach < span else least)
    inside = _inside(offsets, width)[: len(data) - width + 1]
    return np.flatnonzero(inside), np.concatenate(parts)[inside]


def _inside(offsets: np.ndarray, width: int) -> np.ndarray:
    """Whether a window that begins at a byte ends within its document."""
    out = np.ones(offsets[-1], bool)
    size = np.minimum(np.diff(offsets), width - 1)
    out[ranges(offsets[1:] - size, size)] = False
    return out


def front_code(sorted_rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix of each row with the one before, and the rests end to end."""
    differs = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), sorted_rows.shape[1])
    common = np.r_[0, common].astype(np.uint8)
    return common, sorted_rows[np.arange(sorted_rows.shape[1]) >= common[:, None]].tobytes()


def unfold(common: np.ndarray, rest: bytes, width: int) -> np.ndarray:
    """The rows of a front-coded run, as ``read_run`` reads them."""
    given = np.arange(width) >= common[:, None]
    rows = np.empty(given.shape, np.uint8)
    rows[given] = np.frombuffer(rest, np.uint8)
    last = np.maximum.accumulate(np.where(given, np.arange(len(common), dtype=np.int32)[:, None], np.int32(0)), axis=0)
    return np.take_along_axis(rows, last, axis=0)


def sorted_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes, and which in it differ from the one before. Sorted runs in them are merged."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows[order]
    words = words.view(U64)
    return order, np.r_[True, (words[1:] != words[:-1]).any(axis=1)][: len(rows)]


def read_run(common: np.ndarray, rest: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the suffix before, suffix) of a front-coded run."""
    last, at = b"", 0
    for c in common.tolist():
        end = at + width - c
        last = last[:c] + rest[at:end]
        at = end
        yield c, last


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int]]:
    """(run, common prefix with the suffix put out before) of all suffixes in sorted order.

    A loser tree. ``lcp[r]`` is what run r's head shares with the last winner on its path. Of two heads the one that
    shares more with that winner is smaller; only if both share the same are they compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    lcp = [0] * k
    losers = [0] * k

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        if y is None:
            return True
        if x is None:
            return False
        p, q = lcp[a], lcp[b]
        if p != q:
            return p > q
        n = len(x)
        while p < n and x[p] == y[p]:
            p += 1
        wins = p == n or x[p] < y[p]
        lcp[b if wins else a] = p
        return wins

    for r, run in enumerate(runs):
        _, heads[r] = next(run, (0, None))

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b

    winner = play(1)
    while heads[winner] is not None:
        yield winner, lcp[winner]
        lcp[winner], heads[winner] = next(runs[winner], (0, None))
        node = (winner + k) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def answer_runs(payloads: list[bytes], width: int) -> list[np.ndarray]:
    """Whether a document with a smaller id holds the same suffix, for each entry of each sorted run."""
    parts = []
    for p in payloads:
        ids, at = B.unpack_ids(p)
        parts.append((ids, unfold(np.frombuffer(p, np.uint8, len(ids), at), p[at + len(ids) :], width)))
    ids = np.concatenate([x[0] for x in parts])
    order, new = sorted_order(np.concatenate([x[1] for x in parts]))
    least = np.empty(len(ids), np.int64)
    least[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return np.split(least < ids, np.cumsum([len(x[0]) for x in parts])[:-1])


class SuffixMerge:
    """Compares single windows by merging front-coded sorted suffixes, dealt into ranges by sampled splitters."""

    def __init__(self, blocks: DataFrame, width: int, buckets: int):
        self.width = width
        self.splitters = _splitters(blocks, width, buckets)

    def distinct(self, block: B.Block, w: Windows, at: np.ndarray, ids: np.ndarray):
        """Distinct suffixes in order, the smallest id of each, and the place of each window among them."""
        view = np.lib.stride_tricks.sliding_window_view(block.data, self.width) if len(block.data) >= self.width else np.empty((0, self.width), np.uint8)
        rows = np.ascontiguousarray(view[at])
        if not len(rows):
            return rows, ids, at
        order, new = sorted_order(rows)
        where = np.empty(len(order), np.int64)
        where[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return rows[order[first]], np.minimum.reduceat(ids[order], first), where

    def send(self, number: int, rows: np.ndarray, least: np.ndarray) -> Iterator[tuple]:
        for b, lo, hi in _ranges_of(rows, self.splitters):
            common, rest = front_code(rows[lo:hi])
            yield b, number, B.pack_ids(least[lo:hi]) + common.tobytes() + rest

    def answer(self, bucket: int, payloads: list[bytes]) -> list[np.ndarray]:
        return answer_runs(payloads, self.width)

    def read(self, rows: np.ndarray, answers: dict, base: int) -> np.ndarray:
        out = np.zeros(len(rows), bool)
        for b, lo, hi in _ranges_of(rows, self.splitters):
            out[lo:hi] = answers[base + b][: hi - lo]
        return out


def deduplicate_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW, gram: int = GRAM, block_bytes: int = B.BLOCK_BYTES, kept: bool = False) -> DataFrame:
    """Remove each UTF-8 byte inside a ``width``-byte string that also starts in a document with a smaller key.

    One row per row of ``docs``: key, bytes, removed bytes, maximal removed spans, SHA-256 of the remaining bytes, and
    with ``kept`` those bytes. Strings are judged on the input and never cross documents. A null text is
    empty; texts of fewer than ``width`` bytes stay whole. Rows with equal keys never remove from each other;
    a null key counts as larger than all others. An empty table gives no rows; other columns are ignored.
    """
    if not 2 <= gram < width < 256:
        raise ValueError("2 <= gram < width < 256 is needed")

    def cut(block, hashes):
        starts, least = smallest_grams(block.data, block.offsets, width, gram)
        return Windows(block.offsets, starts, least, (), None, None, (lambda first, last: span_keys(block.data, first, last - first + width)) if hashes else None)

    def finish(block, k, removed):
        raw = block.text(k)
        doc = None if block.nulls[k] else int(block.ids[k])
        gone = np.zeros(len(raw), bool)
        for lo, hi in removed:
            gone[lo:hi] = True
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes() if removed else raw
        return (doc, len(raw), len(raw) - len(left), int((gone & ~np.r_[False, gone[:-1]]).sum()) if removed else 0, hashlib.sha256(left).hexdigest(), *((left,) * kept))

    return remove_repeats(docs, key, text, width, cut, lambda blocks, buckets: SuffixMerge(blocks, width, buckets), finish, f"{_RESULT}, kept binary" if kept else _RESULT, "bytes", block_bytes)


def _splitters(blocks: DataFrame, width: int, buckets: int) -> list[bytes]:
    """Range borders from a sample of the pieces' windows: SAMPLE for each range, MOST_SAMPLED at most."""
    count, wanted = blocks.count(), min(SAMPLE * buckets, MOST_SAMPLED)
    each = max(1, wanted // max(1, count))

    def draw(block):
        at = np.flatnonzero(_inside(block.offsets, width))
        at = at[np.linspace(0, len(at) - 1, min(each, len(at))).astype(np.int64)] if len(at) else at
        for k in at:
            yield (block.data[k : k + width].tobytes(),)

    some = blocks if count <= wanted else blocks.sample(wanted / count, seed=1)
    drawn = sorted(r[0] for r in B.map_blocks(some, draw, "window binary").collect())
    return sorted({bytes(drawn[i]) for i in np.linspace(0, len(drawn) - 1, buckets + 1).astype(np.int64)[1:-1]}) if drawn else []


def _ranges_of(rows: np.ndarray, splitters: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(range, first row, end) of sorted rows that fall into each range."""
    lo, keys = 0, _BytesView(rows)
    while lo < len(rows):
        b = bisect.bisect_right(splitters, keys[lo])
        hi = bisect.bisect_left(keys, splitters[b], lo) if b < len(splitters) else len(rows)
        yield b, lo, hi
        lo = hi


class _BytesView:
    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> bytes:
        return self.rows[k].tobytes()
