"""Removal of windows that also start in a document with a smaller key: the passes that words and bytes share.

1. Every window is given a symbol that its content alone decides. Windows whose symbol occurs in one document only
   cannot repeat; documents without others are done.
2. Neighbouring windows with one symbol form a stretch. Equal stretches (128-bit keys) hold equal windows, so the
   smallest id stands for all of them: copies are folded before single windows are compared.
3. Where stretches of one symbol differ, the windows of those that stand for themselves are compared one by one.

Each pass is a question of ``blocks``: what is sent grows with the text, a hot passage is sent once per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import segment_hash, store


class Windows(NamedTuple):
    """Texts laid end to end and cut into units (bytes or words)."""

    bounds: np.ndarray  # first unit of each text, and the end
    starts: np.ndarray  # of all windows inside a text
    symbol: np.ndarray  # of each of them
    hashes: tuple  # two arrays by first unit, or () where not asked for
    at: np.ndarray | None  # bytes that the units begin and end at; None: a unit is a byte
    end: np.ndarray | None
    keys: Callable | None = None  # both halves of a stretch's key from its first and last window's start, else from ``hashes``


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    if not len(size):
        return np.empty(0, np.int64)
    return np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def stretches(w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window of each stretch, its symbol, its text."""
    if not len(w.starts):
        return np.empty(0, np.int64), w.symbol, np.empty(0, np.int64)
    new = np.r_[True, (w.symbol[1:] != w.symbol[:-1]) | (w.starts[1:] != w.starts[:-1] + 1)]
    first = np.flatnonzero(new)
    return first, w.symbol[first], np.searchsorted(w.bounds, w.starts[first], side="right") - 1


class Classes(NamedTuple):
    starts: np.ndarray  # of all windows
    begin: np.ndarray  # first window of each stretch
    size: np.ndarray
    symbol: np.ndarray
    ids: np.ndarray
    one: np.ndarray  # the stretch's 128-bit key
    two: np.ndarray
    order: np.ndarray  # stretches by key, then id
    head: np.ndarray  # of each distinct stretch, the one with the smallest id
    group: np.ndarray  # distinct stretch of each in ``order``


def classes(block: B.Block, w: Windows) -> Classes:
    begin, symbol, owner = stretches(w)
    if w.keys:
        one, two = w.keys(w.starts[begin], w.starts[np.r_[begin[1:], len(w.starts)][: len(begin)] - 1])
    else:
        one, two = (segment_hash(h[w.starts], begin, half) for half, h in enumerate(w.hashes))
    ids = block.ids[owner]
    order, head, group = B.group_min([one, two], ids)
    return Classes(w.starts, begin, np.diff(np.r_[begin, len(w.starts)]), symbol, ids, one, two, order, order[head], group)


def cut_out(block: B.Block, w: Windows, found: np.ndarray, width: int) -> B.Block | None:
    """The pieces of a block whose windows are ``found``; ``origin`` holds each one's block, document and first unit there."""
    at = np.flatnonzero(found)
    if not len(at):
        return None
    new = np.r_[True, (np.diff(at) > 1) | (np.diff(w.starts[at]) > 1)]
    first, last = w.starts[at[new]], w.starts[at[np.r_[new[1:], True]]] + width - 1
    doc = np.searchsorted(w.bounds, first, side="right") - 1
    lo, hi = (first, last + 1) if w.at is None else (w.at[first], w.end[last])
    return B.Block(block.number, block.ids[doc], block.nulls[doc], np.r_[0, np.cumsum(hi - lo)], block.data[ranges(lo, hi - lo)], np.c_[np.full(len(doc), block.number), doc, first - w.bounds[doc]].astype(np.int64).ravel())


def one_each(symbol: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct symbols, the key of a stretch of each, and 1 if the block holds stretches that differ, else 0."""
    if not len(symbol):
        return symbol, one, np.empty(0, np.int64)
    order = np.argsort(symbol)
    s, a, b = symbol[order], one[order], two[order]
    new = np.r_[True, s[1:] != s[:-1]]
    first = np.flatnonzero(new)
    other = np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] & ~new
    return s[first], a[first], np.logical_or.reduceat(other, first).astype(np.int64)


def answer_several(payloads: list[bytes]) -> list[np.ndarray]:
    """Whether a symbol has stretches that differ."""
    symbol, stretch, flag, ends = B.read_keys(payloads)
    order = np.argsort(symbol)
    s, t = symbol[order], stretch[order]
    new = np.r_[True, s[1:] != s[:-1]]
    other = np.r_[False, t[1:] != t[:-1]] & ~new | (flag[order] > 0)
    several = np.logical_or.reduceat(other, np.flatnonzero(new))
    out = np.empty(len(s), bool)
    out[order] = several[np.cumsum(new) - 1]
    return np.split(out, ends)


class ByKey:
    """Compares single windows by their 128-bit keys."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def distinct(self, block: B.Block, w: Windows, at: np.ndarray, ids: np.ndarray):
        one, two = (h[at] for h in w.hashes)
        order, first, group = B.group_min([one, two], ids)
        where = np.empty(len(at), np.int64)
        where[order] = group
        head = order[first]
        return (one[head], two[head]), ids[head], where

    def send(self, number: int, entries, least: np.ndarray) -> Iterator[tuple]:
        return B.ask_smaller(number, *entries, least, self.buckets)

    def answer(self, bucket: int, payloads: list[bytes]) -> list[np.ndarray]:
        return B.answer_smaller(bucket, payloads)

    def read(self, entries, answers: dict, base: int) -> np.ndarray:
        return B.gather(*B.split(entries[0], self.buckets), answers, base)


def remove_repeats(docs: DataFrame, key: str, text: str, width: int, cut, compare, finish, result: str, name: str, block_bytes: int) -> DataFrame:
    """Rows ``result`` of all documents.

    ``cut(block, hashes)`` gives its Windows, ``compare(blocks, buckets)`` the way single windows are compared,
    ``finish(block, k, removed)`` the row of document k; ``removed`` lists ranges of units, which may overlap.
    """
    base = B.build_blocks(docs, key, text, name, block_bytes)
    buckets = B.bucket_count(base)

    def ask_symbols(block):
        _, symbol, owner = stretches(cut(block, False))
        distinct, _, several = B.shared_in(symbol, owner)
        yield from B.ask_shared(block.number, distinct, several, buckets)

    shared = B.ask(B.map_blocks(base, ask_symbols, B._ASK), B.answer_shared)

    def sift(block, answers):
        w = cut(block, False)
        first, symbol, _ = stretches(w)
        distinct, place = np.unique(symbol, return_inverse=True)
        found = B.gather(*B.split(distinct, buckets), answers)[place]
        return cut_out(block, w, np.repeat(found, np.diff(np.r_[first, len(w.starts)])), width)

    pieces = B.keep_blocks(B.pack_blocks(B.with_answers(base, shared), sift, block_bytes), f"{name}_pieces")

    def fold(block):
        c = classes(block, cut(block, True))
        yield from B.ask_smaller(block.number, c.one[c.head], c.two[c.head], c.ids[c.head], buckets)
        yield from B.ask_smaller(block.number, *one_each(c.symbol, c.one, c.two), buckets, buckets)

    def answer_fold(bucket, payloads):
        return B.answer_smaller(bucket, payloads) if bucket < buckets else answer_several(payloads)

    folded = store(B.ask(B.map_blocks(pieces, fold, B._ASK), answer_fold), f"{name}-folded")
    compared = compare(pieces, buckets)

    def standing(block, answers):
        """Whether a smaller document holds each distinct stretch; those whose windows are compared, and these."""
        w = cut(block, True)
        c = classes(block, w)
        beaten = B.gather(*B.split(c.one[c.head], buckets), answers)
        symbols = one_each(c.symbol, c.one, c.two)[0]
        several = B.gather(*B.split(symbols, buckets), answers, buckets)
        single = c.head[~beaten & several[np.searchsorted(symbols, c.symbol[c.head])]] if len(c.head) else c.head
        owner = np.repeat(c.ids[single], c.size[single])
        return c, beaten, single, owner, compared.distinct(block, w, c.starts[ranges(c.begin[single], c.size[single])], owner), w

    def ask_windows(block, answers):
        *_, (entries, least, _), _ = standing(block, answers)
        yield from compared.send(block.number, entries, least)

    single_answers = B.ask(B.map_blocks(B.with_answers(pieces, folded), ask_windows, B._ASK), compared.answer)
    offset = 2 * buckets

    def resolve(block, answers):
        """Units to remove, as ranges: document, first unit, end."""
        c, beaten, single, owner, (entries, least, where), w = standing(block, answers)
        hit = compared.read(entries, answers, offset)[where] | (owner > least[where])
        covered = np.zeros(w.bounds[-1], bool)
        whole = np.zeros(len(c.ids), bool)
        whole[c.order] = beaten[c.group] | (c.ids[c.order] > c.ids[c.head][c.group])
        covered[c.starts[np.repeat(whole, c.size)]] = True
        # What holds for a compared stretch holds for the block's other rows with its key and id.
        at = np.full(len(c.ids), -1)
        at[single] = np.r_[0, np.cumsum(c.size[single])[:-1]].astype(np.int64)[: len(single)]
        head_of = np.empty(len(c.ids), np.int64)
        head_of[c.order] = c.head[c.group]
        like = np.flatnonzero(~whole & (at[head_of] >= 0)) if len(c.ids) else np.empty(0, np.int64)
        covered[c.starts[ranges(c.begin[like], c.size[like])]] |= hit[ranges(at[head_of[like]], c.size[like])]
        edge = np.diff(np.r_[False, B.spans(covered, width, len(covered)), False].astype(np.int8))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # A removed run may go on over the border of two pieces.
        piece = np.searchsorted(w.bounds, lo, side="right") - 1
        over = np.searchsorted(w.bounds, hi - 1, side="right") - 1 - piece
        n = ranges(piece, over + 1)
        lo, hi = np.maximum(np.repeat(lo, over + 1), w.bounds[n]), np.minimum(np.repeat(hi, over + 1), w.bounds[n + 1])
        number, doc, first = block.origin.reshape(-1, 3)[n].T
        for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(number)) + 1) if len(n) else ():
            yield int(number[part[0]]), np.r_[doc, lo - w.bounds[n] + first, hi - w.bounds[n] + first].reshape(3, -1)[:, part].astype(np.int64).tobytes()

    answers = folded.unionByName(single_answers.withColumn("bucket", F.col("bucket") + offset))
    removed = B.map_blocks(B.with_answers(pieces, answers), resolve, "block long, removed binary")
    return B.map_blocks(base.join(removed, "block", "left"), lambda block, ranges_: _finish_all(block, ranges_, finish), result)


def _finish_all(block: B.Block, removed: bytes | None, finish) -> Iterator[tuple]:
    doc, lo, hi = np.frombuffer(removed or b"", np.int64).reshape(3, -1)
    order = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[order], np.arange(len(block.ids) + 1))
    for k in range(len(block.ids)):
        own = order[bounds[k] : bounds[k + 1]]
        yield finish(block, k, list(zip(lo[own].tolist(), hi[own].tolist())))
