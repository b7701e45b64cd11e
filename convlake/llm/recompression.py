"""Substring deduplication of word sequences by recompression.

Rounds of naming shorten every document at once: a run of one symbol gets a name made of the symbol and its length,
then a pair gets a name if its first symbol falls into the left and its second into the right half of the names of
that round. Names are hashes of what they replace, so all tasks give equal strings equal names without a table of
names. Away from the ends of two equal windows the names agree; how far the ends reach follows from the window
alone. The highest named symbol that surely lies inside a window stands for it: Spark finds the symbols that several
documents share, and only windows with such a symbol are verified in full.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame

from . import blocks as B
from .common import MULT, NON_BLANK, U64, Words, mix, window_key
from .repeats import ByKey, Windows, remove_repeats

WINDOW = 50
ROUNDS = 16
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def window_symbols(names: np.ndarray, bounds: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` words within a document, and the symbol that stands for each.

    ``names`` are the words' names, ``bounds`` the first word of each document and the end. ``lo`` and ``hi``
    enclose what of a window is named alike in every document that holds it: a round takes away the first
    and last run, as both may go on outside, then a first symbol that may be the end of a pair and a last one
    that may begin one.
    """
    n = len(names)
    count = np.maximum(np.diff(bounds) - width + 1, 0)
    starts = np.repeat(bounds[:-1] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    symbol = names[starts]
    lo = starts.astype(np.int32)
    hi = lo + np.int32(width)
    live = np.arange(len(lo), dtype=np.int32)  # windows that still hold a symbol
    first_of_doc = np.zeros(n + 1, bool)
    first_of_doc[bounds] = True
    start = np.arange(n, dtype=np.int32)  # first word of each symbol

    def by_word(begin: np.ndarray) -> np.ndarray:
        """The symbol that each word lies in."""
        flag = np.zeros(n, np.int32)
        flag[begin] = 1
        return np.cumsum(flag, dtype=np.int32) - np.int32(1)

    for r in range(rounds):
        if not len(live):
            break
        salt = U64((r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        # Runs.
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | first_of_doc[start[1:]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(names)])
        names, start = names[first], start[first]
        for_run = size > 1
        if for_run.any():
            names = names.copy()
            names[for_run] = mix(names[for_run] * MULT[0] + size[for_run].astype(U64) + salt)
        end = np.r_[start[1:], np.int32(n)]
        at = by_word(start)
        lo = end[at[lo]]
        hi = start[at[hi - 1]]
        keep = lo < hi
        lo, hi, live = lo[keep], hi[keep], live[keep]
        # Pairs.
        left = (mix(names ^ salt) & U64(1)).astype(bool)
        a = at[lo]
        lo = np.where(left[a], lo, end[a])
        b = at[hi - 1]
        hi = np.where(left[b], start[b], hi)
        keep = lo < hi
        lo, hi, live = lo[keep], hi[keep], live[keep]
        joined = np.zeros(len(names), bool)
        joined[1:] = left[:-1] & ~left[1:] & ~first_of_doc[start[1:]]
        k = np.flatnonzero(joined) - 1
        named = names.copy()
        named[k] = mix(mix(names[k] + salt) * MULT[1] + names[k + 1])
        symbol[live] = named[at[lo]]  # the symbol at ``lo`` begins there, so it is the first of its pair
        names, start = named[~joined], start[~joined]
    return starts, symbol


def _finish(block: B.Block, k: int, removed: list[tuple[int, int]]) -> tuple:
    words = block.text(k).split()  # bytes.split takes the same blanks
    keep = bytearray(b"\1" * len(words))
    for lo, hi in removed:
        keep[lo:hi] = bytes(hi - lo)
    kept = list(compress(words, keep)) if removed else words
    joined = b" ".join(kept)
    return None if block.nulls[k] else int(block.ids[k]), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace")


def deduplicate_words(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW, block_bytes: int = B.BLOCK_BYTES, kept: bool = False) -> DataFrame:
    """Remove each word inside a window of ``width`` words that also starts in a document with a smaller key.

    One row per row of ``docs``: key, words, removed words, SHA-256 of the kept words joined by single blanks, and
    with ``kept`` those words themselves. Windows are judged on the input. A null text is empty; documents of fewer
    than ``width`` words stay whole. Rows with equal keys never remove from each other; a null key counts as
    larger than all others. An empty table gives no rows; other columns are ignored.
    """

    def cut(block, hashes):
        words = Words(block.data, block.offsets, NON_BLANK, 2 if hashes else 1)
        starts, symbol = window_symbols(words.hash[0], words.bounds, width)
        return Windows(words.bounds, starts, symbol, tuple(window_key(h, width, m) for h, m in zip(words.hash, MULT)) if hashes else (), words.start, words.end)

    def finish(block, k, removed):
        row = _finish(block, k, removed)
        return row if kept else row[:4]

    return remove_repeats(docs, key, text, width, cut, lambda _, buckets: ByKey(buckets), finish, f"{_RESULT}, kept string" if kept else _RESULT, "words", block_bytes)
