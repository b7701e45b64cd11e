"""Shared helpers: vectorised hashing of text inside tasks."""

from __future__ import annotations

import numpy as np

from ..storage import partitions, scratch, store, table  # noqa: F401

U64 = np.uint64
#: Odd multipliers of the two halves of a 128-bit key.
MULT = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
#: Stands for a null id: larger than every id.
NULL_ID = np.iinfo(np.int64).max


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser; spreads the low-entropy bits of a polynomial hash."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def window_hash(values: np.ndarray, width: int, mult: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive values, by doubling; for choosing candidates, not for deciding."""
    if len(values) < width:
        return np.empty(0, U64)
    part, size, done, at = values, 1, None, 0
    while True:
        if width & size:
            done = part[: len(values) - width + 1] if done is None else done * U64(pow(int(mult), size, 1 << 64)) + part[at : at + len(values) - width + 1]
            at += size
        if size * 2 > width:
            return mix(done)
        part = part[:-size] * U64(pow(int(mult), size, 1 << 64)) + part[size:]
        size *= 2


def _pair(a: np.ndarray, b: np.ndarray, mult: np.uint64) -> np.ndarray:
    """A hash of two hashes. It is not linear in them, so no sum over several levels cancels out."""
    h = a * mult
    h ^= h >> U64(32)
    h += b * U64(0xA24BAED4963EE407)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def window_key(values: np.ndarray, width: int, mult: np.uint64) -> np.ndarray:
    """One half of a 128-bit key of every ``width`` consecutive values: a tree of hashed pairs, by doubling.

    Up to eight values of type uint8 are not hashed, but packed into one number.
    """
    if len(values) < width:
        return np.empty(0, U64)
    pack = 8 if values.dtype == np.uint8 else 1
    part, size, done, at = values.astype(U64, copy=False), 1, None, 0
    n = len(values) - width + 1
    while True:
        if width & size:
            done = part[:n] if done is None else _pair(done, part[at : at + n], mult)
            at += size
        if size * 2 > width:
            return mix(done ^ mult)
        part = part[:-size] << U64(8 * size) | part[size:] if 2 * size <= pack else _pair(part[:-size], part[size:], mult)
        size *= 2


#: Bytes of a span that are hashed word by word; longer ones are summed.
_CHAINED = 512


def span_keys(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit key of the bytes ``data[first : first + size]``, for each span."""
    out = tuple(size.astype(U64) * m for m in MULT)
    if not len(first):
        return out
    words = np.ndarray(len(data) + 1, "<u8", buffer=np.r_[data, np.zeros(8, np.uint8)].tobytes(), strides=(1,))  # eight bytes from each place on
    live = np.flatnonzero(size <= _CHAINED)
    for at in range(0, _CHAINED, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        n = size[live]
        word = words[first[live] + np.clip(n - 8, 0, at)]  # the last word ends with the span
        if at == 0 and n.min() < 8:
            word &= ~(~U64(0) << (8 * np.minimum(n, 7)).astype(U64)) | np.where(n < 8, U64(0), ~U64(0))
        for h, m in zip(out, MULT):
            h[live] = _pair(h[live], word, m)
    out = tuple(mix(h ^ m) for h, m in zip(out, MULT))
    if len(long := np.flatnonzero(size > _CHAINED)):
        n = size[long]
        start = np.r_[0, np.cumsum(n)[:-1]]
        text = data[np.arange(n.sum()) + np.repeat(first[long] - start, n)]
        for half, h in enumerate(out):
            h[long] = segment_hash(text, start, half)
    return out


#: Places in a segment whose terms are looked up.
_LISTED = 64


def _terms(values: np.ndarray, at: np.ndarray, mult: np.uint64) -> np.ndarray:
    """A random number for each (value, place)."""
    return mix(mix(values + mult) + at.astype(U64) * U64(0xD1B54A32D192ED03))


_BYTE_TERMS = [_terms(np.tile(np.arange(256, dtype=U64), _LISTED), np.repeat(np.arange(_LISTED), 256), m) for m in MULT]


def segment_hash(values: np.ndarray, starts: np.ndarray, half: int) -> np.ndarray:
    """One half of a 128-bit key of the segments of ``values`` that begin at ``starts``; the last ends with it.

    It sums a random number for each value and place. Values of type uint8 are looked up.
    """
    if not len(starts):
        return np.empty(0, U64)
    size = np.diff(np.r_[starts, len(values)])
    at = np.arange(len(values)) - np.repeat(starts, size)
    if values.dtype == np.uint8:
        if size.max() <= _LISTED:
            terms = _BYTE_TERMS[half][(at << 8) + values]
        else:
            terms = _terms(values.astype(U64), at, MULT[half])
    else:
        terms = _terms(values, at, MULT[half])
    return mix(np.add.reduceat(terms, starts) + size.astype(U64))


class Words:
    """Words of several byte strings laid end to end: hashes, owners and byte spans."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, seeds: int = 1):
        word = is_word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a word never crosses from one text into the next
        before = np.r_[False, word[:-1]] if len(data) else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.r_[word[1:], False] if len(data) else word
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # first word of each text, and the end
        self.owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        size = self.end - self.start
        self.hash = []
        if len(size):
            kept = data[word]
            first = np.r_[0, np.cumsum(size)[:-1]]
            self.hash = [segment_hash(kept, first, half) for half in range(seeds)]
        else:
            self.hash = [np.empty(0, U64) for _ in range(seeds)]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Membership of each byte value outside of the given inclusive ranges."""
    out = np.ones(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = False
    return out


#: Everything but ASCII blanks.
NON_BLANK = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case letters and all bytes above ASCII, after lower-casing A-Z.
ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_key(text):
    """The first 128 bits of the SHA-256 of a Column's text, in hexadecimal; a null text counts as empty."""
    from pyspark.sql import functions as F

    return F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256), 1, 32)


def ids_of(column) -> np.ndarray:
    """int64 ids of an Arrow column, null as NULL_ID."""
    return column.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, null as empty."""
    import pyarrow as pa

    array = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches, limit: int):
    """Arrow batches cut so that each holds about ``limit`` bytes of its column ``text`` at most."""
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(size)] if len(size) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
