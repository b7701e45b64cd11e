"""Blocks of documents, and questions that the blocks put to the whole corpus.

A block is one row that packs a few MB of whole documents, stored once in the shared folder so that its contents
never change. In ``ask`` every block sends its distinct keys, dealt over buckets; each bucket answers one bit per key
(for example: does another document hold it?); the answers come back to their block. A key is sent once per block,
however often it occurs, so a bucket gets at most as many copies of a key as there are blocks, and the number of
buckets grows with the corpus. A block sends messages only to buckets of its keys: they are never more than its keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, partitions, pieces, scratch, texts_of

BLOCK = "block long, raw long, ids binary, nulls binary, lens binary, origin binary, data binary"
_ASK = "bucket int, block long, payload binary"
_ANSWER = "block long, bucket int, bits binary"
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of text for each bucket of a question.
BUCKET_TEXT = 16 << 20


class Block(NamedTuple):
    number: int
    ids: np.ndarray  # NULL_ID for null
    nulls: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    origin: np.ndarray  # int64, for pieces of documents: what a pass notes about each

    def row(self) -> tuple:
        pack = zstandard.ZstdCompressor(level=1).compress
        return (self.number, len(self.data), self.ids.tobytes(), np.packbits(self.nulls).tobytes(), np.diff(self.offsets).tobytes(), self.origin.tobytes(), pack(self.data.tobytes()))

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def unpack(row: dict) -> Block:
    ids = np.frombuffer(row["ids"], np.int64)
    offsets = np.r_[0, np.cumsum(np.frombuffer(row["lens"], np.int64))]
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, row["raw"])), np.uint8)
    return Block(row["block"], ids, np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(ids)).astype(bool), offsets, data, np.frombuffer(row["origin"], np.int64))


def rows_to_arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def build_blocks(docs: DataFrame, key: str, text: str, name: str, size: int = BLOCK_BYTES) -> DataFrame:
    """Pack all rows of ``docs`` into stored blocks; a null text counts as empty."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        data: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        held = 0

        def flush():
            lens_ = np.concatenate(lens)
            return rows_to_arrow([Block(number, np.concatenate(ids), np.concatenate(nulls), np.r_[0, np.cumsum(lens_)], np.concatenate(data), np.empty(0, np.int64)).row()], BLOCK)

        for batch in pieces(batches, size):
            part, offsets = texts_of(batch.column("text"))
            ids.append(ids_of(batch.column("doc_id")))
            nulls.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
            data.append(part)
            lens.append(np.diff(offsets))
            held += len(part)
            if held >= size:
                yield flush()
                number += 1
                ids, nulls, data, lens, held = [], [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return keep_blocks(rows.mapInArrow(run, BLOCK), name)


def keep_blocks(blocks: DataFrame, name: str) -> DataFrame:
    """Store blocks in the shared folder, bucketed by their number: answers are brought to them, texts are not shuffled again.

    Only tables can be bucketed; this one leaves the catalog once it is resolved, its files stay where the scratch tables are.
    """
    spark = blocks.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    blocks.write.bucketBy(partitions(spark), "block").option("path", scratch(spark, name)).option("compression", "uncompressed").saveAsTable(table)  # the data are compressed already
    kept = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return kept


def bucket_count(blocks: DataFrame, per: int = BUCKET_TEXT) -> int:
    """Buckets in proportion to the text, and at least eight for each core.

    A block sends up to a message for each bucket. Shuffle partitions, which tend to grow with the text, don't raise their number.
    """
    total = blocks.agg(F.sum("raw")).first()[0] or 0
    return max(8 * blocks.sparkSession.sparkContext.defaultParallelism, -(-total // per))


def split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of hashed keys by bucket, else as they are, and (bucket, begin, end) of each bucket with keys."""
    bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.empty(0, np.int64)
    return order, list(zip(bucket[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)]))


def map_blocks(blocks: DataFrame, run: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Apply ``run(block[, more])`` to each row; ``more``: the bits by bucket in column ``answers``, or column ``removed``."""
    read, columns = _reader(blocks)

    def apply(batches):
        for block, more in read(batches):
            out = list(run(block, *more))
            if out:
                yield rows_to_arrow(out, schema)

    return blocks.select(*columns).mapInArrow(apply, schema)


def _reader(blocks: DataFrame) -> tuple[Callable, list[str]]:
    """What reads (block, more) from batches of the given columns."""
    extra = [c for c in ("answers", "removed") if c in blocks.columns]

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                yield unpack(row), [{a["bucket"]: np.unpackbits(np.frombuffer(a["bits"], np.uint8)).astype(bool) for a in row[c] or []} if c == "answers" else row[c] for c in extra]

    return read, [f.split()[0] for f in BLOCK.split(", ")] + extra


def pack_blocks(blocks: DataFrame, run: Callable[..., Block | None], size: int) -> DataFrame:
    """The blocks that ``run(block[, more])`` gives, put together within tasks as long as they hold ``size`` bytes at most.

    Each has the number of its first one; ``origin`` has to tell them apart.
    """
    read, columns = _reader(blocks)

    def apply(batches):
        held: list[Block] = []

        def told():
            ids, nulls, lens, data, origin = (np.concatenate(x) for x in zip(*((b.ids, b.nulls, np.diff(b.offsets), b.data, b.origin) for b in held)))
            return rows_to_arrow([Block(held[0].number, ids, nulls, np.r_[0, np.cumsum(lens)], data, origin).row()], BLOCK)

        for block, more in read(batches):
            part = run(block, *more)
            if part is None:
                continue
            if held and sum(len(b.data) for b in held) + len(part.data) > size:
                yield told()
                held.clear()
            held.append(part)
        if held:
            yield told()

    return blocks.select(*columns).mapInArrow(apply, BLOCK)


def ask(asked: DataFrame, answer: Callable[[int, list[bytes]], list[np.ndarray]]) -> DataFrame:
    """Answer each bucket's payloads: ``answer(bucket, payloads)`` gives the bits for each of them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        bucket = table.column("bucket")[0].as_py()
        bits = answer(bucket, table.column("payload").to_pylist())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, _ANSWER)


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    got = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    return blocks.join(got, "block", "left")


def gather(order: np.ndarray, parts: list[tuple[int, int, int]], answers: dict[int, np.ndarray], first: int = 0) -> np.ndarray:
    """Bits in the keys' own order, from the answers to the buckets that ``split`` made of them."""
    out = np.zeros(len(order), bool)
    for b, lo, hi in parts:
        out[order[lo:hi]] = answers[first + b][: hi - lo]
    return out


def group_min(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys then id, first row of each distinct key in it, and each ordered row's group."""
    order = np.argsort(keys[0])
    tied = np.r_[False, keys[0][order[1:]] == keys[0][order[:-1]]][: len(order)]
    tied[:-1] |= tied[1:]  # what agrees in the first key is put in order
    some = order[tied]
    order[tied] = some[np.lexsort((ids[some], *(k[some] for k in reversed(keys))))]
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def shared_in(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, each row's place among them, and whether a value has two owners; owners ascend."""
    distinct, place = np.unique(values, return_inverse=True)
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    high = np.full(len(distinct), -1)
    np.minimum.at(low, place, owner)
    np.maximum.at(high, place, owner)
    return distinct, place, low != high


#: Bytes of a symbol that are sent: its bucket stands for the leading ones, and a false match only costs a comparison.
_SENT = 5


def ask_shared(number: int, values: np.ndarray, several: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Questions of a block for ``answer_shared``."""
    order, parts = split(values, buckets)
    sent = values[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SENT]
    flags = several[order]
    for b, lo, hi in parts:
        yield b, number, sent[lo:hi].tobytes() + np.packbits(flags[lo:hi]).tobytes()


def answer_shared(bucket: int, payloads: list[bytes]) -> list[np.ndarray]:
    """Whether two documents hold a value: in different blocks, or in the one that says so."""
    bits = 8 * _SENT + 1  # the value and a flag each
    sizes = [len(p) * 8 // bits for p in payloads]
    every = np.zeros((sum(sizes), 8), np.uint8)
    every[:, :_SENT] = np.frombuffer(b"".join(p[: _SENT * n] for p, n in zip(payloads, sizes)), np.uint8).reshape(-1, _SENT)
    flags = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, offset=_SENT * n), count=n) for p, n in zip(payloads, sizes)]).astype(bool)
    _, place, count = np.unique(every.view("<u8").ravel(), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[place[flags]] = True
    return np.split(shared[place], np.cumsum(sizes)[:-1])


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as places in the list of distinct ones, which are few beside the rows of a block."""
    known, place = np.unique(ids, return_inverse=True)
    kind = np.uint16 if len(known) <= 1 << 16 else np.uint32
    return np.array([len(ids), len(known), np.dtype(kind).itemsize], np.int64).tobytes() + known.tobytes() + place.astype(kind).tobytes()


def unpack_ids(raw: bytes) -> tuple[np.ndarray, int]:
    """Ids, and the bytes that they took."""
    n, k, size = np.frombuffer(raw, np.int64, 3).tolist()
    place = np.frombuffer(raw, np.uint16 if size == 2 else np.uint32, n, 24 + 8 * k)
    return np.frombuffer(raw, np.int64, k, 24)[place], 24 + 8 * k + size * n


def ask_smaller(number: int, first: np.ndarray, second: np.ndarray, ids: np.ndarray, buckets: int, base: int = 0) -> Iterator[tuple]:
    """Questions for ``answer_smaller`` about distinct 128-bit keys and their smallest ids in the block."""
    order, parts = split(first, buckets)
    for b, lo, hi in parts:
        part = order[lo:hi]
        yield base + b, number, pack_ids(ids[part]) + first[part].tobytes() + second[part].tobytes()


def read_keys(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """First halves, second halves and ids of the keys in all payloads, and where each ends but the last."""
    parts = []
    for p in payloads:
        ids, at = unpack_ids(p)
        parts.append((*np.frombuffer(p[at:], np.uint64).reshape(2, -1), ids))
    one, two, ids = (np.concatenate(x) for x in zip(*parts))
    return one, two, ids, np.cumsum([len(x[2]) for x in parts])[:-1]


def answer_smaller(bucket: int, payloads: list[bytes]) -> list[np.ndarray]:
    """Whether a document with a smaller id than the given one holds the key."""
    one, two, ids, ends = read_keys(payloads)
    order, first, group = group_min([one, two], ids)
    least = np.empty(len(ids), np.int64)
    least[order] = ids[order][first][group]
    return np.split(least < ids, ends)


def spans(covered: np.ndarray, width: int, size: int) -> np.ndarray:
    """Positions inside a window of ``width`` that begins where ``covered`` says."""
    at = np.flatnonzero(covered)
    if not len(at):
        return np.zeros(size, bool)
    change = np.bincount(at, minlength=size + 1) - np.bincount(np.minimum(at + width, size), minlength=size + 1)
    return np.cumsum(change[:size]) > 0
