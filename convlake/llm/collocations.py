"""Phrase collocations from depth-truncated suffix trees that are built in independent groups of word prefixes.

Words are counted first. Suffixes of up to five words are then dealt into groups by a prefix: the shortest one that
holds a word which is not heavy, so no prefix has more suffixes than a group's budget allows, however common its first
word is. The groups of a heavy word lie side by side, as many as its count asks for. A block of text sends each group one message with its distinct suffixes and their numbers. A group sorts its
suffixes, which lays out its subtree, and reads every node's count from the totals of the leaves below it. Nodes above
the prefixes have parts in a few groups, which Spark sums. What a task has to know of the corpus are bit maps
of fixed size, one for words that are frequent enough and one for each level of heavy ones; a wrong bit costs time, never a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, MULT, U64, byte_set, mix, pieces, segment_hash, store, texts_of

LEAST, LONGEST, FIRST, SCALE = 100, 5, 2000, 1000
#: Suffixes that a group may have; groups are half full on average. A word in more than an eighth of them is heavy;
#: each further level is that of words SPREAD times as common, which have SPREAD times as many groups.
BUDGET, SPREAD = 1 << 22, 4
#: Bits of each map of words.
BITS = 1 << 25
#: Bytes of text that are looked at together.
BLOCK = 8 << 20
#: Everything but blanks and what ends a piece; what ends a piece.
_ENDS = ~byte_set((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
_WORD = byte_set((0x20, 0x20), (0x09, 0x09)) & ~_ENDS
_ZSTD = pa.Codec("zstd", 6)
_MESSAGE = "group int, lang string, width int, words binary, suffixes binary"


class Block:
    """Words of some texts: ``code`` in ``words``, number of their language, and whether the next one follows in the same piece."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        langs = table.column("lang").fill_null("und").combine_chunks().dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        raw, offsets = texts_of(table.column("text"))
        data = LOWER[raw]
        del raw
        word = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(word & (~np.r_[False, word[:-1]] | edge[:-1])) if len(data) else np.empty(0, np.int64)
        end = np.flatnonzero(word & (~np.r_[word[1:], False] | edge[1:])) + 1 if len(data) else np.empty(0, np.int64)
        piece = np.searchsorted(np.flatnonzero(_ENDS[data]), start)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
        self.lang = langs.indices.to_numpy()[owner]
        self.joined = np.r_[(piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1]), False] if len(start) else np.empty(0, bool)
        spans = np.r_[0, np.cumsum(end - start)].astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(spans.tobytes()), pa.py_buffer(data[word].tobytes())]).dictionary_encode()
        self.words = coded.dictionary
        self.code = coded.indices.to_numpy()

    def hashes(self) -> np.ndarray:
        """A hash of each of ``words``."""
        return _hashes(self.words)


def _hashes(words: pa.Array) -> np.ndarray:
    data, offsets = texts_of(words)
    return segment_hash(data, offsets[:-1], 0)


def _places(lang: str, hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each word of a language, of so many."""
    tag = segment_hash(np.frombuffer(lang.encode() or b"\0", np.uint8), np.zeros(1, np.int64), 1)
    return (mix(hashes ^ tag) % U64(bits)).astype(np.int64)


def _blocks(batches):
    """Blocks of about BLOCK bytes of text; a longer text is a block of its own."""
    held, size = [], 0
    for batch in pieces(batches, BLOCK):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= BLOCK:
            yield Block(held)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield Block(held)


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, a): occurrences of each word; every block has summed its own."""

    def run(batches):
        for block in _blocks(batches):
            size = max(1, len(block.words))
            key, n = np.unique(block.lang.astype(np.int64) * size + block.code, return_counts=True)
            words, langs = block.words.take(pa.array(key % size)).cast(pa.large_string()), pa.array(block.langs, pa.string()).take(pa.array(key // size))
            for k in range(0, len(key), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([langs[part], words[part].cast(pa.string()), pa.array(n[part])], names=["lang", "word", "a"])

    return rows.mapInArrow(run, "lang string, word string, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))


def _bit_map(words: DataFrame, size: int) -> np.ndarray:
    """``size`` bits, set for ``words``: at most ``size`` / 64 rows reach the driver."""

    def run(batches):
        for batch in batches:
            lang, bits = batch.column("lang").dictionary_encode(), np.empty(batch.num_rows, np.int64)
            hashes, which = _hashes(batch.column("word")), lang.indices.to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                bits[which == k] = _places(name, hashes[which == k], size)
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((U64(1) << (bits & 63).astype(U64)).view(np.int64))], names=["slot", "bits"])

    found = words.select("lang", "word").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, U64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(U64)
    return out


def _in(bit_map: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bit_map[bits >> 6] >> (bits & 63).astype(U64) & U64(1)).astype(bool)


def _sorted(codes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of ``codes`` (all below ``top``), and at which column each row first differs from the one before."""
    bits = max(1, int(top).bit_length())
    each = max(1, 63 // bits)
    keys = []
    for k in range(0, codes.shape[1], each):
        key = np.zeros(len(codes), np.int64)
        for c in range(k, min(k + each, codes.shape[1])):
            key <<= bits
            key |= codes[:, c]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    first = np.full(len(codes), codes.shape[1], np.int8)
    for c in range(codes.shape[1] - 1, -1, -1):
        column = codes[order, c]
        first[1:][column[1:] != column[:-1]] = c
    first[:1] = 0
    return order, first


def _levels(heavy: list[np.ndarray], bits: np.ndarray) -> np.ndarray:
    """How heavy words are: 0 for those that are not."""
    return np.add.reduce([_in(m, bits) for m in heavy], dtype=np.int8) if heavy else np.zeros(len(bits), np.int8)


def _suffixes(block: Block, common: np.ndarray, heavy: list[np.ndarray], groups: int, longest: int):
    """Messages of one block: for each language and group its distinct suffixes of two words or more."""
    hashes = block.hashes()
    size = max(1, len(block.words))
    bits = np.zeros(len(block.code), np.int64)
    for k, name in enumerate(block.langs):
        own = block.lang == k
        bits[own] = _places(name, hashes, 64 * len(common))[block.code[own]]
    kept, level = _in(common, bits), _levels(heavy, bits)
    link = block.joined & kept & np.r_[kept[1:], False] if len(kept) else block.joined
    length = np.ones(len(kept), np.int8)
    run = link.copy()
    for step in range(1, longest):
        length += run
        run &= np.r_[link[step:], np.zeros(min(step, len(link)), bool)]
    at = np.flatnonzero(link)
    length = length[at]
    codes = np.zeros((len(at), longest), np.int32)
    path = mix(hashes[block.code[at]])
    group, open_ = (path % U64(groups)).astype(np.int64), level[at].astype(np.int64)
    for j in range(longest):
        there = length > j
        codes[there, j] = block.code[at[there] + j] + 1
        if j:
            longer = np.flatnonzero(there & (open_ > 0))
            path[longer] = mix(path[longer] * MULT[1] + hashes[block.code[at[longer] + j]])
            group[longer] += (path[longer] % np.minimum(groups, SPREAD ** open_[longer]).astype(U64)).astype(np.int64)
            open_[longer] = np.minimum(open_[longer], level[at[longer] + j])
    group %= groups
    for k, name in enumerate(block.langs):
        mine = np.flatnonzero(block.lang[at] == k)
        if not len(mine):
            continue
        order, first = _sorted(codes[mine], size)
        new = np.flatnonzero(first < longest)
        chosen = mine[order[new]]
        times = np.diff(np.r_[new, len(order)])
        by = np.argsort(group[chosen], kind="stable")
        edges = np.r_[np.flatnonzero(np.diff(group[chosen][by], prepend=-1)), len(by)]
        for x, y in zip(edges[:-1], edges[1:]):
            rows = by[x:y]
            used, number = np.unique(codes[chosen[rows]], return_inverse=True)
            number = number.reshape(len(rows), longest) + (used[0] != 0)  # 0: no word
            kind = np.uint16 if len(used) < (1 << 16) - 1 else np.uint32
            used = used[used > 0] - 1
            body = number.T.astype(kind).tobytes() + times[rows].astype(np.uint32).tobytes()
            words = b" ".join(block.words.take(pa.array(used)).to_pylist())
            yield int(group[chosen[rows[0]]]), name, np.dtype(kind).itemsize, _ZSTD.compress(words, asbytes=True), len(words), _ZSTD.compress(body, asbytes=True), len(body)


def _packed(raw: bytes, size: int) -> bytes:
    return size.to_bytes(8, "little") + raw


def _unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def _subtree(messages: list[dict], heavy: list[np.ndarray], bits: int, longest: int, least: int, lang: str):
    """(phrase, count) of the nodes of one language's part of a group: those of at least ``least``, and parts of nodes that other groups share."""
    dictionary = [_unpacked(m["words"]).split(b" ") for m in messages]
    coded = pa.array([w for part in dictionary for w in part], pa.large_binary()).dictionary_encode()
    words, where = coded.dictionary, coded.indices.to_numpy() + np.int32(1)
    codes, counts, at = [], [], 0
    for m, part in zip(messages, dictionary):
        body, kind = _unpacked(m["suffixes"]), np.uint16 if m["width"] == 2 else np.uint32
        n = len(body) // (longest * m["width"] + 4)
        number = np.frombuffer(body, kind, n * longest).reshape(longest, n).T
        codes.append(np.r_[np.int32(0), where[at : at + len(part)]][number])
        counts.append(np.frombuffer(body, np.uint32, n, n * longest * m["width"]).astype(np.int64))
        at += len(part)
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    order, first = _sorted(codes, len(words) + 1)
    codes, counts = codes[order], counts[order]
    many = np.r_[False, _levels(heavy, _places(lang, _hashes(words), bits)) > 0]
    open_ = many[codes[:, 0]]
    for depth in range(2, longest + 1):
        has = codes[:, depth - 1] > 0
        open_ = open_ & many[codes[:, depth - 1]]  # heavy words alone
        shared = open_ & (depth < longest)  # the node lies above a prefix; a prefix itself is in one group alone
        new = np.flatnonzero(first < depth)
        total = np.add.reduceat(counts, new)
        kept = has[new] & ((total >= least) | shared[new])
        for x, n in zip(new[kept], total[kept]):
            yield b" ".join(words[int(c) - 1].as_py() for c in codes[x, :depth]).decode(), int(n), depth


def count_phrases(rows: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, budget: int = BUDGET, bits: int = BITS) -> DataFrame:
    """(lang, phrase, words, a): phrases of two to ``longest`` words with at least ``least`` occurrences.

    ``words`` are the counted words; of them those below ``least`` end a suffix.
    """
    spark = rows.sparkSession
    total, most = (x or 0 for x in words.agg(F.sum("a"), F.max("a")).first())
    groups = max(1, -(-2 * total // budget))
    heavy = []
    while most > (over := max(1, budget // 8) * SPREAD ** len(heavy)) and SPREAD ** len(heavy) < groups:  # so levels grow with the logarithm of the corpus
        heavy.append(_bit_map(words.where(F.col("a") > over), bits))
    sent = spark.sparkContext.broadcast((_bit_map(words.where(F.col("a") >= least), bits), heavy))

    def send(batches):
        for block in _blocks(batches):
            held, size = [], 0
            for g, lang, width, dictionary, n, body, m in _suffixes(block, *sent.value, groups, longest):
                held.append((g, lang, width, _packed(dictionary, n), _packed(body, m)))
                size += len(dictionary) + len(body)
                if size > 4 << 20:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    def build(group: pa.Table) -> pa.Table:
        out: dict[str, list] = {"lang": [], "phrase": [], "words": [], "a": []}
        for lang in group.column("lang").unique().to_pylist():
            own = group.filter(pc.equal(group.column("lang"), lang)).to_pylist()
            for phrase, n, depth in _subtree(own, sent.value[1], bits, longest, least, lang):
                for name, x in zip(out, (lang, phrase, depth, n)):
                    out[name].append(x)
        return pa.table(out, schema=pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64())]))

    nodes = rows.mapInArrow(send, _MESSAGE).groupBy("group").applyInArrow(build, "lang string, phrase string, words int, a long")
    return nodes.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["group", "lang", "width", "words", "suffixes"])


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST, budget: int = BUDGET, bits: int = BITS) -> DataFrame:
    """The ``first`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score, and ``cut``, the words before the lowest-scoring cut.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line breaks, words at blanks and tabs. A null language is ``und``, a null
    text empty. A phrase goes when a longer one that holds it occurs as often. Repeated rows count as often as they are
    there. Ties go by count, then by the phrase's UTF-8 bytes. Texts without words add nothing; an empty table gives no
    rows; other columns are ignored.
    """
    rows = _rows(docs, text, lang)
    words = store(count_words(rows), "words")
    return ranked(store(count_phrases(rows, words, least, longest, budget, bits), "phrases"), words, least, first)


def ranked(found: DataFrame, words: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """The best of ``found`` phrases (lang, phrase, words, a) by the counts of their parts; ``words`` are (lang, word, a)."""
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    counted = found.select("lang", "phrase", "a").unionByName(words.where(F.col("a") >= least).select("lang", F.col("word").alias("phrase"), "a"))
    part = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    split = found.withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = split.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]).join(totals, "lang")
    # 38 digits hold the products of counts below 10**17.
    scored = cuts.withColumn("score", F.expr(f"(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) * {SCALE}) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "n", "s.*")
    # Counts fall from a phrase to any longer one, so a phrase of the same count that is one word longer is there if any is.
    longer = found.where("words > 2").withColumn("w", F.split("phrase", " "))
    inner = longer.select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), "a")
    left = lowest.join(inner, ["lang", "phrase", "a"], "left_anti")
    ordered = left.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ordered.where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")
