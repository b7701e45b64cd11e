import random

import numpy as np
import pytest

from convlake.llm import toxicity

from convlake.llm import mixing, ogg, order_minhash, suffix_dedup, warc
from convlake.llm.common import MULT, NON_BLANK, U64, Words, mix, window_hash, window_key
from convlake.llm.recompression import window_symbols


def test_ogg_round_trip_and_damage():
    random.seed(1)
    for n in (0, 1, 191, 192, 193, 255 * 255, 70_000):
        text = bytes(random.randrange(256) for _ in range(n))
        media = ogg.encode(ogg.pad(text), n)
        payload, size, feature = ogg.decode(media)
        assert payload == ogg.pad(text) and size == n and len(payload) % 192 == 0 and payload
        assert feature["end_ms"] == round(len(payload) / ogg.RATE * 1000) and feature["streams"] == 2
        broken = bytearray(media)
        broken[len(media) // 2] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(broken))
        with pytest.raises(ogg.OggError):
            ogg.decode(media[:-1])


def test_ogg_checksum_is_the_formats():
    def slow(data):
        r = 0
        for b in data:
            r ^= b << 24
            for _ in range(8):
                r = (r << 1) ^ (0x04C11DB7 if r & 0x80000000 else 0)
        return r & 0xFFFFFFFF

    for data in (b"", b"OggS", bytes(range(256))):
        assert ogg.page_crc(data) == slow(data)


def test_window_hash_depends_on_the_window_alone():
    v = np.array([random.randrange(1 << 60) for _ in range(300)], U64)
    for width in (1, 2, 7, 50):
        h = window_hash(np.r_[v, v], width, MULT[0])
        assert len(h) == 601 - width and (h[: 300 - width] == h[300 : 600 - width]).all() and len(set(h[:250].tolist())) == min(250, len(set(h[:250].tolist())))


def test_keys_tell_regular_texts_apart():
    """A word of 1,024 letters and its complement, on which sums of powers collide; and windows of such words."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    texts = [a.encode(), a.translate(str.maketrans("ab", "ba")).encode()]
    w = Words(np.frombuffer(b" ".join(texts), np.uint8), np.r_[0, 2 * len(a) + 1], NON_BLANK, 2)
    assert all(h[0] != h[1] for h in w.hash)
    v = np.frombuffer(b"".join(texts), np.uint8).astype(U64)
    for m in MULT:
        for width in (32, 50, 64):
            for values in (v, v.astype(np.uint8)):
                first = {}
                for k, x in enumerate(window_key(values, width, m).tolist()):
                    assert first.setdefault(bytes(v[k : k + width].astype(np.uint8)), x) == x
                assert len(set(first.values())) == len(first)


def test_equal_windows_get_equal_symbols():
    random.seed(5)
    for alphabet in (1, 2, 3, 40):
        docs = [[random.randrange(alphabet) for _ in range(random.randrange(0, 200))] for _ in range(12)]
        for _ in range(12):  # shared passages in other surroundings
            src, dst = random.choice(docs), random.choice(docs)
            a = random.randrange(len(src) + 1)
            dst[len(dst) // 2 : len(dst) // 2] = src[a : a + 80]
        names = mix(np.array([w for d in docs for w in d], U64) + U64(9))
        bounds = np.r_[0, np.cumsum([len(d) for d in docs])]
        starts, symbol = window_symbols(names, bounds, 50)
        flat = [w for d in docs for w in d]
        seen = {}
        for s, y in zip(starts.tolist(), symbol.tolist()):
            assert seen.setdefault(tuple(flat[s : s + 50]), y) == y
        assert len(starts) == sum(max(0, len(d) - 49) for d in docs)


def test_loser_tree_merges_with_true_prefixes():
    random.seed(2)
    for k in (1, 2, 3, 7):
        runs = []
        for _ in range(k):
            rows = sorted({bytes(random.choice(b"ab") for _ in range(9)) for _ in range(random.randrange(0, 40))})
            runs.append(rows)
        coded = []
        for rows in runs:
            m = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 9)
            common, rest = suffix_dedup.front_code(m) if rows else (np.empty(0, np.uint8), b"")
            coded.append(suffix_dedup.read_run(common, rest, 9))
        out, at = [], [0] * k
        for r, lcp in suffix_dedup.merge(coded):
            x = runs[r][at[r]]
            at[r] += 1
            want = 0
            if out:
                while want < 9 and out[-1][want] == x[want]:
                    want += 1
            assert lcp == want
            out.append(x)
        assert out == sorted(x for rows in runs for x in rows)


def test_warc_ranges_find_each_record_once(tmp_path):
    import io

    records = [warc.record({"WARC-Type": "response", "X-Page-ID": i}, bytes(random.randrange(256) for _ in range(random.randrange(3000)))) for i in range(60)]
    data = b"".join(records)
    for span in (700, 5000, 1 << 20):
        got = []
        for a in range(0, len(data), span):
            got += [int(h["x-page-id"]) for h, _ in warc.members(io.BytesIO(data), a, a + span, lambda h: (True, True))]
        assert got == list(range(60))


def test_pfair_windows_and_lag():
    """Irrational weights: no source is a block off its exact share at any slot of a phase, however long."""
    from fractions import Fraction

    sizes = [30_000, 10_000, 7_000, 3_001, 503, 1, 0]
    weights = [n**0.5 for n in sizes[:-1]] + [1.0]
    whole = mixing.whole_weights(weights)
    assert all(Fraction(a, whole[0]) == Fraction(b) / Fraction(weights[0]) for a, b in zip(whole, weights))
    slots, releases, deadlines = mixing.schedule(sizes, whole)
    assert [slots.count(s) for s in range(len(sizes))] == sizes
    assert all(r <= t < d for t, (r, d) in enumerate(zip(releases, deadlines)))
    left, base = list(sizes), 0
    done = [0] * len(sizes)
    alive = [s for s, n in enumerate(left) if n]
    for t, s in enumerate(slots, 1):
        done[s] += 1
        left[s] -= 1
        total = sum(whole[x] for x in alive)
        if t % 97 == 0 or not left[s]:
            assert all(abs(done[x] - Fraction(whole[x] * (t - base), total)) < 1 for x in alive)
        if not left[s]:
            alive, base, done = [x for x in alive if left[x]], t, [0] * len(sizes)


def test_edit_distance_equals_full_table():
    def full(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    random.seed(0)
    for _ in range(800):
        a = [random.randrange(3) for _ in range(random.randrange(10))]
        b = [random.randrange(3) for _ in range(random.randrange(10))]
        e, most = full(a, b), random.randrange(8)
        assert order_minhash.edit_distance(a, b, most) == (e if e <= most else None)
    for n in (40, 90, 150):
        for _ in range(12):
            a = [random.randrange(9) for _ in range(n)]
            b = list(a)
            for _ in range(random.randrange(40)):
                b[random.randrange(len(b)) :][:1] = []
                k = random.randrange(len(b))
                b[k : k + random.randrange(3)] = [random.randrange(9) for _ in range(random.randrange(3))]
            e = full(a, b)
            assert [order_minhash.edit_distance(a, b, most) for most in (e - 1, e, e + 1, e + 200) if most >= 0] == [x for x in (None, e, e, e)[e == 0 :]]


def test_words_never_cross_texts():
    texts = [b"one two", b"three", b"", b" four\tfive"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    w = Words(data, np.r_[0, np.cumsum([len(t) for t in texts])], NON_BLANK)
    assert [data[a:b].tobytes() for a, b in zip(w.start, w.end)] == [b"one", b"two", b"three", b"four", b"five"]
    assert w.owner.tolist() == [0, 0, 1, 3, 3] and w.bounds.tolist() == [0, 2, 3, 3, 5]




def test_warc_skips_payloads_without_inflating_them():
    import io
    import zlib

    big = bytes(2_000_000)
    records = [warc.record({"WARC-Type": t, "X-Page-ID": i}, big if i % 2 else b"small") for i, t in enumerate(["response", "revisit"] * 4)]
    foreign = zlib.compressobj(1, zlib.DEFLATED, 31)
    records.append(foreign.compress(b"WARC/1.1\r\nWARC-Type: revisit\r\nX-Page-ID: 8\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n") + foreign.flush())
    data = b"".join(records)
    for wanted, payload in ((lambda h: (h["warc-type"] == "response", True), b"small"), (lambda h: (True, False), None)):
        inflated = []
        got = list(warc.members(io.BytesIO(data), 0, len(data), wanted, inflated))
        assert max(inflated) <= warc._HEAD and len(inflated) == 9
        assert [int(h["x-page-id"]) for h, _ in got] == ([0, 2, 4, 6] if payload else list(range(9)))
        assert {x for _, x in got} == {payload}
    inflated = []
    got = list(warc.members(io.BytesIO(data), 0, len(data), lambda h: (True, True), inflated))
    assert [len(x) for _, x in got] == [5, 2_000_000] * 4 + [3] and sum(inflated) > 8_000_000
    assert all(zlib.decompress(r, 31).startswith(b"WARC/1.1") for r in records)


def test_training_rows_are_bounded(spark):
    """A key that is there very often is one row of the sample."""
    docs = spark.createDataFrame([(2, f"text {i}") for i in range(5000)] + [(i, "other") for i in range(3, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, sample=10).count() <= 10
    rows = toxicity.training_rows(docs, labels)
    assert rows.count() == rows.distinct().count() + rows.where("text = 'other'").count() - rows.where("text = 'other'").distinct().count()
    assert [r.text for r in rows.where("text <> 'other'").collect()] in ([], ["text 0"])


def test_messages_of_blocks_do_not_grow_with_shuffle_partitions(spark, monkeypatch):
    """Partitions tend to grow with the text; messages of each block would make both grow as its square."""
    from convlake.llm import blocks

    random.seed(4)
    texts = [bytes(random.choice(b"abcdefgh ") for _ in range(3_000)).decode() for _ in range(40)]
    docs = spark.createDataFrame([(i, texts[i % 25]) for i in range(40)], "doc_id long, text string").repartition(4)
    sent, ask = [], blocks.ask

    def counted(asked, answer):
        sent.append(asked.count())
        return ask(asked, answer)

    monkeypatch.setattr(blocks, "ask", counted)
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(suffix_dedup.deduplicate_bytes(docs, block_bytes=20_000).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and sum(r.n_removed > 0 for r in got[0]) == 15
    few, many = sent[: len(sent) // 2], sent[len(sent) // 2 :]
    assert len(few) == 3 and few[0] > 0 and all(b <= 2 * a for a, b in zip(few, many))  # smaller tasks put fewer pieces together


def test_pieces_are_put_together(spark):
    """What a pass leaves of many blocks fills blocks again, within a task and up to the given size."""
    from convlake.llm import blocks

    docs = spark.createDataFrame([(i, "x" * 1_000) for i in range(60)], "doc_id long, text string").repartition(1)
    base = blocks.build_blocks(docs, "doc_id", "text", "whole", 1_000)
    fifth = lambda b: blocks.Block(b.number, b.ids[:1], b.nulls[:1], np.array([0, 200]), b.data[:200], np.array([b.number, 0, 0])) if b.ids[0] % 3 else None
    packed = [blocks.unpack(r.asDict()) for r in blocks.pack_blocks(base.coalesce(1), fifth, 1_000).collect()]
    assert [len(b.data) for b in packed] == [1_000] * 8 and sorted(i for b in packed for i in b.ids.tolist()) == [i for i in range(60) if i % 3]
    assert all(b.origin.reshape(-1, 3)[0, 0] == b.number and len(b.origin) == 15 for b in packed)


def test_runs_are_answered_as_the_loser_tree_merges_them():
    from convlake.llm import blocks

    random.seed(6)
    for k in (1, 2, 9):
        for alphabet in (b"ab", b"\0\xff", b"\0\1 a\x80"):
            runs = [sorted({bytes(random.choice(alphabet) for _ in range(9)) for _ in range(random.randrange(1, 60))}) for _ in range(k)]
            ids = [np.array([random.randrange(7) for _ in r], np.int64) for r in runs]
            coded = [suffix_dedup.front_code(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 9)) for r in runs]
            assert all(suffix_dedup.unfold(c, x, 9).tobytes() == b"".join(r) for r, (c, x) in zip(runs, coded))
            least, at, last = {}, [0] * k, None
            for r, shared in suffix_dedup.merge([suffix_dedup.read_run(c, x, 9) for c, x in coded]):
                last = runs[r][at[r]] if shared < 9 or last is None else last
                least[last] = min(least.get(last, 9), int(ids[r][at[r]]))
                at[r] += 1
            got = suffix_dedup.answer_runs([blocks.pack_ids(i) + c.tobytes() + x for i, (c, x) in zip(ids, coded)], 9)
            assert [g.tolist() for g in got] == [[least[x] < i for x, i in zip(r, n.tolist())] for r, n in zip(runs, ids)]


def test_span_keys_tell_spans_apart():
    from convlake.llm.common import span_keys

    random.seed(7)
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    data = np.frombuffer((word + word.translate(str.maketrans("ab", "ba"))).encode() + bytes(3_000) + bytes(random.randrange(256) for _ in range(300)) * 2, np.uint8)
    first = np.array([random.randrange(len(data)) for _ in range(6_000)] + [2048, 2049, 5048, 5348, 0, 1024])
    size = np.array([random.choice((1, 3, 7, 8, 9, 50, 68, 512, 513, 2_000)) for _ in range(6_000)] + [2_999, 2_999, 300, 300, 1024, 1024])
    size = np.minimum(size, len(data) - first)
    one, two = span_keys(data, first, size)
    spans = [data[a : a + n].tobytes() for a, n in zip(first, size)]
    for half in (one, two):
        known = {}
        assert all(known.setdefault(s, h) == h for s, h in zip(spans, half.tolist())) and len(set(known.values())) == len(known)
    assert one[-3] == one[-4] and one[-5] == one[-6] and one[-1] != one[-2]


def test_order_by_keys_then_ids():
    from convlake.llm.blocks import group_min, split

    random.seed(8)
    for n in (0, 1, 2, 500):
        one, two = (np.array([random.randrange(40) for _ in range(n)], U64) for _ in range(2))
        ids = np.array([random.randrange(9) for _ in range(n)], np.int64)
        order, first, group = group_min([one, two], ids)
        rows = sorted(zip(one.tolist(), two.tolist(), ids.tolist()))
        assert list(zip(one[order].tolist(), two[order].tolist(), ids[order].tolist())) == rows
        assert len(first) == len({r[:2] for r in rows}) and (np.r_[group[1:] != group[:-1], True][: len(order)].sum() == len(first))
        order, parts = split(one << U64(40), 7)
        assert sorted(order.tolist()) == list(range(n)) and all((one[order[a:b]] % U64(7) == U64(k)).all() for k, a, b in parts) and sum(b - a for _, a, b in parts) == n
