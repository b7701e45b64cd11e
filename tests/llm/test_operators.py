"""Operators against brute force on small tables with nulls, ties, empty and long texts, and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest

from convlake.llm import decontamination, licences, mixing, ogg, order_minhash, recompression, sharding, suffix_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, source string, score double, node string, size long"


def corpus(seed=0, n=60):
    """Rows with shared passages, copies, nulls, empty and one very long text, repeated rows and clashing columns."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    passage = " ".join(word() for _ in range(70))
    rows = []
    for i in range(n):
        t = " ".join(word() for _ in range(rng.randrange(0, 160)))
        if i % 4 == 1:
            t = t[: len(t) // 2] + " " + passage[rng.randrange(60) :] + " " + t[len(t) // 2 :]
        if i % 9 == 2 and rows:
            t = rows[-1][1]
        if i % 13 == 3:
            t = "ha " * 130
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (None, passage), (None, rows[5][1]), (7, rows[7][1]), (7, "other " + passage), (n + 3, "é" * 40 + passage), (n + 4, "x" * 30_000), (n + 5, "x" * 30_001)]
    return [(i, t, None if i is not None and i % 5 == 0 else f"s{(i or 0) % 3}", 0.5, "n", 1) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def removed(rows, unit, width):
    """Brute force: kept units and flags of each row; a null id is larger than all."""
    key = lambda r: float("inf") if r[0] is None else r[0]
    first = {}
    for r in rows:
        u = unit(r[1])
        for j in range(len(u) - width + 1):
            w = tuple(u[j : j + width])
            first[w] = min(first.get(w, float("inf")), key(r))
    out = []
    for r in rows:
        u = unit(r[1])
        gone = [False] * len(u)
        for j in range(len(u) - width + 1):
            if first[tuple(u[j : j + width])] < key(r):
                gone[j : j + width] = [True] * width
        out.append((r[0], u, gone))
    return out


@pytest.mark.parametrize("block", [2_000, 1 << 20])
def test_words_removed(docs, rows, empty, block):
    want = sorted((repr(i), len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g) if not x)).hexdigest()) for i, u, g in removed(rows, lambda t: (t or "").encode().split(), 50))
    got = sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in recompression.deduplicate_words(docs, block_bytes=block).collect())
    assert got == want and any(w[2] for w in want)
    assert recompression.deduplicate_words(empty).count() == 0


@pytest.mark.parametrize("block", [2_000, 1 << 20])
def test_bytes_removed(docs, rows, empty, block):
    spans = lambda g: len(re.findall("1+", "".join("01"[x] for x in g)))
    want = sorted((repr(i), len(u), sum(g), spans(g), hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest()) for i, u, g in removed(rows, lambda t: (t or "").encode(), 50))
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate_bytes(docs, block_bytes=block).collect())
    assert got == want and any(w[2] for w in want)
    assert suffix_dedup.deduplicate_bytes(empty).count() == 0


def test_sharding(docs, rows, empty, spark):
    got = sharding.shard_documents(docs, 5).collect()
    assert len(got) == len(rows) and sharding.shard_documents(empty, 5).count() == 0
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 5) for r in got)
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows}
    kept = sharding.shard_documents(docs, 5, keep=True)
    assert set(docs.columns) <= set(kept.columns) and len(kept.columns) == len(set(kept.columns))
    import math
    import struct

    import xxhash

    def best(key, n):
        """The shard with the largest score, by plain arithmetic."""
        seed = xxhash.xxh64_intdigest(b"null" if key is None else f"k{key}".encode(), 42)
        unit = [((xxhash.xxh64_intdigest(struct.pack("<i", s), seed) >> 11) + 0.5) / 2**53 for s in range(n)]
        return max(range(n), key=lambda s: (-1 / math.log(unit[s]), s))

    assert all(r.shard == best(r.doc_id, 5) and r.grown_shard == best(r.doc_id, 6) for r in got)
    many = spark.range(20_000).selectExpr("id doc_id", "cast(id as string) text")
    share = {r.shard: r["count"] for r in sharding.shard_documents(many, 3, weights=[1.0, 2.0, 0.0]).groupBy("shard").count().collect()}
    assert set(share) == {0, 1} and abs(share[1] / 20_000 - 2 / 3) < 0.02


def test_ogg(docs, rows, empty):
    got = ogg.read_media(ogg.encode_documents(docs)).collect()
    want = sorted((repr(r[0]), len((r[1] or "").encode()), hashlib.sha256(ogg.pad((r[1] or "").encode())).hexdigest(), zlib.crc32(ogg.pad((r[1] or "").encode())[-16:])) for r in rows)
    assert sorted((repr(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert ogg.read_media(ogg.encode_documents(empty)).count() == 0


def test_warc(spark):
    import base64

    pages = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/\nx", "other"), (4, "d", None), (5, "e", ""), (None, "f", "same"), (6, "g", "é" * 9_000), (6, "g", "é" * 9_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.warc_round_trip(df).collect()
    top = {}
    for p, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if p is None else p)
    want = sorted((repr(p), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if p == top[h or ""] else ("revisit", top[h or ""]))) for p, _, h in pages)
    assert sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_filters_reach_the_reader(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"text {i % 3}") for i in range(12)], "page_id long, url string, html string")
    from convlake.storage import scratch

    path = scratch(spark, "warc")
    warc.archive(df, path)
    warc.register(spark)
    got = spark.read.format("warc").load(path).where("record_type = 'revisit'")
    assert got.count() == 9 and got.where("content is not null and length(content) > 0").count() == 0
    assert spark.read.format("warc").load(path).where("page_id = 11").collect()[0].content == b"text 2"


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(4)
    items = [(i, " ".join((rows[rng.randrange(60)][1] or "a").split()[3:30])) for i in range(8)] + [(100, "Ha ha HA"), (101, None), (102, "--"), (None, rows[8][1][:90]), (9, rows[1][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    low = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    windows = {}
    for i, t in items:
        w = low(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add("null" if i is None else str(i))
    want = []
    for r in rows:
        w, found = low(r[1]), set()
        hit = [False] * len(w)
        for k, own in windows.items():
            for j in range(len(w) - len(k) + 1):
                if tuple(w[j : j + len(k)]) == k:
                    hit[j : j + len(k)] = [True] * len(k)
                    found |= own
        want.append((repr(r[0]), len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    take = lambda df: sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())
    assert take(decontamination.decontaminate(docs, bench)) == sorted(want)
    assert take(decontamination.decontaminate(docs, bench, slice_windows=40)) == sorted(want)
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert not any(r[5] for r in take(decontamination.decontaminate(docs, bench.limit(0))))


def test_words_are_told_apart(spark):
    """Words of 1,024 letters on which sums of powers collide: one is not taken for the other."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(49))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in recompression.deduplicate_words(df).collect()} == {1: 0, 2: 0, 3: 50}
    bench = spark.createDataFrame([("A", a)], "item_id string, text string")
    assert {r.doc_id: r.contaminated for r in decontamination.decontaminate(df, bench).collect()} == {1: True, 2: False, 3: True}
    near = spark.createDataFrame([(1, " ".join([a] * 6)), (2, " ".join([b] * 6))], "doc_id long, text string")
    assert {r.class_id for r in order_minhash.near_duplicates(near).collect()} == {1, 2}


@pytest.mark.parametrize("block", [200, 4 << 20])
def test_proximity(spark, block):
    """Windows with a word that the block lacks still match by their three rarest terms."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([10, 12, 14, 25, 2, 1] * 3)]
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    for i, t in items:  # passages with every fourth word changed or in another order
        w = [word() if k % 4 == 1 else x for k, x in enumerate(t.split())]
        rows += [(100 + i, " ".join(w)), (200 + i, " ".join(rng.sample(w, len(w)) + [word() for _ in range(30)]))]
    texts = [t.split() for _, t in rows]
    count = {}
    for t in texts:
        for w in t:
            count[w] = count.get(w, 0) + 1
    want = []
    for (d, _), t in zip(rows, texts):
        found = set()
        for i, item in items:
            w = item.split()
            for j in range(max(1, len(w) - 9)):
                rare = sorted(w[j : j + 10], key=lambda x: count.get(x, 0))[:3]
                if any(x == rare[0] and all(r in t[max(0, p - 15) : p + 16] for r in rare[1:]) for p, x in enumerate(t)):
                    found.add(i)
        want.append((d, len(found)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_near) for r in decontamination.decontaminate(df, bench, block_bytes=block).collect())
    assert got == sorted(want) and sum(n for _, n in want) > 20


def near_corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, truth = [], {}
    for g in range(8):
        base = [word() for _ in range(rng.randrange(60, 200))]
        for c in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(c and len(w) // 60):
                w[rng.randrange(len(w))] = word()
            i = len(rows)
            rows.append((i, " ".join(w).capitalize() if c % 2 else ", ".join(w)))
            truth[i] = g
    return rows, truth


def test_near_duplicates(spark, empty):
    rows, truth = near_corpus()
    rows += [(1000, None), (1001, ""), (1002, "!!"), (1003, "one two"), (1004, "One, two."), (1003, "one two"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = order_minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    first = {}
    for i, g in truth.items():
        first.setdefault(g, i)
    cls = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert all(cls[i] == first[g] for i, g in truth.items())
    assert cls[1000] == cls[1001] == 1000 and cls[1002] == 1002 and cls[1004] == cls[1003] == 1003
    assert [r.class_id for r in got if r.doc_id is None] == [0]
    assert order_minhash.near_duplicates(empty).count() == 0


def test_near_needs_eight_tenths(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    other = [w if i % 3 else f"x{i}" for i, w in enumerate(base)]
    got = order_minhash.near_duplicates(spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:60] + [f"y{i}" for i in range(60)]))], "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {1, 2, 3}


def full_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_all_near_pairs_of_a_sketch_are_linked(spark):
    """Twins with few sketches in common, all of them shared with many other documents; all pairs are aligned by brute force."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, rows = [word() for _ in range(70)], []
    for i in range(30):
        base = passage + [word() for _ in range(50)]
        for k in range(2):
            w = list(base)
            for at in rng.sample(range(len(w)), 7):
                w[at] = word()
            rows.append((2 * i + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = order_minhash._sketched(df.selectExpr("cast(cast(doc_id as string) as binary) node", "text"), order_minhash.SHINGLE, order_minhash.SKETCHES, order_minhash.TAKE)
    keys = {int(bytes(r.node)): set(r["keys"]) for r in sketched.collect()}
    texts = [t.split() for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if keys[a] & keys[b] and full_distance(texts[a], texts[b]) <= 24]
    cls = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df).collect()}
    assert len(near) > 10 and [p for p in near if cls[p[0]] != cls[p[1]]] == []
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in near:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert cls == {i: find(i) for i, _ in rows}


def test_recall_from_eight_tenths_on(spark):
    """Pairs of 300 words with changes at random places; every pair of the two texts is near by its edits."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows, of = [], {}
    for level in (0.80, 0.82, 0.85, 0.9, 0.95):
        for _ in range(60):
            base = [word() for _ in range(300)]
            other = list(base)
            for at in rng.sample(range(300), round(300 * (1 - level))):
                other[at] = word()
            of[len(rows)] = level
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    cls = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for level in set(of.values()):
        found = [cls[i] == cls[i + 1] for i, x in of.items() if x == level]
        assert sum(found) / len(found) >= 0.9
    assert all(cls[i] in (i, i - 1) for i, _ in rows)


def test_recall_at_every_length(spark):
    """Pairs of 5 to 300 words, changed at random places by substitution, insertion and deletion."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows, of = [], {}
    for n in (5, 6, 8, 10, 11, 13, 15, 20, 30, 50, 100, 200, 290, 310):
        for level in (0.8, 0.9):
            edits = int(n * (1 - level) + 1e-9)
            for k in range(40 if edits else 0):
                base = [word() for _ in range(n)]
                other = list(base)
                for at in sorted(rng.sample(range(n), edits), reverse=True):
                    if k % 4 == 3 and at % 2:
                        del other[at]
                    else:
                        other[at] = word()
                of[len(rows)] = (n, level)
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, ", ".join(other))]
    cls = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for case in set(of.values()):
        found = [cls[i] == cls[i + 1] for i, x in of.items() if x == case]
        assert sum(found) / len(found) >= 0.9, case
    assert all(cls[i] in (i, i - 1) for i, _ in rows)


def test_mixing(docs, rows, empty, spark):
    got = mixing.mix_sources(docs, block_rows=2).collect()
    assert sorted(r.position for r in got) == list(range(len(rows))) and mixing.mix_sources(empty).count() == 0
    big = spark.range(6000).selectExpr("id doc_id", "'t' text", "case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' end source")
    out = mixing.mix_sources(big, targets={"a": 5.0, "b": 3.0, None: 2.0}, block_rows=4)
    blocks = sorted({(r.slot, r.source) for r in out.collect()}, key=lambda x: x[0])
    end = 990  # the first source, of 500 blocks, runs out at slot 1000
    for s, w in (("a", 0.5), ("b", 0.3), (None, 0.2)):
        for t in range(0, end, 37):
            assert abs(sum(x == s for _, x in blocks[:t]) - w * t) < 1
    assert all(r.release <= r.slot < r.deadline for r in out.collect())
    assert sorted(r.position for r in out.collect()) == list(range(6000))
    few = mixing.mix_sources(big, most_blocks=10).collect()
    assert sorted(r.position for r in few) == list(range(6000)) and max(r.slot for r in few) < 10 + 3


def test_toxicity(spark, docs, empty):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(rng.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["zzquark", "vexblot"]))
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(d, lab).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    model = toxicity.train(d, lab)
    scored = toxicity.score(docs, model, names=("_s", "_p"))
    assert set(docs.columns) < set(scored.columns) and scored.where("_s is null").count() == 0
    assert toxicity.score_documents(empty, lab).count() == 0
    assert toxicity.score_documents(d.limit(3), lab.limit(0)).where("predicted = 1").count() == 0


def test_licences(spark, docs, empty, rows):
    notices = {1: "Released under the MIT License.", 2: "prose before\nLicensed under the Apache License, Version 2.0.\nprose after", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.", 5: "licensed to kill", 6: None, 7: ""}
    prose = [(1000 + i, r[1]) for i, r in enumerate(rows)]
    d = spark.createDataFrame([*notices.items(), *prose], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(d).collect()}
    assert [got[i].families for i in range(1, 8)] == ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "", "", ""]
    assert not any(r.families for i, r in got.items() if i >= 1000) and len(got) == len(notices) + len(prose)
    assert licences.scan_licences(empty).count() == 0


WRAPPED = {
    "MIT": "Copyright (c) 2020 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.",
    "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Keep the notice.",
    "Apache-2.0": " * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at",
}


def test_licences_held_out(spark):
    """Wrapped notices among prose, notices that lost words, and sentences about licences: precision and recall by family."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(600):
        family = licences.FAMILIES[i % 8]
        kind = i // 8 % 4
        t = rng.choice(licences.TEMPLATES[family])
        if kind == 0:
            t = WRAPPED.get(family, t)
        elif kind == 1:
            w = t.split()
            gone = rng.sample(range(len(w)), len(w) // 10)
            t = " ".join(x for k, x in enumerate(w) if k not in gone)
        elif kind == 2:
            w = t.split()
            t = "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))
        else:
            t, family = rng.choice(["The licence of the driver was copied by the foundation.", "Any person may use the source of the river.", "The terms of the work are met.", prose(20)]), ""
        rows.append((i, rng.choice(["{0}\n{1}\n{2}", "{0}\n\n{1}\n\n{2}", "{1}"]).format(prose(30), t, prose(30))))
        want[i] = family
    rows += [(1000 + i, "\n".join(prose(12) for _ in range(10))) for i in range(300)]
    got = {r.doc_id: r.families for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for f in licences.FAMILIES:
        hit = sum(got[i] == f == x for i, x in want.items())
        assert hit / sum(x == f for x in want.values()) >= 0.9, f
        assert hit / sum(x == f for x in got.values()) >= 0.95, f
    assert not any(got[i] for i in got if want.get(i, "") == "")


#: Licences that differ from a known one by a number or a word, and sentences that deny one: no family.
SIBLING_TEXTS = [
    "This program is free software; you can redistribute it and/or modify it\nunder the terms of the GNU General Public License as published by the\nFree Software Foundation; either version 2 of the License, or (at your\noption) any later version.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
    "You can redistribute it under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution 2.5 Generic License.", "Licensed under CC BY-SA 3.0.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY 2.0.",
    "Released under the BSD 2-Clause License.", "This is not released under the MIT License.", "The code was never licensed under the Apache License, Version 2.0.",
    "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "// SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: CC-BY-ND-4.0", "SPDX-License-Identifier: MIT-0",
]
IDENTIFIED = {"SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: GPL-3.0-or-later */": "GPL-3.0", "SPDX-License-Identifier: CC-BY-SA-4.0": "CC-BY-SA-4.0", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "SPDX-License-Identifier: MPL-2.0": "MPL-2.0"}


def test_licences_tell_siblings(spark, rows):
    """Alone, between lines of prose, and beside a notice that holds; identifiers are found."""
    prose = [(1000 + i, r[1]) for i, r in enumerate(rows)]
    around = "some words before it\n{}\nand some words after it"
    texts, want = [], []
    for t in SIBLING_TEXTS:
        for form, found in (("{}", ""), (around, ""), ("{}\n\nReleased under the MIT License.", "MIT")):
            texts.append(form.format(t))
            want.append(found)
    for t, found in IDENTIFIED.items():
        for form in ("{}", around):
            texts.append(form.format(t))
            want.append(found)
    d = spark.createDataFrame([*enumerate(texts), *prose], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan_licences(d).collect()}
    assert [(texts[i], got[i]) for i in range(len(texts)) if got[i] != want[i]] == []


def test_licences_of_notices_alone(spark):
    """A corpus whose words are all words of templates still gives rows."""
    d = spark.createDataFrame([(i, "Released under the MIT License.") for i in range(300)] + [(300, "version")], "doc_id long, text string")
    assert licences.scan_licences(d).count() == 301


def test_licences_edges(spark):
    """Null keys with different texts, repeated rows, ties, a very long line."""
    long = " ".join(f"x{k}" for k in range(40_000)) + " Released under the MIT License."
    rows = [(None, "Released under the MIT License."), (None, "nothing"), (1, "Licensed under CC BY 4.0."), (1, "Licensed under CC BY 4.0."), (2, long), (3, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (4, "\n\n \n")]
    got = licences.scan_licences(spark.createDataFrame([(*r, 7, "p") for r in rows], "doc_id long, text string, line int, p string")).collect()
    assert sorted((repr(r.doc_id), r.families, r.n_paragraphs) for r in got) == sorted([("None", "MIT", 1), ("None", "", 1), ("1", "CC-BY-4.0", 1), ("1", "CC-BY-4.0", 1), ("2", "MIT", 1), ("3", "Apache-2.0,MIT", 1), ("4", "", 0)])


def test_ogg_query_reads_stored_media(spark, docs, rows, tmp_path):
    from convlake.llm.queries import op2_ogg

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = op2_ogg(spark, str(tmp_path))
    assert out.count() == len(rows) and any("/media-" in f for f in out.inputFiles())


@pytest.mark.parametrize("buckets", [32, 1 << 20])
def test_rarest_words_make_no_rows_and_lose_no_pair(spark, buckets):
    """Texts with one long passage in common: words are not rows, and alike texts share a key, also where many words share a bucket."""
    rng = random.Random(12)
    passage, texts = [f"p{k}" for k in range(60)], []
    for _ in range(40):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(10, 60))]
        near = list(own)
        for _ in range(rng.randrange(1, 20)):
            near[rng.randrange(len(near))] = f"w{rng.randrange(3000)}"
        texts += [passage + own, passage + near + ["end"] * rng.randrange(8)]
    df = spark.createDataFrame([(i + 5, len(t), " ".join(t).encode()) for i, t in enumerate(texts)], "id long, words int, text binary")
    listed = order_minhash._rarest(df, 0.8, buckets)
    assert "Generate" not in listed._jdf.queryExecution().executedPlan().toString()
    keys = {r.id - 5: r["keys"] for r in listed.collect()}
    alike = [(i, j) for j in range(len(texts)) for i in range(j) if order_minhash.similar(texts[i], texts[j], 0.8)]
    assert len(alike) > 30 and all(set(keys[i]) & set(keys[j]) for i, j in alike)
    if buckets > 3000:  # what all texts hold has few keys
        assert sum(map(len, keys.values())) < sum(map(len, texts)) / 4
