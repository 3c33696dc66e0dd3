"""Operators against brute force, other libraries, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seaward.llm import bpe, jpeg, licences, media, neighbours, packing, quality, secrets, simhash, toxicity, trigrams, warc

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"


# --- toxicity


def brute_segments(scores):
    """All maximal segments by definition: the best one, then the same on both sides of it."""

    def split(a, b):
        best = None
        for i in range(a, b):
            for j in range(i, b):
                s = sum(scores[i : j + 1])
                if s > 1e-9 and (best is None or s > best[0] + 1e-9 or (abs(s - best[0]) < 1e-9 and j - i < best[2] - best[1])):
                    best = (s, i, j)
        return [] if best is None else split(a, best[1]) + [best] + split(best[2] + 1, b)

    return split(0, len(scores))


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.choice([-0.5, -0.5, 0.7, 1.1, 2.3]) for _ in range(rng.randint(0, 13))]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0])
        assert [(round(s, 6), a, b) for s, a, b in got] == [(round(s, 6), a, b) for s, a, b in brute_segments(scores)]


def held_out(spark, name, labels, query):
    rows = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    return [(r[labels], r.predicted, r.score) for r in rows]


def test_toxicity_held_out(spark):
    rows = held_out(spark, "op1", "toxic", toxicity.op1_toxicity)
    assert np.mean([y == p for y, p, _ in rows]) > 0.9 and sum(p for y, p, _ in rows if not y) <= 2


def test_quality_held_out(spark):
    rows = held_out(spark, "op5", "quality", quality.op5_quality_pairs)
    assert np.mean([y == p for y, p, _ in rows]) > 0.95


# --- media


def general_file(values, restart):
    """A progressive file of one grey 16 x 16 picture with end-of-band runs, zero runs and refinement, bit by bit."""
    codes = jpeg.huffman_codes([0] * 7 + [254] + [0] * 8, list(range(254)))
    table = bytes([0] * 7 + [254] + [0] * 8) + bytes(range(254))
    out = [b"\xff\xd8", jpeg._HEAD, jpeg._segment(0xC2, bytes([8, 0, 16, 0, 16, 1, 1, 0x11, 0]))]
    out += [jpeg._segment(0xC4, bytes([k]) + table) for k in (0x00, 0x10)]
    if restart:
        out.append(jpeg._segment(0xDD, bytes([0, restart])))

    def amp(v):
        size = abs(v).bit_length()
        return (v if v > 0 else v + (1 << size) - 1, size)

    def scan(first, last, high, low, blocks):
        parts, bits = [], []

        def put(v, n):
            bits.extend(v >> (n - 1 - i) & 1 for i in range(n))

        def close():
            while len(bits) % 8:
                bits.append(1)
            parts.append(np.packbits(np.array(bits, dtype=np.uint8)).tobytes().replace(b"\xff", b"\xff\x00"))
            bits.clear()

        before = 0
        for n, b in enumerate(blocks):
            if restart and n and n % restart == 0:
                close()
                before = 0
            if first == 0:
                v = int(b[0]) >> low
                if high:
                    put(v & 1, 1)
                else:
                    a, size = amp(v - before)
                    put(*codes[size])
                    put(a, size)
                    before = v
                continue
            mags = [abs(int(b[k])) >> low for k in range(first, last + 1)]
            ends = max([i for i, m in enumerate(mags) if (m == 1 if high else m)], default=-1)
            run, corrections = 0, []
            for i, m in enumerate(mags):
                k = first + i
                if not m:
                    run += 1
                    continue
                while run > 15 and i <= ends:  # the corrections so far lie before the sixteenth zero
                    put(*codes[0xF0])
                    run -= 16
                    for c in corrections:
                        put(c, 1)
                    corrections = []
                if high and m > 1:
                    corrections.append(m & 1)
                    continue
                sign = int(b[k]) > 0
                if high:
                    put(*codes[run << 4 | 1])
                    put(int(sign), 1)
                    for c in corrections:
                        put(c, 1)
                    corrections = []
                else:
                    a, size = amp(m if sign else -m)
                    put(*codes[run << 4 | size])
                    put(a, size)
                run = 0
            if run or corrections:
                put(*codes[0x00])
                for c in corrections:
                    put(c, 1)
        close()
        body = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(parts) - 1 else b"") for i, p in enumerate(parts))
        return jpeg._start([(1, 0)], first, last, high, low) + body

    out += [scan(0, 0, 0, 1, values), scan(1, 5, 0, 1, values), scan(6, 63, 0, 1, values), scan(0, 0, 1, 0, values)]
    out += [scan(1, 5, 1, 0, values), scan(6, 63, 1, 0, values)]
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1])
def test_any_progressive_file(restart):
    rng = np.random.default_rng(restart)
    for _ in range(20):
        values = np.where(rng.random((4, 64)) < 0.3, rng.integers(-60, 61, (4, 64)), 0)
        pic = jpeg.decode(general_file(values, restart))
        assert (pic.parts[0]["c"].reshape(4, 64) == values).all()
        flat = jpeg.to_rgb(pic)
        assert flat.shape == (16, 16, 3) and (flat[..., 0] == flat[..., 2]).all()


def direct_rgb(pic):
    """Each pixel by the definition: the cosine sum of its block, chroma of the nearest sample, colour conversion."""
    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
    scale = np.where(np.arange(8) == 0, np.sqrt(0.5), 1.0)

    def sample(part, y, x):
        block = np.zeros((8, 8))
        block.reshape(-1)[zigzag] = part["c"][y // 8, x // 8] * np.asarray(pic.quant[part["q"]]).reshape(-1)
        u = np.arange(8)
        one, two = (scale * np.cos((2 * (p % 8) + 1) * u * np.pi / 16) for p in (y, x))
        return min(max(one @ block @ two / 4 + 128, 0), 255)

    out = np.zeros((pic.height, pic.width, 3))
    for y in range(pic.height):
        for x in range(pic.width):
            values = [sample(p, y * p["v"] // pic.vmax, x * p["h"] // pic.hmax) for p in pic.parts]
            luma, cb, cr = values[0], values[1] - 128, values[2] - 128
            out[y, x] = luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb
    return np.clip(out, 0, 255)


def test_rgb_like_direct_transform():
    rng = np.random.default_rng(6)
    for n in (384, 1200):
        pic = jpeg.decode(jpeg.encode_payload(bytes(n - n % 64)))
        pic.quant = {k: np.arange(1, 65) for k in range(4)}  # so that quantisers count too
        for p in pic.parts:
            p["c"] = np.where(rng.random(p["c"].shape) < 0.15, rng.integers(-8, 9, p["c"].shape), 0)
        assert (pic.parts[0]["h"], pic.parts[1]["h"]) == (2, 1)  # subsampled chroma
        assert np.abs(jpeg.to_rgb(pic).astype(float) - direct_rgb(pic)).max() <= 2


def test_payload_round_trip(spark):
    for n in (64, 128, 384, 448, 64 * 500):
        data = random.Random(n).randbytes(n)
        assert jpeg.read_payload(jpeg.decode(jpeg.encode_payload(data))) == data
    docs = spark.createDataFrame([(1, "ab"), (2, "x" * 64), (3, "ab")], "doc_id long, text string")
    rows = media.text_media(docs, keep_media=True, keep_rgb=True).orderBy("doc_id").collect()
    assert rows[0].payload_sha256 == hashlib.sha256(b"ab" + bytes(62)).hexdigest() and rows[1].payload_bytes == 64
    assert rows[0][1:] == rows[2][1:] and rows[0].tail_crc32 == zlib.crc32(b"ab" + bytes(62))
    back = media.decode_jpeg_column(spark.createDataFrame([(1, bytes(rows[0].media)), (2, b"no"), (3, None)], "k long, media binary"), keys=("k",)).orderBy("k").collect()
    assert back[0].rgb == rows[0].rgb and (back[0].width, back[0].height) == (16, 16) and back[1].error and back[2].error is None


def test_stored_tensors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    stored = media.store_texts(docs)
    files = stored.unionByName(spark.createDataFrame([(-1, 0, b"no picture"), (-2, 0, None)], stored.schema))
    tensors = media.store_tensors(files, keys=("doc_id",))
    rows = {r.doc_id: r for r in tensors.collect()}
    assert rows[-1].rgb is None and rows[-1].error and rows[-2].error is None and rows[-2].width is None
    assert all(len(r.rgb) == r.width * r.height * 3 for i, r in rows.items() if i >= 0)
    want = {r.doc_id: r.feature for r in media.read_texts(stored).collect()} | {-1: None, -2: None}
    assert {r.doc_id: r.feature for r in media.tensor_features(tensors, ("doc_id",)).collect()} == want
    assert media.store_tensors(files.limit(0)).count() == 0


# --- tokens


def test_byte_bpe_like_other_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    codec, rng = bpe.Codec.get(path, P.PATTERN), random.Random(4)
    texts = ["", "a", " a  b\n\nc \t", "don't  I'LL 12345 ½²", "é" * 300, "<|endoftext|>⁇⁇"]
    texts += ["".join(rng.choice("abcDEF 0123'\n\t.,!éß漢字😀\x1c\x85\xa0 ") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]
    for t in texts:
        ids = codec.encode(t)
        assert ids == other.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, path, keep_ids=True).collect()
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for d in docs.collect():
        own = sorted(pieces[d.doc_id], key=lambda r: r.start)
        ids = [i for r in own for i in r.ids]
        assert ids == model.encode(d.text, add_special_tokens=False).ids + [2] and own[0].doc_tokens == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in own)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # no padding at all


def test_shortcuts_only_where_the_file_allows():
    from tokenizers import Tokenizer

    for name, splits in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        tokens = packing.Tokens(P.path(name))
        texts = ["One  TWO three's É x.", " a\tB \n", "", "Ünder, under; UNDER"]
        want = [Tokenizer.from_file(P.path(name)).encode(t, add_special_tokens=False).ids for t in texts]
        assert tokens.splits == splits and [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)] == want


def test_tokens_of_any_text():
    """Arbitrary mixtures, and more new words than fit one line, equal the tokenizer's own ids; so they do after the store starts anew."""
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(5)
    signs = [*"abcXYZéÉßµªÀÿĀįİıŁ '’.,;:!?-_1२\t\n\r\x0b\x1c\x85\xa0\u0301\u0345\u2028\u3000ΣΑς漢か<|>\u200b😀ǅ", "'s", "'LL", "<|endoftext|>", " the "]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(4000)]
    texts += [" ".join("".join(rng.choices("abcdeéü", k=rng.randint(1, 9))) for _ in range(500)), "", "x" * 5000 + "."]
    letters = [chr(c) for c in range(0x80, 0x250)]
    texts += [f"{c} a{c}b, {c}x. X{c}!? {c}" for c in letters]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    tokens = packing.Tokens(path)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)] == want
        tokens.ids.clear()


def test_text_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "SLICE_BYTES", 10)
    for texts in ([], [""], ["a" * 35], ["abc"] * 9 + ["b" * 40, ""]):
        batch = pa.RecordBatch.from_pydict({"k": pa.array(range(len(texts))), "t": pa.array(texts, pa.string())})
        parts = [p.column(1).to_pylist() for p in packing.text_slices(batch, 1)]
        assert sum(parts, []) == texts and all(parts)


def test_bm25_neighbours():
    docs = [np.array(x) for x in ([1, 2, 3, 4], [1, 2, 9, 9], [7, 8, 9, 9], [1, 2, 3, 5], [7, 7, 8, 6])]
    got = packing.Bm25(docs).neighbours(0, np.array([False, True, True, True, True]))
    assert got.tolist() == [3, 1]


# --- near duplicates


def test_fingerprint(spark):
    text = "One two THREE"
    expected = spark.sql("SELECT xxhash64('one two three') AS h").first().h
    assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) == expected
    import xxhash

    words = [f"w{i % 11}" for i in range(40)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(38)]
    bits = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 38)
    assert simhash.fingerprint(simhash.shingle_hashes(" ".join(words), 3)) % (1 << 64) == bits


def brute_groups(points, radius):
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    label = np.arange(len(points))
    for _ in range(len(points)):
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    return label


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 6, dtype=np.uint64)
    out = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        out = out ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    return np.unique(out)


def test_vantage_tree_finds_all_pairs():
    for seed in range(3):
        points = clustered(1500, seed)
        label = np.arange(len(points))
        found = simhash.spanning_links(points, 2)
        label[found[:, 0]] = found[:, 1]
        assert (label == brute_groups(points, 2)).all()


def test_shards_and_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_NODES", 100)
    points = clustered(900, 7)
    signed = points.view(np.int64)
    nodes = spark.createDataFrame([(int(p),) for p in signed], "fp long")
    tree = simhash.build_tree(points, len(points), 2, 100)
    assert isinstance(tree, tuple)
    got = {r.node: r.label for r in simhash.groups(simhash.link_nodes(nodes, 2)).collect()}
    want = {}
    for p, g in zip(signed.tolist(), brute_groups(points, 2).tolist(), strict=True):
        want.setdefault(g, []).append(p)
    for members in want.values():
        for p in members:
            assert got.get(p, p) == min(members)


def dense(n, seed):
    """Fingerprints a few bits around two centres, most of them linked, and some far away."""
    rng = np.random.default_rng(seed)
    bit = lambda: np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    near = np.where(rng.random(n) < 0.5, np.uint64(7), np.uint64(0xFFFF)) ^ bit() ^ bit() ^ bit()
    return np.unique(np.concatenate([near, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]))


@pytest.mark.parametrize("kind", ["clustered", "dense"])
def test_shards_stay_bounded(spark, kind):
    """A small sample and many nodes: shards are split in rounds, or dealt to blocks, and no link is lost."""
    points = clustered(6000, 5) if kind == "clustered" else dense(1500, 5)
    nodes = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    start = nodes.withColumn("shard", F.lit(0).cast("long")).select("shard", "fp")
    sizes = [r["count"] for r in simhash.bounded_shards(start, 2, 100, 300).groupBy("shard").count().collect()]
    assert max(sizes) <= 300 and len(sizes) > 10
    got = {r.node: r.label for r in simhash.groups(simhash.link_nodes(nodes, 2, 100, 300, 64)).collect()}
    want = {}
    for p, g in zip(points.view(np.int64).tolist(), brute_groups(points, 2).tolist(), strict=True):
        want.setdefault(g, []).append(p)
    assert all(got.get(p, p) == min(members) for members in want.values() for p in members)


def test_one_of_each_near_copy(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(12)]
    rows, n = [], 0
    for b in base:
        for edits in (0, 1, 2, 3):
            copy = list(b)
            for _ in range(edits):
                copy[rng.randrange(200)] = "changed"
            rows.append((n, " ".join(copy)))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect())
    assert kept == list(range(0, 48, 4))


def test_near_copies_like_brute_force(spark, monkeypatch):
    """Families around the limit, in buckets larger than a chunk, and texts that share a passage or a fingerprint only."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(4):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(150)] = rng.choice(words)
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(words) for _ in range(90))
    for _ in range(60):
        tail = " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))
        texts += [f"{passage} {tail}", f"{passage} {passage} {passage} {tail}"]
    for _ in range(8):  # P and Q share a fingerprint, Q and C are alike
        line = " ".join(rng.choice(words) for _ in range(10)) + " "
        one, two = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(2))
        texts += [line * 60 + one, line * 60 + two, line + two]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    assert kept == {find(x) for x in label} and 30 < len(kept) < 300


# --- licences and secrets


def test_licence_inheritance(spark):
    mit, gpl = licences.NOTICES["MIT"][0], licences.NOTICES["GPL-3.0"][0]
    files = [("a/LICENSE", mit), ("a/x.txt", "words"), ("a/b/y.txt", "the public of this"), ("a/b/c/LICENSE", gpl + "\nmore"), ("a/b/c/z.txt", None), ("q/r.txt", ""), (None, "x")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "id int, path string, text string")
    got = {r.id: (r.licence, r.origin, r.from_directory) for r in licences.licences(df, "id").collect()}
    assert got[0] == ("MIT", "own", None) and got[1] == ("MIT", "inherited", "a") and got[2] == ("MIT", "inherited", "a")
    assert got[3] == ("GPL-3.0", "own", None) and got[4] == ("GPL-3.0", "inherited", "a/b/c") and got[5] == got[6] == (None, "none", None)


def wrapped(text, mark="", width=72):
    import textwrap

    return "\n".join(f"{mark}{line}" for line in textwrap.wrap(text, width))


def test_real_headers_and_files(spark):
    """Headers in comments, wrapped notices and whole licence files, with names and years filled in, among other text."""
    t = licences.HEADERS | licences.TEXTS
    prose = "The harbour lay still that morning and nobody spoke of the licence on the wall.\n\nA second paragraph of plain words follows."
    cases = [
        (f"MIT License\n\nCopyright (c) 2019 Some Body\n\n{wrapped(t['MIT'][0])}\n", "MIT"),
        ("The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n", "MIT"),
        ("/*\n" + wrapped("Copyright 2020 Some Company. " + t["Apache-2.0"][0], " * ") + "\n */\n\nint main() { return 0; }\n" + prose, "Apache-2.0"),
        (f"BSD 3-Clause License\n\nCopyright (c) 2018, Them\n\n{wrapped(t['BSD-3-Clause'][0])}", "BSD-3-Clause"),
        (f"Copyright (c) 2018, Them\n\n{wrapped(t['BSD-2-Clause'][0])}", "BSD-2-Clause"),
        ("#!/usr/bin/env python\n#\n" + wrapped("Copyright (C) 2021 A. Uthor. " + t["GPL-3.0"][0], "# ") + "\n\nimport os\n", "GPL-3.0"),
        (wrapped(t["LGPL-2.1"][0], "// ") + "\n\n" + prose, "LGPL-2.1"),
        (wrapped(t["MPL-2.0"][0], "; "), "MPL-2.0"),
        (wrapped(t["ISC"][0]), "ISC"),
        ("// SPDX-License-Identifier: GPL-2.0\n" + prose, "GPL-2.0"),
        ("# Use of this source code is governed by a BSD-style license that can be\n# found in the LICENSE file.\n\n" + prose, "BSD-3-Clause"),
        ("# This work is licensed under the GNU General\n# Public License, version 3.\n" + prose, "GPL-3.0"),
        (prose, None),
        ("We must use, copy and modify the software without permission, the author said, and distribute it for any purpose.", None),
    ]
    rows = [(i if i else None, f"d{i}/f", x) for i, (x, _) in enumerate(cases)]  # one row without an id
    df = spark.createDataFrame(rows, "id long, path string, text string")
    got = {r.path: r.licence for r in licences.licences(df, "id").collect()}
    assert got == {f"d{i}/f": want for i, (_, want) in enumerate(cases)}


def test_trigram_queries():
    q = trigrams.trigram_query
    assert q("AKIA[A-Z0-9]{12,}") == [frozenset({"aki", "kia"})] and q("[0-9a-f]{32,}") is None and q("abc?") is None
    assert set(q("(foobar|quux)+z")) == {frozenset({"foo", "oob", "oba", "bar"}), frozenset({"quu", "uux"})}
    assert q("x(abc|d)y") is None or all(len(s) for s in q("x(abc|d)y"))


def test_secrets_like_definition(spark):
    import re

    rng = random.Random(5)
    bits = ["password", "PASSWD", "Secret", "api_key", "apikey", "token", "=", ": ", '"', "'", " ", "abc", "12345678", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "😀", "\n", "="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    for r in secrets.scan(docs).collect():
        spans = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(rules) for m in p.finditer(texts[r.doc_id]) if len(m[g]) >= n]
        text = ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]


# --- neighbours


def near_vectors(kind):
    rng = np.random.default_rng(3)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    if kind == "random":
        return rng.normal(size=(6000, 24)), ()
    if kind == "clusters":
        return unit(unit(rng.normal(size=(60, 24)))[rng.integers(0, 60, 6000)] + 0.1 * rng.normal(size=(6000, 24))), ()
    x = unit(unit(rng.normal(size=(1, 16))) + 0.05 * rng.normal(size=(6000, 16)))  # one dense cluster
    outliers = range(0, 6000, 300)
    x[::300] = unit(rng.normal(size=(20, 16)))
    return x, outliers


@pytest.mark.parametrize("kind", ["random", "clusters", "outliers"])
def test_recall(spark, kind):
    x, outliers = near_vectors(kind)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 60 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    share = {}
    for q in range(0, 6000, 60):
        s = x @ x[q]
        s[q] = -np.inf
        own = sorted(got[q], key=lambda r: (-r.score, r.vec_id))
        assert [r["rank"] for r in own] == list(range(1, 21))  # no query is short
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
        share.setdefault(q in outliers, []).append(len(set(np.argsort(-s)[:20].tolist()) & {r.vec_id for r in own}) / 20)
    assert all(np.mean(v) >= 0.9 for v in share.values()) and len(share) == (2 if kind == "outliers" else 1)


def test_all_rows_for_the_rest(spark, monkeypatch):
    """With one bucket a table and visit, most queries need the last table; equal vectors tie by id; ids repeat."""
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.ones((700, 6)), rng.normal(size=(1300, 6))])
    ids = np.append(np.arange(1900), np.arange(100))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    # Each id's own best vector as a query: ids from 100 on are there once.
    got = {}
    for r in neighbours.search(df, (F.col("vec_id") % 50 == 0) & (F.col("vec_id") >= 100), rounds=(1,)).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    exact = 0
    for q in range(100, 1900, 50):
        best = {}
        for i, s in zip(ids.tolist(), (x @ x[q]).tolist(), strict=True):
            if i != q:
                best[i] = max(best.get(i, -np.inf), s)
        want = sorted((-round(s, 9), i) for i, s in best.items())[:20]
        assert len(got[q]) == 20
        exact += [i for _, i in want] == [i for _, i in sorted((round(s, 9), i) for s, i in got[q])]
    assert exact >= 34  # of 36


def test_probe_order():
    f = np.array([0.1, 0.45])
    cells = neighbours.probe_steps(f, 60)
    assert len({tuple(c) for c in cells.tolist()}) == 60 and cells[0].tolist() == [0, 0] and cells[1].tolist() == [-1, 0]

    def cost(c):
        return sum((c[j] - f[j]) ** 2 if c[j] > f[j] else (f[j] - c[j] - 1) ** 2 if c[j] < np.floor(f[j]) else 0 for j in range(2))

    assert all(cost(a) <= cost(b) + 1e-12 for a, b in zip(cells, cells[1:], strict=False))


# --- archives


def test_archive_bytes(spark):
    zstandard = pytest.importorskip("zstandard")
    records = [warc.record(i, f"http://x/{i}", f"<p>{'page ' * 50}{i}</p>".encode(), None if i % 3 else (i - 1 if i else None)) for i in range(300)]
    data = warc.build_archive(records)
    assert data[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])
    rows = list(warc.read_archive(data))
    assert [r[1] for r in rows] == list(range(300)) and rows[3][0] == "revisit" and rows[3][5] is None and rows[4][5] == f"<p>{'page ' * 50}4</p>".encode()
    size = int.from_bytes(data[4:8], "little")
    frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert frame.decompress(data[8 + size :]) == records[0]  # the first record is a frame of its own
    assert list(warc.read_archive(warc.build_archive([warc.record(1, None, b"", None)])))[0][4] == 0
