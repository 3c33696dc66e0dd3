"""Cases in which estimates, chunks or caps once decided: results must be those of the whole job."""

import random
from itertools import combinations

import numpy as np
import pytest
from test_pipeline import one_of_each, shingles

from seaward.llm import packing, simhash

P = pytest.importorskip("public_tokenizers")


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


# --- near duplicates


def test_family_on_one_template_is_compared_exactly(spark):
    rng = random.Random(5)
    base, texts = words(rng, 300), []
    for _ in range(60):
        text = list(base)
        for at in rng.sample(range(0, 300, 5), 5):
            text[at] = words(rng, 1)[0]
        texts.append(" ".join(text))
    copy = texts[7].split()
    copy[100:104] = words(rng, 4)
    texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in combinations(sets, 2)]
    assert 0.69 < sorted(alike)[len(alike) // 2] < 0.76
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = one_of_each(docs.collect())
    assert len(want) > 40
    assert {r.doc_id for r in simhash.keep_one_of_each(docs).collect()} == want


def test_pairs_that_meet_in_hot_buckets_only(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 2)
    rng = random.Random(9)
    passage = words(rng, 200)
    texts = [" ".join(passage + words(rng, n)) for n in [20] * 2 + [60] * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = shingles(texts[0]), shingles(texts[1])
    assert len(a & b) / len(a | b) >= 0.8
    assert {r.doc_id for r in simhash.keep_one_of_each(docs).collect()} == set(range(302)) - {1}


def test_all_open_pairs_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 3)
    keys = spark.createDataFrame([(b, b, n) for b, size in ((1, 20), (2, 3), (3, 12)) for n in range(size)], "bucket long, band int, node long")
    grouped = spark.createDataFrame([(n, 0 if n < 12 else n) for n in range(14)], "node long, label long")
    by_group, met = {}, set()
    for r in simhash.open_rows(keys, grouped).collect():
        by_group.setdefault(r.grp, []).append(r)
    for rows in by_group.values():
        assert len(rows) < 20
        met |= {tuple(sorted((x.node, y.node))) for x, y in combinations(rows, 2) if x.label != y.label and (x.side == 0 or x.side != y.side)}
    assert met == {(x, y) for x, y in combinations(range(20), 2) if y >= 12}  # nodes under 12 are one group already


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rng = random.Random(2)
    one, other, third = (" ".join(words(rng, 50)) for _ in range(3))
    rows = [(1, one), (1, other), (2, one), (3, third), (3, third)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one_of_each(docs).collect())) == sorted([(1, one), (1, other), (3, third)])


# --- retrieval packing


def test_window_is_filled_down_the_ranking():
    """A seed's true neighbours come before strangers, also by its weaker tokens and beyond the best 64."""
    rng = np.random.default_rng(3)
    seed = np.arange(100, 200)
    near = [np.concatenate([[100 + i % 100], rng.integers(1000, 1500, 5)]) for i in range(200)]
    far = [rng.integers(2000, 2500, 50) for _ in range(30)]
    order = packing.packing_order([seed, *near, *far], 1200)
    assert set(order[:184]) <= set(range(201))  # 100 tokens and 184 documents of 6 tokens fill the window


def test_related_documents_meet_wherever_their_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)
    rng = random.Random(4)
    common = ["river", "stone", "green", "house", "light", "paper", "table", "water", "small", "north"]
    topics = ["zebra", "piano", "volcano", "oxygen", "chess", "diamond", "penguin", "algebra"] * 10
    texts = [" ".join(rng.choice([*common, topic, topic]) for _ in range(800)) for topic in topics]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    path = P.path("word_bpe_49k.json")
    runs = [sorted(tuple(r) for r in packing.pack(docs.repartition(n), path).collect()) for n in (1, 16)]
    assert runs[0] == runs[1]
    held = {}
    for r in runs[0]:
        held.setdefault(r[5], []).append(r[0] % 8)
    whole = [w for w in held.values() if len(w) > 3]
    assert sum(max(w.count(t) for t in w) for w in whole) > 0.7 * sum(map(len, whole))


# --- tables beyond what is sent to all tasks


@pytest.mark.parametrize("few", [0, 500_000])
def test_secrets_and_revisits_beyond_a_broadcast(spark, monkeypatch, few):
    from pyspark.sql import functions as F

    from seaward.llm import secrets, warc

    monkeypatch.setattr(secrets, "FEW", few)
    monkeypatch.setattr(warc, "FEW", few)
    rng = random.Random(2)
    bits = ["password=abcdefgh", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "plain words", "token", "x", None]
    docs = spark.createDataFrame([(rng.choice([i, None, 7]), rng.choice(bits)) for i in range(300)], "doc_id long, text string")
    got = {(r.doc_id, r.spans) for r in secrets.scan(docs).collect()}
    kinds = {"password=abcdefgh": "assign:0:17", "AKIAABCDEFGHIJKL": "access:0:16", "0123456789abcdef" * 2: "hex:0:32"}
    assert got == {(r.doc_id, kinds.get(r.text, "")) for r in docs.collect()} and secrets.scan(docs).count() == 300
    assert sorted(r.text or "" for r in secrets.redact(docs).collect()) == sorted({"password=abcdefgh": "<assign>", "AKIAABCDEFGHIJKL": "<access>", "0123456789abcdef" * 2: "<hex>"}.get(r.text, r.text or "") for r in docs.collect())
    plan = secrets.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning" in plan) == (few == 0)
    pages = docs.select(F.monotonically_increasing_id().alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    first: dict = {}
    rows = [(r.page_id, r.html or "") for r in pages.collect()]
    for i, t in sorted(rows):
        first.setdefault(t, i)
    assert {(r.page_id, r.refers_to) for r in warc.mark_revisits(pages).collect()} == {(i, None if first[t] == i else first[t]) for i, t in rows}


def plain_order(docs, window):
    """The packing order by the definition of BM25, pair by pair."""
    import math

    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    counts = [{t: list(d).count(t) for t in set(d.tolist())} for d in docs]
    df = {t: sum(t in c for c in counts) for c in counts for t in c}

    def score(q, d):
        shared = counts[q].keys() & counts[d].keys()
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * counts[d][t] * 2.2 / (counts[d][t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in shared)

    free, order, filled, seed = set(range(n)), [], 0, None
    while free or len(order) < n:
        if seed is None:
            seed = min(free, key=lambda d: (-len(docs[d]), d))
            free.discard(seed)
            order.append(seed)
            filled += len(docs[seed])
        room, current, seed = -filled % window, seed, None
        ranked = sorted(((-score(current, d), d) for d in free), key=lambda x: (round(x[0], 9), x[1])) if room else []
        for s, d in ranked:
            if s > -1e-12:
                break
            free.discard(d)
            order.append(d)
            filled += len(docs[d])
            room -= len(docs[d])
            if room <= 0:
                seed = d if room < 0 else None
                break
    return order


@pytest.mark.parametrize("seed", range(5))
def test_whole_shard_in_the_order_of_plain_bm25(seed):
    rng = np.random.default_rng(seed)
    docs = [np.concatenate([rng.integers(0, 60, rng.integers(1, 40)), rng.zipf(1.6, rng.integers(0, 30)) % 400]) for _ in range(90)]
    docs += [docs[5], docs[9]]
    assert packing.packing_order(docs, 128) == plain_order(docs, 128)


def test_many_tiny_shards_in_few_ranges(spark, monkeypatch):
    """Ranges and sample are bounded; a range is cut in shards as its rows pass by, and every id is in one piece."""
    import zlib

    monkeypatch.setattr(packing, "SHARD_TOKENS", 300)
    monkeypatch.setattr(packing, "RANGES", 3)
    monkeypatch.setattr(packing, "LEAST_SAMPLE", 40)
    monkeypatch.setattr(packing, "MOST_SAMPLE", 60)
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(words(rng, rng.choice([0, 3, 30])))) for i in range(400)], "doc_id long, text string")
    path = P.path("word_bpe_49k.json")
    tokens = packing.tokenised(docs, path)
    known, n, total = packing.statistics(tokens)
    cuts = packing.range_cuts(tokens, known, n, total)
    assert total > 30 * packing.SHARD_TOKENS and 1 <= len(cuts) <= 2
    seen = []
    monkeypatch.setattr(packing, "packing_order", lambda d, w, k, f=packing.packing_order: seen.append(sum(map(len, d))) or f(d, w, k))
    rows = packing.pack(docs, path, keep_ids=True).collect()
    again = packing.pack(docs.repartition(9), path, keep_ids=True).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    want = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokens.collect()}
    assert {d: [t for _, ids in sorted(p) for t in ids] for d, p in pieces.items()} == want
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert len({s >> 32 for s in sequences}) == len(cuts) + 1 and len(sequences) > 30


# --- hot keys


def test_join_with_hot_keys(spark, monkeypatch):
    from seaward.llm import common

    left = spark.createDataFrame([(0, i) for i in range(300)] + [(i % 7, i) for i in range(70)] + [(None, 1)], "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in range(6)], "k long, w long")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    for rows in (50_000, 20):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        assert sorted(map(tuple, common.join_hot(left, right, "k", "v").collect())) == want
    assert common.join_hot(left.limit(0), right, "k", "v").count() == 0


@pytest.mark.parametrize("hot", [1, 50_000])
def test_components_with_hot_keys_and_parts(spark, monkeypatch, hot):
    from seaward.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(simhash, "SHARD_NODES", 64)
    monkeypatch.setattr(simhash, "PART_NODES", 50)
    rng = np.random.default_rng(4)
    centres = rng.integers(-(2**63), 2**63, 12)
    points = np.unique(np.concatenate([centres[rng.integers(0, 12, 900)] ^ (1 << rng.integers(0, 62, 900)) ^ (rng.integers(0, 2, 900) << rng.integers(0, 62, 900)), rng.integers(-(2**63), 2**63, 300), [0]]))
    prints = spark.createDataFrame([(i, int(p)) for i, p in enumerate(points)] + [(5000 + i, 0) for i in range(200)] + [(5300, int(points[3]))], "doc_id long, fp long")
    found = simhash.components(prints, simhash.link_nodes(prints.select("fp").distinct(), 2, shard_nodes=64, most=128, sampled=256)).collect()
    label = {int(p): int(p) for p in points}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    unsigned = points.view(np.uint64)
    for i, p in enumerate(points):
        for q in points[np.flatnonzero(np.bitwise_count(unsigned ^ unsigned[i]) <= 2)]:
            a, b = root(int(p)), root(int(q))
            label[max(a, b)] = min(a, b)
    first: dict = {}
    for r in sorted(prints.collect()):
        first.setdefault(root(r.fp), r.doc_id)
    assert {(r.doc_id, r.component_id) for r in found} == {(r.doc_id, first[root(r.fp)]) for r in prints.collect()} and len(found) == prints.count()
