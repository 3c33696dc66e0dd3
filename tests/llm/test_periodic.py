"""Periodic runs against the definition: every period of every stretch."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seaward.llm import periodic

SF = "/root/testdata/sf0.01"


def brute(words):
    """Runs by definition, period by period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q if j > i else 0
            if length >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), max_size=5))
def test_two_letters(texts):
    assert periodic.runs_of_texts(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("seed", range(40))
def test_nested_repetitions(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(30):
        words: list = []
        while len(words) < rng.choice([5, 60, 400]):
            root = [rng.choice("abcdefg"[: rng.choice([1, 2, 7])]) for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 40]))]
            if rng.random() < 0.4:
                root = root * rng.choice([2, 4, 5]) + [rng.choice("ab")]
            words += (root * rng.choice([1, 2, 3, 4, 5, 9]))[: rng.randrange(1, 500)]
        texts.append(words)
    assert periodic.runs_of_texts(texts) == [brute(t) for t in texts]


def test_long_periods():
    rng = random.Random(1)
    root = [rng.randrange(50) for _ in range(1023)]
    texts = [[1] * 5000, root * 4, root * 3 + root[:-1], [98] + root * 6 + [99], (root[:100] * 5 + root[:3]) * 4]
    got = periodic.runs_of_texts(texts)
    assert got[0] == [(0, 5000, 1)] and got[1] == [(0, 4092, 1023)] and got[2] == [] and got[3] == [(1, 6138, 1023)]
    assert (0, 2012, 503) in got[4] and sum(q == 100 for _, _, q in got[4]) == 4


def test_separated_texts_do_not_meet():
    assert periodic.runs_of_texts([["a"] * 3] * 9 + [[], ["a", "b"] * 3]) == [[]] * 11


def test_chosen_positions_are_sparse():
    w = np.random.default_rng(0).integers(0, 2**63, 100_000).astype(np.uint64)
    assert len(periodic.synchronising(w, 64)) < 4 * len(w) / 64


def test_collapsed():
    words = list("xabababaab")
    runs = periodic.runs_of_texts([words * 1])[0]
    assert runs == [] and periodic.collapsed(words, runs) == words
    words = list("zxyxyxyxyxyq")
    assert periodic.collapsed(words, periodic.runs_of_texts([words])[0]) == list("zxyq")
    assert "".join(periodic.collapsed(list("aaaaaabababab"), [(0, 6, 1), (5, 8, 2)])) == "ab"


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_query(spark):
    import re

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in periodic.op13_periodic_runs(spark, SF).collect()}
    assert got.keys() == texts.keys()
    some = 0
    for i, t in texts.items():
        words = planted(i, re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        if len(words) > 1500:
            continue
        runs, r = brute(words), got[i]
        dropped = {x for s, n, q in runs for x in range(s + q, s + n)}
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for x, w in enumerate(words) if x not in dropped).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3) and r.exponent_milli == (None if best is None else 1000 * best[1] // best[2])
        some += bool(runs)
    assert some > 20


def test_odd_rows(spark):
    rows = [(1, None), (None, "a b " * 9), (None, "a b " * 9), (3, ""), (4, " \x1c\x85  \n"), (5, "x " * 300_000), (6, "é è\t" * 8)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, runs string")
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.repeats(docs).collect()), key=repr)
    want = [(1, 0, [], ""), (3, 0, [], ""), (4, 1, [], "\x1c\x85 "), (5, 300_000, [(0, 300_000, 1)], "x"), (6, 16, [(0, 16, 2)], "é è"), *[(None, 18, [(0, 18, 2)], "a b")] * 2]
    assert got == sorted(want, key=repr)
    assert periodic.repeats(docs.limit(0)).count() == 0
