"""Spelling variants against a search through all words with one letter left out, and against all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seaward.llm import spelling

SF = "/root/testdata/sf0.01"


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def expected(counts, ratio=10):
    """(form, root, n, n_near, form_n) of each word; neighbours meet in a word with one letter left out."""
    meet = defaultdict(set)
    for w in counts:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            meet[x].add(w)
    near = {w: {v for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in meet[x] if v != w and is_near(v, w)} for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]])
    return out


def counted(texts, change=True):
    out: Counter = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if change and i is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def table(spark, counts):
    return spark.createDataFrame(sorted(counts.items()), "word string, n long")


def rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query(spark):
    want = expected(counted([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]))
    got = spelling.op12_spelling_variants(spark, SF).collect()
    assert len(got) == len(want) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert sum(v[0] is not None for v in want.values()) > 50


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcÿ", min_size=1, max_size=5), min_size=2, max_size=30, unique=True), st.integers(1, 30))
def test_products_find_all_pairs(words, left):
    left = min(left, len(words))
    a, b = spelling.near_pairs(left, words, True)
    assert sorted(map(tuple, map(sorted, zip(a.tolist(), b.tolist(), strict=True)))) == [(i, j) for i in range(left) for j in range(i + 1, len(words)) if is_near(words[i], words[j])]
    a, b = spelling.near_pairs(left, words, False)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in range(left) for j in range(left, len(words)) if is_near(words[i], words[j])]


@pytest.mark.parametrize("tile", [1024, 5])
def test_hot_blocks_and_chains(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = random.Random(4)
    counts = {}
    for _ in range(400):  # few letters: many words in few blocks
        w = list("abababab")
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice("abc")
        counts["".join(w)[: rng.choice([7, 8])]] = rng.choice([2, 3, 25, 400, 5000])
    counts |= {"chained" + "x" * k: 2 * 10**k for k in range(7)}  # a chain of forms, ten times as frequent at each step
    got = rows(spelling.variants(table(spark, counts)))
    assert got == expected(counts) and got["chained"][1] == "chainedxxxxxx"


def test_odd_rows(spark):
    long = "q" * 40_000
    data = [(1, None), (2, ""), (3, f"{long} {long} {long}r"), (4, f"{long}r word12345"), (None, "WINDOWS windows Éclàirs Éclàirs éclàirs éclàirs"), (None, "WindowS windo×s"), (None, "WindowS windo×s")]
    docs = spark.createDataFrame([(*r, 1, 1) for r in data], "doc_id long, text string, n long, block long")
    assert rows(spelling.variants(spelling.word_counts(docs, change=spelling.misspelt))) == expected(counted(data))
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0
    assert spelling.variants(spelling.word_counts(docs.filter("doc_id < 3"))).count() == 0


def test_counts_are_handed_on(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.lit(None).cast("long"))
    monkeypatch.setattr(spelling, "HELD", 10)
    got = {r.word: r.n for r in spelling.word_counts(docs).filter("n > 1").collect()}
    assert got == counted([(None, r.text) for r in docs.collect()])
