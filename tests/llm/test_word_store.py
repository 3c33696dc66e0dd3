"""The packing worker's store of words: little memory for each, few calls of the tokenizer, ids as the tokenizer's own."""

import itertools
import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from seaward.llm import packing

PATH = P.path("word_bpe_49k.json")


def ids(tokens, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)]


def test_memory_of_a_word():
    """A kept word took some 130 bytes as Python objects."""
    words = list(itertools.islice(map("".join, itertools.product("abdeghilmnorstuv", repeat=5)), 100_000))
    tokens = packing.Tokens(PATH)
    tokens.encode(["a b"])  # imports
    tracemalloc.start()
    tokens.encode([" ".join(words)])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 90 * len(words)


def test_words_with_runs_of_signs_are_cut():
    """Known words with known signs behind them need no call, whatever their case."""
    tokens = packing.Tokens(PATH)
    texts = ["Élan### the.$$$ WORD!! word,*** (x) it's [the]_", "word' the'' 's. word'.s !!! word" + "!" * 40]
    want = [e.ids for e in tokens.model.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids(tokens, texts) == want
    asked = []
    known, encode = "élan!! ÉLAN.$$$ the### Word,*** THE!!", tokens._encode_parts
    tokens._encode_parts = lambda parts: asked.extend(parts) or encode(parts)
    tokens._encode_words = tokens._encode_parts
    assert ids(tokens, [known]) == [tokens.model.encode(known, add_special_tokens=False).ids] and not asked


def test_store_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 300)
    rng, tokens = random.Random(2), packing.Tokens(PATH)
    for _ in range(12):
        texts = [" ".join("".join(rng.choices("abcdeéÉ", k=rng.randint(1, 18))) for _ in range(40)) + ".$" for _ in range(4)]
        assert ids(tokens, texts) == [e.ids for e in tokens.model.encode_batch_fast(texts, add_special_tokens=False)]
        assert len(tokens.store.ends) <= 300


def test_words_of_one_hash(monkeypatch):
    """Words are compared whole: equal hashes give no wrong ids."""
    monkeypatch.setattr(packing.Words, "_hash", staticmethod(lambda keys: keys[:, 0] & np.uint64(1)))
    tokens, texts = packing.Tokens(PATH), ["one two three four five six seven eight nine ten eleven", "ten nine one twelve two"]
    for _ in range(3):
        assert ids(tokens, texts) == [e.ids for e in tokens.model.encode_batch_fast(texts, add_special_tokens=False)]


def test_used_documents_leave_the_index():
    """The order is that of an index that keeps them."""
    rng = np.random.default_rng(1)
    docs = [np.append(rng.zipf(1.4, n) % 500, 2) for n in rng.integers(1, 90, 300)]
    got = packing.packing_order(docs, 256)
    assert sorted(got) == list(range(300))
    index, free = packing.Bm25(docs), np.ones(300, dtype=bool)
    for d in got[:200]:
        free[d] = False
    whole = [index.neighbours(s, free).tolist() for s in got[190:200]]
    size = len(index.docs)
    index.keep(free)
    assert len(index.docs) < size / 2 and [index.neighbours(s, free).tolist() for s in got[190:200]] == whole


def test_empty_arrays():
    assert packing.word_keys(pa.array([], pa.large_string())).shape == (0, 2)
    assert ids(packing.Tokens(PATH), []) == [] and ids(packing.Tokens(PATH), ["", " "]) == [[], []]


def test_tokenising_workers_get_short_batches(spark, monkeypatch):
    """Spark sends about ``BATCH_BYTES`` of text at once, and the session's setting is as before."""
    import pyarrow.compute as pc

    def slices(batch, column, whole=packing.text_slices):
        assert pc.sum(pc.binary_length(batch.column(column))).as_py() < 2 * packing.BATCH_BYTES
        return whole(batch, column)

    monkeypatch.setattr(packing, "text_slices", slices)
    before = spark.conf.get(packing.BATCH_SETTING)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 900) AS text")
    assert packing.tokenised(docs, PATH).count() == 4000 and spark.conf.get(packing.BATCH_SETTING) == before
