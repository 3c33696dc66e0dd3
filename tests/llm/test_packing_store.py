"""What packing stores and works out of it: short ids, counts of the tokenising tasks, keys of many documents at once."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from seaward.llm import packing


@pytest.fixture
def docs(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdeéÉ", k=rng.randint(1, 6))) for _ in range(rng.choice([0, 2, 40]))) for _ in range(300)]
    return spark.createDataFrame(list(enumerate([*texts, None, "One 漢 two\x85three."])), "doc_id long, text string").repartition(5)


def test_short_ids_and_counts_of_the_same_pass(spark, docs):
    path = P.path("word_bpe_49k.json")
    plain = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.tokenised(docs, path).collect()}
    short = packing.tokenised(docs, path, short=True)
    rows = short.filter("n > 0").collect()
    assert all(len(r.ids) == 2 * r.n for r in rows)
    assert {r.doc_id: packing.ids_of(r.ids, r.n).tolist() for r in rows} == plain
    one, two = packing.statistics(short), packing.statistics(packing.tokenised(docs, path))
    assert one[1:] == two[1:] == (302, sum(map(len, plain.values())))
    want = np.zeros(len(one[0].df), dtype=int)
    for ids in plain.values():
        want[list(set(ids))] += 1
    assert (one[0].df == want).all() and (two[0].df == want).all()


def test_wide_vocabularies_keep_their_ids(spark, docs):
    """A vocabulary beyond 16 bits keeps 32 bits an id, and pieces' sums are of 32-bit ids in either case."""
    ids = np.array([70_000, 5, 70_000, 2], "<u4")
    assert packing.ids_of(ids.tobytes(), 4).tolist() == ids.tolist()
    assert [x.tolist() for x in packing.distinct(np.append(ids, ids[:1]), np.array([4, 1]))] == [[0, 0, 0, 1], [2, 5, 70_000, 70_000], [1, 1, 2, 1]]
    for r in packing.pack(docs, P.path("word_bpe_49k.json"), keep_ids=True).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_keys_by_definition():
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.5, n) % 90 for n in rng.integers(1, 60, 200)] + [np.array([95]), np.array([96, 96])]
    known = packing.Statistics.of(docs)
    for kind in ("<u2", "<u4"):
        got = known.keys(np.concatenate(docs).astype(kind), np.array([len(d) for d in docs]))
        for d, found in zip(docs, got.tolist(), strict=True):
            tf = {int(t): int((d == t).sum()) for t in d if known.df[t] > 1}
            norm = packing.K1 * (1 - packing.B + packing.B * len(d) / known.mean)
            best = sorted((-known.idf[t] * n * (packing.K1 + 1) / (n + norm), t) for t, n in tf.items())[: packing.KEY_TERMS]
            assert found == [t for _, t in best] + [-1] * (packing.KEY_TERMS - len(best))
