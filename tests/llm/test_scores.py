"""The two classifiers' scores against their definitions: counts, log-odds, segments and curves worked out plainly."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_segments

from seaward.llm import common, quality, toxicity

SF = "/root/testdata/sf0.01"
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_toxicity_scores_by_definition(spark):
    large = SF.replace("0.01", "0.1")  # toxic documents are rare
    docs, labels = spark.read.parquet(f"{large}/documents.parquet"), toxicity.training_labels(spark, large)
    model = toxicity.fit(docs, labels)
    # units: documents of each label that hold them, in the part of the sample that is learnt from, near copies once
    sample = common.labelled_sample(docs, labels, "doc_id", "text", toxicity.SAMPLE, "sample")
    learn = common.once_by(common.once_by(sample.filter(F.pmod(F.xxhash64("shape"), F.lit(4)) != 0), "shape"), "shape2").collect()
    word = re.compile(r"[^\W\d_]+")
    held: dict = {0: Counter(), 1: Counter()}
    for r in learn:
        held[r.label].update({u for w in word.findall(r.text.lower()) for u in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)]})
    n = [sum(held[v].values()) for v in (0, 1)]
    prior, want = 0.01 * sum(n), {}
    for u in held[1]:
        if held[1][u] < 3:
            continue
        a = prior / sum(n) * (held[0][u] + held[1][u])
        one, zero = held[1][u] + a, held[0][u] + a
        delta = math.log(one / (n[1] + prior - one)) - math.log(zero / (n[0] + prior - zero))
        if delta / math.sqrt(1 / one + 1 / zero) >= 3.5:
            want[u] = min(delta, 8.0)
    assert model.score_of.keys() == want.keys() and want and all(abs(model.score_of[u] - want[u]) < 1e-9 for u in want)
    got = {r.doc_id: r.score for r in toxicity.op1_toxicity(spark, large).collect()}
    some = 0
    near = [i for i, s in got.items() if s > 0.3][:40]
    for r in docs.filter(F.col("doc_id").isin(near) | ((F.length("text") < 300) & (F.col("doc_id") % 7 == 0))).collect():
        words = word.findall(r.text.lower())
        scores = [max(want.get(u, 0.0) for u in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]) or -0.5 for w in words]
        if len(words) > 90:
            continue
        excess = [model.rate * s - math.log(max(model.scale * max(len(words), 1), 1e-9)) for s, _, _ in brute_segments(scores)]
        p = 1 / (1 + math.exp(-(model.slope * math.log1p(sum(x for x in excess if x > 0)) + model.offset)))
        assert abs(got[r.doc_id] - p) < 1e-9
        some += p > 0.5
    assert some > 0 and model.slope > 0


def test_quality_scores_by_definition(spark, docs):
    model = quality.fit(docs, quality.training_labels(spark, SF))
    got = {r.doc_id: r.score for r in quality.op5_quality_pairs(spark, SF).collect()}
    bins = model.weights.reshape(len(quality.MEASURES), quality.BINS)
    for r in docs.collect():
        x = quality.measures(r.text or "")
        raw = sum(bins[j][sum(e < v for e in model.edges[j])] for j, v in enumerate(x))  # the bin: how many edges lie below
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-(raw - model.cut)) * 3 / 7)) < 1e-6
    assert len(got) == docs.count()


def test_pairwise_likelihood_is_at_its_maximum():
    rng = np.random.default_rng(2)
    differences = rng.normal(size=(400, 6)) + np.array([1.0, 0.5, 0, 0, -1, 0])
    w = quality._learn_pairs(differences)

    def penalised(v):
        return np.log1p(np.exp(-differences @ v)).sum() + quality.RIDGE / 2 * v @ v

    for i in range(6):
        for step in (1e-3, -1e-3):
            assert penalised(w + step * np.eye(6)[i]) > penalised(w)


def test_measures_by_definition():
    text = "AB cd cd 12!! é\nAB cd cd 12!! é\n### x"
    m = dict(zip(quality.MEASURES, quality.measures(text), strict=True))
    data, words = text.encode(), text.split()
    assert m["log_bytes"] == math.log1p(len(data)) and m["word_length"] == len(text) / len(words)
    assert m["marks"] == 4 / len(words) and m["digits"] == 4 / len(data) and m["capitals"] == 4 / len(data)
    assert m["repeats"] == 2 / len(words) and m["lines_repeat"] == 1 - 2 / 3 and m["longest_word"] == 4
    assert m["pair_repeats"] == 1 - len(set(zip(words, words[1:], strict=False))) / (len(words) - 1)
    assert m["capital_words"] == 2 / len(words) and m["distinct"] == len(set(words)) / len(words) ** 0.8
