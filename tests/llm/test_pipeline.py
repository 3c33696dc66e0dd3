"""The whole pipeline against a plain version of each stage, on the smallest tables."""

import re
from itertools import combinations

import pytest

import corpus_pipeline
from seaward.llm import quality, secrets, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def one_of_each(rows):
    """Smallest id of each group of texts whose shingle sets are 0.8 alike."""
    label = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    sets = {r.doc_id: shingles(r.text) for r in rows}
    for a, b in combinations(sorted(label), 2):
        alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if alike >= 0.8:
            label[max(find(a), find(b))] = min(find(a), find(b))
    return {find(x) for x in label}


def redacted(text):
    for r in secrets.RULES:
        p = re.compile(r.pattern, re.A | (re.I if r.any_case else 0))
        text = p.sub(lambda m, r=r: f"<{r.kind}>" if len(m[r.group]) >= r.least else m[0], text)
    return text


def test_stages_like_plain_versions(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]

    model = quality.fit(docs, quality.training_labels(spark, SF))
    kept = stages[0](spark, docs, SF).cache()
    want = {r.doc_id for r in docs.collect() if model.score_texts([r.text])[0] >= 0.7}
    assert {r.doc_id for r in kept.collect()} == want and want

    toxic = toxicity.fit(kept, toxicity.training_labels(spark, SF))
    clean = stages[1](spark, kept, SF).cache()
    want = {r.doc_id for r in kept.collect() if toxic.score(r.text) < 0.5}
    assert {r.doc_id for r in clean.collect()} == want and want

    once = stages[2](spark, clean, SF).cache()
    assert {r.doc_id for r in once.collect()} == one_of_each(clean.collect())

    masked = stages[3](spark, once, SF).cache()
    texts = {r.doc_id: r.text for r in once.collect()}
    rows = masked.collect()
    assert len(rows) == len(texts) and all(r.text == redacted(texts[r.doc_id]) for r in rows)

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = stages[4](spark, masked, SF).collect()
    lengths = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert lengths == {r.doc_id: len(model.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows}


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and got.count() > 50
