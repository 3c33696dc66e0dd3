"""What executors and workers hold in a long job: batches of bounded size in each stage, and no tokenizer kept after its use."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seaward.llm import packing

TEXTS, BYTES = 300, 40_000


def largest_batch(docs):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    return docs.mapInArrow(run, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages_send_small_batches(spark, stage, monkeypatch):
    session = spark.newSession()
    docs = session.range(TEXTS, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), BYTES).alias("text"))
    for module, name in ((corpus_pipeline.quality, "fit"), (corpus_pipeline.quality, "training_labels"), (corpus_pipeline.toxicity, "fit"), (corpus_pipeline.toxicity, "training_labels")):
        monkeypatch.setattr(module, name, lambda *_: None)  # only the settings matter here
    monkeypatch.setattr(corpus_pipeline.simhash, "keep_one_of_each", lambda d: d)
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda d, _: d)
    stage(session, docs, "")
    assert largest_batch(docs) < TEXTS * BYTES / 2


def test_dropped_tokenizers_are_not_kept():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    before = packing.Tokens.get(path).encode(["Some words, some signs."])
    packing.Tokens.drop()
    assert not packing.Tokens._made
    assert packing.Tokens.get(path).encode(["Some words, some signs."]) == before
