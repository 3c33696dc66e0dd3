"""The quality model is learnt from every labelled row, not from a bounded sample."""

import numpy as np
from pyspark.sql import functions as F

from seaward.llm import quality


def test_every_row_is_in_a_pair(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 280, 0).otherwise(1).alias("label"), F.col("id").alias("shape"), F.array(*[F.col("id").cast("double")] * len(quality.MEASURES)).alias("x"))
    edges = np.tile(np.linspace(20, 280, quality.BINS - 1), (len(quality.MEASURES), 1))
    model = quality.Model(edges, np.zeros(edges.shape[0] * quality.BINS), 0.0)
    got = quality._pairs(rows, model, 1).collect()
    bins = lambda ids: sorted(int(np.searchsorted(edges[0], i)) for i in ids)
    assert len(got) == 280 and sorted(r.bad[0] for r in got) == bins(range(280))  # each of label 0 once
    assert {r.good[0] for r in got} == set(bins(range(280, 300)))
    x = np.array([[float(i)] * edges.shape[0] for i in (0, 50, 299)])
    assert (model.of_codes([model.codes(v) for v in x]) == model.design(x)).all()


def test_all_labelled_rows_are_measured(spark):
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.hex(F.xxhash64("id")), F.hex(F.xxhash64("id", F.lit(1)))).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("label"))
    assert quality._measured(docs, labels, "doc_id", "text").count() == 21_000  # 10,000 of a label before
