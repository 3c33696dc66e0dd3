"""Mixing: targets against rounds of resharing, cuts against a plain walk, texts drawn, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from seaward.llm import mixing

NAMES = "doc_id long, text string, source string, size string, name string"


def rounds(sizes, weights, share, most):
    """Targets by resharing the excess until none is above."""
    total = int(sum(sizes.values()) * share + 0.5)
    out, open_ = dict.fromkeys(sizes, 0.0), {s for s in sizes if sizes[s] and weights[s]}
    left = total
    while open_:
        heavy = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / heavy > most * sizes[s]}
        if not over:
            for s in open_:
                out[s] = left * weights[s] / heavy
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"={i:02d}": rng.choice([0, 1, 5, 100, 1000, 10**6]) for i in range(12)}
    weights = {s: rng.choice([0, 1, 2, 5, 900]) for s in sizes}
    share = [1.0, 0.3, 2.0, 5.0][seed]
    table = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "name string, source_size long, weight long")
    got = {r.name: r.target for r in mixing.targets(table, share).collect()}
    want = rounds(sizes, weights, share, 3)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 40])), f"s{min(3, rng.randrange(9))}", None, "n") for i in range(200)]
    rows += [(900, "\ta  b\n", None, None, "n")] * 7 + [(None, "x y z", "s1", None, "n"), (901, None, "s1", None, "n"), (902, "", "only", None, "n"), (903, "q " * 50_000, "long", None, "n")]
    return spark.createDataFrame(rows, NAMES)


def test_plan_and_drawn_texts(spark):
    docs = documents(spark)
    planned = mixing.plan(mixing.sizes(docs)).cache()
    rows = planned.collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.name, []).append(r)
    sizes = {n: sum(r.size for r in g) for n, g in by.items()}
    order = [*sorted(n for n in by if n), ""]
    want = rounds(sizes, {n: mixing.CYCLE[i % 3] for i, n in enumerate(order)}, 1.0, 3)
    for n, g in by.items():
        budget = int(want[n] + 0.5)
        assert {r.source_size for r in g} == {sizes[n]} and abs(g[0].target - want[n]) < 1e-6 and sum(r.taken for r in g) == (budget if sizes[n] else 0)
        at = 0
        for r in sorted(g, key=lambda r: (r.order, r.start)):
            assert r.start == at and r.taken == (0 if not sizes[n] else budget // sizes[n] * r.size + max(0, min(r.size, budget % sizes[n] - at)))
            at += r.size
        assert all(r.taken <= 3 * r.size for r in g)
    assert {r.size for r in by[""]} == {2} and len(by[""]) == 7
    drawn = mixing.draw(docs, planned).withColumn("n", F.size(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)))).groupBy("source").agg(F.sum("n").alias("n")).collect()
    for r in drawn:
        name = "" if r.source is None else f"={r.source}"
        assert 0 <= sum(x.taken for x in by[name]) - r.n < 7
    assert mixing.draw(docs, planned).columns == docs.columns


def test_order_of_rows_and_partitions_does_not_matter(spark):
    docs = documents(spark)
    one, two = (sorted(map(tuple, mixing.plan(mixing.sizes(d)).collect()), key=repr) for d in (docs, docs.repartition(7, "text").orderBy(F.desc("doc_id"))))
    assert one == two


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPREAD", 4)
    docs = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, "d", "s"), (3, "e " * 40, "t")], "doc_id long, text string, source string")
    rows = mixing.plan(mixing.sizes(docs), spark.createDataFrame([("=s", 1), ("=t", 1)], "name string, weight long")).collect()
    assert len(rows) == 52 and sum(r.taken for r in rows) in (190, 191, 192) and len({r.start for r in rows if r.id == 1}) == 50


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    planned = mixing.plan(mixing.sizes(docs))
    assert planned.count() == 0 and mixing.draw(docs, planned).count() == 0


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(mixing.SQL["op11_mix"].replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    got = [tuple(r) for r in mixing.op11_mix(spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in got) == sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in want)
