"""Quality-control tests at their edges: equality, nulls, gaps, wrap-around, repeated cells."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seaward.operators import qc

T0 = dt.datetime(2019, 1, 1)
SCHEMA = "prefix string, site string, time timestamp, row_no int, LOND double, LATD double, VELO double, VFLG int, BEAR double, SPRC int"


def rows(spark, data):
    base = dict(prefix="RDLi", site="A", time=T0, row_no=0, LOND=1.0, LATD=2.0, VELO=0.0, VFLG=0, BEAR=1.0, SPRC=2)
    return spark.createDataFrame([tuple((base | d)[c.split()[0]] for c in SCHEMA.split(", ")) for d in data], SCHEMA)


def flags(df, column, order="row_no"):
    return [r[0] for r in df.orderBy(order).select(column).collect()]


def test_maximum_velocity(spark):
    values = [0.0, 150.0, 150.1, -200.0, 250.0, -250.0, 250.1, None]
    df = rows(spark, [{"row_no": i, "VELO": v} for i, v in enumerate(values)])
    assert flags(df.withColumn("Q", qc.q202_maximum_velocity()), "Q") == [1, 1, 3, 3, 1, 1, 4, 1]


def test_valid_location(spark):
    df = rows(spark, [{"row_no": i, "VFLG": v} for i, v in enumerate([0, 128, 129, None])])
    assert flags(df.withColumn("Q", qc.q203_valid_location(df.columns)), "Q") == [1, 4, 1, 1]
    assert flags(df.withColumn("Q", qc.q203_valid_location(df.columns, F.col("row_no") == 0)), "Q") == [4, 4, 1, 1]
    bare = df.drop("VFLG")
    assert flags(bare.withColumn("Q", qc.q203_valid_location(bare.columns)), "Q") == [1, 1, 1, 1]


@pytest.mark.parametrize(("good", "expected"), [(149, 4), (150, 3), (300, 3), (301, 1)])
def test_radial_count(spark, good, expected):
    df = rows(spark, [{"row_no": i, "VFLG": None if i % 2 else 0} for i in range(good)] + [{"row_no": 1000 + i, "VFLG": 128} for i in range(400)])
    assert set(flags(df.withColumn("Q", qc.q204_radial_count()), "Q")) == {expected}


@pytest.mark.parametrize(("bearing", "expected"), [(180.0, 1), (194.9, 1), (195.0, 3), (150.0, 4), (None, 2)])
def test_average_bearing(spark, bearing, expected):
    df = rows(spark, [{"BEAR": bearing}, {"row_no": 1, "BEAR": None}])
    assert set(flags(df.withColumn("Q", qc.q207_average_bearing()), "Q")) == {expected}


def history(spark, *values, **more):
    """One place; a value per hour, "-" for an hour without the row."""
    data = [{"row_no": i, "time": T0 + dt.timedelta(hours=i), "VELO": v} for i, v in enumerate(values) if v != "-"]
    return rows(spark, [d | more for d in data])


@pytest.mark.parametrize(
    ("before", "now", "expected"),
    [("-", 1.0, 2), (None, 1.0, 1), (0.0, None, 1), (0.0, 36.0, 1), (0.0, 36.1, 3), (0.0, 54.0, 1), (0.0, -54.1, 4)],
)
def test_temporal_gradient(spark, before, now, expected):
    df = qc.temporal_tests(history(spark, before, now), tests=["Q206"])
    assert flags(df, "Q206")[-1] == expected


@pytest.mark.parametrize(
    ("series", "stuck", "second"),
    [((1.0, 1.0, 1.0), 4, 4), ((1.0, 1.0, 1.02), 1, 1), (("-", 1.0, 1.0), 2, 2), ((1.0, "-", 1.0), 2, 2), ((None, 1.0, 1.0), 2, 1), ((1.0, 1.008, 1.016), 4, 1)],
)
def test_stuck_value(spark, series, stuck, second):
    df = qc.temporal_tests(history(spark, *series), tests=["Q209", "Q901"])
    assert flags(df, "Q209")[-1] == stuck and flags(df, "Q901")[-1] == second


def test_history_takes_the_last_of_repeated_places(spark):
    df = rows(spark, [{"row_no": 5, "VELO": 100.0}, {"row_no": 6, "VELO": 10.0}, {"row_no": 7, "time": T0 + dt.timedelta(hours=1), "VELO": 12.0}])
    assert flags(qc.temporal_tests(df, tests=["Q206"]), "Q206")[-1] == 1
    other = rows(spark, [{"site": "B", "VELO": 100.0}, {"row_no": 7, "time": T0 + dt.timedelta(hours=1)}])
    assert flags(qc.temporal_tests(other, tests=["Q206"]), "Q206")[-1] == 2


def test_spatial_median(spark):
    near = [{"row_no": i, "BEAR": b, "SPRC": s, "VELO": 10.0} for i, (b, s) in enumerate((b, s) for b in (351.0, 356.0, 1.0, 6.0) for s in (2, 3, 4))]
    odd = near + [{"row_no": 50, "BEAR": 1.0, "SPRC": 9, "VELO": 99.0}, {"row_no": 51, "BEAR": 356.0, "SPRC": 3, "VELO": 80.0}, {"row_no": 52, "BEAR": None}]
    df = rows(spark, odd).withColumn("bearing_step", F.lit(5.0))
    got = dict(qc.q205_spatial_median(df).select("row_no", "Q205").collect())
    assert got[50] == 1  # alone: its own median
    assert got[51] == 4 and got[4] == 1  # of two in a cell the last counts, the other passes
    assert got[52] == 2
    no_key = qc.q205_spatial_median(df.withColumn("time", F.lit(None).cast("timestamp")))
    assert set(flags(no_key, "Q205")) == {2} and no_key.count() == len(odd) and no_key.columns == [*df.columns, "Q205"]
    assert set(flags(qc.q205_spatial_median(df.withColumn("bearing_step", F.lit(None).cast("double"))), "Q205")) == {2}


def test_spatial_median_equals_offsets(spark):
    rng = np.random.default_rng(1)
    data = [{"row_no": i, "BEAR": float(1 + 5 * b), "SPRC": int(s), "VELO": float(v)} for i, (b, s, v) in enumerate(zip(rng.integers(0, 72, 900), rng.integers(2, 25, 900), rng.normal(0, 40, 900), strict=True))]
    df = rows(spark, data).withColumns({"bearing_step": F.lit(5.0), "bcell": F.floor((F.col("BEAR") - 1) / 5)})
    a = dict(qc.q205_spatial_median(df).select("row_no", "Q205").collect())
    b = dict(qc.spatial_median_by_offsets(df).select("row_no", "Q205").collect())
    assert a == b and set(a.values()) == {1, 4}


def test_primary_flag(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 3, 1), (2, 3, 4), (3, 2, 2)], "row_no int, Q202 int, Q206 int")
    assert flags(df.withColumn("PRIM", qc.primary_flag(["Q202", "Q206"])), "PRIM") == [1, 3, 4, 1]
    kept = qc.clean_copy(df.withColumn("PRIM", qc.primary_flag(["Q202", "Q206"])))
    assert kept.columns == ["row_no"] and kept.count() == 3


def plan_counts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("Exchange"), plan.count("Join"), "CartesianProduct" in plan


def test_plans_read_and_shuffle_once(spark):
    """Beside what derives the test table (a scan and a shuffle for vectors, the same and one more for files)."""
    from seaward.jobs import queries

    rad = queries.vectors_of(spark, "/root/testdata/sf0.001")
    alone = qc.q205_spatial_median(rad.withColumn("bearing_step", F.lit(5.0)), queries.LIMITS)
    assert plan_counts(alone) == (1, 1 + 1, 0, False)
    # vectors: by file, by place; files: by key
    chain = qc.qc_radials(rad, queries.files_of(rad), queries.LIMITS)
    assert plan_counts(chain) == (2, (1 + 2) + (2 + 1), 1, False)


def test_limits_name_a_site_once(spark):
    df = rows(spark, [{"VELO": 9.0}, {"site": "B", "VELO": 9.0}])
    one = spark.createDataFrame([("A", 5.0), ("B", None)], "site string, max_speed double")
    got, t, added = qc.with_limits(df, one, qc.Thresholds(max_speed=20.0))
    assert {r.site: r.q for r in got.select("site", qc.q202_maximum_velocity(t).alias("q")).collect()} == {"A": 4, "B": 1} and added == ["__limit_max_speed"]
    with pytest.raises(Exception, match="name a site twice: A"):
        qc.with_limits(df, one.unionByName(one.limit(1)))[0].collect()


def test_passed_only(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, 4)], "k int, PRIM int")
    assert [r.k for r in qc.passed_only(df).collect()] == [1]


def test_primary_flag_of_chosen_tests(spark):
    df = spark.createDataFrame([(4, 1, ["Q202"]), (4, 3, ["qc_qartod_valid_location"]), (2, 3, None)], "Q202 int, Q203 int, i array<string>")
    got = df.select(qc.primary_flag(["Q202", "Q203"], F.col("i")).alias("a"), qc.primary_flag(["Q202", "Q203"], ["Q203"]).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(4, 1), (3, 3), (3, 3)]
