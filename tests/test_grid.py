"""Axes, snapping, geodesics, nearest cells, series, land masks, vectors."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seaward.functions import geodesy, vectors
from seaward.operators import grid, land, series

T0 = dt.datetime(2019, 1, 1)


@settings(max_examples=60, deadline=None)
@given(st.floats(-170, 170), st.floats(-75, 75), st.floats(0, 359.9), st.floats(0.5, 300))
def test_forward_and_back(lon, lat, azimuth, km):
    lon2, lat2 = geodesy.forward(np.array([lon]), np.array([lat]), np.array([azimuth]), np.array([km]))
    a, b, d = geodesy.backward(np.array([lon]), np.array([lat]), lon2, lat2)
    assert abs(d[0] - km) < 1e-5 and abs((a[0] - azimuth + 180) % 360 - 180) < 1e-4
    lon3, lat3 = geodesy.forward(lon2, lat2, b, d)
    assert abs(lon3[0] - lon) < 1e-7 and abs(lat3[0] - lat) < 1e-7


def test_known_point(spark):
    r = spark.range(1).select(geodesy.reckon(F.lit(-73.9735333), F.lit(40.3668167), F.lit(1.0), F.lit(6.0406)).alias("p")).first().p
    assert abs(r.lon + 73.9722911) < 1e-7 and abs(r.lat - 40.4212075) < 1e-7
    same = geodesy.backward(*(np.array([x]) for x in (5.0, 5.0, 5.0, 5.0)))
    assert same[2][0] == 0


def test_axes(spark):
    r = spark.range(1).select(grid.range_axis(F.lit(6.0406), F.lit(12.0812), F.lit(3.0203)).alias("r"), grid.bearing_axis(F.lit(350.0), F.lit(60.0)).alias("b")).first()
    assert r.r == [6.0406, 9.0609, 12.0812] and r.b == [50.0, 110.0, 170.0, 230.0, 290.0, 350.0]
    values = [0.0, 1.5, 1.51, 9.0, -4.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [i[0] for i in df.select(grid.nearest_index(F.col("x"), F.lit(1.0), F.lit(1.0), F.lit(4))).collect()] == [0, 0, 1, 3, 0]


def cells(spark):
    rows = [("p", "A", T0, 0, 1.1, 10.0, 5.0), ("p", "A", T0, 1, 0.9, 10.0, 7.0), ("p", "A", T0 + dt.timedelta(hours=1), 0, 2.0, 20.0, 9.0)]
    df = spark.createDataFrame(rows, "prefix string, site string, time timestamp, row_no int, RNGE double, BEAR double, VELO double")
    axes = spark.createDataFrame([("A", 1.0, 1.0, 2, 10.0, 10.0, 2)], "site string, range_first double, range_step double, n_ranges int, bearing_first double, bearing_step double, n_bearings int")
    return grid.snap(df, axes, ["VELO"])


def test_snap_and_densify(spark):
    got = cells(spark)
    assert sorted((r.range, r.bearing, r.VELO) for r in got.collect()) == [(1.0, 10.0, 7.0), (2.0, 20.0, 9.0)]
    axes = spark.createDataFrame([("A", [1.0, 2.0], [10.0, 20.0])], "site string, ranges array<double>, bearings array<double>")
    dense = grid.densify(got, axes, ["VELO"]).collect()
    assert len(dense) == 8 and sum(r.VELO is not None for r in dense) == 2


def test_series_has_every_hour(spark):
    lon, lat = geodesy.forward(np.array([0.0]), np.array([45.0]), np.array([12.0]), np.array([1.2]))
    points = spark.createDataFrame([("x", "A", float(lon[0]), float(lat[0]))], "point_id string, site string, lon double, lat double")
    origins = spark.createDataFrame([("A", 0.0, 45.0)], "site string, origin_lon double, origin_lat double")
    got = grid.extract_series(cells(spark), points, origins, ["VELO"]).orderBy("time").collect()
    assert [(r.range, r.bearing, r.VELO) for r in got] == [(1.0, 10.0, 7.0), (1.0, 10.0, None)]


def test_nearest_tie_takes_the_larger(spark):
    lon, lat = geodesy.forward(np.array([0.0]), np.array([45.0]), np.array([15.0]), np.array([1.0]))
    points = spark.createDataFrame([("x", "A", float(lon[0]), float(lat[0]))], "point_id string, site string, lon double, lat double")
    origins = spark.createDataFrame([("A", 0.0, 45.0)], "site string, origin_lon double, origin_lat double")
    r = grid.nearest_cells(points, cells(spark), origins).withColumn("bearing", F.col("bearing")).first()
    assert r.range == 1.0 and abs(r.azimuth - 15) < 1e-6


def test_land(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0), (0.0, 0.0)]
    edges = spark.createDataFrame([(0, *a, *b) for a, b in zip(ring, ring[1:], strict=False)], "ring_id int, x1 double, y1 double, x2 double, y2 double")
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 2.0), (0.5, 2.0), (5.0, 1.0), (-1.0, 1.0), (None, 1.0), (1.0, 0.5)], "LOND double, LATD double")
    got = {(r.LOND, r.LATD): r.on_land for r in land.mask_land(df, edges).collect()}
    assert got == {(1.0, 0.5): True, (2.0, 2.0): False, (0.5, 2.0): True, (5.0, 1.0): False, (-1.0, 1.0): False, (None, 1.0): False}
    assert land.mask_land(df, edges, subset=True).count() == 4


def test_vectors(spark):
    df = spark.createDataFrame([(3.0, 4.0), (-1.0, 0.0), (0.0, -2.0)], "u double, v double")
    speed, direction = vectors.uv_to_speed_direction(F.col("u"), F.col("v"))
    back = vectors.speed_direction_to_uv(speed, direction, degrees=True)
    for r in df.select("u", "v", speed.alias("s"), direction.alias("d"), back[0].alias("bu"), back[1].alias("bv")).collect():
        assert abs(r.u - r.bu) < 1e-12 and abs(r.v - r.bv) < 1e-12 and 0 <= r.d < 360
    rows = df.select(direction.alias("d")).collect()
    assert [round(r.d, 6) for r in rows] == [36.869898, 270.0, 180.0]
    sign, motion = vectors.motion_class(F.col("u"))
    assert [tuple(r) for r in df.select(sign, motion).collect()] == [(1, "towards"), (-1, "away"), (1, "towards")]


def test_subsets_and_names(spark):
    df = spark.createDataFrame([("A", T0, 0, 5.0, 1), ("A", T0 + dt.timedelta(hours=1), 1, 6.0, 4), ("B", T0, 2, 7.0, 1)], "site string, time timestamp, row_no int, VELO double, PRIM int")
    assert series.time_slice(df, T0, T0).count() == 2 and series.time_slice(df).count() == 3
    assert sorted(r.row_no for r in series.latest_step(df).collect()) == [1, 2]
    assert [r.row_no for r in series.every_nth(df, 2).orderBy("row_no").collect()] == [0, 2]
    named = series.rename_published(df)
    assert named.columns == ["site", "time", "row_no", "velocity", "primary_flag_qc"]
    assert named.schema["velocity"].metadata["units"] == "cm s-1" and named.schema["primary_flag_qc"].metadata["flag_values"] == [1, 2, 3, 4, 9]
    assert series.concatenate(df, df.drop("VELO")).filter("VELO IS NULL").count() == 3
