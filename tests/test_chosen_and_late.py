"""Files chosen before they are opened, named text files, late hours, overlapping tables, shared grids, land files, stored series."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F
from test_sources import CODAR, NAME, WAVES

from seaward.jobs import queries, workflows
from seaward.operators import grid, land, qc, series
from seaward.sources import ctf, tables
from seaward.streaming import incremental

T0 = dt.datetime(2019, 1, 1)
SF = "/root/testdata/sf0.001"


def leaves(plan):
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return leaves(plan.executedPlan())
    below = plan.children()
    return [plan] if below.size() == 0 else [x for i in range(below.size()) for x in leaves(below.apply(i))]


def files_opened(df):
    """Runs ``df`` and counts the files that its scans read."""
    rows = df.collect()
    return len(rows), sum(x.metrics().get("numFiles").get().value() for x in leaves(df._jdf.queryExecution().executedPlan()) if x.metrics().contains("numFiles"))


@pytest.fixture
def station(tmp_path):
    for prefix in ("RDLi", "RDLm"):
        for site in ("TEST", "OTHR"):
            folder = tmp_path / site
            folder.mkdir(exist_ok=True)
            for h in range(5):
                (folder / f"{prefix}_{site}_2019_01_01_0{h}00.ruv").write_text(CODAR.format(hour=h, velo=5.0 + h).replace("TEST", site))
    (tmp_path / "TEST" / "WVLM_TEST_2019_01_01_0000.wls").write_text(WAVES.format(h="1.0", d="nan"))
    (tmp_path / "TEST" / "notes.txt").write_text("no station file")
    return tmp_path


def test_only_chosen_files_are_opened(spark, station):
    at = f"file://{station}"
    everything = ctf.contents(spark, at, ["*.ruv", "*.wls"])
    assert files_opened(everything) == (21, 21)
    chosen = ctf.chosen_files(everything, "RDLi", ["TEST"], "2019-01-01 01:00:00", T0 + dt.timedelta(hours=3)).select("content")
    assert files_opened(chosen) == (3, 3)
    rows, opened = files_opened(ctf.read_files(spark, at, "*.ruv", prefix=["RDLi", "RDLm"], end=T0))
    assert (rows, opened) == (4, 4)
    assert ctf.read_files(spark, at, "*.ruv", sites=["NONE"]).count() == 0
    # filters of a user's own on the parts of the name, too
    assert files_opened(everything.filter("prefix = 'WVLM' OR hour(file_time) = 4").select("path"))[1] == 5


def test_lists_of_types_and_folders(spark, station):
    at = f"file://{station}"
    assert tables.list_files(spark, at, ["*.ruv", "*.wls"]).count() == 21
    assert tables.list_files(spark, at, ["*.wls", "*.txt"], folders=["TEST", "absent"]).count() == 2
    assert tables.list_files(spark, at, "*.ruv", folders=["absent"]).count() == 0
    (station / "TEST" / "deep").mkdir()
    (station / "TEST" / "deep" / "RDLi_TEST_2019_01_01_0900.ruv").write_text("x")
    assert tables.list_files(spark, at, "*.ruv", folders=["TEST"]).count() == 10  # not what is below them


def test_named_text(spark, tmp_path):
    target = tmp_path / "out"
    rows = spark.createDataFrame([("/a/one.ruv", "1\n"), ("/b/two.ruv", "2é"), ("three", None)], "path string, value string").repartition(3)
    tables.write_text(rows, f"file://{target}")
    assert {p.name: p.read_bytes() for p in target.iterdir()} == {"one.ruv": b"1\n", "two.ruv": b"2\xe9", "three": b""}
    tables.write_text(rows.limit(0), str(target))  # replaces what was there
    assert list(target.iterdir()) == []
    tables.write_text(rows.withColumn("site", F.lit("A")), str(target), "site")
    assert sorted(p.name for p in (target / "A").iterdir()) == ["one.ruv", "three", "two.ruv"]
    before = sorted(target.rglob("*"))
    for bad in (rows.unionByName(rows), rows.withColumn("path", F.lit("..")), rows.withColumn("value", F.raise_error(F.lit("stop")).cast("string"))):
        with pytest.raises(Exception):
            tables.write_text(bad, str(target))
    assert sorted(target.rglob("*")) == before and [p.name for p in tmp_path.iterdir()] == ["out"]  # nothing half written stays
    with pytest.raises(Exception, match="is there already"):
        rows.select(F.lit("x").alias("name"), "value").write.format("named_text").mode("append").save(str(target))


def test_exports_of_the_job(spark, station, tmp_path_factory):
    target = tmp_path_factory.mktemp("job")
    limits = spark.createDataFrame([("TEST", 6.5, ["Q202"]), ("OTHR", 500.0, ["Q202"])], "site string, max_speed double, include array<string>")
    workflows.qc_job(spark, f"file://{station}", str(target), limits=limits, export=True, prefix="RDLi", end="2019-01-01 03:00:00")
    names = sorted(f"RDLi_{s}_2019_01_01_0{h}00.ruv" for s in ("TEST", "OTHR") for h in range(4))
    assert sorted(p.name for p in (target / "text").iterdir()) == names == sorted(p.name for p in (target / "clean_text").iterdir())
    lines = (target / "clean_text" / NAME.format(3)).read_text().splitlines()
    assert "%TableRows: 1" in lines and "%TableColumnTypes: LOND LATD VELO VFLG BEAR SPRC" in lines  # 8 cm/s failed, the fill value passed
    back = ctf.read_radials(ctf.read_files(spark, f"file://{target}/clean_text"))
    want = spark.read.parquet(f"{target}/clean").select("site", "time", "row_no", "VELO", "VFLG")
    key = lambda df: sorted((r.site, r.time, r.VELO is None, r.VELO, r.VFLG) for r in df.collect())
    assert key(back) == key(want) and 8 < back.count() < 16


def test_gridded_output_of_flagged_vectors(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    text = CODAR.replace("%TableColumnTypes: LOND LATD VELO VFLG BEAR SPRC", "%TableColumnTypes: LOND LATD VELO VFLG BEAR RNGE").replace("%AngularResolution: 5 Deg", "%AngularResolution: 5 Deg\n%AntennaBearing: 1.0 True")
    text = text.replace(" -73.96  40.43  999.00  128  6.0  3\n", " -73.96  40.43  7.00  128  6.0  3\n -73.95  40.44  300.0  0  6.1  3\n")
    (source / NAME.format(0)).write_text(text.format(hour=0, velo=5.0))
    workflows.qc_job(spark, f"file://{source}", target, tests=("Q202", "Q203"), gridded=True, variables=("VELO",))
    cells = sorted((r.range, r.bearing, r.VELO, r.Q202, r.Q203, r.PRIM) for r in spark.read.parquet(f"{target}/gridded").collect())
    assert [c[1:] for c in cells] == [(1.0, 5.0, 1, 1, 1), (6.0, 300.0, 4, 1, 4)]  # of two in a cell the last brings its flags
    assert [(r.bearing, r.VELO) for r in spark.read.parquet(f"{target}/clean_gridded").collect()] == [(1.0, 5.0)]


# --- late files


def stream(spark, source, target, check, **more):
    incremental.start_qc(spark, f"file://{source}", target, check, **more).awaitTermination()


@pytest.mark.parametrize("order", [[0, 2, 1], [4, 3, 2, 1, 0], [0, 3, 1, 2, 1]])
def test_late_hours_leave_the_same_table(spark, tmp_path, order):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    limits = spark.createDataFrame([("TEST", 4, ["Q206", "Q209"])], "site string, n_steps int, include array<string>")
    chosen = {"limits": limits, "tests": ("Q202", "Q206", "Q209", "Q901")}
    for n, h in enumerate(order):
        (source / NAME.format(h)).write_text(CODAR.format(hour=h, velo=5.5 + 40 * (h == 3)) + "\n" * n)
        stream(spark, source, target, str(tmp_path / f"check{n if h in order[:n] else ''}"), **chosen)
    whole = str(tmp_path / "whole")
    workflows.qc_job(spark, f"file://{source}", whole, limits=limits, tests=chosen["tests"])
    pick = ["time", "row_no", "Q202", "Q206", "Q209", "Q901", "PRIM"]
    one, two = (sorted(map(tuple, spark.read.parquet(p).select(*pick).collect())) for p in (target, f"{whole}/flagged"))
    assert one == two and len(one) == 2 * len(set(order))


def test_shuffled_batches(spark, tmp_path):
    rad = queries.vectors_of(spark, SF).filter("hr BETWEEN 18 AND 32").cache()
    files, hours = queries.files_of(rad), list(range(18, 33))
    random.Random(5).shuffle(hours)
    for part in (hours[:5], hours[5:9], hours[9:]):
        incremental.update(str(tmp_path / "t"), files.filter(F.col("hr").isin(part)), rad.filter(F.col("hr").isin(part)), queries.LIMITS)
    pick = ["site", "hr", "row_no", "Q204", "Q205", "Q206", "Q209", "PRIM"]
    whole = qc.qc_radials(rad, files, queries.LIMITS).select(*pick)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select(*pick).collect())) == sorted(map(tuple, whole.collect()))


# --- overlapping tables


def test_combine(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x"), (2, 2.5, "x"), (3, None, None)], "k int, v double, w string")
    b = spark.createDataFrame([(2, 3.0, "x"), (3, 4.0, "y"), (None, 5.0, "z")], "k int, v double, w string")
    for rule, two in (("first", 2.0), ("last", 3.0)):
        rows, report = tables.combine([a, b], ["k"], rule)
        assert {r.k: (r.v, r.w) for r in rows.collect()} == {1: (1.0, None), 2: (two, "x"), 3: (4.0, "y"), None: (5.0, "z")}
        assert [tuple(r) for r in report.collect()] == [(2, "v", "2.0", "3.0", 2)]
    with pytest.raises(Exception, match="tables differ in v at 2"):
        tables.combine([a, b], ["k"])[0].collect()
    assert tables.combine([a.filter("k <> 2"), b.drop("w")], ["k"])[0].count() == 4
    assert tables.combine([a.limit(0), b.limit(0)], ["k"], "first")[0].count() == 0
    plan = tables.combine([a, b], ["k"], "first")[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        tables.combine([a, b], ["k"], "any")


def test_concat_job_combines(spark, tmp_path):
    rows = [("A", T0, 1.0, 2.0, 5.0), ("A", T0 + dt.timedelta(hours=1), 1.0, 2.0, 6.0)]
    df = spark.createDataFrame(rows, "site string, time timestamp, BEAR double, RNGE double, VELO double").withColumns({"LOND": F.lit(1.0), "LATD": F.lit(2.0)})
    for n, part in enumerate((df, df.withColumn("VELO", F.col("VELO") + (F.hour("time") == 1).cast("int")))):
        tables.write_table(part, f"{tmp_path}/{n}")
    cover = workflows.concat_job(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], f"{tmp_path}/all", keys=["site", "time", "BEAR", "RNGE"], rule="last").first()
    assert cover.n_rows == 2 and [r.VELO for r in spark.read.parquet(f"{tmp_path}/all").orderBy("time").collect()] == [5.0, 7.0]
    assert [(r.column, r.lowest, r.highest) for r in spark.read.parquet(f"{tmp_path}/all_conflicts").collect()] == [("VELO", "6.0", "7.0")]


# --- shared grids


def test_shared_axes(spark):
    axes = spark.createDataFrame([("p", "A", T0, [1.0, 2.00001], [10.0, 20.0]), ("p", "A", T0 + dt.timedelta(hours=1), [1.5, 2.0], [15.0]), ("p", "B", T0, [9.0], [0.0])], "prefix string, site string, time timestamp, ranges array<double>, bearings array<double>")
    got = {r.site: (r.ranges, r.bearings) for r in grid.shared_axes(axes).collect()}
    assert got == {"A": ([1.0, 1.5, 2.0], [10.0, 15.0, 20.0]), "B": ([9.0], [0.0])}
    assert grid.shared_axes(axes, ("prefix",)).first().ranges == [1.0, 1.5, 2.0, 9.0]
    cells = spark.createDataFrame([("p", "A", T0, 2.0, 20.0, 7.0), ("p", "A", T0 + dt.timedelta(hours=1), 1.5, 15.0, 8.0), ("p", "B", T0, 9.0, 0.0, 9.0)], "prefix string, site string, time timestamp, range double, bearing double, VELO double")
    whole = grid.concat_gridded(cells, axes, ["VELO"]).collect()
    assert len(whole) == 9 + 9 + 1 and sum(r.VELO is not None for r in whole) == 3
    assert grid.concat_gridded(cells, axes, ["VELO"], dense=False).count() == 3


def test_concat_gridded_job(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    text = CODAR.replace("%TableColumnTypes: LOND LATD VELO VFLG BEAR SPRC", "%TableColumnTypes: LOND LATD VELO VFLG BEAR RNGE").replace("%AngularResolution: 5 Deg", "%AngularResolution: {res} Deg\n%AntennaBearing: 1.0 True")
    for h, res in enumerate((5, 90)):
        (source / NAME.format(h)).write_text(text.format(hour=h, velo=5.0, res=res))
    workflows.concat_gridded_job(spark, f"file://{source}", target, ("VELO",))
    rows = spark.read.parquet(f"{target}/concatenated")
    assert rows.groupBy("time").count().select("count").distinct().count() == 1 and rows.filter("VELO IS NOT NULL").count() == 1  # at 90 degrees both vectors are in one cell, the last is a fill value
    assert rows.select("bearing").distinct().count() == 72


# --- land from polygon files


def test_geojson(spark):
    square = lambda x, y, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]
    feature = lambda kind, shape, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": shape}}
    main = feature("Polygon", [square(0, 0, 10), square(2, 2, 4)], continent="X", size=3)
    island = feature("MultiPolygon", [[square(3, 3, 1)[:-1]], [square(20, 20, 2)]], continent="X")  # the first ring is left open
    others = [feature("Polygon", [square(40, 0, 5)], continent="Y"), feature("Point", [1, 2], continent="X"), feature("Polygon", [[[0, 0], [1, 1]]], continent="X")]
    whole = json.dumps({"type": "FeatureCollection", "features": [main, island, *others]})
    lines = [json.dumps(f) for f in (main, island, *others)]
    places = spark.createDataFrame([(1.0, 1.0), (3.5, 2.5), (3.5, 3.5), (21.0, 21.0), (41.0, 1.0), (-1.0, 5.0), (15.0, 5.0)], "LOND double, LATD double")
    for texts in ([whole], lines, [whole, "no json", None, "{}"]):
        edges = land.edges_from_geojson(spark.createDataFrame([(t,) for t in texts], "value string"), "properties['continent'] = 'X'")
        got = {(r.LOND, r.LATD): r.on_land for r in land.on_land(places, edges).collect()}
        assert got == {(1.0, 1.0): True, (3.5, 2.5): False, (3.5, 3.5): True, (21.0, 21.0): True, (41.0, 1.0): False, (-1.0, 5.0): False, (15.0, 5.0): False}
        assert edges.count() == 4 * 4
    assert land.edges_from_geojson(spark.createDataFrame([(whole,)], "value string")).count() == 5 * 4


# --- stored series, metadata


def test_stored_cells_are_picked_by_the_scan(spark, tmp_path):
    rows = [("p", s, T0 + dt.timedelta(hours=h), float(r), float(b), float(r * 1000 + b + h)) for s in "AB" for h in range(30) for r in range(1, 6) for b in range(0, 360, 10)]
    cells = spark.createDataFrame(rows, "prefix string, site string, time timestamp, range double, bearing double, VELO double")
    tables.write_table(cells, f"{tmp_path}/cells")
    stored = spark.read.parquet(f"{tmp_path}/cells")
    axes = grid.cell_axes(stored)
    points = spark.createDataFrame([("x", "A", 0.02, 45.01), ("y", "A", 0.0, 45.02)], "point_id string, site string, lon double, lat double")
    origins = spark.createDataFrame([("A", 0.0, 45.0), ("B", 1.0, 45.0)], "site string, origin_lon double, origin_lat double")
    got = grid.extract_stored(stored, axes, points, origins, ["VELO"])
    want = grid.extract_series(stored, points, origins, ["VELO"])
    pick = ["point_id", "time", "range", "bearing", "VELO"]
    assert sorted(map(tuple, got.select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect())) and got.count() == 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(range,", plan) and re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(bearing,", plan), plan
    assert re.search(r"PartitionFilters: \[[^\]]*site#\d+ = A", plan), plan
    by_join, grid_most = None, grid.MOST_PICKED
    try:
        grid.MOST_PICKED = 1
        by_join = sorted(map(tuple, grid.extract_stored(stored, axes, points, origins, ["VELO"]).select(*pick).collect()))
    finally:
        grid.MOST_PICKED = grid_most
    assert by_join == sorted(map(tuple, want.select(*pick).collect()))


def test_stored_series_job(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    text = CODAR.replace("%TableColumnTypes: LOND LATD VELO VFLG BEAR SPRC", "%TableColumnTypes: LOND LATD VELO VFLG BEAR RNGE")
    for h in range(3):
        (source / NAME.format(h)).write_text(text.format(hour=h, velo=5.0 + h))
    workflows.gridded_job(spark, f"file://{source}", target, ("VELO",), attributes={"title": "test"})
    attributes = {r.attribute: r.value for r in tables.read_attributes(spark, f"{target}/gridded").collect()}
    assert attributes["title"] == "test" and attributes["time_coverage_end"] == "20190101T020000Z" and attributes["geospatial_lon_min"] == "-73.97"
    assert tables.column_metadata(tables.read_tables(spark, f"{target}/gridded"))["velocity"]["valid_max"] == 1000.0
    points = spark.createDataFrame([("x", "TEST", -73.9735, 40.385)], "point_id string, site string, lon double, lat double")
    origins = spark.createDataFrame([("TEST", -73.9735333, 40.3668167)], "site string, origin_lon double, origin_lat double")
    workflows.stored_series_job(spark, target, points, origins, f"{target}/series", start="2019-01-01 01:00:00")
    rows = spark.read.option("header", True).csv(f"{target}/series").orderBy("time").collect()
    assert [r.velocity for r in rows] == ["6.0", "7.0"]


def test_wave_metadata_and_positions(spark, tmp_path):
    source = tmp_path / "waves"
    source.mkdir()
    (source / "WVLM_TEST_2019_01_01_0000.wls").write_text("%Origin: 40.5 -73.5\n" + WAVES.format(h="1.0", d="nan"))
    workflows.wave_job(spark, f"file://{source}", str(tmp_path / "out"))
    back = tables.read_tables(spark, str(tmp_path / "out"))
    assert [(r.wave_height, r.lon, r.lat) for r in back.collect()] == [(1.0, -73.5, 40.5)]
    meta = tables.column_metadata(back)
    assert meta["wave_height"] == {"units": "m", "standard_name": "sea_surface_wave_significant_height", "long_name": "wave model height in meters", "comment": "wave model height in meters for every one of three waves", "valid_min": 0.0, "valid_max": 100.0, "coordinates": "time", "coverage_content_type": "physicalMeasurement"}
    assert meta["lon"]["units"] == "degrees_east" and meta["time"]["standard_name"] == "time"
    assert series.published_metadata("VFLG")["flag_masks"][-1] == 1024 and series.published_metadata("PRIM")["flag_values"] == [1, 2, 3, 4, 9]
