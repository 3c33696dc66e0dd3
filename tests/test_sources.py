"""Parsing, headers, rendering and the jobs on small station files written here."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seaward.functions import headers
from seaward.jobs import workflows
from seaward.operators import series
from seaward.sources import ctf, tables
from seaward.streaming import incremental

CODAR = """%CTF: 1.00
%FileType: LLUV rdls "RadialMap"
%Manufacturer: CODAR
%Site: TEST ""
%TimeStamp: 2019 01 01  {hour:02d} 00 00
%TimeZone: "UTC" +0.000 0 "Atlantic/Reykjavik"
%Origin:  40.3668167  -73.9735333
%PatternType: Ideal
%AngularResolution: 5 Deg
%RangeResolutionKMeters: 3.020300
%RangeEnd: 24.0 km
%MergedCount: 7 minutes
%Note: a:b
%TableType: LLUV RDL9
%TableColumns: 6
%TableColumnTypes: LOND LATD VELO VFLG BEAR SPRC
%TableRows: 2
%TableStart:
%%   title line
 -73.97  40.42  {velo}  0  1.0  2
 -73.96  40.43  999.00  128  6.0  3
%TableEnd:
%TableType: rads rad1
%TableColumns: 8
%TableColumnTypes: TIME XTRP TYRS TMON TDAY THRS TMIN TSEC
%TableRows: 1
%TableStart: 2
%  0 0F 2019 1 1 {hour} 10 0
%TableEnd: 2
%ProcessedTimeStamp: 2019 01 02
%ProcessingTool: "A" 1
%ProcessingTool: "B" 2
%End:
"""
WERA = """%Manufacturer: Helzel WERA
%Site: stf "STF
%TimeStamp: 2019 06 01 00 00 00
%TableType: LLUV RDL7
%TableColumnTypes: LATD LOND VELO
%TableStart:
 25.1 -80.0 1.5
%TableEnd:
%End
"""
WAVES = """%Site: TEST
%TableType: WAVL WVM9
%TableColumnTypes: TIME MWHT DIST TYRS TMON TDAY THRS TMIN TSEC
%TableStart:
 0 {h} {d} 2019 1 1 0 0 0
 1 999.0 nan 2019 1 1 1 0 0
%TableEnd:
%TableType: WAVL WVM9
%TableColumnTypes: TIME MWHT DIST TYRS TMON TDAY THRS TMIN TSEC
%TableStart: 2
% 0 2.5 6.0 2019 1 1 0 0 0
%TableEnd: 2
%End:
"""
NAME = "RDLi_TEST_2019_01_01_{:02d}00.ruv"


def parsed(spark, *texts):
    return ctf.parse_files(spark.createDataFrame([(f"/d/{NAME.format(i)}", t) for i, t in enumerate(texts)], "path string, content string"))


def test_parse(spark):
    got = parsed(spark, CODAR.format(hour=0, velo=5.5), WERA, CODAR.format(hour=2, velo=1)[:-6], "", CODAR.replace("%TableColumnTypes: LOND LATD VELO VFLG BEAR SPRC\n", "").format(hour=4, velo=1))
    files = {r.file_name: r for r in ctf.file_table(got).collect()}
    a, b, c, d, e = (files[NAME.format(i)] for i in range(5))
    assert (a.site, a.n_rows, a.n_cols_row, a.is_wera, a.is_corrupt) == ("TEST", 2, 6, False, False)
    assert a.time == a.file_time == dt.datetime(2019, 1, 1) and a.processing_tools == ['"A" 1', '"B" 2'] and a.meta["Note"] == "a"
    assert b.is_wera and not b.is_corrupt and b.columns == ["LATD", "LOND", "VELO"] and c.is_corrupt and d.is_corrupt and e.n_rows == 0
    assert series.valid_files(ctf.file_table(got)).count() == 2
    rows = ctf.read_radials(got).orderBy("path", "row_no").collect()
    assert [(r.LOND, r.VELO, r.VFLG, r.SPRC) for r in rows] == [(-73.97, 5.5, 0, 2), (-73.96, None, 128, 3), (-80.0, 1.5, None, None)]
    assert [r.VELO for r in ctf.read_radials(got, flip=True).orderBy("path", "row_no").collect()][0] == -5.5
    diag = ctf.read_diagnostics(got, "rads", {"TIME": "double", "XTRP": "string"}).collect()
    assert sorted((r.XTRP, r.time) for r in diag) == [("0F", dt.datetime(2019, 1, 1, h, 10)) for h in (0, 4)]


def test_header(spark):
    files = ctf.file_table(parsed(spark, CODAR.format(hour=3, velo=1), WERA)).orderBy("path")
    lon, lat = headers.receiver(F.col("meta"))
    typed = headers.clean_radial_header(F.col("meta"))
    a, b = files.select(lon.alias("lon"), lat.alias("lat"), *(typed[k].alias(k) for k in ("TimeZone", "RangeEnd", "MergedCount", "RangeResolutionKMeters", "Origin", "TransmitCenterFreqMHz", "TimeStamp"))).collect()
    assert (a.lon, a.lat, a.TimeZone, a.RangeEnd, a.MergedCount, a.RangeResolutionKMeters) == (-73.9735333, 40.3668167, "UTC", 24, 7, 3.0203)
    assert a.TimeStamp == dt.datetime(2019, 1, 1, 3) and a.Origin.startswith("40.36") and b.Origin is None and b.TransmitCenterFreqMHz is None
    meta = spark.range(1).select(F.create_map(F.lit("CoastlineSector"), F.lit("10.5 True 200 Deg"), F.lit("TimeCoverage"), F.lit("75.5 Minutes"), F.lit("WaveMergeMethod"), F.lit("1 x"), F.lit("TimeStamp"), F.lit("2019 1 2 3 4 5")).alias("meta"))
    wave = headers.clean_wave_header(F.col("meta"))
    r = meta.select(*(wave[k].alias(k) for k in ("CoastlineSector", "TimeCoverage", "WaveMergeMethod", "TimeStamp", "Site"))).first()
    assert tuple(r) == ("10.5, 200", "75.5", "1", "2019-01-02 03:04:05", None)


def test_waves(spark):
    texts = [WAVES.format(h="0.2", d="nan"), WAVES.format(h="5.0", d="3.0")]
    got = ctf.read_waves(ctf.parse_files(spark.createDataFrame([(f"/d/W_{i}.wls", t) for i, t in enumerate(texts)], "path string, content string")))
    assert [(r.kind, r.MWHT, r.DIST) for r in got.orderBy("path", "table_no", "row_no").collect()] == [("averaged", 0.2, None), ("averaged", None, None), ("ranged", 5.0, 3.0), ("ranged", None, None), ("ranged", 2.5, 6.0)]
    assert [r.mwht_flag for r in series.flag_wave_heights(got).orderBy("path", "table_no", "row_no").collect()] == [1, 4, 1, 4, 1]
    assert series.flag_wave_heights(got, remove=True).count() == 3


@pytest.fixture
def station(tmp_path):
    for hour in range(4):
        (tmp_path / NAME.format(hour)).write_text(CODAR.format(hour=hour, velo=5.5 + 40 * (hour == 3)))
    return tmp_path


def test_catalogue(spark, station):
    got = tables.catalogue(tables.list_files(spark, str(station), "RDLi*")).collect()
    assert [r.file_time.hour for r in got] == [0, 1, 2, 3] and got[0].prefix == "RDLi"


def test_qc_job(spark, station, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("out"))
    workflows.qc_job(spark, str(station), target)
    rows = spark.read.parquet(f"{target}/flagged").filter("SPRC = 2").orderBy("time").collect()
    assert [r.Q206 for r in rows] == [2, 1, 1, 3] and [r.Q209 for r in rows] == [2, 2, 4, 1]
    assert [r.PRIM for r in rows] == [4] * 4  # too few vectors
    assert spark.read.parquet(f"{target}/files").first().provenance[0].startswith("%QCTest")
    cover = workflows.concat_job(spark, [f"{target}/flagged"], f"{target}/all", "RDLi", "2019-01-01 01:00:00").first()
    assert cover.n_times == 3 and cover.time_coverage_start == "20190101T010000Z"


def test_incremental_equals_whole(spark, station, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")
    source, target = base / "in", str(base / "out")
    source.mkdir()
    for hour in range(4):
        (source / NAME.format(hour)).write_text((station / NAME.format(hour)).read_text())
        incremental.start_qc(spark, str(source), target, str(base / "check")).awaitTermination()
    whole = str(base / "whole")
    workflows.qc_job(spark, str(station), whole)
    pick = ["time", "row_no", "Q206", "Q209", "PRIM"]
    one, two = (sorted(map(tuple, spark.read.parquet(p).select(*pick).collect())) for p in (target, f"{whole}/flagged"))
    assert one == two


def test_render_round_trip(spark):
    rows = ctf.read_radials(parsed(spark, CODAR.format(hour=0, velo=5.5)))
    texts = ctf.render_files(rows, F.array(F.lit("%Site: TEST"), F.lit("%TimeStamp: 2019 01 01 00 00 00")), {"LOND": "%.7f", "VELO": "%.3f", "VFLG": "%d"}, "LLUV RDL9")
    text = texts.first().value
    assert "%TableRows: 2" in text and "999.000" in text
    back = ctf.read_radials(ctf.parse_files(texts.withColumnRenamed("value", "content"))).orderBy("row_no").collect()
    assert [(r.LOND, r.VELO, r.VFLG) for r in back] == [(-73.97, 5.5, 0), (-73.96, None, 128)]


def test_wave_and_series_jobs(spark, tmp_path):
    source = tmp_path / "waves"
    source.mkdir()
    for i, (h, d) in enumerate((("0.1", "nan"), ("5.0", "3.0"))):
        (source / f"WVLM_TEST_2019_0{i + 1}_01_0000.wls").write_text(WAVES.format(h=h, d=d))
    workflows.wave_job(spark, str(source), str(tmp_path / "out"))
    kept = tables.read_tables(spark, str(tmp_path / "out"))
    assert sorted(r.wave_height for r in kept.collect()) == [2.5, 5.0] and {r.site for r in kept.collect()} == {"TEST"}

    t0 = dt.datetime(2019, 1, 1)
    cells = spark.createDataFrame([("A", t0, 1.0, 10.0, 5.0), ("A", t0 + dt.timedelta(hours=1), 1.0, 20.0, 6.0)], "site string, time timestamp, range double, bearing double, VELO double")
    points = spark.createDataFrame([("x", "A", 0.01, 45.01)], "point_id string, site string, lon double, lat double")
    origins = spark.createDataFrame([("A", 0.0, 45.0)], "site string, origin_lon double, origin_lat double")
    workflows.series_job(cells, points, origins, str(tmp_path / "series"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "series")).orderBy("time").collect()
    assert [(r.point_id, r.VELO) for r in rows] == [("x", None), ("x", "6.0")]


# --- small files of the other kinds

RANGED = """%Site: TEST ""
%Origin:  40.3668167  -73.9735333
%TableType: WAVL WVM9
%TableColumnTypes: TIME MWHT DIST TYRS TMON TDAY THRS TMIN TSEC
%TableStart:
 0 1.5 3.0 2019 1 1 0 0 0
%TableEnd:
%TableType: WAVL WVM9
%TableColumnTypes: TIME MWHT DIST TYRS TMON TDAY THRS TMIN TSEC
%TableStart: 2
 0 1.7 6.0 2019 1 1 0 0 0
%TableEnd: 2
%End:
"""
RDT = """%Site: TEST ""
%TableType: rads rad1
%TableColumns: 10
%TableColumnTypes: TIME AMP1 AMP2 RTYP TYRS TMON TDAY THRS TMIN TSEC
%TableRows: 2
%TableStart:
%%   Time  Amp1  Amp2
    0  0.5000  999.0000  1  2018 1 1 0 0 0
  600  0.6000    0.7000  1  2018 1 1 0 10 0
%TableEnd:
%%
%ProcessingTool: "Maker" 1.0
%End:
"""
ELLIPTICAL = """%FileType: LLUV elpt "EllipticalMap"
%Site: BRLO ""
%TimeStamp: 2020 10 01  00 00 00
%RadialSite: BRLO
%TransmitterLocation: 40.3 -73.9
%TableType: LLUV ELP9
%TableColumnTypes: LOND LATD VELU VELV VFLG VELO SPRC
%TableStart:
 -73.1 40.1 1.0 2.0 0 2.2 3
%TableEnd:
%End:
"""


def parsed_text(spark, *files):
    return ctf.parse_files(spark.createDataFrame(list(files), "path string, content string"))


def test_other_kinds(spark):
    waves = ctf.read_waves(parsed_text(spark, ("WVLR_TEST_2019_01_01_0000.wls", RANGED)))
    assert sorted((r.kind, r.MWHT, r.DIST) for r in waves.collect()) == [("ranged", 1.5, 3.0), ("ranged", 1.7, 6.0)]
    parsed = parsed_text(spark, ("STAT_TEST_2018_01_01.rdt", RDT))
    rows = ctf.read_diagnostics(parsed, "rads", {"TIME": "double", "AMP1": "double", "AMP2": "double"}).orderBy("TIME_S").collect()
    assert [(r.AMP1, r.AMP2) for r in rows] == [(0.5, 999.0), (0.6, 0.7)] and rows[1].time == dt.datetime(2018, 1, 1, 0, 10)
    parsed = parsed_text(spark, ("ELTm_BRLO_2020_10_01_0000.euv", ELLIPTICAL))
    assert ctf.file_table(parsed).first().meta["TransmitterLocation"] == "40.3 -73.9" and ctf.read_radials(parsed).first().VELO == 2.2


def test_export_of_whole_files(spark):
    parsed = parsed_text(spark, ("RDLi_TEST_2019_01_01_0000.ruv", CODAR.format(hour=0, velo=5.5)), ("RDLi_TEST_2019_01_01_0100.ruv", CODAR.format(hour=1, velo=6.5)))
    parsed = parsed.withColumn("ran", F.array(F.lit("%QCTest: one")))
    rows = ctf.read_radials(parsed).withColumn("PRIM", F.lit(1))
    texts = {r.path: r.value for r in ctf.export_files(rows, parsed, ctf.RADIAL_COLUMNS, ("PRIM",), "ran").collect()}
    first = texts["RDLi_TEST_2019_01_01_0000.ruv"]
    lines = first.splitlines()
    assert lines[:3] == ["%CTF: 1.00", '%FileType: LLUV rdls "RadialMap"', "%Manufacturer: CODAR"]
    assert lines.index("%QCTest: one") < lines.index("%TableType: LLUV RDL9") and "%TableColumnTypes: LOND LATD VELO VFLG BEAR SPRC PRIM" in lines
    assert " -73.9600000  40.4300000  999.000  128  6.0  3  1" in lines and "%  0  0F  2019  1  1  0  10  0" in lines
    assert lines[-4:] == ["%ProcessedTimeStamp: 2019 01 02", '%ProcessingTool: "A" 1', '%ProcessingTool: "B" 2', "%End:"]
    again = ctf.export_files(ctf.read_radials(parsed_text(spark, *texts.items())).withColumn("PRIM", F.lit(1)), parsed, ctf.RADIAL_COLUMNS, ("PRIM",), "ran")
    assert {r.path: r.value for r in again.collect()} == texts


def test_signs_of_whole_numbers(spark):
    row = spark.createDataFrame([("-40 -73",), ("+5 .5 -1.25 7.",)], "o string").select(headers.numbers(F.col("o")).alias("n")).collect()
    assert [r.n for r in row] == [["-40", "-73"], ["+5", ".5", "-1.25", "7."]]


def test_replayed_files_leave_the_same_rows(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for run, hours in enumerate(((0, 1), (1, 2, 3), (3,))):  # later batches bring hours again, with other velocities
        for h in hours:
            (source / f"RDLi_TEST_2019_01_01_0{h}00.ruv").write_text(CODAR.format(hour=h, velo=5.0 + h + run))
        incremental.start_qc(spark, f"file://{source}", target, str(tmp_path / f"check{run}")).awaitTermination()
    rows = spark.read.parquet(target).groupBy("time").count().collect()
    assert sorted((r.time.hour, r["count"]) for r in rows) == [(0, 2), (1, 2), (2, 2), (3, 2)]


def test_jobs_on_files(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for h in range(3):
        (source / f"RDLi_TEST_2019_01_01_0{h}00.ruv").write_text(CODAR.format(hour=h, velo=5.0 + h))
    limits = spark.createDataFrame([("TEST", 6.5, ["Q202"])], "site string, max_speed double, include array<string>")
    workflows.qc_job(spark, f"file://{source}", target, limits=limits, export=True)
    flagged = spark.read.parquet(f"{target}/flagged")
    assert sorted((r.time.hour, r.PRIM) for r in flagged.filter("VELO IS NOT NULL").collect()) == [(0, 1), (1, 1), (2, 4)]
    assert "highest of Q202 (2 ignored)" in spark.read.parquet(f"{target}/files").first().provenance[-1]
    assert spark.read.text(f"{target}/text").filter("value = '%End:'").count() == 3
    with_range = CODAR.replace("%TableColumnTypes: LOND LATD VELO VFLG BEAR SPRC", "%TableColumnTypes: LOND LATD VELO VFLG BEAR RNGE")
    (source / "RDLi_TEST_2019_01_01_0500.ruv").write_text(with_range.format(hour=5, velo=1.0))
    workflows.gridded_job(spark, f"file://{source}", f"{target}/g", ("VELO",))
    cells = spark.read.parquet(f"{target}/g/gridded").collect()
    assert {r.kind for r in cells} == {"gridded"} and {r.time.hour for r in cells} == {5} and len(cells) == 2
