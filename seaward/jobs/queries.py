"""Registered queries: each operator on a radar table derived from the given tables, with the same in DuckDB SQL.

Vectors come from ``lineitem``: sites, hours, bearing and range cells and velocities are functions of its keys.  Waves
and diagnostics come from ``events``, points from ``supplier``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.functions import geodesy, headers, vectors
from seaward.operators import grid, land, qc, series
from seaward.sources import ctf, tables
from seaward.streaming import incremental

EPOCH = 1546300800  # 2019-01-01, hour 0
LIMITS = qc.Thresholds(max_speed=75.0, high_speed=60.0, min_count=180, low_count=190, warning_threshold=2.0, failure_threshold=5.0)
KEYS = ["site", "hr", "bcell", "SPRC"]
ORIGINS = [("S0", -73.9735333, 40.3668167), ("S1", -74.25, 39.7)]
RING = [(-74.2, 39.9), (-73.6, 39.95), (-73.5, 40.12), (-73.75, 40.05), (-73.9, 40.3), (-74.2, 39.9)]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived radial table."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_suppkey % 2 AS site_id", "l_orderkey % 120 AS hr", "l_partkey % 72 AS bcell",
        "2 + (CAST(floor(l_partkey / 72) AS BIGINT) + l_linenumber * 7 + CAST(l_quantity AS BIGINT)) % 23 AS sprc",
        "CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 16001 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(80 AS DOUBLE) AS v",
    )
    cells = raw.groupBy("site_id", "hr", "bcell", "sprc").agg(F.max("v").alias("v"))
    return cells.selectExpr(
        "concat('RDL', CASE WHEN site_id < 2 THEN 'i' ELSE 'm' END) AS prefix", "concat('S', site_id) AS site", f"timestamp_seconds({EPOCH} + hr * 3600) AS time", "CAST(hr AS BIGINT) AS hr",
        "CAST(bcell AS BIGINT) AS bcell", "CAST(sprc AS BIGINT) AS SPRC", "CAST(bcell * 100 + sprc AS BIGINT) AS row_no",
        "CAST(-74 AS DOUBLE) + bcell * CAST(0.01 AS DOUBLE) AS LOND", "CAST(39.8 AS DOUBLE) + sprc * CAST(0.02 AS DOUBLE) AS LATD",
        "CASE WHEN bcell % 9 = 0 THEN CAST(sprc AS DOUBLE) ELSE v END AS VELO", "CASE WHEN (bcell + sprc) % 5 = 0 THEN 128 ELSE 0 END AS VFLG",
        "CAST(1 + 5 * bcell AS DOUBLE) AS BEAR", "sprc * CAST(3.0203 AS DOUBLE) AS RNGE",
    )


RAD = f"""raw AS (
 SELECT l_suppkey % 2 AS site_id, l_orderkey % 120 AS hr, l_partkey % 72 AS bcell,
  2 + (CAST(floor(l_partkey / 72) AS BIGINT) + l_linenumber * 7 + CAST(l_quantity AS BIGINT)) % 23 AS sprc,
  CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 16001 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(80 AS DOUBLE) AS v FROM lineitem),
rad AS (SELECT 'S' || site_id AS site, CAST(hr AS BIGINT) AS hr, CAST(bcell AS BIGINT) AS bcell, CAST(sprc AS BIGINT) AS "SPRC", bcell * 100 + sprc AS row_no,
  CAST(-74 AS DOUBLE) + bcell * CAST(0.01 AS DOUBLE) AS lond, CAST(39.8 AS DOUBLE) + sprc * CAST(0.02 AS DOUBLE) AS latd,
  CASE WHEN bcell % 9 = 0 THEN CAST(sprc AS DOUBLE) ELSE max(v) END AS velo, CASE WHEN (bcell + sprc) % 5 = 0 THEN 128 ELSE 0 END AS vflg,
  CAST(1 + 5 * bcell AS DOUBLE) AS bear, sprc * CAST(3.0203 AS DOUBLE) AS rnge, to_timestamp({EPOCH} + hr * 3600) AT TIME ZONE 'UTC' AS ts
 FROM raw GROUP BY site_id, hr, bcell, sprc),
origins(site, olon, olat) AS (VALUES {', '.join(f"('{s}', CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for s, x, y in ORIGINS)})"""
WITH = f"WITH {RAD}"
_K = 'site, hr, bcell, "SPRC"'


def files_of(rad: DataFrame) -> DataFrame:
    """Catalogue rows of the derived table; some hours have a faulty header."""
    hour = F.date_format("time", "yyyy_MM_dd_HHmm")
    files = rad.groupBy("prefix", "site", "time", "hr").agg(F.count(F.lit(1)).cast("int").alias("n_rows"))
    zone = F.when(F.col("hr") % 7 == 3, "").otherwise('"UTC" +0.000 0 "Atlantic/Reykjavik"')
    place = F.when(F.col("hr") % 11 == 5, "140.3668167  -73.9735333").otherwise("40.3668167  -73.9735333")
    stamp = F.date_format("time", "yyyy MM dd  HH mm ss")
    pairs = {
        "FileType": F.lit('LLUV rdls "RadialMap"'), "Site": F.concat("site", F.lit(' ""')), "TimeStamp": stamp, "TimeZone": zone, "Origin": place,
        "PatternType": F.lit("Ideal"), "AngularResolution": F.lit("5 Deg"), "RangeResolutionKMeters": F.lit("3.0203"), "TransmitCenterFreqMHz": F.concat_ws("", F.lit("13."), F.col("hr")),
        "TableColumns": F.when(F.col("hr") % 13 == 0, "19").otherwise("18"), "RangeEnd": F.concat_ws("", F.col("hr"), F.lit(".0 km")), "MergedCount": F.concat_ws(" ", F.col("hr"), F.lit("minutes")), "Other": F.lit("x"),
    }
    return files.select(
        "prefix", "site", "time", "hr", F.concat_ws("_", "prefix", "site", hour).alias("stem"), F.concat(F.concat_ws("_", "prefix", "site", hour), F.lit(".ruv")).alias("path"),
        F.col("time").alias("file_time"), F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))).alias("meta"), "n_rows", F.lit(18).alias("n_cols_row"), F.lit(False).alias("is_corrupt"),
    )


def origins_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ORIGINS, "site string, origin_lon double, origin_lat double")


def waves_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "event_type", "CAST(ts AS timestamp) AS time", "value / CAST(100 AS DOUBLE) AS MWHT", "user_id % 10 AS DIST")


@query(f"""{WITH} SELECT site, hr, 'RDLi_' || site || strftime(ts, '_%Y_%m_%d_%H%M') || '.ruv' AS file_name, 'RDLi' AS prefix,
 strftime(ts, '%Y-%m-%d %H:%M') AS file_time FROM (SELECT DISTINCT site, hr, ts FROM rad)""")
def catalog_time(spark, sf_dir):
    found = tables.catalogue(files_of(vectors_of(spark, sf_dir)).select("site", "hr", F.concat(F.lit("/data/"), "path").alias("path")))
    return found.select("site", "hr", "file_name", "prefix", F.date_format("file_time", "yyyy-MM-dd HH:mm").alias("file_time"))


FORMATS = {"LOND": "%.7f", "LATD": "%.7f", "VFLG": "%d", "VELO": "%.3f", "BEAR": "%.1f", "SPRC": "%d"}


@query(f"""{WITH} SELECT site, hr, CAST(round(lond, 7) AS DOUBLE) AS "LOND", CAST(round(latd, 7) AS DOUBLE) AS "LATD", vflg AS "VFLG", round(velo, 3) AS "VELO",
 bear AS "BEAR", CAST("SPRC" AS INTEGER) AS "SPRC" FROM rad""")
def ctf_roundtrip(spark, sf_dir):
    rad = vectors_of(spark, sf_dir).withColumn("path", F.concat(F.concat_ws("_", "prefix", "site", F.date_format("time", "yyyy_MM_dd_HHmm")), F.lit(".ruv")))
    head = F.array(F.lit("%CTF: 1.00"), F.concat(F.lit("%Site: "), "site", F.lit(' ""')), F.concat(F.lit("%TimeStamp: "), F.date_format("time", "yyyy MM dd  HH mm ss")))
    texts = ctf.render_files(rad, head, FORMATS, "LLUV RDL9", qc.provenance())
    back = ctf.read_radials(ctf.parse_files(texts.withColumnRenamed("value", "content")))
    return back.select("site", ((F.unix_timestamp("time") - EPOCH) / 3600).cast("bigint").alias("hr"), *FORMATS)


@query(f"""{WITH} SELECT {_K}, CASE WHEN velo NOT IN (999, 1080) AND "SPRC" NOT IN (4, 9) THEN velo END AS "VELO" FROM rad""")
def fill_to_null(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    filled = rad.withColumn("VELO", F.when(F.col("SPRC") == 4, 999.0).when(F.col("SPRC") == 9, 1080.0).otherwise(F.col("VELO")))
    return ctf.fill_to_null(filled, ["VELO"]).select(*KEYS, "VELO")


@query(f'{WITH} SELECT {_K}, -velo AS "VELO", -(velo + 1) AS "MAXV", -(velo - 1) AS "MINV" FROM rad')
def flip_velocity(spark, sf_dir):
    rad = vectors_of(spark, sf_dir).withColumns({"MAXV": F.col("VELO") + 1, "MINV": F.col("VELO") - 1})
    return ctf.flip_velocity(rad).select(*KEYS, "VELO", "MAXV", "MINV")


@query(f"""{WITH} SELECT DISTINCT site, hr, site AS "Site", strftime(ts, '%Y-%m-%d %H:%M:%S') AS "TimeStamp", CASE WHEN hr % 7 <> 3 THEN 'UTC' END AS "TimeZone",
 CASE WHEN hr % 11 = 5 THEN 140.3668167 ELSE 40.3668167 END::DOUBLE AS lat, CAST(-73.9735333 AS DOUBLE) AS lon, CAST(hr AS INTEGER) AS "RangeEnd", CAST(hr AS INTEGER) AS "MergedCount",
 CAST(3.0203 AS DOUBLE) AS "RangeResolutionKMeters", CAST('13.' || hr AS DOUBLE) AS "TransmitCenterFreqMHz", 5 AS "AngularResolution" FROM rad""")
def clean_header(spark, sf_dir):
    files = files_of(vectors_of(spark, sf_dir))
    lon, lat = headers.receiver(F.col("meta"))
    typed = headers.clean_radial_header(F.col("meta"))
    chosen = ["Site", "TimeZone", "RangeEnd", "MergedCount", "RangeResolutionKMeters", "TransmitCenterFreqMHz", "AngularResolution"]
    stamp = F.date_format(typed["TimeStamp"], "yyyy-MM-dd HH:mm:ss").alias("TimeStamp")
    return files.select("site", "hr", *(typed[c].alias(c if c != "Site" else "Code") for c in chosen), stamp, lat.alias("lat"), lon.alias("lon"))


SQL["clean_header"] = SQL["clean_header"].replace('site AS "Site"', 'site AS "Code"')


@query(f'{WITH} SELECT {_K}, velo AS "VELO" FROM rad WHERE hr BETWEEN 10 AND 34')
def time_slice(spark, sf_dir):
    return series.time_slice(vectors_of(spark, sf_dir), "2019-01-01 10:00:00", "2019-01-02 10:00:00").select(*KEYS, "VELO")


_Q201 = "CASE WHEN hr % 7 = 3 OR hr % 11 = 5 OR hr % 13 = 0 THEN 4 ELSE 1 END"
_Q202 = "CASE WHEN abs(velo) > 75 THEN 4 WHEN abs(velo) > 60 AND abs(velo) < 75 THEN 3 ELSE 1 END"
_Q203 = "CASE WHEN vflg = 128 THEN 4 ELSE 1 END"
_N = "count(*) FILTER (WHERE vflg <> 128) OVER (PARTITION BY site, hr)"
_Q204 = f"CASE WHEN {_N} < 180 THEN 4 WHEN {_N} <= 190 THEN 3 ELSE 1 END"
_D = "abs(avg(bear) OVER (PARTITION BY site, hr) - 180)"
_Q207 = f"CASE WHEN {_D} >= 5 THEN 4 WHEN {_D} >= 2 THEN 3 ELSE 1 END"
_Q206 = "CASE WHEN p.velo IS NULL THEN 2 WHEN abs(r.velo - p.velo) > 54 THEN 4 WHEN abs(r.velo - p.velo) > 36 AND abs(r.velo - p.velo) < 54 THEN 3 ELSE 1 END"
_Q209 = "CASE WHEN p.velo IS NULL OR o.velo IS NULL THEN 2 WHEN abs(r.velo - p.velo) >= 0.01 OR abs(p.velo - o.velo) >= 0.01 THEN 1 ELSE 4 END"
_Q901 = "CASE WHEN p.velo IS NULL OR o.velo IS NULL THEN 2 WHEN abs(r.velo - p.velo) < 0.01 AND abs(r.velo - o.velo) < 0.01 THEN 4 ELSE 1 END"
_BACK = """rad r LEFT JOIN rad p ON p.site = r.site AND p.lond = r.lond AND p.latd = r.latd AND p.hr = r.hr - 1
 LEFT JOIN rad o ON o.site = r.site AND o.lond = r.lond AND o.latd = r.latd AND o.hr = r.hr - 2"""
_RK = 'r.site, r.hr, r.bcell, r."SPRC"'
_MED = """med AS (SELECT site, hr, (bcell + b + 72) % 72 AS bcell, "SPRC" + s AS "SPRC", median(velo) AS m
 FROM rad, (SELECT unnest(generate_series(-2, 2)) AS b) x, (SELECT unnest(generate_series(-2, 2)) AS s) y GROUP BY ALL)"""


@query(f'{WITH} SELECT DISTINCT site, hr, {_Q201} AS "Q201" FROM rad')
def q201_syntax(spark, sf_dir):
    files = files_of(vectors_of(spark, sf_dir))
    return qc.q201_syntax(files).join(files.select("prefix", "site", "time", "hr"), ["prefix", "site", "time"]).select("site", "hr", "Q201")


@query(f'{WITH} SELECT {_K}, {_Q202} AS "Q202" FROM rad')
def q202_max_velocity(spark, sf_dir):
    return vectors_of(spark, sf_dir).select(*KEYS, qc.q202_maximum_velocity(LIMITS).alias("Q202"))


@query(f'{WITH} SELECT {_K}, {_Q203} AS "Q203" FROM rad')
def q203_valid_location(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    return rad.select(*KEYS, qc.q203_valid_location(rad.columns).alias("Q203"))


@query(f'{WITH} SELECT {_K}, {_Q204} AS "Q204" FROM rad')
def q204_radial_count(spark, sf_dir):
    return vectors_of(spark, sf_dir).select(*KEYS, qc.q204_radial_count(LIMITS).alias("Q204"))


@query(f'{WITH}, {_MED} SELECT {_RK}, CASE WHEN abs(r.velo - m) > 30 THEN 4 ELSE 1 END AS "Q205" FROM rad r JOIN med USING (site, hr, bcell, "SPRC")')
def q205_spatial_median(spark, sf_dir):
    rad = vectors_of(spark, sf_dir).select("prefix", "time", *KEYS, "row_no", "BEAR", "VELO", F.lit(5.0).alias("bearing_step"))
    return qc.q205_spatial_median(rad, LIMITS).select(*KEYS, "Q205")


@query(f'{WITH} SELECT {_RK}, {_Q206} AS "Q206" FROM {_BACK}')
def q206_temporal_gradient(spark, sf_dir):
    return qc.temporal_tests(vectors_of(spark, sf_dir), LIMITS, ["Q206"]).select(*KEYS, "Q206")


@query(f'{WITH} SELECT {_K}, {_Q207} AS "Q207" FROM rad')
def q207_avg_bearing(spark, sf_dir):
    return vectors_of(spark, sf_dir).select(*KEYS, qc.q207_average_bearing(LIMITS).alias("Q207"))


@query(f'{WITH} SELECT {_RK}, {_Q209} AS "Q209" FROM {_BACK}')
def q209_stuck_value(spark, sf_dir):
    return qc.temporal_tests(vectors_of(spark, sf_dir), LIMITS, ["Q209"]).select(*KEYS, "Q209")


@query(f'{WITH} SELECT {_RK}, {_Q901} AS "Q901" FROM {_BACK}')
def q901_stuck_value_v2(spark, sf_dir):
    return qc.temporal_tests(vectors_of(spark, sf_dir), LIMITS, ["Q901"]).select(*KEYS, "Q901")



def _prim(*names: str) -> str:
    every = lambda v: "(" + " OR ".join(f'"{n}" = {v}' for n in names) + ")"
    return f"CASE WHEN {every(4)} THEN 4 WHEN {every(3)} THEN 3 ELSE 1 END"


_ROWS = f'SELECT {_K}, velo, {_Q202} AS "Q202", {_Q203} AS "Q203", {_Q204} AS "Q204" FROM rad'


@query(f'{WITH} SELECT {_K}, "Q202", "Q203", "Q204", {_prim("Q202", "Q203", "Q204")} AS "PRIM" FROM ({_ROWS})')
def primary_flag(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    flagged = rad.withColumns({"Q202": qc.q202_maximum_velocity(LIMITS), "Q203": qc.q203_valid_location(rad.columns), "Q204": qc.q204_radial_count(LIMITS)})
    return flagged.select(*KEYS, "Q202", "Q203", "Q204", qc.primary_flag(["Q202", "Q203", "Q204"]).alias("PRIM"))


_CHAIN = f"""{WITH}, {_MED}, flagged AS (SELECT {_RK}, r.velo, {_Q201.replace('hr', 'r.hr')} AS "Q201", {_Q202.replace('velo', 'r.velo')} AS "Q202", {_Q203.replace('vflg', 'r.vflg')} AS "Q203",
 f."Q204", CASE WHEN abs(r.velo - m) > 30 THEN 4 ELSE 1 END AS "Q205", {_Q206} AS "Q206", f."Q207", {_Q209} AS "Q209" FROM {_BACK}
 JOIN med m ON m.site = r.site AND m.hr = r.hr AND m.bcell = r.bcell AND m."SPRC" = r."SPRC"
 JOIN (SELECT {_K}, {_Q204} AS "Q204", {_Q207} AS "Q207" FROM rad) f ON f.site = r.site AND f.hr = r.hr AND f.bcell = r.bcell AND f."SPRC" = r."SPRC")"""
_TESTS = [f"Q20{i}" for i in (1, 2, 3, 4, 5, 6, 7, 9)]
_ALL = ", ".join(f'"{t}"' for t in _TESTS)


def _chain(spark, sf_dir) -> DataFrame:
    rad = vectors_of(spark, sf_dir)
    return qc.qc_radials(rad, files_of(rad), LIMITS)


@query(f'{_CHAIN} SELECT {_K}, velo AS "VELO", {_ALL}, {_prim(*_TESTS)} AS "PRIM" FROM flagged')
def qc_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select(*KEYS, "VELO", *_TESTS, "PRIM")


@query(f'{_CHAIN} SELECT {_K}, velo AS "VELO" FROM flagged WHERE {_prim(*_TESTS)} <> 4')
def clean_copy(spark, sf_dir):
    return qc.clean_copy(_chain(spark, sf_dir)).select(*KEYS, "VELO")


_EDGES = [(0, *a, *b) for a, b in zip(RING, RING[1:], strict=False)]
_EDGE_SQL = ", ".join("(" + ", ".join(f"CAST({v} AS DOUBLE)" for v in e[1:]) + ")" for e in _EDGES)


@query(f"""{WITH}, edges(x1, y1, x2, y2) AS (VALUES {_EDGE_SQL}), places AS (SELECT DISTINCT lond, latd FROM rad)
SELECT lond AS "LOND", latd AS "LATD", count(*) FILTER (WHERE CASE WHEN (y1 > latd) <> (y2 > latd) THEN lond < (x2 - x1) * (latd - y1) / (y2 - y1) + x1 ELSE false END) % 2 = 1 AS on_land
FROM places, edges GROUP BY lond, latd""")
def land_mask(spark, sf_dir):
    edges = spark.createDataFrame(_EDGES, "ring_id int, x1 double, y1 double, x2 double, y2 double")
    return land.on_land(vectors_of(spark, sf_dir), edges)


@query(f"""{WITH}, s AS (SELECT site, min(rnge) AS lo, round(max(rnge) + 3.0203, 4) AS hi FROM rad GROUP BY site)
SELECT site, 'range' AS axis, CAST(i AS INTEGER) AS position, round(lo + i * CAST(3.0203 AS DOUBLE), 4) AS value FROM (SELECT site, lo, unnest(generate_series(0, CAST(ceil((hi - lo) / 3.0203) AS BIGINT) - 1)) AS i FROM s)
UNION ALL SELECT site, 'bearing', CAST(i AS INTEGER), CAST(1 + 5 * i AS DOUBLE) FROM (SELECT DISTINCT site FROM rad), (SELECT unnest(generate_series(0, 71)) AS i)""")
def grid_axes(spark, sf_dir):
    step = F.lit(3.0203)
    found = vectors_of(spark, sf_dir).groupBy("site").agg(grid.range_axis(F.min("RNGE"), F.max("RNGE"), step).alias("range"), grid.bearing_axis(F.lit(151.0), F.lit(5.0)).alias("bearing"))
    one = lambda axis: found.select("site", F.lit(axis).alias("axis"), F.posexplode(axis).alias("position", "value"))
    return one("range").unionByName(one("bearing"))


def _axes(spark) -> DataFrame:
    rows = [(s, 6.0, 6.1, 11, 1.0, 10.0, 36) for s, _, _ in ORIGINS]
    return spark.createDataFrame(rows, "site string, range_first double, range_step double, n_ranges int, bearing_first double, bearing_step double, n_bearings int")


_SNAP = """snapped AS (SELECT site, hr, round(6 + ri * CAST(6.1 AS DOUBLE), 4) AS "range", CAST(1 + 10 * bi AS DOUBLE) AS bearing, row_no, velo, vflg FROM (SELECT *,
 least(greatest(ceil((rnge - 6) / CAST(6.1 AS DOUBLE) - 0.5), 0), 10) AS ri, least(greatest(ceil((bear - 1) / CAST(10 AS DOUBLE) - 0.5), 0), 35) AS bi FROM rad)),
cells AS (SELECT site, hr, "range", bearing, arg_max(velo, row_no) AS velo, arg_max(vflg, row_no) AS vflg FROM snapped GROUP BY ALL)"""


def _cells(spark, sf_dir) -> DataFrame:
    return grid.snap(vectors_of(spark, sf_dir), _axes(spark), ["VELO", "VFLG"], ("prefix", "site", "time", "hr"))


@query(f'{WITH}, {_SNAP} SELECT site, hr, "range", bearing, velo AS "VELO", vflg AS "VFLG" FROM cells')
def grid_snap(spark, sf_dir):
    return _cells(spark, sf_dir).select("site", "hr", "range", "bearing", "VELO", "VFLG")


@query(f"""{WITH}, {_SNAP}, axes AS (SELECT * FROM (SELECT DISTINCT site, hr FROM cells), (SELECT round(6 + unnest(generate_series(0, 10)) * CAST(6.1 AS DOUBLE), 4) AS "range"), (SELECT CAST(1 + 10 * unnest(generate_series(0, 35)) AS DOUBLE) AS bearing))
SELECT site, hr, "range", bearing, velo AS "VELO" FROM axes LEFT JOIN cells USING (site, hr, "range", bearing)""")
def densify(spark, sf_dir):
    axes = _axes(spark).select("site", F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.round(F.lit(6.0) + i * F.lit(6.1), 4)).alias("ranges"), grid.bearing_axis(F.lit(1.0), F.lit(10.0)).alias("bearings"))
    return grid.densify(_cells(spark, sf_dir), axes, ["VELO"], ("prefix", "site", "time", "hr")).select("site", "hr", "range", "bearing", "VELO")


def _forward_sql(source: str, keep: str) -> str:
    """Unrolled forward geodesic over a source with lon, lat, az (degrees) and km; gives lon2, lat2."""
    a, f = geodesy.MAJOR, "(1.0::DOUBLE / 298.257223563::DOUBLE)"
    b = f"({a} * (1 - {f}))"
    q = f"SELECT *, radians(az) AS a1, (1 - {f}) * tan(radians(lat)) AS tu FROM ({source})"
    q = f"SELECT *, 1 / sqrt(1 + tu * tu) AS cu, tu / sqrt(1 + tu * tu) AS su, atan2(tu, cos(a1)) AS s1, sin(a1) / sqrt(1 + tu * tu) AS sa FROM ({q})"
    q = f"SELECT *, 1 - sa * sa AS c2a, (1 - sa * sa) * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS u2 FROM ({q})"
    q = f"SELECT *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) AS ba, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) AS bb FROM ({q})"
    q = f"SELECT *, km * 1000 / ({b} * ba) AS g0, km * 1000 / ({b} * ba) AS g FROM ({q})"
    for i in range(6):
        q = f"SELECT * EXCLUDE (g), g AS p{i}, g0 + bb * sin(g) * (cos(2 * s1 + g) + bb / 4 * (cos(g) * (2 * cos(2 * s1 + g) * cos(2 * s1 + g) - 1) - bb / 6 * cos(2 * s1 + g) * (4 * sin(g) * sin(g) - 3) * (4 * cos(2 * s1 + g) * cos(2 * s1 + g) - 3))) AS g FROM ({q})"
    q = f"SELECT *, cos(2 * s1 + g) AS md, sin(g) AS sg, cos(g) AS cg, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS cc FROM ({q})"
    lat2 = f"degrees(atan2(su * cg + cu * sg * cos(a1), (1 - {f}) * sqrt(sa * sa + (su * sg - cu * cg * cos(a1)) * (su * sg - cu * cg * cos(a1)))))"
    lon2 = f"lon + degrees(atan2(sg * sin(a1), cu * cg - su * sg * cos(a1)) - (1 - cc) * {f} * sa * (g + cc * sg * (md + cc * cg * (2 * md * md - 1))))"
    return f"SELECT {keep}, {lon2} AS lon2, {lat2} AS lat2 FROM ({q})"


def _inverse_sql(source: str, keep: str) -> str:
    """Unrolled inverse geodesic over a source with lon1, lat1, lon2, lat2; gives az, back, km."""
    a, f = geodesy.MAJOR, "(1.0::DOUBLE / 298.257223563::DOUBLE)"
    b = f"({a} * (1 - {f}))"
    q = f"SELECT *, atan((1 - {f}) * tan(radians(lat1))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2, radians(lon2 - lon1) AS ap, radians(lon2 - lon1) AS lam, CAST(0 AS DOUBLE) AS used FROM ({source})"
    extra = ""
    for _ in range(7):
        drop = f" EXCLUDE (lam, used{extra})"
        q = f"SELECT *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM ({q})"
        q = f"SELECT *, atan2(ss, cs) AS sg, cos(u1) * cos(u2) * sin(lam) / ss AS sa FROM ({q})"
        q = f"SELECT *, 1 - sa * sa AS c2, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS md FROM ({q})"
        q = f"SELECT *, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) AS cc FROM ({q})"
        q = f"SELECT * EXCLUDE (lam, used, ss, cs, sg, sa, c2, md, cc), ss AS ss_, cs AS cs_, sg AS sg_, c2 AS c2_, md AS md_, lam AS used, ap + (1 - cc) * {f} * sa * (sg + cc * ss * (md + cc * cs * (2 * md * md - 1))) AS lam FROM ({q.replace(drop, '')})"
        q = f"SELECT * EXCLUDE (ss_, cs_, sg_, c2_, md_), ss_ AS zs, cs_ AS zc, sg_ AS zg, c2_ AS z2, md_ AS zm FROM ({q})"
        if _ < 6:
            q = f"SELECT * EXCLUDE (zs, zc, zg, z2, zm) FROM ({q})"
    q = f"SELECT *, z2 * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS w FROM ({q})"
    q = f"SELECT *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS ba, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS bb FROM ({q})"
    km = f"{b} * ba * (zg - bb * zs * (zm + bb / 4 * (zc * (2 * zm * zm - 1) - bb / 6 * zm * (4 * zs * zs - 3) * (4 * zm * zm - 3)))) / 1000"
    az = "degrees(atan2(cos(u2) * sin(used), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(used)))"
    back = "degrees(atan2(cos(u1) * sin(used), cos(u1) * sin(u2) * cos(used) - sin(u1) * cos(u2))) + 180"
    return f"SELECT {keep}, (({az}) + 720) % 360 AS az, (({back}) + 720) % 360 AS back, {km} AS km FROM ({q})"


_PLACES = "SELECT DISTINCT site, bear, rnge, olon AS lon, olat AS lat, bear AS az, rnge AS km FROM rad JOIN origins USING (site)"


@query(f"""{WITH}, {_SNAP} SELECT site, "range", bearing, round(lon2, 4) AS lon, round(lat2, 4) AS lat FROM
 ({_forward_sql('SELECT DISTINCT site, "range", bearing, olon AS lon, olat AS lat, bearing AS az, "range" AS km FROM cells JOIN origins USING (site)', 'site, "range", bearing')})""")
def grid_lonlat(spark, sf_dir):
    return grid.positions(_cells(spark, sf_dir), origins_of(spark))


@query(f"{WITH} SELECT site, bear, rnge, round(lon2, 6) AS lon, round(lat2, 6) AS lat FROM ({_forward_sql(_PLACES, 'site, bear, rnge')})")
def reckon(spark, sf_dir):
    once = vectors_of(spark, sf_dir).select("site", F.col("BEAR").alias("bear"), F.col("RNGE").alias("rnge")).distinct().join(origins_of(spark), "site")
    at = once.withColumn("p", geodesy.reckon(F.col("origin_lon"), F.col("origin_lat"), F.col("bear"), F.col("rnge")))
    return at.select("site", "bear", "rnge", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


_PAIRS = "SELECT DISTINCT site, bcell, \"SPRC\", olon AS lon1, olat AS lat1, lond AS lon2, latd AS lat2 FROM rad JOIN origins USING (site)"


@query(f"""{WITH} SELECT site, bcell, "SPRC", round(az, 6) AS azimuth, round(back, 6) AS back_azimuth, round(km, 6) AS km FROM ({_inverse_sql(_PAIRS, 'site, bcell, "SPRC"')})""")
def inverse(spark, sf_dir):
    once = vectors_of(spark, sf_dir).select("site", "bcell", "SPRC", "LOND", "LATD").distinct().join(origins_of(spark), "site")
    at = once.withColumn("g", geodesy.inverse(F.col("origin_lon"), F.col("origin_lat"), F.col("LOND"), F.col("LATD")))
    return at.select("site", "bcell", "SPRC", *(F.round(f"g.{c}", 6).alias(c) for c in ("azimuth", "back_azimuth", "km")))


def _points(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS point_id", "concat('S', s_suppkey % 2) AS site", "s_suppkey AS k")
    return rows.join(origins_of(spark), "site").selectExpr("point_id", "site", "origin_lon + CAST(0.05 AS DOUBLE) + (k % 17) * CAST(0.03 AS DOUBLE) AS lon", "origin_lat - CAST(0.3 AS DOUBLE) + (k % 13) * CAST(0.04 AS DOUBLE) AS lat")


_POINTS = """points AS (SELECT s_suppkey AS point_id, site, olon + CAST(0.05 AS DOUBLE) + (s_suppkey % 17) * CAST(0.03 AS DOUBLE) AS lon2, olat - CAST(0.3 AS DOUBLE) + (s_suppkey % 13) * CAST(0.04 AS DOUBLE) AS lat2, olon AS lon1, olat AS lat1
 FROM supplier JOIN origins ON site = 'S' || (s_suppkey % 2))"""
_NEAR = f"""{WITH}, {_SNAP}, {_POINTS}, seen AS ({_inverse_sql('SELECT * FROM points', 'point_id, site')}),
nr AS (SELECT point_id, "range" FROM seen JOIN (SELECT DISTINCT site, "range" FROM cells) USING (site) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY abs("range" - km), "range" DESC) = 1),
nb AS (SELECT point_id, bearing FROM seen JOIN (SELECT DISTINCT site, bearing FROM cells) USING (site) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY abs(bearing - az), bearing DESC) = 1),
near AS (SELECT point_id, site, az, km, "range", bearing FROM seen JOIN nr USING (point_id) JOIN nb USING (point_id))"""


@query(f'{_NEAR} SELECT point_id, site, round(az, 6) AS azimuth, round(km, 6) AS km, "range", bearing FROM near')
def nearest_cell(spark, sf_dir):
    found = grid.nearest_cells(_points(spark, sf_dir), _cells(spark, sf_dir), origins_of(spark))
    return found.select("point_id", "site", F.round("azimuth", 6).alias("azimuth"), F.round("km", 6).alias("km"), "range", "bearing")


@query(f"""{_NEAR} SELECT point_id, site, t.hr, "range", bearing, velo AS "VELO" FROM near JOIN (SELECT DISTINCT site, hr FROM cells WHERE hr BETWEEN 0 AND 59) t USING (site)
 LEFT JOIN cells c USING (site, hr, "range", bearing)""")
def extract_timeseries(spark, sf_dir):
    rad = series.time_slice(vectors_of(spark, sf_dir), None, "2019-01-03 11:00:00")
    found = grid.extract_vectors(rad, _axes(spark), _points(spark, sf_dir), origins_of(spark), ["VELO"])
    return found.select("point_id", "site", ((F.unix_timestamp("time") - EPOCH) / 3600).cast("bigint").alias("hr"), "range", "bearing", "VELO")


SQL["extract_timeseries"] = SQL["extract_timeseries"].replace("(SELECT DISTINCT site, \"range\" FROM cells)", "(SELECT DISTINCT site, \"range\" FROM cells WHERE hr <= 59)").replace("(SELECT DISTINCT site, bearing FROM cells)", "(SELECT DISTINCT site, bearing FROM cells WHERE hr <= 59)")


@query(f'{WITH} SELECT site, hr, round(avg(velo), 6) + 0.0 AS "VELO" FROM rad WHERE bear BETWEEN 101 AND 141 AND rnge BETWEEN 20 AND 60 GROUP BY site, hr')
def box_mean(spark, sf_dir):
    found = grid.box_means(vectors_of(spark, sf_dir), (101, 141), (20, 60), ["VELO", "hr"])
    return found.select("site", F.col("hr").cast("bigint").alias("hr"), (F.round("VELO", 6) + F.lit(0.0)).alias("VELO"))


@query(f"""{WITH} SELECT site, hr, bcell, "SPRC", velo AS "VELO", CASE WHEN site = 'S1' THEN vflg END AS "VFLG" FROM rad""")
def concat_radials(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    return series.concatenate(rad.filter("site = 'S0'").drop("VFLG"), rad.filter("site = 'S1'")).select(*KEYS, "VELO", "VFLG")


@query(f'{WITH} SELECT {_K}, velo AS "VELO" FROM rad QUALIFY hr = max(hr) OVER (PARTITION BY site)')
def latest_step(spark, sf_dir):
    return series.latest_step(vectors_of(spark, sf_dir)).select(*KEYS, "VELO")


_WAVES = "WITH waves AS (SELECT event_id, event_type, ts, value / CAST(100 AS DOUBLE) AS mwht, user_id % 10 AS dist FROM events)"


@query(f"""{_WAVES} SELECT event_id, mwht AS "MWHT", CASE WHEN mwht BETWEEN 0.2 AND 5 THEN 1 ELSE 4 END AS mwht_flag FROM waves""")
def wave_flag(spark, sf_dir):
    return series.flag_wave_heights(waves_of(spark, sf_dir)).select("event_id", "MWHT", "mwht_flag")


@query(f"""{_WAVES} SELECT event_id, mwht AS wave_height, dist AS distance_from_origin FROM waves WHERE mwht BETWEEN 0.2 AND 5""")
def wave_filter(spark, sf_dir):
    kept = series.flag_wave_heights(waves_of(spark, sf_dir), remove=True)
    return series.rename_published(kept, series.WAVE_NAMES).select("event_id", "wave_height", "distance_from_origin")


@query(f"""{_WAVES} SELECT event_id, mwht AS "MWHT", CASE WHEN event_id % 2 = 1 THEN dist END AS "DIST", CASE WHEN event_id % 2 = 1 THEN 'ranged' ELSE 'averaged' END AS kind FROM waves""")
def wave_concat(spark, sf_dir):
    waves = waves_of(spark, sf_dir)
    averaged = waves.filter("event_id % 2 <> 1").drop("DIST").withColumn("kind", F.lit("averaged"))
    ranged = waves.filter("event_id % 2 = 1").withColumn("kind", F.lit("ranged"))
    return series.concatenate(averaged, ranged, order=("time",)).select("event_id", "MWHT", "DIST", "kind")


@query("""SELECT event_id, 'STAT_' || strftime(ts, '%Y_%m_%d') || '.rdt' AS file_name, CASE WHEN event_id % 3 = 0 THEN value END AS "RTMP", CASE WHEN event_id % 3 <> 0 THEN value END AS "MTMP" FROM events""")
def diag_concat(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("file_name", F.concat(F.lit("STAT_"), F.date_format("ts", "yyyy_MM_dd"), F.lit(".rdt")))
    parts = [rows.filter("event_id % 3 = 0").withColumnRenamed("value", "RTMP"), rows.filter("event_id % 3 <> 0").withColumnRenamed("value", "MTMP")]
    return series.concatenate(*parts, order=("file_name", "event_id")).select("event_id", "file_name", "RTMP", "MTMP")


@query(f"""{WITH} SELECT {_K}, round(velo * sin(radians(bear)), 6) + 0.0 AS u, round(velo * cos(radians(bear)), 6) + 0.0 AS v FROM rad""")
def spdir2uv(spark, sf_dir):
    u, v = vectors.speed_direction_to_uv(F.col("VELO"), F.col("BEAR"), degrees=True)
    return vectors_of(spark, sf_dir).select(*KEYS, (F.round(u, 6) + F.lit(0.0)).alias("u"), (F.round(v, 6) + F.lit(0.0)).alias("v"))


_DIR = "(((90 - degrees(atan2(velo, rnge - 30))) % 360) + 360) % 360"


@query(f"{WITH} SELECT {_K}, round(sqrt((rnge - 30) * (rnge - 30) + velo * velo), 6) AS speed, round({_DIR}, 6) AS direction FROM rad")
def uv2spdir(spark, sf_dir):
    speed, direction = vectors.uv_to_speed_direction(F.col("RNGE") - 30, F.col("VELO"))
    return vectors_of(spark, sf_dir).select(*KEYS, F.round(speed, 6).alias("speed"), F.round(direction, 6).alias("direction"))


@query(f"{WITH} SELECT {_K}, round(sin(radians({_DIR})), 6) + 0.0 AS u, round(cos(radians({_DIR})), 6) + 0.0 AS v FROM rad")
def unit_vectors(spark, sf_dir):
    u, v = vectors.unit_vector(F.col("RNGE") - 30, F.col("VELO"))
    return vectors_of(spark, sf_dir).select(*KEYS, (F.round(u, 6) + F.lit(0.0)).alias("u"), (F.round(v, 6) + F.lit(0.0)).alias("v"))


@query(f"""{WITH} SELECT {_K}, CASE WHEN velo < 0 THEN -1 ELSE 1 END AS sign, CASE WHEN velo < 0 THEN 'away' ELSE 'towards' END AS motion, greatest(-40.0::DOUBLE, least(40.0::DOUBLE, velo)) AS clipped FROM rad""")
def motion_class(spark, sf_dir):
    sign, motion = vectors.motion_class(F.col("VELO"))
    return vectors_of(spark, sf_dir).select(*KEYS, sign.alias("sign"), motion.alias("motion"), vectors.clipped(F.col("VELO"), -40.0, 40.0).alias("clipped"))


@query(f'{WITH} SELECT {_K}, velo AS "VELO" FROM rad WHERE row_no % 3 = 0')
def every_nth(spark, sf_dir):
    return series.every_nth(vectors_of(spark, sf_dir), 3).select(*KEYS, "VELO")


@query(f"""{WITH} SELECT site, strftime(min(ts), '%Y%m%dT%H%M%SZ') AS time_coverage_start, strftime(max(ts), '%Y%m%dT%H%M%SZ') AS time_coverage_end, count(DISTINCT hr) AS n_times,
 min(latd) AS lat_min, max(latd) AS lat_max, min(lond) AS lon_min, max(lond) AS lon_max, min(rnge) AS range_min, max(rnge) AS range_max, min(abs(velo)) AS speed_min, max(abs(velo)) AS speed_max,
 count(*) AS n_rows, 'surface currents' AS title FROM rad GROUP BY site""")
def coverage(spark, sf_dir):
    return series.coverage(vectors_of(spark, sf_dir), {"title": "surface currents"})


@query(f"""{WITH} SELECT site, hr, bcell, "SPRC" AS range_cell, lond AS lon, latd AS lat, velo AS velocity, vflg AS vector_flag, bear AS bearing, rnge AS "range", {_Q203} AS valid_location_qc FROM rad""")
def rename_cf(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    flagged = rad.withColumn("Q203", qc.q203_valid_location(rad.columns)).drop("prefix", "time", "row_no")
    return series.rename_published(flagged)


# --- limits of each site, chosen tests, provenance

LIMIT_ROWS = {
    "S0": {"max_speed": 75.0, "high_speed": 60.0, "min_count": 180, "low_count": 190, "reference_bearing": 180.0, "warning_threshold": 2.0, "failure_threshold": 5.0,
           "current_difference": 30.0, "gradient_fail": 54.0, "gradient_warn": 36.0, "n_steps": 3, "include": ["qc_qartod_syntax", "qc_qartod_valid_location", "qc_qartod_radial_count", "qc_qartod_maximum_velocity", "qc_qartod_spatial_median"]},
    "S1": {"max_speed": 70.0, "high_speed": 50.0, "min_count": 170, "low_count": 185, "reference_bearing": 170.0, "warning_threshold": 4.0, "failure_threshold": 12.0,
           "current_difference": 25.0, "gradient_fail": 50.0, "gradient_warn": 30.0, "n_steps": 2, "include": None},
}
_NAMES = [n for n in LIMIT_ROWS["S0"] if n != "include"]


def site_limits(spark: SparkSession) -> DataFrame:
    kinds = ", ".join(f"{n} {'int' if n in ('min_count', 'low_count', 'n_steps') else 'double'}" for n in _NAMES)
    return spark.createDataFrame([(s, *(v[n] for n in _NAMES), v["include"]) for s, v in LIMIT_ROWS.items()], f"site string, {kinds}, include array<string>")


_LIM = f"lim(site, {', '.join(_NAMES)}) AS (VALUES {', '.join('(' + ', '.join([repr(s), *(f'{v[n]}' if n in ('min_count', 'low_count', 'n_steps') else f'CAST({v[n]} AS DOUBLE)' for n in _NAMES)]) + ')' for s, v in LIMIT_ROWS.items())})"
_STEP = "abs(r.velo - p.velo)"


@query(f"""{WITH}, {_MED}, {_LIM}, flagged AS (SELECT {_RK}, {_Q201.replace('hr', 'r.hr')} AS "Q201", CASE WHEN abs(r.velo) > max_speed THEN 4 WHEN abs(r.velo) > high_speed AND abs(r.velo) < max_speed THEN 3 ELSE 1 END AS "Q202",
 {_Q203.replace('vflg', 'r.vflg')} AS "Q203", CASE WHEN n < min_count THEN 4 WHEN n <= low_count THEN 3 ELSE 1 END AS "Q204", CASE WHEN abs(r.velo - m) > current_difference THEN 4 ELSE 1 END AS "Q205",
 CASE WHEN p.velo IS NULL THEN 2 WHEN {_STEP} > gradient_fail THEN 4 WHEN {_STEP} > gradient_warn AND {_STEP} < gradient_fail THEN 3 ELSE 1 END AS "Q206",
 CASE WHEN p.velo IS NULL OR (n_steps > 2 AND o.velo IS NULL) THEN 2 WHEN {_STEP} >= 0.01 OR (n_steps > 2 AND abs(p.velo - o.velo) >= 0.01) THEN 1 ELSE 4 END AS "Q209",
 CASE WHEN abs(b - reference_bearing) >= failure_threshold THEN 4 WHEN abs(b - reference_bearing) >= warning_threshold THEN 3 ELSE 1 END AS "Q207"
 FROM {_BACK} JOIN med m ON m.site = r.site AND m.hr = r.hr AND m.bcell = r.bcell AND m."SPRC" = r."SPRC" JOIN lim ON lim.site = r.site
 JOIN (SELECT site, hr, count(*) FILTER (WHERE vflg <> 128) AS n, avg(bear) AS b FROM rad GROUP BY ALL) f ON f.site = r.site AND f.hr = r.hr)
SELECT {_K}, {_ALL}, CASE WHEN site = 'S0' THEN {_prim("Q201", "Q202", "Q203", "Q204", "Q205")} ELSE {_prim(*_TESTS)} END AS "PRIM" FROM flagged""")
def qc_by_site(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    return qc.qc_radials(rad, files_of(rad), limits=site_limits(spark)).select(*KEYS, *_TESTS, "PRIM")


@query(f'{WITH} SELECT {_K}, "Q202", "Q204", {_prim("Q202")} AS "PRIM" FROM ({_ROWS})')
def qc_chosen_tests(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    flagged = qc.qc_radials(rad, files_of(rad), LIMITS, tests=("Q202", "Q204"), include=["qc_qartod_maximum_velocity"])
    return flagged.drop("prefix", "time", "row_no", "LOND", "LATD", "VELO", "VFLG", "BEAR", "RNGE")


@query(f'{_CHAIN} SELECT {_K}, velo AS "VELO" FROM flagged WHERE {_prim(*_TESTS)} = 1')
def passed_only(spark, sf_dir):
    return qc.passed_only(_chain(spark, sf_dir)).select(*KEYS, "VELO")


def _provenance_sql() -> str:
    def lines(v: dict) -> list[str]:
        inside = {
            "syntax (Q201": "", "maximum_velocity (Q202": f"high={v['high_speed']}, max={v['max_speed']}", "valid_location (Q203": "VFLG=128",
            "radial_count (Q204": f"failure={v['min_count']}, warning={v['low_count']}, valid=@", "spatial_median (Q205": f"range_cells=2.1, angle=10.0, difference={v['current_difference']}",
            "temporal_gradient (Q206": f"warning={v['gradient_warn']}, failure={v['gradient_fail']}", "stuck_value (Q209": f"resolution=0.01, N={v['n_steps']}",
            "avg_radial_bearing (Q207": f"reference={v['reference_bearing']}, warning={v['warning_threshold']}, failure={v['failure_threshold']}",
        }
        counted = "Q201, Q202, Q203, Q204, Q205" if v["include"] else "Q201, Q202, Q203, Q204, Q205, Q206, Q209, Q207"
        return [*(f"%QCTest: qc_qartod_{k}) - Thresholds=[{x}]" for k, x in inside.items()), f"%QCTest: qc_qartod_primary_flag (PRIM) - highest of {counted} (2 ignored)"]

    rows = ", ".join(f"('{s}', {i}, '{line}')" for s, v in LIMIT_ROWS.items() for i, line in enumerate(lines(v)))
    return f"""{WITH}, told(site, position, line) AS (VALUES {rows}), n AS (SELECT site, hr, count(*) FILTER (WHERE vflg <> 128) AS n FROM rad GROUP BY ALL)
SELECT site, hr, CAST(position AS INTEGER) AS position, replace(line, '@', CAST(n AS VARCHAR)) AS line FROM told JOIN n USING (site)"""


@query(_provenance_sql())
def qc_provenance(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    valid = rad.groupBy("site", "hr").agg(F.count_if(F.col("VFLG") != 128).alias("n_valid"))
    files, limits, _ = qc.with_limits(valid, site_limits(spark))
    include = site_limits(spark).select("site", "include")
    lines = qc.provenance(limits, qc.USUAL, F.col("include"), F.col("n_valid"))
    return files.join(include, "site").select("site", "hr", F.posexplode(lines).alias("position", "line"))


# --- texts of station files

_SECOND = "%TableType: rads rad1\n%TableColumns: 8\n%TableColumnTypes: TIME AMP1 TYRS TMON TDAY THRS TMIN TSEC\n%TableRows: 1\n%TableStart: 2\n%  {}  0.5  2019  1  2  3  4  5\n%TableEnd: 2\n%%\n"
_FOOT = "%ProcessedTimeStamp: 2019 01 02  03 04 05\n%ProcessingTool: \"First\" 1.0\n%ProcessingTool: \"Second\" 2.0\n%End:\n"


def radial_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of a station file for each site and hour, with an inner diagnostics table and a footer."""
    rad = vectors_of(spark, sf_dir).withColumn("path", F.concat(F.concat_ws("_", "prefix", "site", F.date_format("time", "yyyy_MM_dd_HHmm")), F.lit(".ruv")))
    head = F.array(F.lit("%CTF: 1.00"), F.concat(F.lit("%Site: "), "site", F.lit(' ""')), F.concat(F.lit("%TimeStamp: "), F.date_format("time", "yyyy MM dd  HH mm ss")))
    texts = ctf.render_files(rad, head, FORMATS, "LLUV RDL9")
    hour = F.regexp_extract("path", "_([0-9]{2})00\\.ruv$", 1)
    before, after = (F.lit(x) for x in _SECOND.split("{}"))
    return texts.select("path", F.concat(F.regexp_replace("value", "%End:\n$", ""), before, hour, after, F.lit(_FOOT)).alias("content"))


def _text(*lines: str) -> str:
    return " || chr(10) || ".join(lines)


_QC_HEAD = _text(*(f"'{x}'" for x in ctf.QC_LINES))
_STAMP = "strftime(any_value(ts), '%Y %m %d  %H %M %S')"
_LINE = """' ' || concat_ws('  ', printf('%.7f', lond), printf('%.7f', latd), CAST(vflg AS VARCHAR), printf('%.3f', velo), printf('%.1f', bear), CAST("SPRC" AS VARCHAR), CAST("Q202" AS VARCHAR), CAST("Q202" AS VARCHAR))"""


@query(f"""{WITH}, flagged AS (SELECT *, {_Q202} AS "Q202" FROM rad),
texts AS (SELECT site, hr, 'RDLi_' || site || strftime(any_value(ts), '_%Y_%m_%d_%H%M') || '.ruv' AS path, {_text("'%CTF: 1.00'", "'%Site: ' || site || ' \"\"'", f"'%TimeStamp: ' || {_STAMP}", _QC_HEAD,
 "'%QCTest: qc_qartod_maximum_velocity (Q202) - Thresholds=[high=60.0, max=75.0]'", "'%QCTest: qc_qartod_primary_flag (PRIM) - highest of Q202 (2 ignored)'", "'%TableType: LLUV RDL9'", "'%TableColumns: 8'", "'%TableColumnTypes: LOND LATD VFLG VELO BEAR SPRC Q202 PRIM'",
 "'%TableRows: ' || CAST(count(*) AS VARCHAR)", "'%TableStart:'", f"string_agg({_LINE}, chr(10) ORDER BY row_no)", "'%TableEnd:'", "'%%'")} || chr(10) ||
 replace(replace('{_SECOND}', '{{}}', lpad(CAST(hr % 24 AS VARCHAR), 2, '0')), '\n', chr(10)) || replace('{_FOOT}', '\n', chr(10)) AS value FROM flagged GROUP BY site, hr)
SELECT path, length(value) AS n, md5(value) AS digest FROM texts""".replace(_SECOND, _SECOND.replace("\n", "\\n")).replace(_FOOT, _FOOT.replace("\n", "\\n")).replace("'\n', chr(10)", "'\\n', chr(10)"))
def ctf_export(spark, sf_dir):
    parsed = ctf.parse_files(radial_texts(spark, sf_dir)).withColumn("ran", qc.provenance(LIMITS, ("Q202",)))
    flagged = qc.qc_radials(ctf.read_radials(parsed), ctf.file_table(parsed), LIMITS, tests=("Q202",))
    out = ctf.export_files(flagged, parsed, ctf.RADIAL_COLUMNS, ("Q202", "PRIM"), "ran")
    return out.select("path", F.length("value").alias("n"), F.md5("value").alias("digest"))


@query(f"""{WITH} SELECT DISTINCT site, hr, CAST(hr % 24 AS DOUBLE) AS "TIME_S", CAST(0.5 AS DOUBLE) AS "AMP1", '2019-01-02 03:04:05' AS stamp FROM rad""")
def internal_diagnostics(spark, sf_dir):
    parsed = ctf.parse_files(radial_texts(spark, sf_dir))
    rows = ctf.read_diagnostics(parsed, "rads", {"TIME": "double", "AMP1": "double"}).withColumn("hour", F.regexp_extract("path", "_([0-9]{4}_[0-9]{2}_[0-9]{2}_[0-9]{4})", 1))
    at = F.try_to_timestamp("hour", F.lit("yyyy_MM_dd_HHmm"))
    return rows.select("site", ((F.unix_timestamp(at) - EPOCH) / 3600).cast("bigint").alias("hr"), "TIME_S", "AMP1", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


def diagnostic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of a diagnostics file for each day of events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS row_no", "concat('STAT_TEST_', date_format(ts, 'yyyy_MM_dd'), '.rdt') AS path", "CAST(event_id AS INT) AS TIME", "CAST(round(value * 100) AS INT) AS AMP1", *_PARTS)
    head = F.array(F.lit("%CTF: 1.00"), F.lit('%Site: TEST ""'))
    texts = ctf.render_files(rows, head, dict.fromkeys(("TIME", "AMP1", *ctf.TIME_PARTS), "%d"), "rads rad1")
    return texts.select("path", F.regexp_replace("value", "%End:\n$", '%ProcessingTool: "One" 1.0\n%End:\n').alias("content"))


_PARTS = [f"CAST({f}(ts) AS INT) AS {n}" for f, n in zip(("year", "month", "day", "hour", "minute", "second"), ctf.TIME_PARTS, strict=True)]
_DIAG = {"TIME": "int", "AMP1": "int"}


@query("""SELECT event_id AS "TIME_S", CAST(round(value * 100) AS INTEGER) AS "AMP1", strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, 'TEST' AS site FROM events""")
def diag_read(spark, sf_dir):
    rows = ctf.read_diagnostics(ctf.parse_files(diagnostic_texts(spark, sf_dir)), "rads", _DIAG)
    return rows.select(F.col("TIME_S").cast("bigint").alias("TIME_S"), "AMP1", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "site")


@query(f"""WITH rows AS (SELECT event_id, strftime(ts, 'STAT_TEST_%Y_%m_%d.rdt') AS path, ' ' || concat_ws('  ', event_id, CAST(round(value * 100) AS INTEGER), {', '.join(f'{f}(ts)' for f in ('year', 'month', 'day', 'hour', 'minute', 'second'))}) AS line FROM events WHERE event_id % 2 = 0),
texts AS (SELECT path, {_text("'%CTF: 1.00'", "'%Site: TEST \"\"'", "'%TableType: rads rad1'", "'%TableColumns: 8'", "'%TableColumnTypes: TIME AMP1 TYRS TMON TDAY THRS TMIN TSEC'", "'%TableRows: ' || CAST(count(*) AS VARCHAR)", "'%TableStart:'", "string_agg(line, chr(10) ORDER BY event_id)", "'%TableEnd:'", "'%%'", "'%ProcessingTool: \"One\" 1.0'", "'%End:'")} || chr(10) AS value FROM rows GROUP BY path)
SELECT path, length(value) AS n, md5(value) AS digest FROM texts""")
def diag_export(spark, sf_dir):
    parsed = ctf.parse_files(diagnostic_texts(spark, sf_dir))
    columns = _DIAG | dict.fromkeys(ctf.TIME_PARTS, "int")
    rows = ctf.table_rows(parsed, "rads", columns).filter("TIME_S % 2 = 0")
    out = ctf.export_files(rows, parsed.join(rows.select("path").distinct(), "path", "left_semi"), columns)
    return out.select("path", F.length("value").alias("n"), F.md5("value").alias("digest"))


def wave_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of wave files: ranged ones with a table for each distance, averaged ones with a second table too."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS row_no", "event_id % 2 AS ranged", "event_id % 4 DIV 2 AS part", "date_format(ts, 'yyyy_MM_dd') AS day", "CAST(event_id AS INT) AS TIME", "CAST(round(value * 100) AS INT) AS MWHT", "CAST(user_id % 10 AS INT) AS DIST", *_PARTS,
    ).withColumn("path", F.concat_ws("/", "ranged", "day", "part"))
    head = F.array(F.lit('%Site: TEST ""'), F.lit("%Origin: 40.3668167 -73.9735333"))
    shown = dict.fromkeys(("TIME", "MWHT", "DIST", *ctf.TIME_PARTS), "%d")
    one = ctf.render_files(rows, head, shown, "WAVL WVM9").select(F.split("path", "/").alias("p"), "value")
    hidden = F.regexp_replace("value", r"(?m)^(\d+  \d+)  \d+", "$1  nan")  # averaged files have no distances
    tables_ = one.select(F.col("p")[0].alias("ranged"), F.col("p")[1].alias("day"), F.col("p")[2].alias("part"), F.regexp_replace(F.when(F.col("p")[0] == "1", F.col("value")).otherwise(hidden), "%End:\n$", "").alias("value"))
    whole = tables_.groupBy("ranged", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "value"))), lambda x: x["value"]), "").alias("text"))
    return whole.select(F.concat(F.when(F.col("ranged") == "1", "WVLR").otherwise("WVLM"), F.lit("_TEST_"), "day", F.lit("_0000.wls")).alias("path"), F.concat("text", F.lit("%End:\n")).alias("content"))


@query("""WITH e AS (SELECT *, min(event_id % 4 // 2) OVER (PARTITION BY event_id % 2, CAST(ts AS DATE)) AS part FROM events)
SELECT event_id AS "TIME_S", CAST(round(value * 100) AS DOUBLE) AS "MWHT", CASE WHEN event_id % 2 = 1 THEN CAST(user_id % 10 AS DOUBLE) END AS "DIST", CASE WHEN event_id % 2 = 1 THEN 'ranged' ELSE 'averaged' END AS kind,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CAST(-73.9735333 AS DOUBLE) AS lon, CAST(40.3668167 AS DOUBLE) AS lat FROM e WHERE (event_id % 2 = 1 OR event_id % 4 // 2 = part) AND round(value * 100) NOT IN (999, 1080)
UNION ALL SELECT event_id, NULL, CASE WHEN event_id % 2 = 1 THEN CAST(user_id % 10 AS DOUBLE) END, CASE WHEN event_id % 2 = 1 THEN 'ranged' ELSE 'averaged' END, strftime(ts, '%Y-%m-%d %H:%M:%S'), -73.9735333, 40.3668167
 FROM e WHERE (event_id % 2 = 1 OR event_id % 4 // 2 = part) AND round(value * 100) IN (999, 1080)""")
def wave_read(spark, sf_dir):
    waves = ctf.read_waves(ctf.parse_files(wave_texts(spark, sf_dir)), {"TIME": "double"}, positions=True)
    return waves.select(F.col("TIME_S").cast("bigint").alias("TIME_S"), "MWHT", "DIST", "kind", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "lon", "lat")


@query("""SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, 'TEST' AS "Site", strftime(ts, '%Y-%m-%d') || ' 01:00:00' AS "TimeStamp", '10.5' AS "TimeCoverage", '2' AS "WaveMergeMethod", 'UTC' AS "TimeZone",
 '0.0, 360.0' AS "WaveBearingLimits", CAST(year(ts) AS VARCHAR) || ', -' || CAST(day(ts) AS VARCHAR) AS "CoastlineSector" FROM events""")
def clean_wave_header(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.year("ts").alias("y"), F.dayofmonth("ts").alias("d")).distinct()
    pairs = {
        "Site": F.lit('TEST ""'), "TimeStamp": F.concat(F.regexp_replace("day", "-", " "), F.lit("  01 00 00")), "TimeCoverage": F.lit("10.5 Minutes"), "WaveMergeMethod": F.lit("2 MedVectors"),
        "TimeZone": F.lit('"UTC" +0.000 0'), "WaveBearingLimits": F.lit("0.0 360.0"), "CoastlineSector": F.concat_ws(" ", F.col("y"), F.concat(F.lit("-"), F.col("d"))),
    }
    typed = headers.clean_wave_header(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))))
    return days.select("day", *(typed[k].alias(k) for k in pairs))


# --- written and read back


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{tables.shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query(f"{WITH} SELECT DISTINCT 'RDLi_' || site || strftime(ts, '_%Y_%m_%d_%H%M') || '.ruv' AS file FROM rad")
def list_files(spark, sf_dir):
    at = _scratch(spark, "text")
    tables.write_text(radial_texts(spark, sf_dir).withColumnRenamed("content", "value"), at)
    return tables.list_files(spark, at, "*.ruv").filter("length > 0").select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"))


@query(SQL["extract_timeseries"].replace('"range", bearing, velo AS "VELO" FROM near', 'velo AS "VELO" FROM near'))
def series_csv(spark, sf_dir):
    at = _scratch(spark, "series")
    cells = series.time_slice(_cells(spark, sf_dir), None, "2019-01-03 11:00:00")
    tables.write_series(grid.extract_series(cells, _points(spark, sf_dir), origins_of(spark), ["VELO"]), at)
    columns = grid.extract_series(cells, _points(spark, sf_dir), origins_of(spark), ["VELO"]).columns
    kinds = {"point_id": "bigint", "site": "string", "time": "timestamp", "range": "double", "bearing": "double", "VELO": "double"}
    back = spark.read.option("header", True).schema(", ".join(f"`{c}` {kinds[c]}" for c in columns)).csv(at)
    return back.select("point_id", "site", ((F.unix_timestamp("time") - EPOCH) / 3600).cast("bigint").alias("hr"), "VELO")


@query(SQL["concat_radials"])
def read_back(spark, sf_dir):
    at, rad = _scratch(spark, "tables"), vectors_of(spark, sf_dir)
    tables.write_table(rad.filter("site = 'S0'").drop("VFLG"), f"{at}/one")
    tables.write_table(rad.filter("site = 'S1'"), f"{at}/two")
    return tables.read_tables(spark, f"{at}/one", f"{at}/two").select(*KEYS, "VELO", "VFLG")


@query(f"""{WITH} SELECT {_K}, velo AS "VELO" FROM rad WHERE site = 'S1'""")
def of_prefix(spark, sf_dir):
    rad = vectors_of(spark, sf_dir).withColumn("prefix", F.when(F.col("site") == "S1", "RDLm").otherwise("RDLi"))
    return series.of_prefix(rad, "RDLm").select(*KEYS, "VELO")


@query(f"{WITH} SELECT site, hr FROM (SELECT site, hr, count(*) AS n FROM rad GROUP BY ALL) WHERE hr % 17 <> 4")
def valid_files(spark, sf_dir):
    files = files_of(vectors_of(spark, sf_dir)).withColumn("is_corrupt", F.col("hr") % 17 == 4)
    return series.valid_files(files).select("site", "hr")


# --- grids of files

_AXES = """ax AS (SELECT site, hr, round(min(rnge), 4) AS lo, CAST(ceil((round(max(rnge) + 3.0203, 4) - min(rnge)) / 3.0203) AS BIGINT) AS n, min(rnge) AS low FROM rad WHERE hr % 11 <> 5 GROUP BY ALL),
fcells AS (SELECT site, hr, round(low + i * CAST(3.0203 AS DOUBLE), 4) AS "range", bear AS bearing, arg_max(velo, row_no) AS velo FROM (SELECT *, least(greatest(ceil((rnge - lo) / CAST(3.0203 AS DOUBLE) - 0.5), 0), n - 1) AS i FROM rad JOIN ax USING (site, hr)) GROUP BY ALL)"""
_HERE = "CAST(-73.9735333 AS DOUBLE) AS lon, CAST(40.3668167 AS DOUBLE) AS lat"
_GRID = f"""{WITH}, {_AXES}, places AS ({_forward_sql(f'SELECT DISTINCT "range", bearing, {_HERE}, bearing AS az, "range" AS km FROM fcells', '"range", bearing')})
SELECT site, hr, "range", bearing, round(lon2, 4) AS lon, round(lat2, 4) AS lat, velo AS "VELO" FROM fcells JOIN places USING ("range", bearing)"""


def _hour(column: str = "time"):
    return ((F.unix_timestamp(column) - EPOCH) / 3600).cast("bigint").alias("hr")


@query(_GRID)
def grid_from_header(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    cells = grid.grid_files(rad, files_of(rad).filter("hr % 11 <> 5"), ["VELO"])
    return cells.select("site", _hour(), "range", "bearing", "lon", "lat", "VELO")


RANGES, BEARINGS = [6.0, 20.0, 45.5, 60.0], [0.0, 45.0, 90.0, 200.0, 300.0]
_VALUES = lambda name, values: f"{name}(v) AS (VALUES {', '.join(f'(CAST({v} AS DOUBLE))' for v in values)})"


@query(f"""{WITH}, {_VALUES("rs", RANGES)}, {_VALUES("bs", BEARINGS)}, files AS (SELECT DISTINCT site, hr FROM rad WHERE hr % 11 <> 5),
nr AS (SELECT rnge, v AS "range" FROM (SELECT DISTINCT rnge FROM rad), rs QUALIFY row_number() OVER (PARTITION BY rnge ORDER BY abs(v - rnge), v) = 1),
nb AS (SELECT bear, v AS bearing FROM (SELECT DISTINCT bear FROM rad), bs QUALIFY row_number() OVER (PARTITION BY bear ORDER BY abs(v - bear), v) = 1),
ecells AS (SELECT site, hr, "range", bearing, arg_max(velo, row_no) AS velo FROM rad JOIN nr USING (rnge) JOIN nb USING (bear) GROUP BY ALL)
SELECT f.site, f.hr, f.r AS "range", f.b AS bearing, velo AS "VELO" FROM (SELECT site, hr, rs.v AS r, bs.v AS b FROM files, rs, bs) f LEFT JOIN ecells c ON c.site = f.site AND c.hr = f.hr AND c."range" = f.r AND c.bearing = f.b""")
def grid_explicit_axes(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    cells = grid.grid_files(rad, files_of(rad).filter("hr % 11 <> 5"), ["VELO"], RANGES, BEARINGS, dense=True)
    return cells.select("site", _hour(), "range", "bearing", "VELO")


@query(f"SELECT *, 'gridded' AS kind, strftime(to_timestamp({EPOCH} + hr * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM ({_GRID})")
def write_gridded(spark, sf_dir):
    at, rad = _scratch(spark, "gridded"), vectors_of(spark, sf_dir)
    tables.write_table(grid.grid_files(rad, files_of(rad).filter("hr % 11 <> 5"), ["VELO"]), at)
    back = tables.read_tables(spark, at)
    return back.select("site", _hour(), "range", "bearing", "lon", "lat", "VELO", "kind", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query(f"""{WITH} SELECT {_K}, lond AS lon, latd AS lat, velo AS "VELO", 'tabular' AS kind FROM rad""")
def tabular(spark, sf_dir):
    return grid.tabular(vectors_of(spark, sf_dir)).select(*KEYS, "lon", "lat", "VELO", "kind")


# --- files chosen by name, written under their names

_SEEN = """site, hr, CAST(round(lond, 7) AS DOUBLE) AS "LOND", CAST(round(latd, 7) AS DOUBLE) AS "LATD", vflg AS "VFLG", round(velo, 3) AS "VELO", bear AS "BEAR", CAST("SPRC" AS INTEGER) AS "SPRC\""""


@query(f"{WITH} SELECT {_SEEN} FROM rad WHERE site = 'S1' AND hr BETWEEN 10 AND 34")
def ctf_pruned(spark, sf_dir):
    at = _scratch(spark, "pruned")
    tables.write_text(radial_texts(spark, sf_dir).withColumnRenamed("content", "value"), at)
    parsed = ctf.read_files(spark, at, ["*.ruv", "*.wls"], prefix="RDLi", sites=["S1"], start="2019-01-01 10:00:00", end="2019-01-02 10:00:00")
    return ctf.read_radials(parsed).select("site", _hour(), *FORMATS)


@query(f"""{WITH} SELECT DISTINCT 'S1' AS folder, 'RDLi_' || site || strftime(ts, '_%Y_%m_%d_%H%M') || '.ruv' AS file FROM rad WHERE site = 'S1'
UNION ALL SELECT DISTINCT 'diagnostics', strftime(ts, 'STAT_TEST_%Y_%m_%d.rdt') FROM events""")
def list_files_in_folders(spark, sf_dir):
    at = _scratch(spark, "folders")
    radials = radial_texts(spark, sf_dir).select("path", F.col("content").alias("value"), F.regexp_extract("path", "_(S[0-9])_", 1).alias("folder"))
    others = diagnostic_texts(spark, sf_dir).select("path", F.col("content").alias("value"), F.lit("diagnostics").alias("folder"))
    tables.write_text(radials.unionByName(others), at, "folder")
    found = tables.list_files(spark, at, ["*.ruv", "*.rdt"], folders=["S1", "diagnostics", "absent"])
    parts = F.split("path", "/")
    return found.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"))


@query(f"""{WITH} SELECT 'RDLi_' || site || strftime(ts, '_%Y_%m_%d_%H%M') || '.ruv' AS file, {_SEEN} FROM rad WHERE {_Q202} <> 4""")
def clean_export(spark, sf_dir):
    at, parsed = _scratch(spark, "clean"), ctf.parse_files(radial_texts(spark, sf_dir))
    flagged = qc.qc_radials(ctf.read_radials(parsed), ctf.file_table(parsed), LIMITS, tests=("Q202",))
    tables.write_text(ctf.export_files(qc.clean_copy(flagged), parsed, ctf.RADIAL_COLUMNS), at)
    back = ctf.read_radials(ctf.read_files(spark, at, "RDLi_*.ruv"))
    return back.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "site", _hour(), *FORMATS)


# --- files that arrive late


@query(SQL["qc_chain"])
def qc_late_files(spark, sf_dir):
    at, rad = _scratch(spark, "late"), vectors_of(spark, sf_dir)
    files = files_of(rad)
    for part in ("hr % 2 = 1", "hr % 2 = 0"):  # every other hour comes after the hours that look back at it
        incremental.update(at, files.filter(part), rad.filter(part), LIMITS)
    return spark.read.parquet(at).select(*KEYS, "VELO", *_TESTS, "PRIM")


@query(SQL["qc_by_site"])
def qc_late_files_by_site(spark, sf_dir):
    at, rad = _scratch(spark, "late"), vectors_of(spark, sf_dir)
    files = files_of(rad)
    for part in ("hr % 3 = 2", "hr % 3 = 0", "hr % 3 = 1", "hr % 3 = 0"):  # one batch comes twice
        incremental.update(at, files.filter(part), rad.filter(part), limits=site_limits(spark))
    return spark.read.parquet(at).select(*KEYS, *_TESTS, "PRIM")


# --- overlapping tables

_CHANGED = "CASE WHEN bcell % 10 = 0 AND hr < 80 THEN velo + 1 ELSE velo END"
_COMBINE_KEYS = ["site", "time", "BEAR", "SPRC"]


def _overlapping(spark, sf_dir) -> list[DataFrame]:
    rad = vectors_of(spark, sf_dir)
    one = rad.filter("hr < 80").select(*_COMBINE_KEYS, "VELO")
    return [one, rad.filter("hr >= 40").select(*_COMBINE_KEYS, F.expr("CASE WHEN bcell % 10 = 0 AND hr < 80 THEN VELO + 1 ELSE VELO END").alias("VELO"), "VFLG")]


@query(f"""{WITH} SELECT site, hr, bear AS "BEAR", "SPRC", CASE WHEN hr < 80 THEN velo ELSE {_CHANGED} END AS "VELO", CASE WHEN hr >= 40 THEN vflg END AS "VFLG" FROM rad""")
def combine_by_coords(spark, sf_dir):
    whole, _ = tables.combine(_overlapping(spark, sf_dir), _COMBINE_KEYS, "first")
    return whole.select("site", _hour(), "BEAR", "SPRC", "VELO", "VFLG")


@query(f"""{WITH} SELECT site, hr, bear AS "BEAR", "SPRC", 'VELO' AS "column", 2 AS n_tables FROM rad WHERE hr BETWEEN 40 AND 79 AND bcell % 10 = 0""")
def combine_conflicts(spark, sf_dir):
    _, report = tables.combine(_overlapping(spark, sf_dir), _COMBINE_KEYS, "last")
    good = report.filter("abs(CAST(highest AS DOUBLE) - CAST(lowest AS DOUBLE) - 1) < 1e-9")
    return good.select("site", _hour(), "BEAR", "SPRC", "column", "n_tables")


# --- grids of several files and of flagged vectors

_STEPS = 'CASE WHEN hr % 2 = 0 THEN CAST(3.0203 AS DOUBLE) ELSE CAST(6.0406 AS DOUBLE) END AS s, CASE WHEN hr % 2 = 0 THEN 5 ELSE 10 END AS b'


@query(f"""{WITH}, st AS (SELECT *, {_STEPS} FROM rad WHERE hr % 11 <> 5),
ax AS (SELECT site, hr, s, b, min(rnge) AS low, round(min(rnge), 4) AS lo, CAST(ceil((round(max(rnge) + s, 4) - min(rnge)) / s) AS BIGINT) AS n FROM st GROUP BY site, hr, s, b),
ccells AS (SELECT site, hr, round(low + ri * s, 4) AS "range", 1 + bi * b AS bearing, arg_max(velo, row_no) AS velo FROM (SELECT st.*, low, least(greatest(ceil((rnge - lo) / st.s - 0.5), 0), n - 1) AS ri,
 least(greatest(ceil((bear - 1) / st.b - 0.5), 0), 360 / st.b - 1) AS bi FROM st JOIN ax USING (site, hr)) GROUP BY ALL),
rv AS (SELECT DISTINCT site, round(low + i * s, 4) AS "range" FROM (SELECT site, low, s, unnest(generate_series(0, n - 1)) AS i FROM ax)),
bv AS (SELECT DISTINCT site, 1 + i * b AS bearing FROM (SELECT DISTINCT site, b, unnest(generate_series(0, CAST(360 / b AS BIGINT) - 1)) AS i FROM ax))
SELECT site, hr, "range", CAST(bearing AS DOUBLE) AS bearing, velo AS "VELO" FROM (SELECT DISTINCT site, hr FROM ax) JOIN rv USING (site) JOIN bv USING (site) LEFT JOIN ccells USING (site, hr, "range", bearing)""")
def concat_gridded(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    even = F.col("hr") % 2 == 0
    own = F.create_map(F.lit("RangeResolutionKMeters"), F.when(even, "3.0203").otherwise("6.0406"), F.lit("AntennaBearing"), F.lit("1.0"), F.lit("AngularResolution"), F.when(even, "5 Deg").otherwise("10 Deg"))
    known = F.map_filter("meta", lambda k, _: ~k.isin("RangeResolutionKMeters", "AntennaBearing", "AngularResolution"))
    files = files_of(rad).filter("hr % 11 <> 5").withColumn("meta", F.map_concat(known, own))
    whole = grid.concat_gridded(grid.grid_files(rad, files, ["VELO"]), grid.file_axes(rad, files), ["VELO"])
    return whole.select("site", _hour(), "range", "bearing", "VELO")


def _flag_cells(where: str, columns: str) -> str:
    return f"""{_CHAIN}, f AS (SELECT *, bcell * 100 + "SPRC" AS row_no, "SPRC" * CAST(3.0203 AS DOUBLE) AS rnge, CAST(1 + 5 * bcell AS DOUBLE) AS bearing, {_prim(*_TESTS)} AS "PRIM" FROM flagged WHERE hr % 11 <> 5),
k AS (SELECT * FROM f WHERE {where}),
ax AS (SELECT site, hr, min(rnge) AS low, round(min(rnge), 4) AS lo, CAST(ceil((round(max(rnge) + 3.0203, 4) - min(rnge)) / 3.0203) AS BIGINT) AS n FROM k GROUP BY ALL),
c AS (SELECT k.*, round(low + least(greatest(ceil((rnge - lo) / CAST(3.0203 AS DOUBLE) - 0.5), 0), n - 1) * CAST(3.0203 AS DOUBLE), 4) AS "range" FROM k JOIN ax USING (site, hr))
SELECT site, hr, "range", bearing, velo AS "VELO"{columns} FROM c QUALIFY row_number() OVER (PARTITION BY site, hr, "range", bearing ORDER BY row_no DESC) = 1"""


@query(_flag_cells("true", f', {_ALL}, "PRIM"'))
def qc_gridded(spark, sf_dir):
    at, rad = _scratch(spark, "qc-gridded"), vectors_of(spark, sf_dir)
    files = files_of(rad)
    tables.write_table(grid.grid_files(qc.qc_radials(rad, files, LIMITS), files.filter("hr % 11 <> 5"), ["VELO", *_TESTS, "PRIM"]), at)
    return tables.read_tables(spark, at).select("site", _hour(), "range", "bearing", "VELO", *_TESTS, "PRIM")


@query(_flag_cells('"PRIM" <> 4', ""))
def clean_gridded(spark, sf_dir):
    rad = vectors_of(spark, sf_dir)
    files = files_of(rad)
    cells = grid.grid_files(qc.clean_copy(qc.qc_radials(rad, files, LIMITS)), files.filter("hr % 11 <> 5"), ["VELO"])
    return cells.select("site", _hour(), "range", "bearing", "VELO")


# --- point series from stored cells


@query(SQL["extract_timeseries"])
def series_stored(spark, sf_dir):
    at = _scratch(spark, "cells")
    cells = series.time_slice(_cells(spark, sf_dir), None, "2019-01-03 11:00:00")
    tables.write_table(cells, f"{at}/cells")
    stored = spark.read.parquet(f"{at}/cells")
    grid.cell_axes(stored).write.parquet(f"{at}/axes")
    found = grid.extract_stored(stored, spark.read.parquet(f"{at}/axes"), _points(spark, sf_dir), origins_of(spark), ["VELO"])
    return found.select("point_id", "site", _hour(), "range", "bearing", "VELO")


# --- land from polygon files

_BOX = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
_HOLE, _ISLES, _ELSEWHERE = _BOX(-73.85, 40.0, 0.15, 0.05), [_BOX(-73.45, 39.85, 0.1, 0.1), _BOX(-73.4, 40.2, 0.1, 0.06)], _BOX(-74.0, 40.1, 0.1, 0.1)


def _geojson() -> str:
    feature = lambda kind, shape, continent: {"type": "Feature", "properties": {"continent": continent, "rank": 1}, "geometry": {"type": kind, "coordinates": shape}}
    main = feature("Polygon", [[list(p) for p in RING], _HOLE], "North America")
    isles = feature("MultiPolygon", [[r] for r in _ISLES], "North America")
    line = feature("LineString", [[-74.0, 40.0], [-73.0, 40.0]], "North America")
    return json.dumps({"type": "FeatureCollection", "features": [main, isles, line, feature("Polygon", [_ELSEWHERE], "Europe")]})


def _geo_edges(spark) -> DataFrame:
    return land.edges_from_geojson(spark.createDataFrame([(_geojson(),)], "value string"), "properties['continent'] = 'North America'")


_POLYGONS = [(n, *a, *b) for n, ring in ((0, RING), (0, _HOLE), (1, _ISLES[0]), (2, _ISLES[1])) for a, b in zip(ring, ring[1:], strict=False)]
_LAND = f"""edges(poly, x1, y1, x2, y2) AS (VALUES {", ".join("(" + ", ".join([str(e[0]), *(f"CAST({v} AS DOUBLE)" for v in e[1:])]) + ")" for e in _POLYGONS)}), places AS (SELECT DISTINCT lond, latd FROM rad),
crossed AS (SELECT lond, latd, poly, count(*) FILTER (WHERE CASE WHEN (y1 > latd) <> (y2 > latd) THEN lond < (x2 - x1) * (latd - y1) / (y2 - y1) + x1 ELSE false END) % 2 = 1 AS inside FROM places, edges GROUP BY ALL),
land AS (SELECT lond, latd, bool_or(inside) AS on_land FROM crossed GROUP BY ALL)"""


@query(f'{WITH}, {_LAND} SELECT lond AS "LOND", latd AS "LATD", on_land FROM land')
def land_from_geojson(spark, sf_dir):
    return land.on_land(vectors_of(spark, sf_dir), _geo_edges(spark))


@query(f"""{WITH}, {_LAND}, flagged AS (SELECT rad.*, CASE WHEN vflg = 128 OR on_land THEN 4 ELSE 1 END AS "Q203" FROM rad JOIN land USING (lond, latd))
SELECT {_K}, on_land, "Q202", "Q203", {_prim("Q202", "Q203")} AS "PRIM" FROM (SELECT flagged.*, on_land, {_Q202} AS "Q202" FROM flagged JOIN land USING (lond, latd))""")
def q203_masked(spark, sf_dir):
    masked = land.mask_land(vectors_of(spark, sf_dir), _geo_edges(spark))
    flagged = qc.qc_radials(masked, files_of(masked), LIMITS, F.col("on_land"), tests=("Q202", "Q203"))
    return flagged.select(*KEYS, "on_land", "Q202", "Q203", "PRIM")


# --- metadata, written and read back

_PUBLISHED = {
    "lon": ("degrees_east", "longitude", "Longitude", -180, 180), "lat": ("degrees_north", "latitude", "Latitude", -90, 90), "range": ("km", None, "Range from origin (away from instrument)", 0, 1000),
    "bearing": ("degrees", None, "Bearing from origin (away from instrument)", 0, 360), "velocity": ("cm s-1", "radial_sea_water_velocity_away_from_instrument", None, -1000, 1000),
    "vector_flag": (None, None, "Vector Flag Masks", 0, 2048), "time": (None, "time", None, None, None), "valid_location_qc": (None, None, "Valid Location (QARTOD Test 203) Flag Masks", 1, 9),
}
_TOLD = ", ".join(f"('{c}', {', '.join('NULL' if x is None else repr(x) for x in v[:3])}, {', '.join('NULL' if x is None else str(x) for x in v[3:])})" for c, v in _PUBLISHED.items())
_HELD = {"lon": "lond", "lat": "latd", "range": "rnge", "bearing": "bear", "velocity": "velo", "vector_flag": "vflg", "valid_location_qc": "vflg", "time": "ts"}
_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({x}) AS n_values FROM rad" for c, x in _HELD.items())


@query(f"""{WITH}, told("column", units, standard_name, long_name, low, high) AS (VALUES {_TOLD}), held AS ({_COUNTS})
SELECT "column", units, standard_name, long_name, CAST(low AS DOUBLE) AS valid_min, CAST(high AS DOUBLE) AS valid_max, CASE WHEN "column" LIKE '%_qc' THEN 'pass not_evaluated suspect fail missing_data' END AS qc_meanings, n_values FROM told JOIN held USING ("column")""")
def published_metadata(spark, sf_dir):
    at, rad = _scratch(spark, "published"), vectors_of(spark, sf_dir)
    flagged = rad.withColumn("Q203", qc.q203_valid_location(rad.columns))
    tables.write_table(series.rename_published(flagged.drop("prefix", "hr", "bcell", "SPRC", "row_no")), at)
    back = tables.read_tables(spark, at)
    found = tables.column_metadata(back)
    names = ("units", "standard_name", "long_name", "valid_min", "valid_max")
    told = [(c, *(m.get(k) for k in names), m.get("flag_meanings") if c.endswith("_qc") else None) for c, m in found.items()]
    rows = spark.createDataFrame(told, "column string, units string, standard_name string, long_name string, valid_min double, valid_max double, qc_meanings string")
    counts = back.agg(*(F.count(c).alias(c) for c in found)).unpivot([], list(found), "column", "n_values")
    return rows.join(F.broadcast(counts), "column")  # a row for each column


@query(f"""{WITH}, a AS (SELECT strftime(min(ts), '%Y%m%dT%H%M%SZ') AS time_coverage_start, strftime(max(ts), '%Y%m%dT%H%M%SZ') AS time_coverage_end, CAST(min(latd) AS VARCHAR) AS geospatial_lat_min, CAST(max(latd) AS VARCHAR) AS geospatial_lat_max,
 CAST(min(lond) AS VARCHAR) AS geospatial_lon_min, CAST(max(lond) AS VARCHAR) AS geospatial_lon_max, 'CF-1.6, ACDD-1.3' AS "Conventions", 'CF Standard Name Table v41' AS standard_name_vocabulary, 'degrees_north' AS geospatial_lat_units,
 'degrees_east' AS geospatial_lon_units, 'surface currents' AS title FROM rad) SELECT name AS attribute, value FROM (UNPIVOT a ON COLUMNS(*))""")
def dataset_attributes(spark, sf_dir):
    at, rad = _scratch(spark, "attributes"), vectors_of(spark, sf_dir)
    tables.write_table(rad, at, series.dataset_attributes(rad, {"title": "surface currents"}))
    return tables.read_attributes(spark, at)
