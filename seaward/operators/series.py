"""Time and site operations: subsets, concatenation, coverage, latest steps, names, waves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaward.functions.headers import receiver
from seaward.operators import small

#: The names that columns have in published data sets.
RADIAL_NAMES = {
    "VELU": "u", "VELV": "v", "VFLG": "vector_flag", "ESPC": "spatial_quality", "ETMP": "temporal_quality", "MAXV": "velocity_max",
    "MINV": "velocity_min", "ERSC": "spatial_count", "ERTC": "temporal_count", "XDST": "dist_east_from_origin",
    "YDST": "dist_north_from_origin", "VELO": "velocity", "HEAD": "heading", "SPRC": "range_cell", "EACC": "accuracy", "LOND": "lon",
    "LATD": "lat", "BEAR": "bearing", "RNGE": "range", "Q201": "syntax_qc", "Q202": "max_threshold_qc", "Q203": "valid_location_qc",
    "Q204": "radial_count_qc", "Q205": "spatial_median_filter_qc", "Q206": "temporal_gradient_qc", "Q207": "average_radial_bearing_qc",
    "Q209": "radial_stuck_value_qc", "PRIM": "primary_flag_qc", "QCOP": "operator_flag_qc",
}
WAVE_NAMES = {
    "MWHT": "wave_height", "MWPD": "wave_period", "WAVB": "wave_bearing", "WNDB": "wind_bearing", "ACNT": "cross_spectra_averaged_count",
    "DIST": "distance_from_origin", "RCLL": "range_cell_result", "WDPT": "doppler_points_used", "MTHD": "wave_method", "FLAG": "vector_flag",
    "PMWH": "maximum_observable_wave_height", "WHNM": "num_valid_source_wave_vectors", "WHSD": "standard_deviation_of_wave_heights",
}
#: Units and long names of the published data sets.
UNITS = {
    "VELO": "cm s-1", "VELU": "cm s-1", "VELV": "cm s-1", "ESPC": "cm s-1", "ETMP": "cm s-1", "MAXV": "cm s-1", "MINV": "cm s-1", "EACC": "cm s-1",
    "XDST": "km", "YDST": "km", "RNGE": "km", "BEAR": "degrees", "HEAD": "degrees", "LOND": "degrees_east", "LATD": "degrees_north",
    "MWHT": "m", "PMWH": "m", "WHSD": "m", "MWPD": "s", "WAVB": "degrees", "WNDB": "degrees", "DIST": "km",
}
LONG_NAMES = {
    "LOND": "Longitude", "LATD": "Latitude", "VELU": "Eastward Surface Current (cm/s)", "VELV": "Northward Surface Current (cm/s)",
    "BEAR": "Bearing from origin (away from instrument)", "RNGE": "Range from origin (away from instrument)", "VFLG": "Vector Flag Masks",
    "ESPC": "Spatial Quality of radial sea water velocity", "ETMP": "Temporal Quality of radial sea water velocity",
    "MAXV": "Maximum Velocity of sea water (away from instrument)", "MINV": "Minimum Velocity of sea water (away from instrument)",
    "ERSC": "Spatial count of sea water velocity (away from instrument)", "ERTC": "Temporal count of sea water velocity (away from instrument)",
    "XDST": "Eastward distance from instrument", "YDST": "Northward distance from instrument",
    "SPRC": "Cross Spectra Range Cell  of sea water velocity (away from instrument)", "EACC": "Accuracy",
    "Q201": "Syntax (QARTOD Test 201) Flag Masks", "Q202": "Maximum Velocity Threshold (QARTOD Test 202) Flag Masks",
    "Q203": "Valid Location (QARTOD Test 203) Flag Masks", "Q204": "Radial Count (QARTOD Test 204) Flag Masks",
    "Q205": "Spatial Median Filter (QARTOD Test 205) Flag Masks", "Q206": "Temporal Gradient (QARTOD Test 206) Flag Masks",
    "Q207": "Average Radial Bearing (QARTOD Test 207) Flag Masks", "Q209": "Radial Stuck Value (QARTOD Test 209) Flag Masks",
    "PRIM": "Primary Flag Masks", "QCOP": "Operator Flag Masks",
}


#: Standard names, axes, comments and valid ranges of the published data sets.
STANDARD_NAMES = {
    "LOND": "longitude", "LATD": "latitude", "VELU": "surface_eastward_sea_water_velocity", "VELV": "surface_northward_sea_water_velocity",
    "VELO": "radial_sea_water_velocity_away_from_instrument", "HEAD": "direction_of_radial_vector_away_from_instrument", "time": "time",
}
WAVE_STANDARD_NAMES = {
    "MWHT": "sea_surface_wave_significant_height", "MWPD": "sea_surface_wave_mean_period", "WAVB": "sea_surface_wave_from_direction",
    "WNDB": "sea_surface_wind_wave_from_direction", "lon": "longitude", "lat": "latitude", "time": "time",
}
WAVE_LONG_NAMES = {
    "MWHT": "wave model height in meters", "MWPD": "wave spectra period in seconds", "WAVB": "wave from direction in degrees",
    "WNDB": "wind from direction in degrees", "lon": "Longitude", "lat": "Latitude", "time": "Universal Time Coordinated (UTC) Time",
}
COMMENTS = {"QCOP": "Flag that is manually set by operator. Flag vectors that are not detected by QC tests but are clearly wrong."}
WAVE_COMMENTS = {
    "MWHT": "wave model height in meters for every one of three waves", "MWPD": "wave spectra period in seconds",
    "WAVB": "wave from direction in degrees", "WNDB": "wind from direction in degrees",
}
VALID = {
    "LOND": (-180.0, 180.0), "LATD": (-90.0, 90.0), "VELU": (-300.0, 300.0), "VELV": (-300.0, 300.0), "BEAR": (0.0, 360.0), "RNGE": (0.0, 1000.0),
    "VELO": (-1000.0, 1000.0), "VFLG": (0.0, 2048.0),
}
WAVE_VALID = {"MWHT": (0.0, 100.0), "MWPD": (0.0, 100.0), "WAVB": (0.0, 360.0), "WNDB": (0.0, 360.0), "lon": (-180.0, 180.0), "lat": (-90.0, 90.0)}
AXES = {"LOND": "X", "LATD": "Y", "RNGE": "X", "BEAR": "Y"}
WAVE_UNITS = {"lon": "degrees_east", "lat": "degrees_north"}
CONVENTIONS = {"Conventions": "CF-1.6, ACDD-1.3", "standard_name_vocabulary": "CF Standard Name Table v41", "geospatial_lat_units": "degrees_north", "geospatial_lon_units": "degrees_east"}
FLAG_VALUES, FLAG_MEANINGS = [1, 2, 3, 4, 9], "pass not_evaluated suspect fail missing_data"
VECTOR_FLAG_MASKS = [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]
VECTOR_FLAG_MEANINGS = (
    "grid_point_deleted grid_point_near_coast point_measurement no_radial_solution baseline_interpolation exceeds_max_speed "
    "invalid_solution solution_beyond_valid_spatial_domain insufficient_angular_resolution reserved reserved"
)


def published_metadata(column: str, names: dict[str, str] = RADIAL_NAMES) -> dict:
    """What a published data set says of a column: units, names, valid range, axis, comment, the meaning of flags.

    Flag values are those that the tests give (9 for missing data).  Headings are degrees as they are, without a scale.
    """
    wave = names is WAVE_NAMES
    tables = {
        "units": UNITS | WAVE_UNITS if wave else UNITS, "standard_name": WAVE_STANDARD_NAMES if wave else STANDARD_NAMES,
        "long_name": WAVE_LONG_NAMES if wave else LONG_NAMES, "comment": WAVE_COMMENTS if wave else COMMENTS, "axis": {} if wave else AXES,
    }
    found = {k: t[column] for k, t in tables.items() if column in t}
    if column in (valid := WAVE_VALID if wave else VALID):
        found |= dict(zip(("valid_min", "valid_max"), valid[column], strict=True))
    if names.get(column, "").endswith("_qc"):
        found |= {"flag_values": FLAG_VALUES, "flag_meanings": FLAG_MEANINGS, "valid_min": 1.0, "valid_max": 9.0}
    elif column == "VFLG" and not wave:
        found |= {"flag_masks": VECTOR_FLAG_MASKS, "flag_meanings": VECTOR_FLAG_MEANINGS}
    if not wave and column in names and column not in AXES:
        found["coordinates"] = "lon lat"
    elif column in WAVE_STANDARD_NAMES and column in WAVE_NAMES and wave:
        found |= {"coordinates": "time", "coverage_content_type": "physicalMeasurement"}
    return found


def rename_published(df: DataFrame, names: dict[str, str] = RADIAL_NAMES) -> DataFrame:
    """Published names, with ``published_metadata`` as metadata of the columns (Parquet keeps it)."""

    def one(c: str):
        meta = published_metadata(c, names)
        return F.col(c).alias(names.get(c, c), metadata=meta) if meta else F.col(c).alias(names.get(c, c))

    return df.select(*(one(c) for c in df.columns))


def dataset_attributes(df: DataFrame, given: dict[str, str] | None = None, lon: str = "LOND", lat: str = "LATD") -> DataFrame:
    """The attributes of a data set as one row: time coverage, bounds of positions, conventions, and those ``given``."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    found = df.agg(
        stamp(F.min("time")).alias("time_coverage_start"), stamp(F.max("time")).alias("time_coverage_end"),
        *(f(c).alias(f"geospatial_{n}_{e}") for n, c in (("lat", lat), ("lon", lon)) for e, f in (("min", F.min), ("max", F.max))),
    )
    return found.withColumns({k: F.lit(v) for k, v in (CONVENTIONS | (given or {})).items()})


def time_slice(df: DataFrame, start=None, end=None, column: str = "time") -> DataFrame:
    """Rows from start to end, both inclusive; an end left out is open."""
    out = df
    if start is not None:
        out = out.filter(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col(column) <= F.lit(end).cast("timestamp"))
    return out


def of_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.filter(F.col("prefix") == prefix)


def valid_files(files: DataFrame) -> DataFrame:
    """Files that ended properly and have rows."""
    return files.filter(~F.col("is_corrupt") & (F.col("n_rows") > 0))


def concatenate(*tables: DataFrame, order=("site", "time")) -> DataFrame:
    """All rows by column name (absent columns null), range-partitioned and sorted in partitions."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return whole.repartitionByRange(*order).sortWithinPartitions(*order)


def latest_step(df: DataFrame) -> DataFrame:
    """The rows of each site's last time.  The times are one small aggregate, joined back."""
    return df.join(df.groupBy("site").agg(F.max("time").alias("time")), ["site", "time"])


def coverage(df: DataFrame, attributes: dict[str, str] | None = None) -> DataFrame:
    """By site: time coverage as text, distinct times, extents, rows, and given attributes."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    found = df.groupBy("site").agg(
        stamp(F.min("time")).alias("time_coverage_start"), stamp(F.max("time")).alias("time_coverage_end"), F.count_distinct("time").alias("n_times"),
        F.min("LATD").alias("lat_min"), F.max("LATD").alias("lat_max"), F.min("LOND").alias("lon_min"), F.max("LOND").alias("lon_max"),
        F.min("RNGE").alias("range_min"), F.max("RNGE").alias("range_max"), F.min(F.abs("VELO")).alias("speed_min"), F.max(F.abs("VELO")).alias("speed_max"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return found.withColumns({k: F.lit(v) for k, v in (attributes or {}).items()})


def every_nth(df: DataFrame, n: int, position: str = "row_no") -> DataFrame:
    """Positions 0, n, 2n, ... of each file."""
    return df.filter(F.col(position) % n == 0)


def flag_wave_heights(df: DataFrame, low: float = 0.2, high: float = 5.0, remove: bool = False) -> DataFrame:
    """Heights within limits (inclusive) pass, others and nulls fail or are removed."""
    good = F.col("MWHT").between(low, high)
    return df.filter(good) if remove else df.withColumn("mwht_flag", F.when(good, 1).otherwise(4))


def wave_positions(waves: DataFrame, files: DataFrame) -> DataFrame:
    """``waves`` with lon and lat: the receiver of their file, by the header of ``files``."""
    lon, lat = receiver(F.col("meta"))
    return waves.join(small(files.select("path", lon.alias("lon"), lat.alias("lat"))), "path", "left")
