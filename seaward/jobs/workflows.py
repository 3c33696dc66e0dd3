"""The jobs that a station operator runs: quality control, point series, concatenation, waves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.operators import grid, land, qc, series
from seaward.sources import ctf, tables


def _parsed_once(spark: SparkSession, source: str | list[str], pattern: str, target: str, **chosen) -> DataFrame:
    """The files' one parse, as a Parquet table that all else reads; files that are not ``chosen`` are not opened."""
    ctf.read_files(spark, source, pattern, **chosen).write.mode("overwrite").parquet(f"{target}/parsed")
    return spark.read.parquet(f"{target}/parsed")


def qc_job(
    spark: SparkSession,
    source: str | list[str],
    target: str,
    thresholds: qc.Thresholds = qc.Thresholds(),
    edges: DataFrame | None = None,
    limits: DataFrame | None = None,
    tests=qc.USUAL,
    include: list[str] | None = None,
    export: bool = False,
    gridded: bool = False,
    variables=("VELU", "VELV", "VELO"),
    **chosen,
) -> None:
    """Reads radial files and writes their flagged vectors, the cleaned ones and the catalogue as Parquet.

    Files are parsed once, to a Parquet table that all else reads; ``chosen`` (prefix, sites, start, end) says which are opened.
    ``edges`` are those of ``land`` (see ``edges_from_geojson``); ``limits``, ``tests`` and ``include`` are those of
    ``qc.qc_radials``.  With ``export`` the flagged files are written as text, and the cleaned ones in the form of their
    sources, each under its file's own name.  With ``gridded`` the flagged and the cleaned vectors are put on their files'
    grids: the last vector of a cell brings its variables and its flags.
    """
    parsed = _parsed_once(spark, source, "*.ruv", target, **chosen)
    files, radials = series.valid_files(ctf.file_table(parsed)), ctf.read_radials(parsed)
    if edges is not None:
        radials = land.mask_land(radials, edges)
    mask = F.col("on_land") if edges is not None else None
    tables.write_table(qc.qc_radials(radials, files, thresholds, mask, limits=limits, tests=tests, include=include), f"{target}/flagged")
    flagged = spark.read.parquet(f"{target}/flagged").drop("date")
    clean = qc.clean_copy(flagged)
    tables.write_table(clean, f"{target}/clean")
    valid = flagged.groupBy("path").agg(F.count_if(~F.col("VFLG").eqNullSafe(F.lit(128))).alias("n_valid"))
    known, limited, added = files.join(valid, "path", "left"), thresholds, []
    if limits is not None:
        known, limited, added = qc.with_limits(known, limits, thresholds)
    known = known.withColumn("provenance", qc.provenance(limited, tests, qc.included(include, "__include" in added), F.coalesce("n_valid", F.lit(0))))
    known.drop("n_valid", *added).write.mode("overwrite").parquet(f"{target}/files")
    flags = tuple(c for c in qc.TESTS if c in tests)
    if export:
        ran = spark.read.parquet(f"{target}/files").select("path", "provenance")
        tables.write_text(ctf.export_files(flagged, parsed.join(ran, "path"), ctf.RADIAL_COLUMNS, (*flags, "PRIM"), "provenance"), f"{target}/text")
        tables.write_text(ctf.export_files(clean, parsed.join(ran.select("path"), "path", "left_semi"), ctf.RADIAL_COLUMNS), f"{target}/clean_text")
    if gridded:
        tables.write_table(grid.grid_files(flagged, files, [*variables, *flags, "PRIM"]), f"{target}/gridded")
        tables.write_table(grid.grid_files(clean, files, list(variables)), f"{target}/clean_gridded")


def gridded_job(spark: SparkSession, source: str | list[str], target: str, variables=("VELU", "VELV", "VELO"), ranges=None, bearings=None, dense: bool = False, attributes: dict[str, str] | None = None, **chosen) -> None:
    """Reads radial files, puts the vectors of valid ones on their grids, and writes cells, their axes and coverage."""
    parsed = _parsed_once(spark, source, "*.ruv", target, **chosen)
    files = series.valid_files(ctf.file_table(parsed))
    radials = ctf.read_radials(parsed).join(files.select("path"), "path", "left_semi")
    named = series.rename_published(grid.grid_files(radials, files, list(variables), ranges, bearings, dense))
    tables.write_table(named, f"{target}/gridded", series.dataset_attributes(radials, attributes))
    grid.cell_axes(spark.read.parquet(f"{target}/gridded")).write.mode("overwrite").parquet(f"{target}/axes")
    series.coverage(radials).write.mode("overwrite").parquet(f"{target}/coverage")


def concat_gridded_job(spark: SparkSession, source: str | list[str], target: str, variables=("VELU", "VELV", "VELO"), ranges=None, bearings=None, group=("site",), **chosen) -> None:
    """Reads radial files and writes them on one shared grid for each group, in the order of time."""
    parsed = _parsed_once(spark, source, "*.ruv", target, **chosen)
    files = series.valid_files(ctf.file_table(parsed))
    radials = ctf.read_radials(parsed).join(files.select("path"), "path", "left_semi")
    cells = grid.grid_files(radials, files, list(variables), ranges, bearings)
    axes = grid.file_axes(radials, files, ranges, bearings).filter(F.size("ranges") > 0)
    tables.write_table(grid.concat_gridded(cells, axes, list(variables), group), f"{target}/concatenated")


def series_job(cells: DataFrame, points: DataFrame, origins: DataFrame, target: str, start=None, end=None, variables=("VELO",)) -> None:
    """Writes the series of each point as CSV."""
    chosen = series.time_slice(cells, start, end)
    tables.write_series(grid.extract_series(chosen, points, origins, list(variables)), target)


def stored_series_job(spark: SparkSession, source: str, points: DataFrame, origins: DataFrame, target: str, start=None, end=None, variables=("velocity",)) -> None:
    """The same from what ``gridded_job`` wrote: the scan reads the points' cells only."""
    cells, axes = series.time_slice(spark.read.parquet(f"{source}/gridded"), start, end), spark.read.parquet(f"{source}/axes")
    axes = axes.filter("kind = 'cell'").unionByName(series.time_slice(axes.filter("kind = 'time'"), start, end))
    tables.write_series(grid.extract_stored(cells, axes, points, origins, list(variables)), target)


def concat_job(spark: SparkSession, sources: list[str], target: str, prefix: str | None = None, start=None, end=None, keys: list[str] | None = None, rule: str = "error") -> DataFrame:
    """Unites tables written before, writes them by site and day, and returns their coverage.

    With ``keys`` rows of the same key are one row (``tables.combine``), and conflicts are reported in ``<target>_conflicts``.
    """
    if keys is None:
        rows = tables.read_tables(spark, *sources)
    else:
        rows, report = tables.combine([tables.read_tables(spark, s).drop("date") for s in sources], keys, rule)
        report.write.mode("overwrite").parquet(f"{target}_conflicts")
    rows = series.time_slice(series.of_prefix(rows, prefix) if prefix else rows, start, end)
    tables.write_table(rows.drop("date"), target)
    return series.coverage(spark.read.parquet(target))


def wave_job(spark: SparkSession, source: str | list[str], target: str, low: float = 0.2, high: float = 5.0, **chosen) -> None:
    """Reads wave files, leaves out heights beyond the limits, and writes the rest with the receiver's position.

    One parse: a row's receiver is in the header of its own file, which is the same parsed row.
    """
    parsed = ctf.read_files(spark, source, "*.wls", **chosen)
    waves = series.flag_wave_heights(ctf.read_waves(parsed, positions=True), low, high, remove=True)
    tables.write_table(series.rename_published(waves, series.WAVE_NAMES), target)
