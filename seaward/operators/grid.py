"""Range-bearing grids: axes, snapping, positions, dense form, nearest cells and point time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaward.functions.geodesy import inverse, reckon
from seaward.functions.headers import header, numbers, receiver
from seaward.operators import FILE_KEY, small


def range_axis(low: Column, high: Column, step: Column) -> Column:
    """Array low, low + step, ... up to and with the first value that covers ``high``, rounded to 4 places."""
    stop = F.round(high + step, 4)
    n = F.greatest(F.ceil((stop - low) / step), F.lit(0)).cast("int")
    indexes = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(indexes, lambda i: F.round(low + i * step, 4))


def bearing_axis(start: Column, step: Column) -> Column:
    """Sorted array of the whole circle in steps, from a start (degrees, 0 to 360)."""
    n = F.ceil(F.lit(360.0) / step).cast("int")
    return F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(start + i * step, F.lit(360.0))))


def nearest_index(value: Column, first: Column, step: Column, size: Column) -> Column:
    """Index on a uniform axis; ties go to the lower one, values outside to the edge."""
    return F.least(F.greatest(F.ceil((value - first) / step - 0.5), F.lit(0)), size - 1).cast("int")


def nearest_value(value: Column, axis: Column) -> Column:
    """The axis value (of any array) nearest to a value; of two as near the lower one."""
    return F.array_min(F.transform(axis, lambda a: F.struct(F.abs(a - value).alias("d"), a.alias("a"))))["a"]


def place(df: DataFrame, axes: DataFrame) -> DataFrame:
    """``df`` with the range and bearing of the grid cell of each vector; no shuffle.

    ``axes`` has, for each site, range_first, range_step, n_ranges, bearing_first, bearing_step, n_bearings.
    """
    joined = df.join(small(axes), "site")
    i = nearest_index(F.col("RNGE"), F.col("range_first"), F.col("range_step"), F.col("n_ranges"))
    j = nearest_index(F.col("BEAR"), F.col("bearing_first"), F.col("bearing_step"), F.col("n_bearings"))
    return joined.withColumns({"range": F.round(F.col("range_first") + i * F.col("range_step"), 4), "bearing": F.col("bearing_first") + j * F.col("bearing_step")})


def snap(df: DataFrame, axes: DataFrame, variables: list[str], keys=FILE_KEY) -> DataFrame:
    """One row per file and grid cell, with the last vector's variables; ``axes`` as for ``place``."""
    return _last(place(df, axes), variables, keys)


def _last(placed: DataFrame, variables: list[str], keys) -> DataFrame:
    last = F.max_by(F.struct(*variables), "row_no")
    return placed.filter("RNGE IS NOT NULL AND BEAR IS NOT NULL").groupBy(*keys, "range", "bearing").agg(last.alias("v")).select(*keys, "range", "bearing", "v.*")


def file_axes(radials: DataFrame, files: DataFrame, ranges=None, bearings=None) -> DataFrame:
    """Each file's key with its axes (arrays ``ranges`` and ``bearings``), their steps, and the receiver's position.

    ``ranges``: a list is the axis itself; a pair (low, high), or without one the file's own least and largest range, is
    filled in steps of the header's range resolution.  ``bearings``: a list is the axis itself; a pair (start, step), or
    the header's antenna bearing and angular resolution, or steps of one degree from 0 where the header lacks one of them,
    goes round the circle.  Steps are null for lists.
    """
    meta = F.col("meta")
    number = lambda k: F.get(numbers(header(meta, k)), F.lit(0)).try_cast("double")
    literal = lambda values: F.array(*(F.lit(float(v)) for v in values))
    lon, lat = receiver(meta)
    info = files.groupBy(*FILE_KEY).agg(F.max_by(F.struct(number("RangeResolutionKMeters").alias("r"), number("AntennaBearing").alias("a"), number("AngularResolution").alias("s"), lon.alias("origin_lon"), lat.alias("origin_lat")), "path").alias("i")).select(*FILE_KEY, "i.*")
    if isinstance(ranges, list):
        info = info.withColumns({"ranges": F.array_sort(literal(ranges)), "range_step": F.lit(None).cast("double")})
    else:
        if ranges is None:
            own = radials.groupBy(*FILE_KEY).agg(F.min("RNGE").alias("low"), F.max("RNGE").alias("high"))
            info = info.join(own, list(FILE_KEY))
        low, high = (F.col("low"), F.col("high")) if ranges is None else (F.lit(float(v)) for v in ranges)
        info = info.withColumns({"ranges": range_axis(low, high, F.col("r")), "range_step": F.col("r")})
    if isinstance(bearings, list):
        return info.withColumns({"bearings": F.array_sort(literal(bearings)), "bearing_step": F.lit(None).cast("double")})
    known = F.col("a").isNotNull() & F.col("s").isNotNull()
    start, step = (F.when(known, F.col("a")).otherwise(0.0), F.when(known, F.col("s")).otherwise(1.0)) if bearings is None else (F.lit(float(v)) for v in bearings)
    # Steps that do not divide the circle leave a gap, so that such an axis is not uniform.
    return info.withColumns({"bearings": bearing_axis(start, step), "bearing_step": F.when(F.pmod(F.lit(360.0), step) == 0, step)})


def grid_files(radials: DataFrame, files: DataFrame, variables: list[str], ranges=None, bearings=None, dense: bool = False) -> DataFrame:
    """Vectors on their files' grids: key, range, bearing, lon, lat (4 places) and the variables, ``kind`` gridded.

    Axes are those of ``file_axes``; of vectors in one cell the last one counts, and those beyond an axis go to its edge.
    With ``dense`` every cell of each file's grid is a row.  Vectors join their file's axes by the file's key, and positions
    are worked out once for each receiver, range and bearing.
    """
    axes = file_axes(radials, files, ranges, bearings)

    def on(value, axis, step):
        index = nearest_index(value, F.get(axis, F.lit(0)), step, F.size(axis))
        return F.when(step.isNotNull(), F.get(axis, index)).otherwise(nearest_value(value, axis))

    origin = ["origin_lon", "origin_lat"]
    joined = radials.join(axes.select(*FILE_KEY, "ranges", "bearings", "range_step", "bearing_step"), list(FILE_KEY)).filter(F.size("ranges") > 0)
    placed = joined.withColumns({"range": on(F.col("RNGE"), F.col("ranges"), F.col("range_step")), "bearing": on(F.col("BEAR"), F.col("bearings"), F.col("bearing_step"))})
    cells = _last(placed, variables, FILE_KEY)
    if dense:
        whole = axes.withColumn("range", F.explode("ranges")).withColumn("bearing", F.explode("bearings")).select(*FILE_KEY, "range", "bearing", *origin)
        cells = whole.join(cells, [*FILE_KEY, "range", "bearing"], "left")
    else:
        cells = cells.join(axes.select(*FILE_KEY, *origin), list(FILE_KEY))
    once = cells.select(*origin, "range", "bearing").distinct().withColumn("p", reckon(F.col("origin_lon"), F.col("origin_lat"), F.col("bearing"), F.col("range")))
    at = once.select(*origin, "range", "bearing", F.round("p.lon", 4).alias("lon"), F.round("p.lat", 4).alias("lat"))
    return cells.join(at, [*origin, "range", "bearing"], "left").select(*FILE_KEY, "range", "bearing", "lon", "lat", *variables, F.lit("gridded").alias("kind"))


def shared_axes(axes: DataFrame, group=("site",)) -> DataFrame:
    """The outer axes of the files of each group: all values (to 4 places) that any file has, sorted.

    ``axes`` has a row for each file (``file_axes``).  Most files of a site have the same axes, so the different ones are found
    first, and only their values are gathered.
    """
    rounded = lambda c: F.transform(c, lambda v: F.round(v, 4))
    keys = list(group)
    different = [axes.select(*keys, rounded(c).alias(c)).distinct().select(*keys, F.explode(c).alias("v")).groupBy(*keys).agg(F.array_sort(F.collect_set("v")).alias(c)) for c in ("ranges", "bearings")]
    return different[0].join(different[1], keys)


def concat_gridded(cells: DataFrame, axes: DataFrame, variables: list[str], group=("site",), dense: bool = True) -> DataFrame:
    """Gridded files of each group on one shared grid: every file has every range and bearing, null where it has no vector.

    Values of axes match exactly, to 4 places: a cell stays where it is, and files with other steps get empty cells between
    theirs.  ``dense=False`` leaves the empty cells out.  Rows are range-partitioned and sorted by group and time.
    """
    place = {c: F.round(c, 4) for c in ("range", "bearing")}
    order = [*group, "time", "range", "bearing"]
    own = cells.withColumns(place).select(*FILE_KEY, "range", "bearing", *variables)
    if dense:
        files = axes.select(*FILE_KEY).distinct().join(small(shared_axes(axes, group)), list(group))
        whole = files.withColumn("range", F.explode("ranges")).withColumn("bearing", F.explode("bearings")).select(*FILE_KEY, "range", "bearing")
        own = whole.join(own, [*FILE_KEY, "range", "bearing"], "left")
    return own.repartitionByRange(*group, "time").sortWithinPartitions(*order)


def tabular(radials: DataFrame) -> DataFrame:
    """Vectors as they are, with positions named lon and lat, ``kind`` tabular."""
    return radials.withColumnsRenamed({"LOND": "lon", "LATD": "lat"}).withColumn("kind", F.lit("tabular"))


def positions(cells: DataFrame, origins: DataFrame) -> DataFrame:
    """lon and lat (4 places) of each distinct site, range and bearing; ``origins``: site, origin_lon, origin_lat."""
    once = cells.select("site", "range", "bearing").distinct().join(origins, "site")
    at = once.withColumn("p", reckon(F.col("origin_lon"), F.col("origin_lat"), F.col("bearing"), F.col("range")))
    return at.select("site", "range", "bearing", F.round("p.lon", 4).alias("lon"), F.round("p.lat", 4).alias("lat"))


def densify(cells: DataFrame, axes: DataFrame, variables: list[str], keys=FILE_KEY) -> DataFrame:
    """Every cell of each file's grid, null where there is no vector; ``axes``: site, ranges and bearings (arrays)."""
    whole = cells.select(*keys).distinct().join(small(axes), "site").withColumn("range", F.explode("ranges")).withColumn("bearing", F.explode("bearings"))
    return whole.select(*keys, "range", "bearing").join(cells.select(*keys, "range", "bearing", *variables), [*keys, "range", "bearing"], "left")


def nearest_cells(points: DataFrame, cells: DataFrame, origins: DataFrame) -> DataFrame:
    """For each point of a site the nearest range and bearing that the site has, each on its own (ties: the larger).

    ``points``: point_id, site, lon, lat.  The axes are short (a site's distinct ranges or bearings).
    """
    seen = points.join(origins, "site").withColumn("g", inverse(F.col("origin_lon"), F.col("origin_lat"), F.col("lon"), F.col("lat")))
    seen = seen.select("point_id", "site", F.col("g.azimuth").alias("azimuth"), F.col("g.km").alias("km"))
    axes = cells.groupBy("site").agg(F.collect_set("range").alias("ranges"), F.collect_set("bearing").alias("bearings"))
    best = lambda axis, x: F.element_at(F.array_sort(F.transform(axis, lambda a: F.struct(F.abs(a - x).alias("d"), (-a).alias("a")))), 1)["a"] * -1.0
    return seen.join(axes, "site").select("point_id", "site", "azimuth", "km", best("ranges", F.col("km")).alias("range"), best("bearings", F.col("azimuth")).alias("bearing"))


def extract_series(cells: DataFrame, points: DataFrame, origins: DataFrame, variables: list[str]) -> DataFrame:
    """A row for each point and each time of its site; null where the point's cell has no vector then."""
    chosen = nearest_cells(points, cells, origins)
    return _series(chosen, cells.select("site", "time").distinct(), cells, variables)


def _series(chosen: DataFrame, times: DataFrame, cells: DataFrame, variables: list[str]) -> DataFrame:
    wanted = chosen.select("point_id", "site", "range", "bearing").join(times, "site")
    return wanted.join(cells.select("site", "time", "range", "bearing", *variables), ["site", "time", "range", "bearing"], "left")


def extract_vectors(radials: DataFrame, axes: DataFrame, points: DataFrame, origins: DataFrame, variables: list[str], keys=FILE_KEY) -> DataFrame:
    """The same as ``extract_series`` from vectors: only those in a point's cell are shuffled and compared.

    ``axes`` as for ``place``.  The points' cells are found from the sites' distinct ranges and bearings.
    """
    placed = place(radials, axes)
    chosen = nearest_cells(points, placed.filter("RNGE IS NOT NULL AND BEAR IS NOT NULL"), origins)
    picked = placed.join(small(chosen.select("site", "range", "bearing").distinct()), ["site", "range", "bearing"], "left_semi")
    return _series(chosen, placed.filter("RNGE IS NOT NULL AND BEAR IS NOT NULL").select("site", "time").distinct(), _last(picked, variables, keys), variables)


#: Most different cells that are written into a scan's filter.
MOST_PICKED = 500


def extract_stored(cells: DataFrame, axes: DataFrame, points: DataFrame, origins: DataFrame, variables: list[str]) -> DataFrame:
    """The same from a table of cells that ``tables.write_table`` wrote, of which the scan reads the points' cells only.

    ``axes`` has the distinct site, range and bearing of the table, ``times`` of which are its site and time (see
    ``cell_axes``).  The cells of up to ``MOST_PICKED`` points become filters of the scan: partitions of other sites and row
    groups of other bearings and ranges are passed over.  More than these are joined.
    """
    chosen = nearest_cells(points, axes.filter("kind = 'cell'"), origins)
    few = chosen.select("site", "range", "bearing").distinct().limit(MOST_PICKED + 1).collect()  # a bounded number of rows
    if len(few) <= MOST_PICKED:
        sites, ranges, bearings = (sorted({r[i] for r in few}) for i in range(3))
        picked = cells.filter(F.col("site").isin(sites) & F.col("range").isin(ranges) & F.col("bearing").isin(bearings))
    else:
        picked = cells.join(chosen.select("site", "range", "bearing").distinct(), ["site", "range", "bearing"], "left_semi")
    return _series(chosen, axes.filter("kind = 'time'").select("site", "time"), picked, variables)


def cell_axes(cells: DataFrame) -> DataFrame:
    """What ``extract_stored`` needs to know of a table of cells: its distinct cells (``kind`` cell) and times (``kind`` time)."""
    places = cells.select("site", "range", "bearing").distinct().withColumn("kind", F.lit("cell"))
    return places.unionByName(cells.select("site", "time").distinct().withColumn("kind", F.lit("time")), allowMissingColumns=True)


def in_box(df: DataFrame, bearings: tuple[float, float], ranges: tuple[float, float], bearing: str = "BEAR", range_: str = "RNGE") -> DataFrame:
    """Rows inside a bearing-range box, both ends inclusive."""
    return df.filter(F.col(bearing).between(*bearings) & F.col(range_).between(*ranges))


def box_means(df: DataFrame, bearings: tuple[float, float], ranges: tuple[float, float], variables: list[str]) -> DataFrame:
    """Mean of each variable in the box by site and time, nulls left out."""
    return in_box(df, bearings, ranges).groupBy("site", "time").agg(*(F.avg(v).alias(v) for v in variables))
