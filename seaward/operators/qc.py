"""Quality control of radial vectors (QARTOD tests): row, file, neighbour and history tests, and the primary flag.

Flags: 1 pass, 2 not evaluated, 3 suspect, 4 fail.  Comparisons with null leave the default flag, so fill values and NaN
must be null before (``sources.ctf``).  Equality with a threshold passes, unless said otherwise.  Limits are numbers, or
columns where each site has its own (``with_limits``).
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaward.functions.headers import header, numbers, receiver, whole_number
from seaward.operators import FILE_KEY, small

#: The names of the tests in file headers, in the order in which they run.
TESTS = {
    "Q201": "qc_qartod_syntax",
    "Q202": "qc_qartod_maximum_velocity",
    "Q203": "qc_qartod_valid_location",
    "Q204": "qc_qartod_radial_count",
    "Q205": "qc_qartod_spatial_median",
    "Q206": "qc_qartod_temporal_gradient",
    "Q209": "qc_qartod_stuck_value",
    "Q207": "qc_qartod_avg_radial_bearing",
    "Q901": "qc_qartod_stuck_value_v2",
}
PRIMARY = "qc_qartod_primary_flag"
#: Tests that run unless others are asked for.
USUAL = tuple(t for t in TESTS if t != "Q901")


@dataclass(frozen=True)
class Thresholds:
    """Limits of the tests: numbers for all sites, or columns of the table they are applied to."""

    max_speed: float | Column = 250.0
    high_speed: float | Column = 150.0
    min_count: int | Column = 150
    low_count: int | Column = 300
    reference_bearing: float | Column = 180.0
    warning_threshold: float | Column = 15.0
    failure_threshold: float | Column = 30.0
    range_cell_limit: float | Column = 2.1
    angular_limit: float | Column = 10.0
    current_difference: float | Column = 30.0
    gradient_fail: float | Column = 54.0
    gradient_warn: float | Column = 36.0
    resolution: float | Column = 0.01
    n_steps: int | Column = 3


def with_limits(df: DataFrame, limits: DataFrame, t: Thresholds = Thresholds()) -> tuple[DataFrame, Thresholds, list[str]]:
    """``df`` with the limits of each row's site, as thresholds, and the names of the columns added.

    ``limits`` has one row for each site: ``site`` and any of the thresholds' names; a site, name or value that it lacks
    takes the value of ``t``.  A column ``include`` comes along as ``__include``.  A site that is listed twice is an error when
    the job runs.  The table is joined by broadcast as long as it is short.
    """
    names = [f.name for f in fields(Thresholds) if f.name in limits.columns]
    added = [f"__limit_{n}" for n in names] + ["__include"] * ("include" in limits.columns)
    given = F.struct(*(F.col(c.replace("__limit_", "").replace("__include", "include")).alias(c) for c in added))
    twice = F.raise_error(F.concat(F.lit("limits name a site twice: "), "site")).cast(limits.select(given.alias("v")).schema["v"].dataType)
    one = limits.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.max(given).alias("v")).select("site", F.when(F.col("n") > 1, twice).otherwise(F.col("v")).alias("v"))
    columns = {n: F.coalesce(a, F.lit(getattr(t, n))) for n, a in zip(names, added, strict=False)}
    return df.join(small(one.select("site", "v.*")), "site", "left"), Thresholds(**{f.name: columns.get(f.name, getattr(t, f.name)) for f in fields(Thresholds)}), added


def q202_maximum_velocity(t: Thresholds = Thresholds()) -> Column:
    speed = F.abs("VELO")
    return F.when(speed > t.max_speed, 4).when((speed > t.high_speed) & (speed < t.max_speed), 3).otherwise(1)


def q203_valid_location(columns: list[str], on_land: Column | None = None) -> Column:
    """4 where the vector flag is 128 exactly or (with a mask) the place is on land; files without the flag pass."""
    bad = F.lit(False)
    if "VFLG" in columns:
        bad = bad | F.coalesce(F.col("VFLG") == 128, F.lit(False))
    if on_land is not None:
        bad = bad | F.coalesce(on_land, F.lit(False))
    return F.when(bad, 4).otherwise(1)


def q204_radial_count(t: Thresholds = Thresholds()) -> Column:
    """By the file's vectors that are not flagged 128 (null flags count)."""
    return _count_flag(_valid_vectors().over(Window.partitionBy(*FILE_KEY)), t)


def _valid_vectors() -> Column:
    return F.count_if(~F.col("VFLG").eqNullSafe(F.lit(128)))


def _count_flag(n: Column, t: Thresholds) -> Column:
    return F.when(n < t.min_count, 4).when(n <= t.low_count, 3).otherwise(1)


def q207_average_bearing(t: Thresholds = Thresholds()) -> Column:
    """By the distance of the file's plain mean bearing from the reference; equality flags; no bearings: 2."""
    return _bearing_flag(F.avg("BEAR").over(Window.partitionBy(*FILE_KEY)), t)


def _bearing_flag(mean: Column, t: Thresholds) -> Column:
    off = F.abs(mean - F.lit(t.reference_bearing))
    return F.when(off.isNull(), 2).when(off >= t.failure_threshold, 4).when(off >= t.warning_threshold, 3).otherwise(1)


def syntax_flag() -> Column:
    """Six checks of a file's name, header and table, all needed to pass."""
    meta = F.col("meta")
    lon, lat = receiver(meta)
    filled = [F.length(F.trim(F.coalesce(header(meta, k), F.lit("")))) > 0 for k in ("FileType", "Site", "TimeStamp", "Origin", "PatternType", "TimeZone")]
    declared = whole_number(header(meta, "TableColumns"))
    checks = [
        F.col("file_time").isNotNull(),
        F.col("n_rows") > 0,
        *filled,
        F.col("file_time") == F.col("time"),
        declared == F.col("n_cols_row"),
        lon.between(-180, 180) & lat.between(-90, 90),
    ]
    good = F.lit(True)
    for c in checks:
        good = good & F.coalesce(c, F.lit(False))
    return F.when(good, 1).otherwise(4)


def q201_syntax(files: DataFrame) -> DataFrame:
    """Each file's key and syntax flag."""
    return files.select(*FILE_KEY, syntax_flag().alias("Q201"))


def _neighbour_median(bcell: np.ndarray, rcell: np.ndarray, velo: np.ndarray, rows: int, blim: int, rlim: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid of medians over circular bearings and plain ranges, and for each cell the position that fills it."""
    cols = int(rcell.max()) + 1
    last = np.full((rows, cols), -1)
    last[bcell, rcell] = np.arange(len(bcell))  # of vectors in one cell the last one counts
    grid = np.full((rows, cols + 2 * rlim), np.nan)
    taken = last >= 0
    grid[:, rlim : rlim + cols][taken] = velo[last[taken]]
    layers = [np.roll(grid, s, axis=0)[:, r : r + cols] for s in range(-blim, blim + 1) for r in range(2 * rlim + 1)]
    stack = np.sort(np.stack(layers), axis=0)  # NaN sorts last
    n = (~np.isnan(stack)).sum(0)
    low = np.take_along_axis(stack, np.maximum((n - 1) // 2, 0)[None], 0)[0]
    high = np.take_along_axis(stack, np.minimum(n // 2, len(layers) - 1)[None], 0)[0]
    return np.where(n > 0, (low + high) / 2, np.nan), last


def _file_flags(row_no: np.ndarray, bear: np.ndarray, sprc: np.ndarray, velo: np.ndarray, size: float, cells: float, angle: float, most: float) -> np.ndarray:
    """The Q205 flags of one file's vectors, in their order."""
    flag = np.full(len(row_no), 2, dtype=np.int32)
    order = np.lexsort((velo, sprc, bear, row_no))
    order = order[~(np.isnan(bear) | np.isnan(sprc))[order]]
    if len(order) and size > 0:
        bear, rcell, velo = bear[order], sprc[order].astype(int), velo[order]
        rows, rcell = max(1, int(round(360 / size))), rcell - int(rcell.min())
        bcell = np.trunc((bear - np.mod(bear.min(), size)) / size - 1).astype(int) % rows
        median, last = _neighbour_median(bcell, rcell, velo, rows, min(int(angle / size), (rows - 1) // 2), int(round(cells)))
        flag[order] = 1
        flag[order[(np.abs(velo - median[bcell, rcell]) > most) & (last[bcell, rcell] == np.arange(len(bear)))]] = 4
    return flag


def _spatial_flags(row_no: pa.Array, bear: pa.Array, sprc: pa.Array, velo: pa.Array, size: pa.Array, cells: pa.Array, angle: pa.Array, most: pa.Array) -> pa.Array:
    ends = row_no.offsets.to_numpy()
    columns = [np.asarray(c.flatten().to_numpy(zero_copy_only=False), dtype=float) for c in (row_no, bear, sprc, velo)]
    limits = [np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in (size, cells, angle, most)]
    parts = [_file_flags(*(c[a - ends[0] : b - ends[0]] for c in columns), *(x[i] for x in limits)) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *parts])))


def spatial_flags(rows: Column, step: Column, t: Thresholds = Thresholds()) -> Column:
    """The Q205 flags of a file from the array of its vectors (row_no, BEAR, SPRC, VELO), in the order of the array.

    ``step`` is the file's angular resolution.  Only the four arrays go through Python, a file at a time.
    """
    part = lambda c, kind: F.transform(rows, lambda r: r[c].cast(kind))
    limits = (F.lit(x).cast("double") for x in (t.range_cell_limit, t.angular_limit, t.current_difference))
    return F.arrow_udf(_spatial_flags, "array<int>")(part("row_no", "bigint"), *(part(c, "double") for c in ("BEAR", "SPRC", "VELO")), step.cast("double"), *limits)


def by_file(df: DataFrame, *more: Column) -> DataFrame:
    """One row for each file: its key, its vectors as an array of structs ``__rows``, and other aggregates.

    The vectors move once, by the file's key; a file's array is bounded by its grid.
    """
    return df.groupBy(*FILE_KEY).agg(F.collect_list(F.struct(*(c for c in df.columns if c not in FILE_KEY))).alias("__rows"), *more)


def by_row(files: DataFrame, columns: list[str], flags: list[str], spatial: Column | None = None) -> DataFrame:
    """The vectors of ``by_file`` as rows again, with the files' ``flags`` and, if given, Q205 from an array in their order."""
    known = F.lit(True)
    for k in FILE_KEY:
        known = known & F.col(k).isNotNull()
    zipped = F.arrays_zip("__rows") if spatial is None else F.arrays_zip("__rows", spatial.alias("__flags"))
    rows = files.select(*FILE_KEY, *flags, known.alias("__known"), F.inline(zipped))
    own = [F.col(c) if c in FILE_KEY else F.col(f"__rows.{c}") for c in columns]
    q205 = [] if spatial is None else [F.when(F.col("__known"), F.col("__flags")).otherwise(2).alias("Q205")]
    return rows.select(*own, *flags, *q205)


def q205_spatial_median(df: DataFrame, t: Thresholds = Thresholds(), step: str = "bearing_step") -> DataFrame:
    """``df`` with Q205: 4 where a velocity is off the median of its neighbours by more than the limit.

    ``step`` is the column with the file's angular resolution.  Files without it, vectors without bearing or range cell,
    and vectors of files without a part of their key get 2.  One shuffle, by file, and no join: a file's vectors are one array
    from which the flags are worked out.
    """
    names = ("range_cell_limit", "angular_limit", "current_difference")
    files = by_file(df, F.first(step).alias("__step"), *(F.first(F.lit(getattr(t, n))).alias(f"__{n}") for n in names))
    files = files.withColumn("__q205", spatial_flags(F.col("__rows"), F.col("__step"), replace(t, **{n: F.col(f"__{n}") for n in names})))
    return by_row(files, df.columns, [], F.col("__q205"))


def spatial_median_by_offsets(df: DataFrame, t: Thresholds = Thresholds(), bearings: int = 72) -> DataFrame:
    """The same test with built-in functions only, for whole cells ``bcell`` and ``SPRC``: a cross-check of ``q205``."""
    blim, rlim = 2, int(round(t.range_cell_limit))
    cells = df.groupBy(*FILE_KEY, "bcell", "SPRC").agg(F.max_by("VELO", "row_no").alias("VELO"), F.max("row_no").alias("row_no"))
    shifts = [F.struct(F.lit(b).alias("b"), F.lit(r).alias("r")) for b in range(-blim, blim + 1) for r in range(-rlim, rlim + 1)]
    spread = cells.withColumn("o", F.explode(F.array(*shifts))).select(*FILE_KEY, F.pmod(F.col("bcell") + F.col("o.b"), F.lit(bearings)).alias("bcell"), (F.col("SPRC") + F.col("o.r")).alias("SPRC"), "VELO")
    medians = spread.groupBy(*FILE_KEY, "bcell", "SPRC").agg(F.median("VELO").alias("median"))
    joined = df.join(medians, [*FILE_KEY, "bcell", "SPRC"], "left").join(cells.select(*FILE_KEY, "bcell", "SPRC", F.col("row_no").alias("last")), [*FILE_KEY, "bcell", "SPRC"], "left")
    off = (F.abs(F.col("VELO") - F.col("median")) > t.current_difference) & (F.col("row_no") == F.col("last"))
    return joined.withColumn("Q205", F.when(off, 4).otherwise(1)).drop("median", "last")


def _hours_back(i: int) -> Column:
    """struct<v>: the velocity at this place exactly ``i`` hours earlier (of several rows the last); null if no row."""
    w = Window.partitionBy("prefix", "site", "LOND", "LATD").orderBy(F.unix_seconds("time")).rangeBetween(-3600 * i, -3600 * i)
    return F.max_by(F.struct(F.col("VELO").alias("v")), F.col("row_no")).over(w)


def temporal_tests(df: DataFrame, t: Thresholds = Thresholds(), tests=("Q206", "Q209", "Q901"), most_steps: int | None = None) -> DataFrame:
    """``df`` with the tests that look at earlier hours; all share one shuffle by place.

    Q206 temporal gradient: 2 without the row one hour earlier, 4 and 3 by the step's size.  Q209 stuck value: 2 if a
    velocity of the last ``n_steps`` hours is missing, 4 if no step between them reaches the resolution.  Q901: the same
    with each earlier hour held against the current one; there an earlier null velocity passes.  Where ``n_steps`` is a
    column, ``most_steps`` is its largest value.
    """
    most = most_steps if most_steps is not None else t.n_steps
    steps = F.lit(t.n_steps)
    lags = range(1, max(2, most))
    back = df.withColumns({f"__h{i}": _hours_back(i) for i in lags})
    step = F.abs(F.col("VELO") - F.col("__h1.v"))
    gradient = F.when(F.col("__h1").isNull(), 2).when(step > t.gradient_fail, 4).when((step > t.gradient_warn) & (step < t.gradient_fail), 3).otherwise(1)
    missing, moved, apart, gone = F.col("VELO").isNull() & (steps > 1), F.lit(False), F.lit(False), F.lit(False)
    before = F.col("VELO")
    for i in range(1, most):
        now, used = F.col(f"__h{i}.v"), steps > i
        missing = missing | (used & now.isNull())
        moved = moved | (used & (F.abs(before - now) >= t.resolution))
        gone = gone | (used & F.col(f"__h{i}").isNull())
        apart = apart | (used & ~F.coalesce(F.abs(F.col("VELO") - now) < t.resolution, F.lit(False)))
        before = now
    found = {
        "Q206": gradient,
        "Q209": F.when(missing, 2).when(moved, 1).otherwise(4),
        "Q901": F.when(gone, 2).when(apart, 1).otherwise(4),
    }
    return back.withColumns({k: found[k] for k in tests}).drop(*(f"__h{i}" for i in lags))


def primary_flag(tests: list[str], include: Column | list[str] | None = None) -> Column:
    """4 if any test has 4, else 3 if any has 3, else 1 (not evaluated counts as passed).

    ``include`` names the tests that count, by flag or by test name: a list, or a column of such lists (null: all).
    """
    chosen = F.array(*(F.lit(x) for x in include)).cast("array<string>") if isinstance(include, list | tuple) else include
    one = lambda c: F.col(c) if chosen is None else F.when(chosen.isNull() | F.array_contains(chosen, c) | F.array_contains(chosen, TESTS.get(c, c)), F.col(c))
    flags = F.array(*(one(c) for c in tests))
    has = lambda v: F.exists(flags, lambda x: F.coalesce(x == v, F.lit(False)))
    return F.when(has(4), 4).when(has(3), 3).otherwise(1)


def provenance(t: Thresholds = Thresholds(), tests=USUAL, include: Column | list[str] | None = None, valid: Column | None = None) -> Column:
    """Array of text for a file's header: which tests ran with which limits, and what the primary flag is made of.

    ``valid`` is the file's number of valid vectors, if known.
    """
    limits = {
        "Q201": {},
        "Q202": {"high": t.high_speed, "max": t.max_speed},
        "Q203": {"VFLG": 128},
        "Q204": {"failure": t.min_count, "warning": t.low_count} | ({} if valid is None else {"valid": valid}),
        "Q205": {"range_cells": t.range_cell_limit, "angle": t.angular_limit, "difference": t.current_difference},
        "Q206": {"warning": t.gradient_warn, "failure": t.gradient_fail},
        "Q207": {"reference": t.reference_bearing, "warning": t.warning_threshold, "failure": t.failure_threshold},
        "Q209": {"resolution": t.resolution, "N": t.n_steps},
        "Q901": {"resolution": t.resolution, "N": t.n_steps},
    }
    inside = lambda v: F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), F.lit(x).cast("string")) for n, x in v.items()))
    line = lambda c: F.concat(F.lit(f"%QCTest: {TESTS[c]} ({c}) - Thresholds=["), inside(limits[c]), F.lit("]"))
    ran = [c for c in TESTS if c in tests]
    chosen = F.array(*(F.lit(x) for x in include)).cast("array<string>") if isinstance(include, list | tuple) else include
    counted = F.array(*(F.lit(c) for c in ran))
    if chosen is not None:
        kept = [F.when(F.array_contains(chosen, c) | F.array_contains(chosen, TESTS[c]), F.lit(c)) for c in ran]
        counted = F.when(chosen.isNull(), counted).otherwise(F.filter(F.array(*kept), lambda x: x.isNotNull()))
    return F.array(*(line(c) for c in ran), F.concat(F.lit(f"%QCTest: {PRIMARY} (PRIM) - highest of "), F.array_join(counted, ", "), F.lit(" (2 ignored)")))


def file_tests(
    radials: DataFrame,
    files: DataFrame,
    t: Thresholds = Thresholds(),
    on_land: Column | None = None,
    tests=USUAL,
) -> DataFrame:
    """The tests that need a vector's own file only (Q201 to Q205, Q207), as columns of ``radials``.

    One shuffle of the vectors, by file: there they meet the file's header, become one array beside the file's counts and
    means, and are rows again with all flags.
    """
    step = F.get(numbers(header(F.col("meta"), "AngularResolution")), F.lit(0)).try_cast("double")
    info = files.groupBy(*FILE_KEY).agg(F.max(syntax_flag()).alias("Q201"), F.max(step).alias("__step"))
    by_vector = {"Q202": q202_maximum_velocity(t), "Q203": q203_valid_location(radials.columns, on_land)}
    rows = radials.withColumns({c: by_vector[c] for c in by_vector if c in tests})
    of_file = {"Q204": ("min_count", "low_count"), "Q205": ("range_cell_limit", "angular_limit", "current_difference"), "Q207": ("reference_bearing", "warning_threshold", "failure_threshold")}
    names = [n for c, some in of_file.items() if c in tests for n in some]
    more = [F.first("__step").alias("__size"), *(F.first(F.lit(getattr(t, n))).alias(f"__{n}") for n in names)]
    more += [_valid_vectors().alias("__valid")] * ("Q204" in tests) + [F.avg("BEAR").alias("__bearing")] * ("Q207" in tests)
    met = rows.join(info.hint("shuffle_hash"), list(FILE_KEY), "left").withColumn("Q201", F.coalesce("Q201", F.lit(4)))
    held = by_file(met, *more)
    own = replace(t, **{n: F.col(f"__{n}") for n in names})
    if "Q204" in tests:
        held = held.withColumn("Q204", _count_flag(F.col("__valid"), own))
    if "Q207" in tests:
        held = held.withColumn("Q207", _bearing_flag(F.col("__bearing"), own))
    if "Q205" in tests:
        held = held.withColumn("__q205", spatial_flags(F.col("__rows"), F.col("__size"), own))
    own_columns = [*rows.columns, *(["Q201"] if "Q201" in tests else [])]
    return by_row(held, own_columns, [c for c in ("Q204", "Q207") if c in tests], F.col("__q205") if "Q205" in tests else None)


def chosen_tests(tests=None, extra: bool = False) -> list[str]:
    """The names of the tests that run, in their order."""
    return [c for c in TESTS if c in (tests or (*USUAL, *(["Q901"] if extra else [])))]


def included(include: list[str] | None, by_site: bool) -> Column | list[str] | None:
    """The tests that count for the primary flag: the column ``__include`` where sites have lists, else the list for all."""
    if not by_site:
        return include
    return F.coalesce("__include", F.lit(None).cast("array<string>") if include is None else F.array(*(F.lit(x) for x in include)))


def history_tests(rows: DataFrame, t: Thresholds, order: list[str], include: Column | list[str] | None = None, most_steps: int | None = None) -> DataFrame:
    """``rows`` of ``file_tests`` with the tests that look at earlier hours, and the primary flag."""
    if back := [c for c in ("Q206", "Q209", "Q901") if c in order]:
        rows = temporal_tests(rows, t, back, most_steps)
    return rows.withColumn("PRIM", primary_flag(order, include))


def most_steps(limits: DataFrame | None, t: Thresholds) -> int:
    """The largest number of hours that a site's tests look at; of ``limits`` one number is read."""
    if limits is None or "n_steps" not in limits.columns:
        return t.n_steps
    return max(t.n_steps, limits.agg(F.max("n_steps")).first()[0] or 0)


def qc_radials(
    radials: DataFrame,
    files: DataFrame,
    t: Thresholds = Thresholds(),
    on_land: Column | None = None,
    extra: bool = False,
    limits: DataFrame | None = None,
    tests=None,
    include: list[str] | None = None,
) -> DataFrame:
    """The tests and PRIM.  Two shuffles of the vectors: by file for the file's own tests, by place for the hours before.

    ``limits`` gives sites their own thresholds (see ``with_limits``) and, in a column ``include`` (array of text), the
    tests that count for the primary flag; ``include`` is that list for the sites without one.  ``tests`` are those that run
    (``USUAL``, with ``extra`` Q901 too).
    """
    order, most = chosen_tests(tests, extra), most_steps(limits, t)
    rows, added = radials, []
    if limits is not None:
        rows, t, added = with_limits(radials, limits, t)
    flags = history_tests(file_tests(rows, files, t, on_land, order), t, order, included(include, "__include" in added), most)
    return flags.drop(*added)


def clean_copy(flagged: DataFrame) -> DataFrame:
    """The vectors that did not fail, without flags."""
    flags = [c for c in flagged.columns if c.startswith("Q") and c[1:].isdigit()]
    return flagged.filter("PRIM <> 4").drop(*flags, "PRIM")


def passed_only(flagged: DataFrame) -> DataFrame:
    """The vectors whose primary flag is 1."""
    return flagged.filter("PRIM = 1")
