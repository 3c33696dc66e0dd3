"""Incremental quality control: new hours are flagged as their files arrive, in whatever order they come."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.operators import FILE_KEY, qc, series, small
from seaward.sources import ctf

_KEY = list(FILE_KEY)


def start_qc(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    thresholds: qc.Thresholds = qc.Thresholds(),
    pattern: str = "*.ruv",
    limits: DataFrame | None = None,
    tests=None,
    include: list[str] | None = None,
):
    """A file stream whose batches are parsed once, flagged, and put in the table at ``target``, by day and site.

    ``limits``, ``tests`` and ``include`` are those of ``qc.qc_radials``.  See ``update`` for what a batch does.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(source)

    def flag(batch: DataFrame, _: int) -> None:
        parsed = ctf.parse_files(batch).persist()
        try:
            update(target, series.valid_files(ctf.file_table(parsed)), ctf.read_radials(parsed), thresholds, limits, tests, include)
        finally:
            parsed.unpersist()

    return arriving.writeStream.foreachBatch(flag).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _moved(keys: DataFrame, hours: range) -> DataFrame:
    """The keys with their times moved by each number of hours."""
    return keys.withColumn("time", F.explode(F.array(*(F.col("time") + F.make_dt_interval(hours=F.lit(h)) for h in hours)))).distinct()


def _days(keys: DataFrame) -> DataFrame:
    return keys.select(F.to_date("time").alias("date"), "site").distinct()


def update(
    target: str,
    files: DataFrame,
    fresh: DataFrame,
    thresholds: qc.Thresholds = qc.Thresholds(),
    limits: DataFrame | None = None,
    tests=None,
    include: list[str] | None = None,
) -> None:
    """Flags the vectors ``fresh`` of the valid ``files`` and puts them in the table at ``target``.

    A file's own tests look at its vectors only.  The tests by history need the hours before, which are read back; and the
    hours after, if they are there already, were flagged without this file, so their history tests and primary flags are worked
    out again: files that arrive late leave the same table as files in order.  Of the table only the days and sites that a
    fresh file can reach are read and replaced, so a batch that is played again, or a file that comes again, leaves the same
    rows as before.
    """
    spark, order = fresh.sparkSession, qc.chosen_tests(tests)
    most = qc.most_steps(limits, thresholds)
    reach = max(1, most - 1) if {"Q206", "Q209", "Q901"} & set(order) else 0
    keys = fresh.select(*_KEY).join(files.select(*_KEY).distinct(), _KEY, "left_semi").distinct().persist()
    try:
        if keys.limit(1).count() == 0:
            return
        rows, t, added = (fresh, thresholds, []) if limits is None else qc.with_limits(fresh, limits, thresholds)
        own = qc.file_tests(rows, files, t, tests=order).drop(*added).join(small(keys), _KEY, "left_semi")
        both, kept = own, None
        try:
            old = spark.read.parquet(target)
        except AnalysisException as e:  # the first batch finds no table yet
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            near = old.join(small(_days(_moved(keys, range(-reach, reach + 1)))), ["date", "site"], "left_semi").join(small(keys), _KEY, "left_anti")
            both = own.unionByName(near.select(*own.columns))
            touched = _moved(keys, range(reach + 1))
            kept = near.join(small(touched), _KEY, "left_anti").join(small(_days(touched)), ["date", "site"], "left_semi")
        both, t, added = (both, thresholds, []) if limits is None else qc.with_limits(both, limits, thresholds)
        flagged = qc.history_tests(both, t, order, qc.included(include, "__include" in added), most).drop(*added).withColumn("date", F.to_date("time"))
        whole = flagged if kept is None else flagged.join(small(touched), _KEY, "left_semi").unionByName(kept.select(*flagged.columns))
        whole.repartition("date", "site").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "site").parquet(target)
    finally:
        keys.unpersist()
