"""Catalogues, and parsed tables as Parquet or CSV."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from seaward.sources.ctf import name_parts
from seaward.sources.named import NamedText


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a folder of this machine is made and set, but only if all of Spark runs in this one
    process; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def list_files(spark: SparkSession, path: str, pattern: str | list[str] = "*", recursive: bool = True, folders: list[str] | None = None) -> DataFrame:
    """path and length of the files under ``path`` that match a pattern or one of several (contents are not read).

    With ``folders`` only what lies in sub-folders of these names, directly under ``path``, is listed; names that are not there
    are passed over, and if none is there the table is empty.
    """
    globs = pattern if isinstance(pattern, str) else "{" + ",".join(pattern) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", globs).option("recursiveFileLookup", recursive and folders is None)
    try:
        found = reader.load(path if folders is None else f"{path.rstrip('/')}/{{{','.join(folders)}}}")
    except AnalysisException as e:
        if folders is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length bigint")
    return found.select("path", "length")


def catalogue(paths: DataFrame) -> DataFrame:
    """Paths with name, prefix and time from the name, in the order of time (those without a time last)."""
    return paths.withColumns(name_parts(F.col("path"))).orderBy(F.col("file_time").asc_nulls_last(), "path")


#: Order of rows in a written day: what point series look for first.
CELL_ORDER = ("BEAR", "RNGE", "bearing", "range", "time")


def write_table(df: DataFrame, path: str, attributes: DataFrame | None = None) -> None:
    """Parquet by site and day; rows of a day are sorted by grid cell where it is known, for row-group skipping.

    Metadata of columns is kept in the files.  ``attributes`` (one row: the data set's own, see ``series.dataset_attributes``)
    are written beside them, where readers of the table do not look.
    """
    order = [c for c in CELL_ORDER if c in df.columns]
    dated = df.withColumn("date", F.to_date("time"))
    dated.repartition("site", "date").sortWithinPartitions("site", "date", *order).write.mode("overwrite").partitionBy("site", "date").parquet(path)
    if attributes is not None:
        attributes.coalesce(1).write.mode("overwrite").json(f"{path}/_attributes")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """The attributes that were written with a table: one row for each, (attribute, value), as text."""
    row = spark.read.option("inferSchema", False).option("primitivesAsString", True).json(f"{path}/_attributes")
    return row.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in row.columns)), F.array(*(F.col(c) for c in row.columns)))).alias("attribute", "value"))


def column_metadata(df: DataFrame) -> dict[str, dict]:
    """The metadata of the columns that have some."""
    return {f.name: dict(f.metadata) for f in df.schema.fields if f.metadata}


def combine(parts: list[DataFrame], keys: list[str], rule: str = "error") -> tuple[DataFrame, DataFrame]:
    """Overlapping tables as one, a row for each key, and the report of their conflicts.

    Columns that a table lacks, and nulls, are filled from the others.  Where several hold different values the rule decides:
    ``first`` or ``last`` (of the tables in their order; in one table the smallest or largest value), or ``error``, which stops
    the job that reads the result.  The report has a row for each key and column with different values: the keys, column,
    lowest, highest (as text) and ``n_tables``, the number of tables with a value.  One shuffle, by key.
    """
    if rule not in ("first", "last", "error"):
        raise ValueError(f"no such rule: {rule}")
    kinds = {c: k for p in parts for c, k in p.dtypes}
    columns = [c for c in kinds if c not in keys]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("__from", F.lit(i)) for i, p in enumerate(parts)))
    order = lambda c: F.when(F.col(c).isNotNull(), F.struct("__from", c))
    pick = F.max_by if rule == "last" else F.min_by
    found = whole.groupBy(*keys).agg(
        *(pick(F.col(c), order(c)).alias(c) for c in columns),
        *(F.min(c).alias(f"__low_{c}") for c in columns), *(F.max(c).alias(f"__high_{c}") for c in columns),
        *(F.size(F.collect_set(F.when(F.col(c).isNotNull(), F.col("__from")))).alias(f"__n_{c}") for c in columns),
    )
    differs = lambda c: F.col(f"__low_{c}") != F.col(f"__high_{c}")
    if rule == "error":
        told = lambda c: F.raise_error(F.concat_ws(" ", F.lit(f"tables differ in {c} at"), *(F.col(k).cast("string") for k in keys))).cast(kinds[c])
        rows = found.select(*keys, *(F.when(differs(c), told(c)).otherwise(F.col(c)).alias(c) for c in columns))
    else:
        rows = found.select(*keys, *columns)
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"__low_{c}").cast("string").alias("lowest"), F.col(f"__high_{c}").cast("string").alias("highest"), F.col(f"__n_{c}").alias("n_tables"), differs(c).alias("differs")) for c in columns))
    report = found.select(*keys, F.explode(F.filter(entries, lambda e: F.coalesce(e["differs"], F.lit(False)))).alias("e")).select(*keys, "e.column", "e.lowest", "e.highest", "e.n_tables")
    return rows, report


def read_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """Tables written before, each with its own partitions, united by column name (columns that one lacks are null)."""
    one = [spark.read.option("mergeSchema", True).parquet(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one)


def write_series(df: DataFrame, path: str) -> None:
    """Point time series as CSV, in order of point and time."""
    df.orderBy("point_id", "time").write.mode("overwrite").option("header", True).csv(path)


def write_text(files: DataFrame, path: str, folder: str | None = None) -> None:
    """Texts (path, value) as files of the same names as their paths; with ``folder`` (a column) in sub-folders."""
    spark = files.sparkSession
    spark.dataSource.register(NamedText)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    named = files.select((F.concat_ws("/", folder, name) if folder else name).alias("name"), "value")
    named.repartition("name").write.format("named_text").mode("overwrite").save(path)
