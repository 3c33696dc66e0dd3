"""Small helpers shared by the operators: reading tables, shared scratch tables, text defaults."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seaward.sources.tables import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str, compressed: bool = False, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor later costs a re-read of a file, not the work before it.  Tables of large values
    that are ``compressed`` already are stored as they are: a codec would only hold more buffers.  The tables are needed
    until the result is written, and stay in ``spark.checkpoint.dir`` for the job's owner to clear, like checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", "uncompressed" if compressed else codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows, about, that Spark sends to a Python worker at once (both sides hold as much), and rows of a Parquet file that
#: a task decodes at once (their texts lie in one array).  Neither changes a result.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def small_batches(spark: SparkSession) -> None:
    """Settings of this session for long jobs of many steps, whose executors and workers keep what their largest step took."""
    for name, value in SMALL_BATCHES.items():
        spark.conf.set(name, value)


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system; a reused worker would keep it."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)  # glibc has it


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Rows of one key from which it is hot, hot keys at most (by the share of all rows that makes one), tasks for each.
HOT_ROWS, HOT_KEYS, HOT_PARTS = 50_000, 1000, 16


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys with more than ``HOT_ROWS`` rows, and more than one in ``HOT_KEYS`` of all: at most ``HOT_KEYS``, written."""
    (n,) = free_names(rows, "__n")
    most = max(HOT_ROWS, rows.count() // HOT_KEYS)
    return materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > most).select(key), "hot-keys")


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame | None = None) -> DataFrame:
    """Inner join of ``left`` with ``right`` (a row for each key), where one key may hold much of ``left``.

    The ``hot_keys`` of ``left`` are broadcast: their rows are dealt to ``HOT_PARTS`` parts by a hash of ``spread``, and their row
    of ``right`` goes to each part.
    """
    mark, part = free_names(left, "__hot", "__part")
    found = F.broadcast((hot_keys(left, key) if hot is None else hot).select(key, F.lit(True).alias(mark)))  # HOT_KEYS rows at most
    dealt = left.join(found, key, "left").withColumn(part, F.when(F.col(mark), F.pmod(F.xxhash64(spread), F.lit(HOT_PARTS)).cast("int")).otherwise(0)).drop(mark)
    parts = F.when(F.col(mark), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.join(found, key, "left").withColumn(part, F.explode(parts)).drop(mark), [key, part]).drop(part)


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id written as decimal text, modulo ``modulus`` (null ids count as fold of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def arrow_schema(schema: str) -> tuple[T.StructType, pa.Schema]:
    """Spark's and Arrow's form of a schema given as DDL."""
    kind = T._parse_datatype_string(schema)
    return kind, to_arrow_schema(kind)


def map_columns(df: DataFrame, fn, schema, rows_at_once: int = 256) -> DataFrame:
    """Apply ``fn`` to short runs of rows, as dicts of Python lists, partition by partition (no shuffle).

    ``fn`` gets and returns ``{column: list}``; it never sees more than ``rows_at_once`` rows, so that the Python side
    holds a bounded number of texts.  ``schema`` is the result's Spark schema (DDL).
    """
    kind, arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                out = fn(batch.slice(at, rows_at_once).to_pydict())
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        give_back()

    return df.mapInArrow(run, kind)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int, label: str) -> DataFrame:
    """Texts of a bounded sample of labelled rows, written to the shared folder: text, label, shape, shape2.

    Of each label (0 or 1; others and nulls are passed over) the ``most`` ids with the smallest hash.  The ids are at
    most twice ``most``, so they are broadcast.  ``shape`` and ``shape2`` are the smallest hashes of the text's word
    triples under two seeds: copies share them, near copies mostly do.
    """
    marked = labels.filter(F.col(key).isNotNull()).select(key, F.col("label").cast("int"), F.xxhash64(F.col(key), F.lit(7)).alias("__h"))
    ids = [marked.filter(F.col("label") == v).distinct().orderBy("__h", key).limit(most) for v in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]).drop("__h"))
    rows = docs.select(F.col(key), text_or_empty(text).alias("text")).join(chosen, key)

    def shapes(batch):
        found = [_shapes(t) for t in batch["text"]]
        return {"text": batch["text"], "label": batch["label"], "shape": [a for a, _ in found], "shape2": [b for _, b in found]}

    return materialize(map_columns(rows.select("text", "label"), shapes, "text string, label int, shape long, shape2 long"), label)


def once_by(sample: DataFrame, shape: str) -> DataFrame:
    """Of the rows (text, label, ...) of one label and shape the one whose text has the smallest hash, whatever the order."""
    others = [c for c in sample.columns if c not in ("label", shape)]
    least = F.min_by(F.struct(*others), F.struct(F.xxhash64("text"), F.length("text"))).alias("row")
    return sample.groupBy("label", shape).agg(least).select("label", shape, "row.*")


def _shapes(text: str) -> tuple[int, int]:
    words = text.lower().split()
    triples = {hash_text(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))}
    return min(triples), min((t * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 61) for t in triples)


def hash_text(text: str, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode(), seed) >> 1
