"""Media columns: progressive JPEG files decoded to full-resolution RGB tensors, and texts kept in such files.

Nulls: a null file gives null results; a null text is the empty text, stored as one block of zero bytes.  A file that is
not a readable progressive JPEG gives null results and the reason in ``error``.  Equal inputs give equal outputs, and rows that
repeat an id or a text are treated one by one.  Texts of any length become one file.  Other columns are not looked at,
whatever their names.  An empty table gives no rows.  Tensors are stored with ``store_tensors``.  They take two bytes for each
byte of a text (a 4:2:0 unit of 384 coefficients is 256 pixels of three colours) and do not compress, some 3.4 times the
Parquet size of the texts, so the query over all texts works its features out from each tensor in memory and stores the files.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.llm import jpeg
from seaward.llm.common import map_columns, materialize, read_table, text_or_empty

BLOCK = 64


def decode_jpeg_column(df: DataFrame, column: str = "media", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df``: the ``keys``, width, height, ``rgb`` (height x width x 3 bytes) and ``error``."""

    def run(rows):
        out = {k: rows[k] for k in keys} | {"width": [], "height": [], "rgb": [], "error": []}
        for data in rows[column]:
            got = (None, None, None, None)
            if data is not None:
                try:
                    pic = jpeg.decode(data)
                    got = (pic.width, pic.height, jpeg.to_rgb(pic).tobytes(), None)
                except (ValueError, KeyError, IndexError, AttributeError) as e:
                    got = (None, None, None, f"{type(e).__name__}: {e}")
            for name, v in zip(("width", "height", "rgb", "error"), got, strict=True):
                out[name].append(v)
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "width int, height int, rgb binary, error string"])
    return map_columns(df.select(*keys, column), run, schema, rows_at_once=16)


def store_tensors(df: DataFrame, column: str = "media", keys: tuple[str, ...] = ()) -> DataFrame:
    """``decode_jpeg_column`` written to the shared folder and read back: the full-resolution RGB tensors as a column.

    A tensor is height x width x 3 bytes, row by row.  Pictures are decoded 16 at a time, so a task holds a bounded number.
    """
    return materialize(decode_jpeg_column(df, column, keys), "tensors", codec="zstd")


def tensor_features(tensors: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The ``keys`` and ``feature`` of stored tensors: size, mean of each colour and crc32; null where there is no tensor."""

    def run(rows):
        import numpy as np

        out = []
        for width, height, raw in zip(rows["width"], rows["height"], rows["rgb"], strict=True):
            out.append(None if raw is None else feature(np.frombuffer(raw, np.uint8).reshape(height, width, 3)))
        return {k: rows[k] for k in keys} | {"feature": out}

    kinds = dict(tensors.dtypes)
    return map_columns(tensors.select(*keys, "width", "height", "rgb"), run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "feature string"]), rows_at_once=16)


def feature(rgb) -> str:
    """Size, mean of each colour and crc32 of an RGB tensor."""
    means = ",".join(f"{m:.4f}" for m in rgb.reshape(-1, 3).mean(0, dtype="float64"))
    return f"{rgb.shape[1]}x{rgb.shape[0]};{means};{zlib.crc32(rgb.tobytes()):08x}"


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and ``media`` (a progressive JPEG with the text) of each row, written to the shared folder and read back.

    The UTF-8 bytes are filled up with zero bytes to a positive multiple of 64; each byte is one quantised coefficient.
    """

    def run(rows):
        data = [t.encode() for t in rows["__text"]]
        filled = [d + bytes(-len(d) % BLOCK or (0 if d else BLOCK)) for d in data]
        return {key: rows[key], "n_bytes": [len(d) for d in data], "media": [jpeg.encode_payload(d) for d in filled]}

    source = docs.select(F.col(key), text_or_empty(text).alias("__text"))
    return materialize(map_columns(source, run, f"`{key}` {dict(docs.dtypes)[key]}, n_bytes long, media binary", rows_at_once=64), "media", codec="zstd")


def read_texts(stored: DataFrame, key: str = "doc_id", keep_media: bool = False, keep_rgb: bool = False) -> DataFrame:
    """What stored media (key, n_bytes, media) hold: payload, sizes and digests, and a feature of the decoded picture.

    ``feature`` is the picture's size, the mean of each colour and the crc32 of its full-resolution RGB tensor.  With
    ``keep_media`` and ``keep_rgb`` the file and the tensor are columns too.
    """

    def run(rows):
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        out = {key: rows[key], "n_bytes": rows["n_bytes"]} | {n: [] for n in names + ["media"] * keep_media + ["rgb"] * keep_rgb}
        for media in rows["media"]:
            pic = jpeg.decode(media)
            back, rgb = jpeg.read_payload(pic), jpeg.to_rgb(pic)
            values = [len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest()]
            values.append(feature(rgb))
            for n, v in zip(names, values, strict=True):
                out[n].append(v)
            if keep_media:
                out["media"].append(media)
            if keep_rgb:
                out["rgb"].append(rgb.tobytes())
        return out

    schema = f"`{key}` {dict(stored.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long"
    schema += ", media_bytes long, media_sha256 string, feature string"
    schema += ", media binary" * keep_media + ", rgb binary" * keep_rgb
    return map_columns(stored.select(key, "n_bytes", "media"), run, schema, rows_at_once=64)


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False, keep_rgb: bool = False) -> DataFrame:
    """Each text stored as a progressive JPEG, and what reading the stored file gives."""
    return read_texts(store_texts(docs, key, text), key, keep_media, keep_rgb)


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_progressive_jpeg": op2_progressive_jpeg}
SQL: dict[str, str] = {}
