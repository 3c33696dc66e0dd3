"""WARC archives compressed with a Zstandard dictionary that each archive carries itself.

Writer.  Pages with equal payloads are found by digest: the smallest page_id is the response, the others become revisit
records that refer to it.  Each task collects records up to a bounded size, trains a dictionary on them, and writes an
archive: a skippable frame with the dictionary, then one frame for each record.  Archives are rows of a table (name,
number of records, content), written by Spark to the shared folder, so that a lost task is simply run again.

Reader.  The dictionary is taken from the leading frame, the records are decompressed and parsed, and each response's
payload is held against its digest.

Null payloads are empty.  Rows that repeat a page_id with the same payload have the same type.  A null page_id is never
the smallest, unless its payload has no other.  A payload of any length is one record, and one beyond an archive's size has an
archive of its own.  Other columns are not looked at, whatever their names.  An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.llm.common import arrow_schema, materialize, read_table

#: Uncompressed bytes of records after which an archive is closed, bytes of its dictionary, bytes to train it on.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAIN_BYTES = 8 << 20, 32 << 10, 2 << 20
#: Fixed values of the format: magic numbers of the dictionary's skippable frame and of a trained dictionary.
SKIPPABLE_MAGIC, TRAINED_MAGIC = 0x184D2A5D, 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
_DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or (``refers_to`` given) a revisit with the response's head only."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    head += [f"WARC-Date: {_DATE}", f"WARC-Target-URI: {quote(url or '', safe=';/?:@&=+$,#%')}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    else:
        body += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + _END + body + _END


def build_archive(records: list[bytes]) -> bytes:
    """Dictionary frame, then one compressed frame for each record."""
    import zstandard

    size = sum(map(len, records))
    step = max(1, -(-size // TRAIN_BYTES))  # evenly spread training records
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, records[::step])
    except (zstandard.ZstdError, ValueError):  # too few records to train on: their beginning serves as it is
        trained = zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words = trained.as_bytes()
    pack = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True).compress
    return struct.pack("<II", SKIPPABLE_MAGIC, len(words)) + words + b"".join(map(pack, records))


def read_archive(content: bytes):
    """(type, page_id, url, digest, payload length, payload or None, refers_to) of each record, in order."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    words = content[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if words[:4] == struct.pack("<I", TRAINED_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    source = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=kind)).stream_reader(
        memoryview(content)[8 + size :], read_across_frames=True
    )
    data, at = source.read(), 0
    number = lambda v: int(v[10:-1]) if v and v[10:-1] else None
    while at < len(data):
        end = data.index(_END, at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        cut = data.index(_END, start) + 4
        http = dict(line.split(": ", 1) for line in data[start : cut - 4].decode().split("\r\n")[1:])
        digest, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
        if fields["WARC-Type"] == "response":
            payload = data[cut:stop]
            if digest32(payload) != digest or len(payload) != int(http["Content-Length"]):
                raise ValueError(f"payload and digest differ in record {fields['WARC-Record-ID']}")
        yield (fields["WARC-Type"], number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], digest, int(http["Content-Length"]), payload, number(fields.get("WARC-Refers-To")))
        at = stop + 4


#: Payloads that come again, of which the list is sent to all tasks: some 100 bytes each.
FEW = 500_000


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and ``refers_to``: for a page whose payload a smaller page_id has, that page_id.

    Digests and ids are grouped, and those of payloads that come again are written.  While they are at most ``FEW`` they go to
    the pages by broadcast, so that no payload moves, however many pages share one; beyond that the pages meet them in a
    shuffle, whose skewed parts Spark splits.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    shared = rows.filter(F.length("payload") >= LEAST_BYTES).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = materialize(shared.filter("n > 1 AND first IS NOT NULL").drop("n"), "warc-again")
    joined = rows.join(F.broadcast(again) if again.limit(FEW + 1).count() <= FEW else again, "sha", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives of all pages (page_id, url, html) as a table in the shared folder: archive, records, content."""
    kind, arrow = arrow_schema("archive string, records int, content binary")

    def run(batches):
        import pyarrow as pa

        part, made, records, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal made, records, size
            out = pa.RecordBatch.from_pylist([{"archive": f"pages-{part:06d}-{made:06d}.warc.zst", "records": len(records), "content": build_archive(records)}], schema=arrow)
            made, records, size = made + 1, [], 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cut = batch.slice(at, 64)
                for row in zip(*(c.to_pylist() for c in cut.columns), strict=True):
                    records.append(record(*row))
                    size += len(records[-1])
                    if size >= ARCHIVE_BYTES:
                        yield flush()
        if records:
            yield flush()

    return materialize(mark_revisits(pages).mapInArrow(run, kind), "warc", compressed=True)


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """A row for each record of the archives; with ``keep_payload`` its payload too (null for revisits)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    kind, arrow = arrow_schema(schema + ", payload binary" * keep_payload)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                rows = []
                for kind_, page, url, digest, n, payload, refers in read_archive(content.as_buffer().to_pybytes()):
                    rows.append((page, n, digest, kind_, refers, url, *([payload] if keep_payload else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return archives.select("content").mapInArrow(run, kind)


def op10_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(read_table(spark, sf_dir, "pages"))).drop("url")


_BASE32 = " || ".join(
    f"translate(lpad(to_base(CAST('0x' || substr(h, {1 + 10 * i}, 10) AS BIGINT), 32), 8, '0'), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    for i in range(4)
)
QUERIES = {"op10_warc_dictionary": op10_warc_dictionary}
SQL = {
    "op10_warc_dictionary": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)"""
}
