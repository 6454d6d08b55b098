"""Content-addressed web archive.

Payload bytes are stored once, under their SHA-256.  The exact header block of
every record is stored beside its address.  The original records come back by
joining the two tables; what is read is hashed again and must match its address.

Everything is built of SQL functions, so no row leaves the JVM.  ``export_warc``
writes the reconstructed records as plain WARC 1.1 files and ``read_warc`` parses
such files.

Defined cases: a null payload is empty; a null target address is left out of the
header; a null id is an ordinary record that is response only if its payload has
no other id; rows that repeat an id and a payload are written once each, all as
response; empty tables give empty archives; other columns are not read.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwine.llm.common import Scratch, task

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 160 bits are eight groups of four letters."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 1 + 5 * g, 5), 16, 10).cast("int") for g in range(8)]
    letters = [F.substring(F.lit(_B32), F.shiftright(x, 15 - 5 * i).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for x in groups for i in range(4)]
    return F.concat(*letters)


def write_archive(records: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Write ``path/payloads`` (address, payload, response id) and ``path/headers`` (id, address, header)."""
    src = records.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(bytearray())).alias("payload"))
    addressed = src.withColumn("address", F.unhex(F.sha2("payload", 256)))
    store = addressed.groupBy("address").agg(F.first("payload").alias("payload"), F.min("id").alias("response_id"), F.min(F.length("payload")).alias("least"), F.max(F.length("payload")).alias("most"))
    same = F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(F.raise_error(F.lit("payloads of different length share an address")))
    store = store.select("address", same.alias("payload"), "response_id").withColumn("payload_digest", base32_sha1(F.col("payload")))
    store.write.parquet(f"{path}/payloads")
    index = records.sparkSession.read.parquet(f"{path}/payloads").select("address", "response_id", "payload_digest")
    slim = addressed.select("id", "uri", "address", F.length("payload").alias("n"))
    joined = slim.join(index, "address")
    response = F.col("id").eqNullSafe(F.col("response_id"))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_EOL)), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1" + _EOL),
        F.when(response, F.lit(f"WARC-Type: response{_EOL}")).otherwise(F.lit(f"WARC-Type: revisit{_EOL}")),
        field("WARC-Record-ID", urn(F.col("id"))),
        field("WARC-Target-URI", F.regexp_replace("uri", r"[\r\n]", "")),
        F.lit(f"WARC-Date: 1970-01-01T00:00:00Z{_EOL}"),
        F.when(response, F.lit("")).otherwise(F.concat(field("WARC-Profile", F.lit(_PROFILE)), field("WARC-Refers-To", urn(F.col("response_id"))))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.lit(f"Content-Type: text/html; charset=utf-8{_EOL}"),
        field("Content-Length", F.when(response, F.col("n")).otherwise(F.lit(0))),
        F.lit(_EOL),
    )
    joined.select("id", "address", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def _verified(store: DataFrame) -> DataFrame:
    ok = F.unhex(F.sha2("payload", 256)) == F.col("address")
    return store.select("address", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its address"))).alias("payload"))


def read_records(spark, path: str) -> DataFrame:
    """Per record: id, type, refers_to, header, digest named in the header, and from the verified payload its length and digest."""
    store = _verified(spark.read.parquet(f"{path}/payloads")).select("address", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    text = F.col("header").cast("string")
    get = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    heads = spark.read.parquet(f"{path}/headers").select(
        "id", "address", "header", get(r"\r\nWARC-Type: (\w+)\r\n").alias("record_type"), get(r"\r\nWARC-Refers-To: <urn:record:(-?\d+)>\r\n").cast("long").alias("refers_to"), get(r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]{32})\r\n").alias("named")
    )
    out = heads.join(store, "address")
    digest = F.when(F.col("named") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload name different digests")))
    return out.select("id", "record_type", "refers_to", "header", "payload_bytes", digest.alias("payload_digest"))


def reconstruct(spark, path: str) -> DataFrame:
    """The original records: ``id``, ``payload`` in full, and ``record`` as its WARC bytes (a revisit has no block)."""
    heads = spark.read.parquet(f"{path}/headers")
    joined = heads.join(_verified(spark.read.parquet(f"{path}/payloads")), "address")
    block = F.when(F.col("header").cast("string").contains("\r\nWARC-Type: response\r\n"), F.col("payload")).otherwise(F.lit(bytearray()))
    return joined.select("id", "payload", F.concat(F.col("header"), block).alias("record"))


def export_warc(spark, path: str, out: str, records_per_file: int = 50_000) -> None:
    """Write gzip WARC files; the text writer stores bytes as they are and ends each record by an empty line."""
    rows = reconstruct(spark, path).select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", _EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = gzip.decompress(blob) if blob[:2] == b"\x1f\x8b" else blob
            at, rows = 0, []
            while data.startswith(b"WARC/", at):
                end = data.index(b"\r\n\r\n", at) + 4
                head = data[at:end]
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if k}
                size = int(fields.get(b"content-length", b"0"))
                rows.append((name, at, fields.get(b"warc-type", b"").decode(), fields.get(b"warc-record-id", b"").decode(), head, data[end : end + size]))
                at = end + size + 4
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["file", "offset", "record_type", "record_id", "header", "block"])


def read_warc(spark, path: str) -> DataFrame:
    """Records of WARC files (plain or gzip): file, offset, type, id, exact header, block."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(task(_parse), "file string, offset long, record_type string, record_id string, header binary, block binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the scratch folder and read every record back."""
    spark = pages.sparkSession
    base = Scratch(spark, "warc").path("archive")
    write_archive(pages, base)
    return read_records(spark, base).select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
