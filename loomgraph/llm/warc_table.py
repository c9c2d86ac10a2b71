"""WARC archives by a chunked record table.

A record is rows of (record id, chunk number), each with a bounded part of the
payload, on the way into an archive and out of it. Writers and readers hold one
chunk at a time and carry the digest along; no record is put together in memory.
Archives are gzipped WARC 1.1, a member for each record.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.shared import shared_dir, written

CHUNK = 1 << 16
REVISIT_BYTES = 100
#: Fixed value of the published format: a revisit whose payload equals another record's.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(where: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(where)


def chunk_table(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Rows ``(page_id, url, size, digest, record_type, refers_to, number, last, data)`` of every page, a record's together and in order. Revisits have one row without data."""
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha2("payload", 256))
    first = base.where(F.col("size") >= REVISIT_BYTES).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    told = base.join(first, F.col("digest") == F.col("_digest"), "left").withColumn("refers_to", F.expr("CASE WHEN first IS NOT NULL AND NOT page_id <=> first THEN first END"))
    told = told.withColumn("record_type", F.expr("CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END"))
    told = told.withColumn("chunks", F.expr(f"CASE WHEN refers_to IS NULL THEN greatest(1, cast(ceil(size / {chunk}) AS int)) ELSE 1 END"))
    rows = told.select("page_id", "url", "size", "digest", "record_type", "refers_to", "chunks", F.expr("CASE WHEN refers_to IS NULL THEN payload ELSE x'' END").alias("payload"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("number"))
    return rows.select("page_id", "url", "size", "digest", "record_type", "refers_to", "number", F.expr("number = chunks - 1").alias("last"), F.expr(f"substring(payload, number * {chunk} + 1, {chunk})").alias("data"))


def _head(row: dict) -> bytes:
    """The WARC header and, for a response, the HTTP header before its payload."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "urn:unknown")
    http = b"" if row["record_type"] == "revisit" else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:page:{row['page_id']}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{row['digest']}")]
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"), ("X-Payload-Length", str(row["size"])), ("Content-Length", "0")]
    else:
        fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + row["size"]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def write_archives(chunks: DataFrame, where: str, *, level: int = 3) -> DataFrame:
    """Writes a chunk table as archives under ``where``, one a task; ``(file, records)``. A task that runs again replaces its file whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(where)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, out, records, zipped = f"{folder}/.{uuid.uuid4().hex}", None, 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                out = out or store.open_output_stream(draft, compression=None)
                if row["number"] == 0:
                    zipped = zlib.compressobj(level, wbits=31)
                    out.write(zipped.compress(_head(row)))
                out.write(zipped.compress(row["data"]))
                if row["last"]:
                    out.write(zipped.compress(b"\r\n\r\n") + zipped.flush())
                    records += 1
        if out:
            out.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(name)]), pa.array([records], pa.int64())], names=["file", "records"])

    return written(chunks.mapInArrow(write, "file string, records bigint"))[0]


class _Plain:
    """Decompressed bytes of an archive, a bounded part at a time."""

    def __init__(self, raw, step: int):
        self.raw, self.step, self.held, self.zipped, self.rest = raw, step, b"", zlib.decompressobj(wbits=31), b""

    def _more(self) -> bool:
        if self.zipped.eof:
            self.rest, self.zipped = self.zipped.unused_data, zlib.decompressobj(wbits=31)
        if not self.rest:
            self.rest = self.raw.read(self.step)
            if not self.rest:
                return False
        self.held += self.zipped.decompress(self.rest, self.step)
        self.rest = self.zipped.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is passed over; None at the end."""
        while mark not in self.held:
            if not self._more():
                return None
        out, _, self.held = self.held.partition(mark)
        return out

    def take(self, most: int) -> bytes:
        while not self.held and self._more():
            pass
        out, self.held = self.held[:most], self.held[most:]
        return out


def read_chunks(spark: SparkSession, files: DataFrame, where: str, *, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunk table of archives: ``(page_id, url, record_type, refers_to, number, last, size, digest, data)``.

    ``size`` and ``digest`` are of the payload up to and with this chunk; the last
    chunk's are the record's. A revisit's are those its header names. With
    ``data=False`` only last rows come, without bytes.
    """
    names = ["page_id", "url", "record_type", "refers_to", "number", "last", "size", "digest", "data"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def number_in(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def rows_of(plain: _Plain) -> Iterator[tuple]:
        while (head := plain.until(b"\r\n\r\n")) is not None:
            field = dict(x.split(": ", 1) for x in head.decode().split("\r\n") if ": " in x)
            own = (number_in(field["WARC-Record-ID"]), field["WARC-Target-URI"], field["WARC-Type"], number_in(field.get("WARC-Refers-To")))
            left = int(field["Content-Length"])
            if field["WARC-Type"] == "revisit":
                yield (*own, 0, True, int(field["X-Payload-Length"]), field["WARC-Payload-Digest"].partition(":")[2], b"")
            else:
                left -= len(plain.until(b"\r\n\r\n") or b"") + 4
                digest, size, n = hashlib.sha256(), 0, 0
                while True:
                    part = b""
                    while left and len(part) < chunk:
                        got = plain.take(min(left, chunk - len(part)))
                        if not got:
                            raise ValueError("an archive ends inside a record")
                        part, left = part + got, left - len(got)
                    digest.update(part)
                    size += len(part)
                    if data or not left:
                        yield (*own, n, not left, size, digest.hexdigest(), part if data else b"")
                    n += 1
                    if not left:
                        break
                if digest.hexdigest() != field["WARC-Payload-Digest"].partition(":")[2]:
                    raise ValueError("a payload doesn't have its record's digest")
            plain.until(b"\r\n\r\n")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(where)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_stream(f"{folder}/{file}", compression=None) as raw:
                    held: list[tuple] = []
                    for row in rows_of(_Plain(raw, chunk)):
                        held.append(row)
                        if len(held) >= (64 if data else 4096):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names=names)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names=names)

    schema = "page_id bigint, url string, record_type string, refers_to bigint, number bigint, last boolean, size bigint, digest string, data binary"
    return files.select("file").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Writes every page as a record and reads the archives back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Null html is an empty payload, always a response. Of equal payloads of 100
    bytes or more that of the smallest id is the response (rows that share that id
    are all responses), the others revisits. A null id is written and comes back as null.
    """
    spark = pages.sparkSession
    where = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    files = write_archives(chunk_table(pages, id_col=id_col, url_col=url_col, html_col=html_col, chunk=chunk), where)
    last = read_chunks(spark, files, where, chunk=chunk, data=False).where("last")
    return last.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
