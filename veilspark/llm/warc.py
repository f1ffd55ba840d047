"""Web archives: records written as whole-file gzip streams, and a normaliser that gives every record a member of its own.

Writing: each record is one row of Spark's text sink, whose line separator is the blank lines that end a record; with gzip, a task's file is
one monolithic stream. Records with equal payloads (of at least LEAST_REVISIT bytes) refer to the one with the smallest id instead of
repeating it: a revisit keeps the headers, so the full length and digest of its payload.

Normalising: each file is inflated once, as a stream; every record is written again as its own gzip member of a new archive, and a row of
the sidecar index tells archive, offset and length, so any record can be read alone. An archive is written under a name of its attempt
and renamed when it is whole, so a task that runs again replaces it by the same bytes.

Which record refers to which is found from ids and digests alone; payloads go with their rows, unless there are more revisits than may be
broadcast (then rows are joined by their ids).

Null payloads are empty, null URLs empty; control characters of a URL are escaped. Rows with a null id are responses, or revisits of
the smallest id. Rows that repeat the smallest id with the same payload are all responses.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bounded_batches, materialise, shared_dir

#: Payloads below this size are always responses.
LEAST_REVISIT = 100
#: Uncompressed bytes of an archive, about.
ARCHIVE_BYTES = 64 << 20
#: Bytes inflated at once, and bytes of members that are written at once.
CHUNK, WRITTEN = 1 << 18, 4 << 20
#: Revisits (id and digest, about 120 bytes each) are broadcast up to so many.
BROADCAST_REVISITS = 200_000
_BREAK = b"\r\n\r\n"
# The record's format and media types.
VERSION, CONTENT_TYPE, DATE = "WARC/1.1", "application/http;msgtype=response", "2000-01-01T00:00:00Z"


def planned(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """_id, _url, _payload, _digest, _size and _refers (null for responses)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "%20"), F.lit("")).alias("_url"), payload.alias("_payload"), F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).cast("long").alias("_size"))
    large = rows.filter(F.col("_size") >= LEAST_REVISIT).select("_id", "_digest")
    groups = large.groupBy("_digest").agg(F.min("_id").alias("_refers"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    revisits = large.join(groups, "_digest").filter(~F.col("_id").eqNullSafe(F.col("_refers"))).select(F.col("_id").alias("_copy"), F.col("_digest").alias("_same"), "_refers").distinct()
    revisits = materialise(revisits, "revisits")
    few = revisits.count() <= BROADCAST_REVISITS
    return rows.join(F.broadcast(revisits) if few else revisits, F.col("_id").eqNullSafe(F.col("_copy")) & (F.col("_digest") == F.col("_same")), "left").drop("_copy", "_same")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes monolithic archives into a folder."""
    mean = pages.agg(F.avg(F.octet_length(payload_col))).first()[0] or 0
    rows = planned(pages, id_col, url_col, payload_col)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_size").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("_refers").isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("_payload")))
    name = lambda c: F.concat(F.lit("<urn:x-record:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("_id")), F.lit("\r\nWARC-Target-URI: "), F.col("_url"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:"), F.col("_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("_refers")))).otherwise(F.lit("")),
        F.lit(f"\r\nContent-Type: {CONTENT_TYPE}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    per_file = max(1, int(ARCHIVE_BYTES / (mean + 600)))
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and the whole bytes of each record in an uncompressed stream."""
    held = bytearray()

    def more() -> bool:
        part = next(stream, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while True:
        while (end := held.find(_BREAK)) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a header")
                return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record doesn't begin where one should")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = end + len(_BREAK) + int(headers["content-length"]) + len(_BREAK)
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield headers, bytes(held[:size])
        del held[:size]


def inflated(data: bytes) -> Iterator[bytes]:
    """A gzip file's bytes in bounded chunks, over all of its members."""
    engine = zlib.decompressobj(31)
    while data:
        part = engine.decompress(data, CHUNK)
        if part:
            yield part
        if engine.eof:
            data = engine.unused_data
            engine = zlib.decompressobj(31)
        elif not (data := engine.unconsumed_tail) and not part:
            raise ValueError("the gzip stream ends early")
    while not engine.eof and (part := engine.flush(CHUNK)):
        yield part


def member(record: bytes) -> bytes:
    return gzip.compress(record, 4, mtime=0)


INDEX = "archive string, offset long, length long, record_id string, record_type string"


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Writes each binary file (path, content) again as an archive of single members in a folder, and gives the index: a row for each record."""
    bounded_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["archive", "offset", "length", "record_id", "record_type"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        store, top = filesystem(folder)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name, offset, rows = normalised_name(path.as_py()), 0, []
                attempt = f"{top}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(attempt) as out:
                    held = bytearray()
                    for headers, record in records(inflated(content.as_py())):
                        data = member(record)
                        held += data
                        rows.append((name, offset, len(data), headers["warc-record-id"], headers["warc-type"]))
                        offset += len(data)
                        if len(held) >= WRITTEN:
                            out.write(bytes(held))
                            held.clear()
                    out.write(bytes(held))
                store.move(attempt, f"{top}/{name}")
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + 10_000]], t) for c, t in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, INDEX)


def normalised_name(path: str) -> str:
    return path.rpartition("/")[2].removesuffix(".gz").removesuffix(".txt") + ".warc.gz"


def filesystem(folder: str):
    """The file system of a folder that all machines share, and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads each record of an index from its archive, by offset and length alone: record_id, record_type, refers_to, payload_bytes, payload_digest; raises if a response isn't what its digest says."""
    bounded_batches(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(folder)
        opened, source = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if name != opened:
                    if source is not None:
                        source.close()
                    opened, source = name, store.open_input_file(f"{top}/{name}")
                ((headers, record),) = records(iter([gzip.decompress(source.read_at(length, offset))]))
                rows.append(_payload_of(headers, record))
            names = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        if source is not None:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(run, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string")


def _payload_of(headers: dict[str, str], record: bytes) -> tuple:
    block = record[record.index(_BREAK) + 4 : -4]
    http, _, payload = block.partition(_BREAK)
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['warc-record-id']} isn't what its digest says")
    return headers["warc-record-id"], headers["warc-type"], headers.get("warc-refers-to"), size, digest


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes monolithic archives, and normalises them: the index, as read back from the sidecar, and the folder of the normalised archives."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, f"{folder}/streams", id_col, url_col, payload_col)
    store, top = filesystem(f"{folder}/archives")
    store.create_dir(top)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{folder}/streams")
    normalise(files, f"{folder}/archives").write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index"), f"{folder}/archives"
