"""Raw captures archived as WARC, and archives read as a chunked record table.

A capture record is ``(offset, value)``, its payload the value's UTF-8 bytes. A payload is
never held whole on the way: it is cut into rows of (record, chunk number, bytes) by a column
expression, written to the archive chunk by chunk, and read back the same way with the
SHA-1 carried from chunk to chunk. The last chunk of a record carries the digest of all.

Of records with equal payloads, from a stated size on, the one with the largest offset is
stored; the others are ``revisit`` records that name it and repeat its digest.

One task writes one gzip archive, a member for each record, under a temporary name and
renames it when it is complete, so a repeated task leaves the same file. The folder is made a
full URI by Spark's own file system configuration, the manifest keeps full URIs, and tasks open them by
their scheme with ``pyarrow.fs``: it must be a store that all executors reach.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyarrow import fs

from tidemark.session import scratch, stored

CHUNK_BYTES = 1 << 20
REVISIT_FROM = 1000
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:capture-offset:{}>"
_OFFSET = re.compile(rb"<urn:capture-offset:(-?\d+|none)>")
#: Bytes asked from a file at a time.
READ_BYTES = 1 << 20

MANIFEST = "path string, records bigint, bytes bigint, uri string"
CHUNKS = (
    "offset bigint, chunk bigint, data binary, data_bytes bigint, record_bytes bigint, sha1 string, last boolean, "
    "record_type string, refers_to bigint, header_digest string"
)
_CHUNKS_ARROW = pa.schema(
    [
        ("offset", pa.int64()),
        ("chunk", pa.int64()),
        ("data", pa.binary()),
        ("data_bytes", pa.int64()),
        ("record_bytes", pa.int64()),
        ("sha1", pa.string()),
        ("last", pa.bool_()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("header_digest", pa.string()),
    ]
)


def planned(records: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(offset, payload_bytes, sha1, refers_to) of every record; refers_to is NULL for a stored one.

    Equal payloads meet by SHA-1 and length. A NULL value is an empty payload. Copies are
    reduced to the largest offset before they meet, and only digests that occur more than
    once go back to the rows.
    """
    body = F.coalesce(F.col("value").cast("string"), F.lit("")).cast("binary")
    narrow = stored(
        records.select(F.col("offset").cast("bigint").alias("offset"), F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha1(body).alias("sha1")),
        "payload-digests",
    )
    large = narrow.where(F.col("payload_bytes") >= revisit_from)
    # An offset that is repeated with the same payload is planned once.
    narrow = narrow.distinct()
    groups = large.groupBy("sha1", "payload_bytes").agg(F.max("offset").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    at = F.col("newest")
    joined = narrow.join(groups, ["sha1", "payload_bytes"], "left")
    return joined.select("offset", "payload_bytes", "sha1", F.when(at.isNotNull() & ~F.col("offset").eqNullSafe(at), at).alias("refers_to"))


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Record rows as (offset, chunk, data, and the record's other columns); an empty payload is one empty chunk."""
    body = F.coalesce(F.col("value").cast("string"), F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / F.lit(chunk_bytes))).cast("int")
    cut = records.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.withColumn("data", F.substring(body, F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))).drop("value")


def _header(offset: int | None, kind: str, n: int, sha1: str, refers_to: int | None) -> bytes:
    name = "none" if offset is None else offset
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {RECORD_ID.format(name)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: urn:capture-offset:{name}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if kind == REVISIT:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD_ID.format(refers_to)}"]
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {n}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def full_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` with scheme and authority; one without them lies where Spark's default file system says."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", uri)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.gz"
        final = f"{root}/{name}"
        draft = f"{root}/.draft-{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        records = 0
        out = packer = None
        left = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                revisit = row["refers_to"] is not None
                if row["chunk"] == 0:
                    if left:
                        raise ValueError("a record ended before its length")
                    left = 0 if revisit else row["payload_bytes"]
                    records += 1
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    kind = REVISIT if revisit else RESPONSE
                    out.write(packer.compress(_header(row["offset"], kind, left, row["sha1"], row["refers_to"])))
                    more = left > 0
                elif revisit:
                    continue
                if not revisit:
                    data = row["data"]
                    left -= len(data)
                    out.write(packer.compress(data))
                    more = left > 0
                if not more:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            size = out.tell()
            out.close()
            store.move(draft, final)
            yield pa.RecordBatch.from_pydict({"path": [final], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64()), "uri": [f"{folder}/{name}"]})

    return write


def write_archive(records: DataFrame, folder: str | None = None, *, chunk_bytes: int = CHUNK_BYTES, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write ``records`` (offset, value) as WARC files; the manifest (path, records, bytes, uri) is returned.

    Offsets name records; a row that repeats an offset and a payload is written again. Other columns are ignored. A record without an offset is
    written under the name ``none``. ``folder`` is one that all executors reach; by default a
    new one under the shared folder. In the manifest ``path`` is the place in the store and ``uri`` names the
    store as well. No records, no file and an empty manifest.
    """
    spark = records.sparkSession
    folder = full_uri(spark, folder or scratch(spark, "warc"))
    plan = planned(records, revisit_from)
    narrow = records.select(F.col("offset").cast("bigint").alias("at"), F.col("value").cast("string").alias("value"))
    body = F.coalesce("value", F.lit("")).cast("binary")
    same = F.col("at").eqNullSafe(F.col("offset")) & (F.sha1(body) == F.col("sha1"))
    joined = narrow.join(plan, same).select("offset", "value", "payload_bytes", "sha1", "refers_to")
    # A revisit stores no payload, so none is cut into chunks.
    kept = joined.withColumn("value", F.when(F.col("refers_to").isNull(), F.col("value")))
    return stored(chunk_rows(kept, chunk_bytes).mapInArrow(_writer(folder), MANIFEST), "warc-manifest")


class _Member:
    """The decompressed bytes of a gzip file of many members, a bounded piece at a time."""

    def __init__(self, source):
        self.source, self.unzip, self.held, self.raw = source, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.unzip.eof:
                self.raw = self.unzip.unused_data + self.raw
                self.unzip = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(READ_BYTES)
                if not self.raw:
                    return False
            got = self.unzip.decompress(self.raw, READ_BYTES)
            self.raw = self.unzip.unconsumed_tail
            if got:
                self.held += got
                return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        got, self.held = self.held[:n], self.held[n:]
        return got

    def header(self) -> bytes | None:
        while b"\r\n\r\n" not in self.held:
            if not self._more():
                if self.held.strip():
                    raise ValueError("an archive ends inside a header")
                return None
        head, self.held = self.held.split(b"\r\n\r\n", 1)
        return head


def _offset_of(value: bytes | None) -> int | None:
    found = _OFFSET.search(value or b"")
    return None if not found or found[1] == b"none" else int(found[1])


def _records(source, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    stream = _Member(source)
    while (head := stream.header()) is not None:
        lines = head.lstrip(b"\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(b":", 1) for line in lines[1:])}
        left = int(fields[b"content-length"])
        kind = fields[b"warc-type"].decode()
        named = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
        running, size, chunk = hashlib.sha1(), 0, 0
        while True:
            data = stream.take(min(chunk_bytes, left))
            if left and not data:
                raise ValueError("an archive ends inside a record")
            left -= len(data)
            size += len(data)
            running.update(data)
            digest = running.hexdigest()
            if not left and kind == RESPONSE and digest != named:
                raise ValueError(f"payload digest differs: {digest}, header {named}")
            yield (_offset_of(fields[b"warc-record-id"]), chunk, data if with_data else None, len(data), size, digest, not left, kind, _offset_of(fields.get(b"warc-refers-to")), named)
            chunk += 1
            if not left:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its length")


def _reader(chunk_bytes: int, with_data: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for row in _records(source, chunk_bytes, with_data):
                        held.append(row)
                        size += row[3] if with_data else 0
                        if len(held) >= 2000 or size >= 4 * CHUNK_BYTES:
                            yield _arrow(held)
                            held, size = [], 0
                if held:
                    yield _arrow(held)

    return read


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNKS_ARROW, strict=True)], schema=_CHUNKS_ARROW)


def read_archive(manifest: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives a manifest lists (column ``uri``), one task for each file.

    Columns: offset, chunk, data (NULL unless ``with_data``), data_bytes, record_bytes and
    sha1 up to and with this chunk, last, record_type, refers_to, header_digest. Memory is
    bounded by the chunk, not by the record. A broken record or digest fails the job. A file
    that is listed twice is read once.
    """
    files = stored(manifest.select("uri").distinct(), "archive-files")
    # A manifest weighs next to nothing whatever its archives weigh, so its width must be said: Spark
    # would fold a shuffle of that size into one task. One row for each archive is numbered here.
    dealt = files.withColumn("at", (F.row_number().over(W.orderBy("uri")) - 1).cast("int"))
    return dealt.repartitionById(max(1, files.count()), F.col("at")).select("uri").mapInArrow(_reader(chunk_bytes, with_data), CHUNKS)


def payloads(chunks: DataFrame) -> DataFrame:
    """(offset, payload_bytes, payload_digest, record_type, refers_to) for each record.

    A revisit takes its length from the record it names and must agree with its digest; one
    that names a record which is not in the archive fails.
    """
    ends = stored(chunks.where("last").select("offset", "record_bytes", "sha1", "record_type", "refers_to", "header_digest"), "record-ends")
    full = ends.where(F.col("record_type") == RESPONSE)
    named = full.select(F.col("offset").alias("target"), F.col("record_bytes").alias("b"), F.col("sha1").alias("d")).distinct()
    again = ends.where(F.col("record_type") == REVISIT)
    again = again.join(named, (F.col("refers_to") == F.col("target")) & (F.col("header_digest") == F.col("d")), "left")
    bad = F.raise_error(F.concat(F.lit("revisit without its record: "), F.coalesce(F.col("offset").cast("string"), F.lit("none"))))
    size = F.when(F.col("d").isNotNull(), F.col("b")).otherwise(bad.cast("bigint"))
    first = full.select("offset", F.col("record_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")
    return first.unionByName(again.select("offset", size.alias("payload_bytes"), F.col("header_digest").alias("payload_digest"), "record_type", "refers_to"))
