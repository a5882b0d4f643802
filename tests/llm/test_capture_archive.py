import gzip
import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import AWKWARD

from pyspark.sql.functions import spark_partition_id

from tidemark.llm.capture_archive import full_uri, payloads, read_archive, write_archive


def records(spark, values):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(values)], "offset bigint, value string, chunk int, sha1 int")


def expected(values, least):
    newest = {}
    for i, v in enumerate(values):
        newest[v or ""] = i
    out = []
    for i, v in enumerate(values):
        body = (v or "").encode()
        target = newest[v or ""]
        again = len(body) >= least and target != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", target if again else None))
    return out


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_round_trip(spark, chunk):
    big = "é" * 5000 + "\r\n\r\nWARC/1.1\r\n"
    values = [*AWKWARD, big, "x" * 1000, "x" * 999, big, "x" * 1000, "x" * 999, *["hot" * 400] * 40]
    manifest = write_archive(records(spark, values).repartition(4), chunk_bytes=chunk)
    chunks = read_archive(manifest, chunk_bytes=chunk)
    found = sorted((r.offset, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in payloads(chunks).collect())
    assert found == expected(values, 1000)
    rows = sorted((r for r in chunks.where("record_type = 'response'").collect()), key=lambda r: (r.offset, r.chunk))
    bodies, running = {}, {}
    for r in rows:
        bodies[r.offset] = bodies.get(r.offset, b"") + bytes(r.data)
        assert r.data_bytes <= chunk and r.record_bytes == len(bodies[r.offset])
        assert r.sha1 == hashlib.sha1(bodies[r.offset]).hexdigest()
        running[r.offset] = r.last
    assert all(running.values())
    assert all(b == (values[o] or "").encode() for o, b in bodies.items())


def test_files_are_plain_warc(spark):
    manifest = write_archive(records(spark, ["hello", "world"]).coalesce(1)).collect()
    text = gzip.open("/" + manifest[0].path.lstrip("/")).read()
    assert manifest[0].records == 2 and text.count(b"WARC/1.1\r\n") == 2
    assert b"Content-Length: 5\r\n\r\nhello\r\n\r\n" in text


def test_null_offsets_repeats_and_no_records(spark):
    df = spark.createDataFrame([(None, "n" * 1200), (None, "n" * 1200), (3, "r" * 1200), (3, "r" * 1200), (2, "r" * 1200)], "offset bigint, value string")
    out = payloads(read_archive(write_archive(df))).collect()
    assert sorted((r.offset is None, r.offset or 0, r.record_type, r.refers_to) for r in out) == [
        (False, 2, "revisit", 3), (False, 3, "response", None), (False, 3, "response", None), (True, 0, "response", None), (True, 0, "response", None)
    ]
    assert payloads(read_archive(write_archive(df.limit(0)))).collect() == []


def test_a_damaged_archive_fails(spark, tmp_path):
    manifest = write_archive(records(spark, ["a" * 5000, "b" * 5000]).coalesce(1), f"file://{tmp_path}/w")
    path = Path("/" + manifest.first().path.lstrip("/"))
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"aaa", b"aab", 1)))
    with pytest.raises(Exception, match="digest differs"):
        read_archive(manifest).count()


def test_one_reader_task_for_each_archive(spark):
    wide = records(spark, [f"{i}" * 2000 for i in range(40)]).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = write_archive(wide)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = manifest.count()
    assert files > 1
    chunks = read_archive(manifest.unionByName(manifest))
    assert chunks.count() == 40
    assert chunks.rdd.getNumPartitions() == files
    assert chunks.select(spark_partition_id()).distinct().count() == files


def test_folders_without_a_scheme_lie_in_the_default_store(spark, tmp_path):
    """The manifest names the store, and the reader takes it from there."""
    manifest = write_archive(records(spark, ["a", "b"]).coalesce(1), f"{tmp_path}/plain").first()
    assert manifest.uri == f"file://{manifest.path}" and manifest.path.startswith(str(tmp_path))
    assert full_uri(spark, "hdfs-less/relative").startswith("file:///")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://apart/")
    conf.set("fs.viewfs.mounttable.apart.link./data", f"file://{tmp_path}")
    try:
        assert full_uri(spark, "/data/x") == "viewfs://apart/data/x"
    finally:
        conf.set("fs.defaultFS", before)
