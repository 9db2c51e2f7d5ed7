import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from mergescope.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def test_round_trip_and_revisits(spark):
    big = "é<p>" * 300_000
    rows = [(5, "http://a/ b\r\nX: y", "same", "x"), (3, None, "same", "x"), (9, "u", "same", "x"), (7, "u", None, "x"), (8, "u", "", "x"),
            (1, "u", big, "x"), (2, "u", "\r\n\r\nWARC/1.1", "x"), (None, "u", "same", "x"), (3, None, "same", "x"), (None, "n", "lonely", "x")]
    manifest = warc.write_archives(pages(spark, rows))
    got = warc.read_archives(manifest, payloads=True).collect()
    assert all(r.verified for r in got)
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (str(i), "revisit" if ref is not None else "response", ref, len((h or "").encode()), warc.digest((h or "").encode()))
        for (i, _, h, _), ref in zip(rows, [3, None, 3, None, 7, None, None, 3, None, None]))
    assert {r.payload.decode() for r in got if r.record_type == "response"} == {"same", "", big, "\r\n\r\nWARC/1.1", "lonely"}
    small = warc.read_archives(warc.write_archives(pages(spark, rows), least=5)).collect()
    assert all(r.record_type == "response" for r in small)
    assert warc.read_archives(warc.write_archives(pages(spark, []))).collect() == []


def test_reader_on_damaged_and_foreign_archives():
    rng = random.Random(1)
    parts = [warc.record(i, "u", rng.randbytes(rng.randrange(200_000)), None) for i in range(4)]
    whole = b"".join(parts)
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(whole))] == [0, 1, 2, 3]
    assert b"".join(gzip.decompress(whole).split(b"WARC/1.1")[:1]) == b""
    cut = list(warc.read_records(io.BytesIO(whole[:-30])))
    assert [r["verified"] for r in cut] == [True, True, True, False]
    raw = bytearray(gzip.decompress(parts[1]))
    raw[-10] ^= 1
    changed = list(warc.read_records(io.BytesIO(parts[0] + gzip.compress(bytes(raw)) + parts[2])))
    assert [r["verified"] for r in changed] == [True, False, True]
    assert [r["verified"] for r in warc.read_records(io.BytesIO(parts[0] + b"junk"))] == [True, False]


def test_long_heads_lose_no_neighbour():
    url = "data:text/html;base64," + "".join(random.Random(2).choices("abcdefghijklmnop0123456789", k=3 << 20))
    parts = [warc.record(1, "u", b"one", None), warc.record(2, url, b"two", None), warc.record(3, "u", b"three", None)]
    got = list(warc.read_records(io.BytesIO(b"".join(parts)), payloads=True))
    assert [(r["page_id"], r["payload"], r["verified"]) for r in got] == [(1, b"one", True), (2, b"two", True), (3, b"three", True)]
    assert got[1]["url"] == url


def test_lost_records_raise(spark, tmp_path):
    rows = [(i, "u", f"page {i}", "x") for i in range(6)]
    manifest = warc.write_archives(pages(spark, rows).coalesce(1))
    assert warc.read_archives(manifest, strict=True).count() == 6
    with pytest.raises(Exception, match="gives"):
        warc.read_archives(manifest.withColumn("n_records", F.col("n_records") + 1)).collect()
    bad = warc.record(1, "u", b"one", None), warc.record(2, "u", b"two", None)[:-12]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(bad))
    damaged = spark.createDataFrame([(f"{tmp_path}/a.warc.gz", 2, f"file://{tmp_path}")], "path string, n_records long, folder string")
    assert [r.verified for r in warc.read_archives(damaged).collect()] == [True, False]
    with pytest.raises(Exception, match="not verified"):
        warc.read_archives(damaged, strict=True).collect()
