import base64
import hashlib
import io
import zlib

import pytest

from pyspark.sql import functions as F

from tessera.llm import common, warc
from tests.conftest import SF


def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.mark.parametrize("number", [0, 1, -1, 2**63 - 1, -(2**63), 123456789, None])
def test_record_ids_read_back(number):
    assert warc.record_number(f"<{warc.record_urn(number)}>") == number


def test_damaged_archives_are_errors():
    good = warc.record(1, "http://a/", b"abc", warc.base32_sha1(b"abc"), 3, None, False, "1970-01-01T00:00:00Z")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = pack.compress(good) + pack.flush()
    assert [r["payload"] for r in warc.records(io.BytesIO(data + data))] == [b"abc"] * 2
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-12])))
    with pytest.raises(ValueError):
        warc._parse(good.replace(b"abc", b"abd"))


def test_edge_rows(spark):
    rows = [(1, "u", "same", "x"), (5, "u\r\nv", "same", "x"), (5, "u", "same", "x"), (2, None, None, None), (3, " ", "", None), (None, "n", "lone", None), (7, "http://a/%41", "é" * 50000, None), (None, "n", "same", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.round_trip(df).collect()
    assert sorted((str(r.record_id), str(r.url)) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows)
    by = {(r.record_id, r.url): r for r in got}
    assert (by[1, "u"].record_type, by[1, "u"].refers_to, by[1, "u"].payload_bytes, by[1, "u"].payload_digest) == ("revisit", 5, 4, b32("same"))
    assert by[5, "u"].record_type == by[5, "u\r\nv"].record_type == by[3, " "].record_type == "response"
    assert (by[2, None].record_type, by[2, None].refers_to, by[2, None].payload_bytes) == ("revisit", 3, 0)
    assert bytes(by[7, "http://a/%41"].payload).decode() == "é" * 50000
    assert {r.record_type for r in got if r.record_id is None} == {"response", "revisit"}
    assert {r.record_type for r in warc.round_trip(df, least_bytes=5).collect()} == {"response"}
    assert warc.round_trip(df.where("false")).count() == 0
    named = df.withColumn("__original", F.lit(1)).withColumn("__sha1", F.lit("x")).withColumn("id", F.lit(9)).withColumn("key", F.lit(2))
    assert sorted(map(str, warc.round_trip(named).collect())) == sorted(map(str, got))


def test_rows_that_the_map_takes_for_revisits_are_written_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "MARK_BITS", 7)
    monkeypatch.setattr(common, "MOST_MARK_BITS", 7)
    rows = [(i, "u", f"payload {i % 150 if i < 300 else i}") for i in range(600)]
    got = {r.record_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 600
    for i, _, h in rows:
        assert got[i].record_type == ("revisit" if i < 150 else "response") and (i < 150 or bytes(got[i].payload).decode() == h)
        assert got[i].refers_to == (i + 150 if i < 150 else None)


def test_archives_begin_with_their_own_record():
    data = b"".join(zlib.compress(x, 1, 31) for x in (warc.info("a.warc.gz", "2020-01-01T00:00:00Z"), warc.record(1, None, b"x", warc.base32_sha1(b"x"), 1, None, False, "2020-01-01T00:00:00Z")))
    assert [r["record_id"] for r in warc.records(io.BytesIO(data))] == [1]
    revisit = warc.record(1, "a", b"", warc.base32_sha1(b"x"), 1, 2, True, "2020-01-01T00:00:00Z", "http://b/").decode()
    assert "WARC-Refers-To-Target-URI: http://b/" in revisit and "WARC-Refers-To-Date: 2020-01-01T00:00:00Z" in revisit


def test_query_against_brute_force(spark):
    from tessera.llm.queries import op7_warc

    pages = [(r.page_id, r.html or "") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    last = {}
    for i, h in pages:
        last[h] = max(i, last.get(h, i))
    want = {(i, len(h.encode()), b32(h), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in pages}
    assert {tuple(r) for r in op7_warc(spark, SF).collect()} == want
