import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from newsweave.llm import archives as ar
from newsweave.llm import queries
from newsweave.session import scratch_path


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_arc_by_declared_lengths(version, packed):
    payloads = [b"", b"plain", b"http://x.example 1.1.1.1 20200101000000 text/html 5\nnot a header", b"\n\n\r\n", bytes(range(256)), "é 日".encode()]
    urls = ["http://a.example/x y", "", "http://b.example/é", "ftp://c.example/", "http://d.example/?q=1#f", "dns:e.example"]
    parts = [ar.arc_head("a.arc", version), *(ar.arc_record(version, u, p, "20240229120000", "text/html; charset=utf-8") for u, p in zip(urls, payloads))]
    data = b"".join(gzip.compress(p) for p in parts) if packed else b"".join(parts)
    found = list(ar.arc_records(data))
    assert [p for _, p in found] == payloads
    assert [h["Content-type"] for h, _ in found] == ["text/html; charset=utf-8"] * 6
    assert found[0][0]["URL"] == "http://a.example/x%20y" and found[1][0]["URL"] == "-"
    made = [ar.converted(h, p) for h, p in found]
    assert {m["date"] for m in made} == {"2024-02-29T12:00:00Z"}
    assert [m["record_type"] for m in made] == ["response", "response", "response", "resource", "response", "resource"]
    assert [m["payload_digest"] for m in made] == [hashlib.sha1(p).hexdigest() for p in payloads]
    assert len({m["record_id"] for m in made}) == 6 and made == [ar.converted(h, p) for h, p in ar.arc_records(data)]


def test_dates():
    assert ar.iso_date("2019") == "2019-01-01T00:00:00Z"
    assert ar.iso_date("201902031") .startswith("2019-02-03T1")
    assert ar.iso_date("") == ar.iso_date("x" * 14) == "1970-01-01T00:00:00Z"


def test_damaged_archives(spark):
    good = ar.arc_head("a.arc", 1) + ar.arc_record(1, "http://a.example/", b"one") + ar.arc_record(1, "http://a.example/2", b"two")
    rows = [("cut", bytearray(good[:-3])), ("none", None), ("empty", bytearray()), ("noise", bytearray(b"\x00\xff no archive")), ("gz", bytearray(gzip.compress(good)[:-9]))]
    got = ar.arc_table(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sorted(r["error"] is None for r in got if r["source"] == "cut") == [False, True]
    assert all(r["error"] for r in got if r["source"] in ("noise",))
    assert ar.warc_table(spark.createDataFrame([("x", bytearray(b"WARC/1.1\r\nbroken"))], "path string, content binary")).first()["error"]


def broken(parts, at, how):
    """Gzip members with one of them damaged."""
    packed = [gzip.compress(p, mtime=0) for p in parts]
    if how == "flip":
        packed[at] = packed[at][:len(packed[at]) // 2] + bytes([packed[at][len(packed[at]) // 2] ^ 0xFF]) + packed[at][len(packed[at]) // 2 + 1:]
    elif how == "cut":
        packed[at] = packed[at][:-9]
    elif how == "noise":
        packed.insert(at, b"between members \x1f\x8b\x08 nothing")
    elif how == "header":
        packed[at] = gzip.compress(b"no header at all\n", mtime=0)
    return b"".join(packed)


@pytest.mark.parametrize("how, lost", [("flip", 1), ("cut", 1), ("noise", 0), ("header", 1)])
def test_reading_goes_on_behind_damage(spark, how, lost):
    records = [ar.arc_record(1, f"http://a.example/{i}", f"payload {i} ".encode() * 50) for i in range(6)]
    data = broken([ar.arc_head("a.arc", 1), *records], 3, how)
    rows = spark.createDataFrame([("x", bytearray(data)), ("whole", bytearray(b"".join([ar.arc_head("b.arc", 1), *records])))], "path string, content binary")
    got = ar.arc_table(rows).collect()
    good = sorted(r["target_uri"] for r in got if r["source"] == "x" and r["error"] is None)
    assert len(good) == 6 - lost and (not lost or "http://a.example/2" not in good)
    assert sum(r["error"] is not None for r in got if r["source"] == "x") == 1
    assert sum(r["error"] is None for r in got if r["source"] == "whole") == 6
    made = [ar.converted(h, p, "x") for h, p in ar.arc_records(b"".join([ar.arc_head("b.arc", 1), *records]))]
    warc = [gzip.decompress(ar.warc_record({**m, "refers_to": None, "refers_to_uri": None}, b"payload %d " % i * 50)) for i, m in enumerate(made)]
    found = ar.warc_table(spark.createDataFrame([("w", bytearray(broken(warc, 2, how)))], "path string, content binary")).collect()
    assert sum(r["error"] is None for r in found) == 6 - lost and sum(r["error"] is not None for r in found) == 1
    with pytest.raises(ValueError):
        list(ar.arc_records(data))


def test_identifiers_and_archive_records(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "same")] * 4, "page_id long, url string, html string").coalesce(1)
    records = ar.arc_table(ar.to_arc(pages, "url", "html", archive_bytes=300))
    ids = [r["record_id"] for r in records.collect()]
    assert len(set(ids)) == 4 and ids == [r["record_id"] for r in records.collect()]
    path = scratch_path(spark, "warc")
    ar.write_warc(ar.with_revisits(records, F.lit(1)), path, archive_bytes=400)
    files = ar.read_archives(spark, path)
    kinds = [r["record_type"] for r in ar.warc_table(files, info=True).collect()]
    assert kinds.count("warcinfo") == files.count() > 1 and kinds.count("response") == 4
    assert ar.warc_table(files).count() == 4


def test_round_trip(spark):
    big = "<p>" + "long page " * 300 + "</p>"
    rows = [(1, "http://a.example/", big), (2, "http://b.example/", big), (3, "http://c.example/", big), (4, "u", "short"), (5, "u", "short"), (6, None, None),
            (7, "http://d.example/ x", "é日😀 " * 400), (7, "http://d.example/ x", "é日😀 " * 400), (None, "n", big), (8, "z", "\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    for version in (1, 2):
        records = ar.arc_table(ar.to_arc(pages, "url", "html", key="page_id", version=version, archive_bytes=5000))
        path = scratch_path(spark, "warc")
        ar.write_warc(ar.with_revisits(records, ar.key_of(F.col("target_uri")).try_cast("long")), path, archive_bytes=300)
        files = ar.read_archives(spark, path)
        assert files.count() > 2
        for f in files.collect():  # each file is a sequence of gzip members
            assert gzip.decompress(bytes(f["content"])).startswith(b"WARC/1.1\r\nWARC-Type: ")
        got = ar.warc_table(files, payloads=True).collect()
        assert len(got) == len(rows) and not any(r["error"] for r in got)
        by_id = {}
        for r in got:
            by_id.setdefault(r["target_uri"].rpartition(ar.KEY_MARK)[2], []).append(r)
        for k, _, html in rows:
            for r in by_id["" if k is None else str(k)]:
                payload = (html or "").encode()
                assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
                assert bytes(r["payload"]) == (b"" if r["record_type"] == "revisit" else payload)
        assert {k: by_id[k][0]["record_type"] for k in by_id} == {"1": "revisit", "2": "revisit", "3": "response", "4": "response", "5": "response", "6": "response",
                                                                 "7": "response", "8": "response", "": "revisit"}
        assert by_id["1"][0]["refers_to"] == by_id["3"][0]["record_id"] and by_id["1"][0]["refers_to_uri"] == by_id["3"][0]["target_uri"]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    records = ar.arc_table(ar.to_arc(pages, "url", "html", key="page_id"))
    path = scratch_path(spark, "warc")
    ar.write_warc(ar.with_revisits(records, F.lit(1)), path)
    assert ar.warc_table(ar.read_archives(spark, path)).collect() == []


def test_query_counts(spark, sf, read):
    assert queries.QUERIES["op1_archives"](spark, sf).count() == read("pages").count()
