from __future__ import annotations

import hashlib

import pytest

from tickloom.llm import archive as op

SCHEMA = "page_id long, url string, html string, record long, digest string, payload string, n_bytes long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "d", "p", 2) for i, u, h in rows], SCHEMA)


def test_round_trip_and_edges(spark):
    long, short = "<p>" + "é\r\n\r\n" * 100, "tiny"
    rows = [
        (5, "http://a/\r\nX: y", long), (3, "http://ü", long), (3, "http://b", long), (None, None, long), (7, None, short), (8, "http://c", short),
        (9, "http://d", None), (10, "http://e", ""), (11, "http://f", "x" * 100), (12, "http://g", "x" * 100), (13, "", "WARC-Type: revisit\r\n" * 9),
        (14, "http://h", "y" * 3_000_000),
    ]
    written = op.write_archive(pages(spark, rows))
    assert written.payloads(spark).count() == len({h or "" for _, _, h in rows})
    got = op.parse_records(op.read_records(spark, written)).collect()
    assert sorted((r["page_id"] or -1, bytes(r["payload"])) for r in got) == sorted((i or -1, (h or "").encode()) for i, _, h in rows)
    for r in got:
        data = bytes(r["payload"])
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha256(data).hexdigest()
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got if bytes(r["payload"]) == long.encode())
    assert [k[1:] for k in kinds if k[0] != 3] == [("revisit", 3), ("revisit", 3)]
    assert sorted((k[1], k[2]) for k in kinds if k[0] == 3) == [("response", None), ("revisit", 3)]
    assert {r["record_type"] for r in got if len(r["payload"]) < 100} == {"response"}
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] in (11, 12)} == {(11, "response", None), (12, "revisit", 11)}
    assert {r["url"] for r in got if r["page_id"] == 5} == {"http://a/%0D%0AX: y"}
    assert op.parse_records(op.read_records(spark, op.write_archive(pages(spark, [])))).count() == 0


def test_changed_payload_is_noticed(spark):
    written = op.write_archive(pages(spark, [(1, "u", "x" * 200)]))
    from pyspark.sql import functions as F

    other = op.Archive(written.path + "-changed")
    written.payloads(spark).withColumn("payload", F.lit(b"y" * 200)).write.parquet(f"{other.path}/payloads")
    written.headers(spark).write.parquet(f"{other.path}/headers")
    with pytest.raises(Exception, match="does not have the digest"):
        op.read_records(spark, other).collect()


def test_ids_of_any_type(spark):
    body = "<p>" + "same words in each of them " * 8
    pages = spark.createDataFrame([("b", "u1", body), ("a10", "u2", body), (None, "u3", body), ("c", "u4", "short")], "page_id string, url string, html string")
    records = op.parse_records(op.read_records(spark, op.write_archive(pages)), id_type="string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in records.collect()}
    assert got == {"a10": ("response", None), "b": ("revisit", "a10"), None: ("revisit", "a10"), "c": ("response", None)}
