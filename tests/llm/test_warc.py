"""WARC round trips over small byte ranges, compared with the rows that were written."""

import base64
import gzip
import hashlib
import random

import pytest

from shelfmark.llm import warc

SCHEMA = "page_id bigint, url string, html string, record_type string, payload string"


def pages():
    rng = random.Random(5)
    noise = ["".join(chr(rng.randrange(32, 60_000) if rng.random() < 0.8 else 48) for _ in range(400)).encode(
        "utf-8", "ignore").decode() for _ in range(60)]
    rows = [(i, f"http://x.example/{i}%0D", text) for i, text in enumerate(noise)]
    rows += [(100 + i, "http://copy.example/\r\nX: y", "<p>copy</p>") for i in range(30)]
    rows += [(200, None, None), (201, "u", ""), (None, "u", "<p>copy</p>"), (202, "u", "x" * 3_000_000), (202, "u", "x" * 3_000_000)]
    return [(*r, "clash", "clash") for r in rows]


def want(rows, min_bytes=0):
    first = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, url, html, *_ in rows:
        data = (html or "").encode()
        again = page_id is not None and page_id > first[html or ""] and len(data) >= min_bytes
        out.append((page_id, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if again else "response", first[html or ""] if again else None, None if again else data))
    return sorted(out, key=str)


def got(frame):
    return sorted([(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                    None if r["payload"] is None else bytes(r["payload"])) for r in frame.collect()], key=str)


@pytest.mark.parametrize("range_bytes", ["1000", "64k", "128m"])
def test_round_trip(spark, range_bytes):
    rows = pages()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    try:
        assert got(warc.round_trip(spark.createDataFrame(rows, SCHEMA).coalesce(2))) == want(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_small_payloads_are_all_stored(spark):
    rows = pages()
    assert got(warc.round_trip(spark.createDataFrame(rows, SCHEMA), min_bytes=100)) == want(rows, 100)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def stored(record):
    """A gzip member without compression: its data stand in it as they are."""
    return gzip.compress(record, compresslevel=0, mtime=0)


@pytest.mark.parametrize("range_bytes", [40, 300, 5000, 10**8])
def test_magic_inside_records(spark, tmp_path, range_bytes):
    """Payloads full of the magic and of whole gzip members, cut by ranges anywhere."""
    payloads = [warc.MAGIC * 50, b"x" + gzip.compress(b"inner") * 9, b"", warc.MAGIC, b"plain" * 100]
    records = [warc.build_record(i, "u", p, warc.payload_digest(p), None) for i, p in enumerate(payloads)]
    (tmp_path / "a.warc").write_bytes(b"".join(map(stored, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(map(stored, records[::-1])))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    try:
        found = warc.read_archives(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["page_id"], bytes(r["payload"])) for r in found) == sorted(2 * list(enumerate(payloads)))


def test_damage_is_an_error(spark, tmp_path):
    record = stored(warc.build_record(1, "u", b"payload", warc.payload_digest(b"payload"), None))
    (tmp_path / "a.warc").write_bytes(record[:-20] + record)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_members_of_16_mb_end_with_an_empty_one(spark):
    rows = [(1, "u", "y" * 17_000_000, "", ""), (2, "u", "z", "", "")]
    assert got(warc.round_trip(spark.createDataFrame(rows, SCHEMA))) == want(rows)
