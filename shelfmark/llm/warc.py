"""WARC archives: written by tasks, read back by byte ranges.

Every record is a gzip member of its own, so that a reader can start anywhere: a
task scans the byte range it is given for the gzip magic, takes what follows as a
candidate and accepts it if it decodes to a whole member (check sum included)
that begins with a WARC header.  A record belongs to the task in whose range its
magic begins; the task reads on past the end of the range to finish it.

The scan is Spark's own text source with the magic as the line separator, so
ranges, remote stores and retries are Spark's business.  The magic also occurs by
chance inside compressed data.  Such a candidate fails, its bytes are joined to
the member they belong to, and where that member began in the range of another
task both parts meet in a second step that holds nothing but such fragments.

Archives are written through Spark's text sink.  It ends every row with a
separator, here the byte 0, which is the last byte of a member (the high byte of
its length); a member of 16 MB or more, whose last byte differs, is followed by
an empty member.  Archive names must not end in ``.gz``, or Hadoop unpacks them
as one stream before the scan.

Defined results: a null html is an empty payload, a null url leaves out its
field; rows with a null page_id are responses; rows repeated with the smallest
page_id of their payload are responses, too; an empty table gives no records;
other columns are ignored.  Damaged archives raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.lineage import ensure_checkpoint_dir

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEVEL = 5
DATE = "2024-01-31T00:00:00Z"

RECORD_SCHEMA = (
    "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Page-Id", page_id),
        ("WARC-Profile", None if refers_to is None else REVISIT_PROFILE),
        ("WARC-Refers-To", None if refers_to is None else _record_id(refers_to, digest)),
        ("Refers-To-Page-Id", refers_to),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return head.encode("utf-8", "surrogatepass") + END + block + END + END


def parse_record(record: bytes) -> tuple:
    """The columns of RECORD_SCHEMA of one record; raises ValueError if it contradicts itself."""
    head, _, rest = record.partition(END + END)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(END + END)
    size = next(int(x.split(b":")[1]) for x in http.split(END) if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda key: int(fields[key]) if key in fields else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    url = fields.get("WARC-Target-URI")
    url = None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return number("Page-Id"), url, kind, payload if kind == "response" else None, size, digest, number("Refers-To-Page-Id")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) into archives under ``path``.

    Of equal payloads of at least ``min_bytes`` bytes the one with the smallest
    page_id is stored, the others refer to it.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("key", F.sha2("html", 256))
    repeated = (
        rows.filter(F.octet_length("html") >= min_bytes).groupBy("key")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    linked = rows.join(repeated, "key", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            members = []
            for page_id, url, html, refers_to in zip(*[batch[c].astype(object).where(batch[c].notna(), None) for c in batch]):
                payload = html.encode("utf-8", "surrogatepass")
                page_id, refers_to = [None if x is None else int(x) for x in (page_id, refers_to)]
                member = _member(build_record(page_id, url, payload, payload_digest(payload), refers_to))
                if member[-1]:
                    member += _member(b"")
                members.append(member[:-1])
            yield pd.DataFrame({"member": members})

    # The cast keeps the bytes as they are; the separator is the last byte of each member.
    linked.mapInPandas(run, "member binary").select(F.col("member").cast("string").alias("value")).write.text(path, lineSep="\0")


class _Scan:
    """Puts candidates of one byte range together, in order."""

    def __init__(self) -> None:
        self.records: list[bytes] = []
        self.fragments: list[tuple[int, bytes]] = []
        self.pending: list[tuple[int, bytes]] = []
        self.at = 0

    @staticmethod
    def _decode(data: bytes) -> tuple[str, bytes]:
        """Whether data is a whole member, may begin one, or is none."""
        opener = zlib.decompressobj(31)
        try:
            out = opener.decompress(data)
        except zlib.error:
            return "no", b""
        if opener.eof:
            fits = not opener.unused_data and (not out or out.startswith(b"WARC/"))
            return ("whole" if fits else "no"), out
        return ("begin" if out[:5] == b"WARC/"[:len(out)] else "no"), out

    def add(self, fragment: bytes) -> None:
        number, self.at = self.at, self.at + 1
        state, out = self._decode(fragment)
        if state != "whole" and self.pending:
            joined = b"".join(x for _, x in self.pending) + fragment
            longer, longer_out = self._decode(joined)
            if longer == "whole":
                self.pending, state, out = [], longer, longer_out
            elif longer == "begin":
                self.pending.append((number, fragment))
                return
        self.flush()
        if state == "whole":
            if out:
                self.records.append(out)
        elif state == "begin":
            self.pending = [(number, fragment)]
        else:
            self.fragments.append((number, fragment))

    def flush(self) -> None:
        self.fragments += self.pending
        self.pending = []


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """Records of every byte range, and the fragments that are none by themselves."""
    lines = (
        spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
        .select(F.col("value").cast("binary").alias("data"), F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("start"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, place = _Scan(), None

        def done() -> pd.DataFrame:
            rows = [(*parse_record(r), None, None, None, None) for r in scan.records]
            scan.records = []
            return pd.DataFrame(rows, columns=columns, dtype=object)

        def left() -> pd.DataFrame:
            scan.flush()
            return pd.DataFrame([(*[None] * 7, *place, n, x) for n, x in scan.fragments], columns=columns, dtype=object)

        for batch in batches:
            for data, file, start in zip(batch["data"], batch["file"], batch["start"]):
                if (file, start) != place:
                    if place is not None:
                        yield left()
                    yield done()
                    scan, place = _Scan(), (file, start)
                    if start == 0:  # what lies before the first magic of a file is no record
                        if data:
                            raise ValueError(f"{file} does not begin with a gzip member")
                        continue
                scan.add(MAGIC + bytes(data))
            yield done()
        if place is not None:
            yield left()

    columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")] + ["file", "start", "number", "fragment"]
    return lines.mapInPandas(run, f"{RECORD_SCHEMA}, file string, start bigint, number bigint, fragment binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record under ``path``: page_id, url, record_type, payload (null for revisits), payload_bytes,
    payload_digest, refers_to."""
    scanned = _scanned(spark, path)
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def mend(group: pd.DataFrame) -> pd.DataFrame:
        scan = _Scan()
        for data in group.sort_values(["start", "number"])["fragment"]:
            scan.add(bytes(data))
        scan.flush()
        if scan.fragments:
            raise ValueError(f"{group['file'].iloc[0]} is damaged: {len(scan.fragments)} pieces belong to no record")
        return pd.DataFrame([parse_record(r) for r in scan.records], columns=names, dtype=object)

    fragments = scanned.filter("fragment IS NOT NULL").select("file", "start", "number", "fragment")
    return scanned.filter("fragment IS NULL").select(*names).unionByName(
        fragments.groupBy("file").applyInPandas(mend, RECORD_SCHEMA))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into a new folder of the shared checkpoint folder and read the archives back."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path)
