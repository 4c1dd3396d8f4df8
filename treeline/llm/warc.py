"""WARC archives: write records with an index, read selected ones back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import work_dir, written

#: The digits that conv() gives in base 32, and those of RFC 4648.
BASE32_CONV = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_RFC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Bytes of records that one archive file may hold before its task starts the next one.
ARCHIVE_BYTES = 256 << 20
#: Bytes of archives that one task reads back.
READ_BYTES = 32 << 20

INDEX = "page_id long, archive string, offset long, length long, record_id string, record_type string, refers_to long, refers_to_record string, url string, digest string"
RECORDS = "page_id long, record_id string, record_type string, refers_to_record string, url string, digest string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's or binary's bytes."""
    h = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_CONV, BASE32_RFC)


def _record_id(page: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws(":", page.cast("string"), digest), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """One record per row of ``pages(page_id, url, html)``: which are responses, and what the others revisit.

    Equal payloads of at least ``min_revisit_bytes`` bytes: the smallest page_id is the response. Null html is
    an empty payload, null url an empty one; a null page_id sorts last. Rows that repeat the response's page_id
    and payload are responses too. Other columns are ignored.

    Copies are counted before anything is shuffled, and only payloads that occur more than once are in the table
    that verdicts come from: where it is small, no page moves; where not, the join can be split at a payload that
    is very frequent.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"), F.sha2(html, 256).alias("_key"), base32_sha1(html).alias("digest"))
    first = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("_key").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    first = written(first.where("_n > 1").select("_key", "_first"), "payloads")
    out = rows.join(first, "_key", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    refers = F.when(again, F.col("_first"))
    return out.select(
        "page_id", "url", "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        _record_id(F.col("page_id"), F.col("digest")).alias("record_id"),
        refers.alias("refers_to"),
        F.when(again, _record_id(refers, F.col("digest"))).alias("refers_to_record"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def _member(head: list[str], *parts: bytes) -> bytes:
    """A record as a gzip member of its own."""
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    head = [*head, f"Content-Length: {sum(map(len, parts))}"]
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n") + b"".join(map(pack.compress, parts)) + pack.compress(b"\r\n\r\n") + pack.flush()


def escaped(url: str) -> str:
    """The URL with space and control characters percent-encoded, so that it fits a header line."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(row, date: str) -> bytes:
    """A response holds the HTTP head and the page; a revisit holds the head alone."""
    page = "" if pd.isna(row.page_id) else str(int(row.page_id))
    head = [
        "WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <{row.record_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {escaped(row.url)}", f"WARC-Payload-Digest: sha1:{row.digest}", f"X-Page-Id: {page}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row.record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row.refers_to_record}>"]
        return _member(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(row.payload)}\r\n\r\n"
    return _member(head, http.encode(), row.payload)


def _info(name: str, date: str) -> bytes:
    """The record that opens an archive."""
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member(head, b"format: WARC File Format 1.1\r\n")


def write_archives(records: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Writes planned records into ``*.warc.gz`` files under ``root`` and returns the index, written as a table.
    ``date`` (now, unless given) is that of all records.

    Each task writes files of its own under a name that no other attempt uses, and the index keeps only what
    the attempt that counted has returned: a lost executor or a repeated task leaves an unused file at most.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for row in batch.astype({"page_id": object, "refers_to": object}).itertuples(index=False):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                        opening = _info(name, date)
                        out.write(opening)
                        at = len(opening)
                    data = _record(row, date)
                    out.write(data)
                    rows.append((row.page_id, name, at, len(data), row.record_id, row.record_type, row.refers_to, row.refers_to_record, escaped(row.url), row.digest))
                    at += len(data)
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return written(records.mapInPandas(write, INDEX), "warc-index")


def coalesce_ranges(index: DataFrame, max_gap: int = 64 << 10, max_range: int = 8 << 20) -> DataFrame:
    """Sorted byte ranges that cover the selected records: (archive, start, stop, records).

    Records of one archive whose gap is at most ``max_gap`` share a range; a range is cut at multiples of
    ``max_range``, so its size is bounded by that and one record.
    """
    cell = F.floor(F.col("offset") / max_range)
    index = index.withColumn("_cell", cell).withColumn("_end", F.col("offset") + F.col("length"))
    # A cell of an archive is at most max_range bytes of records; its list is bounded by that.
    cells = index.groupBy("archive", "_cell").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "_end", "page_id"))).alias("_r"))
    start = F.transform("_r", lambda x, i: F.when((i == 0) | (x["offset"] - F.get(F.col("_r"), i - 1)["_end"] > max_gap), i))
    starts = F.filter(start, lambda i: i.isNotNull())
    cells = cells.withColumn("_s", starts)
    cut = F.transform("_s", lambda s, j: F.slice(F.col("_r"), s + 1, F.coalesce(F.get(F.col("_s"), j + 1), F.size("_r")) - s))
    ranges = cells.select("archive", F.explode(cut).alias("records"))
    return ranges.select("archive", F.col("records")[0]["offset"].alias("start"), F.element_at("records", -1)["_end"].alias("stop"), "records")


def parse_record(data: bytes) -> tuple[dict, bytes]:
    """(header fields, payload) of one gzip member. The payload of a response is held against its digest."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not re.fullmatch(r"WARC/\d\.\d", lines[0]):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if fields["Content-Type"].startswith("application/http"):
        body = body.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have the digest of the header")
    return fields, body


def read_records(ranges: DataFrame, root: str, tasks: int) -> DataFrame:
    """The records of the ranges with their own payloads (revisits have none), as the archives tell them. Ranges
    are dealt out to so many tasks; each is one read of its archive."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for archive, start, stop, records in batch[["archive", "start", "stop", "records"]].itertuples(index=False):
                with store.open_input_file(f"{folder}/{archive}") as f:
                    f.seek(start)
                    data = f.read(stop - start)
                rows = []
                for r in records:
                    h, payload = parse_record(data[r["offset"] - start : r["_end"] - start])
                    page = int(h["X-Page-Id"]) if h["X-Page-Id"] else None
                    rows.append((page, h["WARC-Record-ID"][1:-1], h["WARC-Type"], h.get("WARC-Refers-To", "")[1:-1] or None, h["WARC-Target-URI"], h["WARC-Payload-Digest"][5:], payload))
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")], dtype=object)
                yield frame.astype({"page_id": "Int64"})

    return ranges.repartition(tasks, "archive", "start").mapInPandas(read, RECORDS)


def archive_digest(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes all pages, reads all records back, and returns per page: page_id, payload_bytes, payload_digest,
    record_type, refers_to. All of it comes from the archives: size and digest are those of the bytes read, a
    revisit has those of the response that its record names, and refers to that one's page. One row per row of
    ``pages``; an empty table gives an empty one; see ``plan_records`` for nulls, repeats and other columns."""
    root = f"{work_dir(spark)}/treeline/warc-{uuid.uuid4().hex}"
    index = write_archives(plan_records(pages, min_revisit_bytes), root)
    size = index.agg(F.sum("length")).first()[0] or 0
    read = read_records(coalesce_ranges(index), root, max(size // READ_BYTES + 1, spark.sparkContext.defaultParallelism))
    read = read.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    read = written(read.drop("payload", "url"), "warc-read")
    own = read.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    again = read.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to_record")
    # Only responses that a revisit names; written, so that the join can be split at one that very many name.
    named = own.join(again.select(F.col("refers_to_record").alias("record_id")).distinct(), "record_id", "left_semi")
    full = named.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"), F.min("page_id").alias("refers_to"))
    again = again.join(written(full, "warc-named"), "refers_to_record", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(*names).union(again.select(*names))
