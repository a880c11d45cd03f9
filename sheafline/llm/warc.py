"""WARC archives: a writer, and a reader that salvages damaged ones.

Records are written as one gzip member each. The reader checks every record; where
a check fails it looks for the next place at which a member or a version line
starts a valid record, goes on from there, and reports the bytes between as a gap.
Within a member it does so in the inflated bytes, and of a broken member it takes
what can be inflated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, new_path, table

#: Payloads of fewer bytes are always stored in full.
REVISIT_BYTES = 100
#: Records in a file by payload size: (bytes below which, records). A file thus holds at most 640 MB of payload, or one record.
FILE_RECORDS = ((1 << 16, 10_000), (1 << 23, 76), (1 << 63, 1))
#: Archives are the same for the same pages, so the date is a parameter.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"

_RECORD = "path string, start bigint, end bigint, reason string, record_type string, record_id string, refers_to string, target_uri string, payload_bytes bigint, payload_digest string, payload binary"


class Damaged(ValueError):
    """A record that fails a check."""


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte; an empty member follows if its own last byte isn't one."""
    out = b""
    for part in (record, b""):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.compress(part) + z.flush()
        if out[-1] == 0:
            break
    return out


def record_bytes(
    record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, date: str = DATE
) -> bytes:
    """A response record, or a revisit record if ``refers_to`` names one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if refers_to is not None else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}"
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data, start: int = 0, proof: bool = False) -> tuple[dict, int]:
    """The record at ``start``, and the place behind it; ``Damaged`` if a check fails, or with ``proof`` if no digest covers the block."""
    if data[start : start + 7] != b"WARC/1.":
        raise Damaged("no version line")
    head = data.find(b"\r\n\r\n", start)
    if head < 0:
        raise Damaged("header without end")
    fields = {}
    for line in data[start:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    if not {
        b"warc-type", b"warc-record-id", b"content-length"
    } <= fields.keys() or not fields[b"content-length"].isdecimal():
        raise Damaged("header without type, id or length")
    end = head + 4 + int(fields[b"content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block without end")
    block = data[head + 4 : end]
    digest = fields.get(b"warc-block-digest", "")
    if digest.startswith("sha256:") and sha256(block).hexdigest() != digest[7:]:
        raise Damaged("block digest differs")
    if proof and not digest.startswith("sha256:"):
        raise Damaged("broken member, and no block digest")
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get(b"content-type", "").startswith("application/http") else (b"", b"", block)
    kind = fields[b"warc-type"]
    size, found = len(payload), sha256(payload).hexdigest()
    said = fields.get(b"warc-payload-digest", "")
    if kind == "revisit":
        said_size = [
            x.partition(b":")[2].strip()
            for x in http.split(b"\r\n")
            if x.lower().startswith(b"content-length:")
        ]
        size, found = int(said_size[0]) if said_size and said_size[0].isdigit() else None, said.removeprefix("sha256:") or None
    elif said.startswith("sha256:") and said[7:] != found:
        raise Damaged("payload digest differs")
    return {
        "record_type": kind, "record_id": fields[b"warc-record-id"].strip("<>"), "refers_to": fields.get(b"warc-refers-to", "").strip("<>") or None, "target_uri": fields.get(b"warc-target-uri"),
        "payload_bytes": size, "payload_digest": found, "payload": payload,
    }, end + 4


def inflate(data: memoryview, start: int) -> tuple[bytes, int, str | None]:
    """The gzip member at ``start``, the place behind it, and what breaks it; of a broken one, all that comes before the break."""
    z, out, at = zlib.decompressobj(31), [], start
    while not z.eof:
        if at >= len(data):
            return b"".join(out), at, "member without end"
        part, before = data[at : at + 65_536], z.copy()
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            try:
                for k in range(len(part)):
                    out.append(before.decompress(part[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(out), at + k, str(e)
        at += len(part)
    return b"".join(out), at - len(z.unused_data), None


def _inside(plain: bytes, broken: str | None) -> tuple[list[dict], str | None]:
    """The valid records of a member and, with a ``reason``, the gaps between them; why there is a gap at its end.

    A bit error may go unnoticed for a while, so in a broken member a record needs a
    digest. One that merely ends early is right as far as it goes, but a record that
    ends where the bytes do isn't taken without the member's own check.
    """
    found, at, gap = [], 0, None
    while at < len(plain):
        try:
            record, end = parse_record(plain, at, broken not in (None, "member without end"))
            if broken == "member without end" and end == len(plain):
                raise Damaged(broken)
        except Damaged as e:
            gap = gap or str(e)
            at = plain.find(b"WARC/1.", at + 1)
            if at < 0:
                break
            continue
        if gap:
            found.append({"reason": gap})
            gap = None
        found.append(record)
        at = end
    return found, broken or gap


def salvage(data: bytes) -> Iterator[dict]:
    """All valid records of an archive and, with a ``reason``, the gaps between them, in order.

    A gap within a member, or at the end of one, has the bytes of the member.
    """
    view, at, gap = memoryview(data), 0, None
    text = 0  # no plain record before this place: it has been inflated
    while at < len(data):
        broken = None
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                plain, end, broken = inflate(view, at)
                found, tail = _inside(plain, broken)
                if (tail or broken) and not any("reason" not in x for x in found):
                    raise Damaged(tail or broken)
                if tail and not broken:
                    found.append({"reason": tail})
            else:
                record, end = parse_record(data, at)
                found = [record]
        except Damaged as e:
            gap = gap or (at, str(e))
        else:
            if gap:
                yield {"start": gap[0], "end": at, "reason": gap[1]}
                gap = None
            for x in found:
                yield {"start": at, "end": end, **x}
            if not broken:
                at = end
                continue
            gap, text = (at, broken), max(text, end)
        # The break may show only within the next member, so members are sought from here on.
        places = [x for x in (data.find(b"\x1f\x8b\x08", at + 1), data.find(b"WARC/1.", max(at + 1, text))) if x >= 0]
        at = min(places, default=len(data))
    if gap:
        yield {"start": gap[0], "end": len(data), "reason": gap[1]}


def _members(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(
                *(batch.column(x).to_pylist() for x in ("page_id", "url", "html", "digest", "refers_to", "again")),
                strict=True
            ):
                page, url, html, digest, refers_to, again = row
                out.append(
                    member(
                        record_bytes(
                            f"{_ID}{page}", url, (html or "").encode(), digest, f"{_ID}{refers_to}" if again else None,
                            date
                        )
                    )[:-1]
                )
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    return run


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) to ``*.gz`` files below ``path``.

    Of equal payloads of at least ``revisit_bytes`` bytes, the smallest page_id's is a
    response and the others revisit it; rows that repeat that page_id are responses
    too. A null html is an empty payload, a null url is left out, and a null page_id
    gives a record id without a number. No pages give an archive without records.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest")
    )
    long = rows.where(F.octet_length("html") >= revisit_bytes)
    repeats = long.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    ).where("n > 1 and first is not null")
    kept = new_path(pages.sparkSession, "payloads")
    repeats.select("digest", "first").write.parquet(kept)
    repeats = pages.sparkSession.read.schema("digest string, first bigint").parquet(kept)
    # As a stored table, the repeats have a known size: Spark broadcasts them only below its limit.
    marked = rows.join(repeats, "digest", "left").select(
        "*",
        (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).alias("again")
    ).withColumnRenamed("first", "refers_to")
    # Spark's text writer ends each row with the separator, which is the member's last byte.
    size, above = F.octet_length("html"), 0
    least, most = rows.agg(F.min(size), F.max(size)).first()
    for below, records in FILE_RECORDS:
        if above <= (most or 0) and (least or 0) < below:
            part = marked.where((size >= above) & (size < below)).mapInArrow(_members(date), "record binary")
            part.select(F.col("record").cast("string")).write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)
        above = below
    forget(pages.sparkSession, kept)


def _salvaged(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
                *((x, pa.string()) for x in ("record_type", "record_id", "refers_to", "target_uri")),
                ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())
            ]
        )
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
                held, size = [], 0
                for row in salvage(data.as_py() or b""):
                    size += len(row.get("payload") or b"")
                    held.append(
                        dict.fromkeys(schema.names) | row | {"path": path.as_py()}
                        | ({} if payloads else {"payload": None})
                    )
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives at ``path``.

    A gap has a ``reason`` and no record; start and end are its bytes in the file. A
    record's start and end are those of its member, as are those of a gap in one. An empty file has no rows. A
    revisit has the digest and the length of the payload that it leaves out.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_salvaged(payloads), _RECORD)


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, f"{path}/part-*", payloads=False)
    # These archives are whole; a gap would silently shorten the result, so it ends the query.
    damage = F.raise_error(F.concat(F.lit("damaged archive: "), F.col("path"), F.lit(": "), F.col("reason")))
    page = F.when(
        F.col("reason").isNull(),
        F.substring("record_id", len(_ID) + 1, 30).try_cast("bigint")
    ).otherwise(damage.cast("bigint"))
    return found.select(
        page.alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.substring("refers_to", len(_ID) + 1, 30).try_cast("bigint").alias("refers_to")
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     q AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
     r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM r
"""
