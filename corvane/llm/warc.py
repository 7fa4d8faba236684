"""WARC archives of pages, with segmented records and their reassembly.

Each page is one record: an HTTP response whose body is sent in chunked framing.
A record block longer than ``segment_bytes`` is split: the first record carries
WARC-Segment-Number 1, the others are continuation records with the origin's id,
their number and, on the last, the total length.  Of pages with equal payloads of
at least ``revisit_bytes`` bytes, the one with the largest page_id is a response
and the others are revisits that name it; a revisit's block is the HTTP header alone, and
its payload is that of the record that it refers to.  A record's id is made of page_id and payload digest, so
it is known before anything is written.

Archives are written as rows of a Parquet table (archive, member, warc), which
gives Spark's commit protocol in any store; the members of an archive, one after
another, are a plain WARC file (``export_archives``).

Writing moves html only for pages whose payload may occur again, by a Bloom filter
of such digests; the others go from the scan into archives.

Reading parses records out of the members, groups segments by origin id, orders
them by number, checks that none is missing and that the lengths give the stated
total, joins the blocks, and decodes the chunked framing.  Every record that a
revisit names is looked up; it has to be a response whose decoded payload has the
size and digest that the revisit states.

Defined cases: null html is an empty payload; null url is an empty target; rows
that repeat page_id and payload are alike: all are responses, or all revisits, and copies of one record with one id;
null page_ids come last in choosing a response, and a payload that null ids alone
have is not revisited; a very long html is many segments, which meet again in one row of its own size; an empty table gives no archives and no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Bloom, Workspace, map_batches

REVISIT_BYTES = 1000
#: Parts into which pages of one payload are dealt out.
SALTS = 16
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: A member is closed at so many bytes.
MEMBER_BYTES = 2 << 20
#: Names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date, so that the same pages give the same archives.
DATE = "2020-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(x), x) for x in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing (extensions and trailers are skipped)."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["content-length"])
        block = raw[end + 4 : end + 4 + n]
        if len(block) < n or raw[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block
        at = end + 8 + n


def _safe(url: str) -> str:
    return "".join(f"%{b:02X}" if b < 33 or b > 126 else chr(b) for b in url.encode())


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def page_records(copy: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The record of a page, or its segments; copy tells rows that repeat a record apart."""
    own = record_id(page_id, digest)
    shown = "" if page_id is None else str(page_id)
    head = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", _safe(url)), ("X-Page-ID", shown), ("X-Copy", copy), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Content-Type", "application/http; msgtype=response")]
        yield record([*more, *head], http)
        return
    block = http + chunked(payload)
    kind = [("WARC-Type", "response"), *head, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield record(kind, block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record([*kind, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        named = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:segment:{own[10:-1]}:{copy}:{k}>"), ("WARC-Date", DATE), ("X-Copy", copy)]
        yield record([*named, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), *last], part)


def archives(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """(archive, member, warc) of all pages."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    # Only ids and digests are grouped; the page that others refer to is known before any html moves.
    keys = own.where(F.octet_length("html") >= revisit_bytes).select("page_id", "digest")
    chosen = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    digest_key = F.xxhash64("digest")
    shared = pages.sparkSession.sparkContext.broadcast(Bloom(chosen.select(digest_key.alias("key")), "key"))
    keyed = own.withColumn("_key", digest_key)

    def only(wanted: bool):
        def keep(b: pa.RecordBatch) -> pa.RecordBatch:
            found = shared.value.has(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
            return b.filter(pa.array(found == wanted))

        return map_batches(keyed, keep, keyed.schema)

    # One payload may be that of a third of all pages, so it is dealt out in parts.
    salted = only(True).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    right = chosen.select("digest", "refers_to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    refers = F.when((F.octet_length("html") >= revisit_bytes) & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("refers_to")), F.col("refers_to"))
    linked = salted.join(right, ["digest", "_salt"], "left").withColumn("refers_to", refers)
    columns = ["page_id", "url", "html", "digest", "refers_to"]
    decided = linked.select(*columns).unionByName(only(False).withColumn("refers_to", F.lit(None).cast("long")).select(*columns))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, member, held, size, row = TaskContext.get().partitionId(), 0, [], 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": pa.array([part], pa.int32()), "member": pa.array([member], pa.int32()), "warc": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for page_id, url, text, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for raw in page_records(f"{part}.{row}", page_id, url, text.encode(), digest, refers_to, segment_bytes):
                    held.append(raw)
                    size += len(raw)
                    if size >= member_bytes:
                        yield close()
                        member, held, size = member + 1, [], 0
                row += 1
        if held:
            yield close()

    return decided.mapInArrow(write, "archive int, member int, warc binary")


_RECORD = "record_id string, copy string, kind string, page_id long, refers_id string, digest string, payload_bytes long, segment int, total long, block binary"
_HEAD = ("kind", "page_id", "refers_id", "digest", "payload_bytes")


def parsed_records(archive_table: DataFrame) -> DataFrame:
    """One row a record of the archives; record_id is the origin's for continuations."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for h, block in records(raw.as_py()):
                    kind, total = h["warc-type"], h.get("warc-segment-total-length")
                    page, refers = h.get("x-page-id"), h.get("warc-refers-to")
                    own = h["warc-segment-origin-id" if kind == "continuation" else "warc-record-id"]
                    head = own, h.get("x-copy", ""), kind, int(page) if page else None, refers, h.get("warc-payload-digest", "")[5:], int(h.get("x-payload-length", -1))
                    rows.append((*head, int(h.get("warc-segment-number", 0)), int(total) if total else None, block))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archive_table.select("warc").mapInArrow(parse, _RECORD)


def reassembled(archive_table: DataFrame) -> DataFrame:
    """Whole records: segments joined in order, their number and total length verified."""
    rows = parsed_records(archive_table)
    whole = rows.where("segment = 0").drop("segment", "total")
    # A group is one record's segments, so it is bounded by the record's own size.
    groups = rows.where("segment > 0").groupBy("record_id", "copy").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in _HEAD],
    )
    joined = groups.withColumn("block", F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["block"])), "")))  # linear, unlike a fold of concat
    numbers = F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    sound = F.coalesce(numbers & (F.octet_length("block") == F.col("total")), F.lit(False))
    checked = F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments are missing from record "), F.col("record_id"))))
    return whole.drop("copy").unionByName(joined.select("record_id", *_HEAD, checked.alias("block")))


def read_pages(archive_table: DataFrame, with_payload: bool = False, work: Workspace | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page; the payload of responses on request.

    A response's size and digest are computed from the decoded payload and held
    against its headers; a revisit's are those of the record that it refers to,
    which has to be there.
    """
    work = work or Workspace(archive_table.sparkSession, "warc")
    schema = "record_id string, kind string, page_id long, refers_id string, digest string, payload_bytes long, payload binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            rows = []
            for own, kind, page_id, refers, digest, stated, block in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                payload, size = None, stated
                if kind == "response":
                    head, _, body = block.partition(b"\r\n\r\n")
                    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    size = len(payload)
                    if size != stated or hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of page {page_id} differs from its record")
                rows.append((own, kind, page_id, refers, digest, size, payload if with_payload else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    found = work.write(reassembled(archive_table).select("record_id", *_HEAD, "block").mapInArrow(decode, schema), "pages")
    # Each named record once, however many pages name it.
    named = found.where("kind = 'revisit'").select(F.col("refers_id").alias("record_id"), "digest", "payload_bytes").distinct()
    sound = found.where("kind = 'response'").select("record_id", "digest", "payload_bytes")
    if lost := named.join(sound, ["record_id", "digest", "payload_bytes"], "left_anti").take(1):
        raise ValueError(f"a revisit refers to {lost[0]['record_id']}, which is missing or differs")
    refers_to = F.regexp_extract("refers_id", r"^<urn:page:(-?\d+):", 1).try_cast("long")
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), refers_to.alias("refers_to"), *(["payload"] if with_payload else []))


def export_archives(archive_table: DataFrame, folder: str) -> int:
    """Writes each archive as a plain .warc file into a local folder, member by member; returns their number."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    seen: set[int] = set()
    for row in archive_table.orderBy("archive", "member").toLocalIterator():
        with (Path(folder) / f"part-{row['archive']:05d}.warc").open("ab" if row["archive"] in seen else "wb") as out:
            out.write(row["warc"])
        seen.add(row["archive"])
    return len(seen)
