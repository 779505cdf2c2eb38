"""WARC archives: pages written as segmented, chunked records, and put together again when read.

Writing: each page is an HTTP response in chunked transfer framing. A block that is longer than a segment is cut:
the first record carries segment number 1, the others are continuation records that name the first one's
identifier, and the last one states the total length. Of pages with equal payloads only the one with the
largest id is stored; the others are revisits of it.

Reading: records are taken from the archives by their content lengths. Only segments are shuffled, by the
identifier of their origin, and joined in order of their numbers, one record at a time; whole records stay where
they are. The total length is verified before the chunked framing is decoded. A damaged stretch of an archive (a cut
record or gzip member, a length that does not lead to the next record, a number that is none) gives one row
of type ``damaged``, and reading goes on at the next record header or gzip member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.operators.shared import new_path, written

SEGMENT = 64 << 10  # bytes of a record's block
CHUNK = 8 << 10  # bytes of a transfer chunk
BUNDLE = 512 << 10  # bytes of records that are written together, and one record more
BUNDLES = 96  # of an archive file: with BUNDLE and SEGMENT, a bound on its bytes
LEAST = 0  # bytes from which equal payloads become revisits
DATE = "2000-01-01T00:00:00Z"
_BATCH = 4 << 20
_PIECE = 16 << 10  # compressed bytes at a time
_BETWEEN = b"\r\n\r\n"
_MEMBER = re.compile(rb"\x1f\x8b\x08")
_HEADER = re.compile(rb"WARC/1\.[0-9]\r?\n")

RECORD = (
    "record_id string, row string, type string, origin string, segment int, total long, uri string, digest string, "
    "refers_to string, block binary"
)


_NAMES = [f.split()[0] for f in RECORD.split(", ")]
DAMAGED = "damaged"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes | None:
    """The body of chunked framing; None if it is cut short or malformed. Extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(framed[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(parts)
        at = end + 2 + size
        if framed[at : at + 2] != b"\r\n":
            return None
        parts.append(framed[end + 2 : at])
        at += 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the two line breaks that end it."""
    head = [f"{name}: {value}" for name, value in fields if value is not None]
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _clean(uri: str | None) -> str | None:
    """Control characters and spaces would end or break a header line."""
    return None if uri is None else "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_records(segment: int):
    def records(page_id, url, html, refers_to, row) -> Iterator[bytes]:
        payload = (html or "").encode()
        shared = [("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Page-Row", row)]
        digest = ("WARC-Payload-Digest", "sha1:" + payload_digest(payload))
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
        kind = ("Content-Type", "application/http; msgtype=response")
        if refers_to is not None:
            profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
            yield _record([("WARC-Type", "revisit"), *shared, kind, digest, profile, ("WARC-Refers-To", _name(refers_to))], http)
            return
        block = http + chunked(payload)
        pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
        number = ("WARC-Segment-Number", 1 if len(pieces) > 1 else None)
        yield _record([("WARC-Type", "response"), *shared, kind, digest, number], pieces[0])
        for n, piece in enumerate(pieces[1:], 2):
            own = [("WARC-Record-ID", f"{_name(page_id)[:-1]}:{n}>"), ("WARC-Date", DATE), ("WARC-Page-Row", row)]
            total = ("WARC-Segment-Total-Length", len(block) if n == len(pieces) else None)
            yield _record(
                [("WARC-Type", "continuation"), *own, ("WARC-Segment-Origin-ID", _name(page_id)), ("WARC-Segment-Number", n), total], piece
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "row")], strict=True):
                for record in records(*row):
                    held.append(record)
                    size += len(record)
                    if size > BUNDLE:
                        yield pa.RecordBatch.from_arrays([pa.array([_BETWEEN.join(held)], pa.binary())], ["records"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_BETWEEN.join(held)], pa.binary())], ["records"])

    return run


def _place(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(-(2**63)))  # null ids meet, too


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """A folder of gzip WARC files from ``pages`` (page_id, url, html); other columns are not stored.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is a response, the others revisit it.
    Rows that repeat that page_id and payload are responses, too. A null html is an empty payload, a null url
    is left out, a null page_id is never referred to.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    digests = rows.select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("bytes"))
    groups = digests.where(F.col("bytes") >= least).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 and refers_to is not null").drop("n")
    again = digests.join(groups, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = written(again.select(_place("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to").distinct(), "revisits")
    rows = rows.withColumns({"_id": _place("page_id"), "_sha": F.sha2("html", 256), "row": F.monotonically_increasing_id().cast("string")})
    records = rows.join(again, ["_id", "_sha"], "left").select("page_id", "url", "html", "refers_to", "row")
    bundles = records.mapInArrow(_page_records(segment), "records binary")
    # A text line of raw bytes with this ending is a bundle of records with the line breaks that close the last one.
    writer = bundles.select(F.col("records").cast("string")).write.option("lineSep", _BETWEEN.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", BUNDLES).text(path)


def _salvaged(member, data: bytes) -> Iterator[bytes]:
    """What a gzip member still gives before the byte at which it breaks."""
    while len(data) > 1:
        half = data[: len(data) // 2]
        before = member.copy()
        try:
            yield member.decompress(half)
            data = data[len(half) :]
        except zlib.error:
            member, data = before, half


def _inflated(raw) -> Iterator[bytes | None]:
    """A file's bytes piece by piece; several gzip members follow each other. None stands where one breaks off."""
    if bytes(raw[:2]) != b"\x1f\x8b":
        yield from (bytes(raw[at : at + _BATCH]) for at in range(0, len(raw), _BATCH))
        return
    at = 0
    while at < len(raw):
        member, start, sound = zlib.decompressobj(31), at, True
        while sound and not member.eof and at < len(raw):
            data = bytes(raw[at : at + _PIECE])
            at += len(data)
            before = member.copy()
            try:
                yield member.decompress(data)
            except zlib.error:
                yield from _salvaged(before, data)
                sound = False
        if sound and member.eof:
            at -= len(member.unused_data)
            continue
        yield None
        following = _MEMBER.search(raw, start + 1)
        at = following.start() if following else len(raw)


class _Reader:
    """Pieces as bytes to look at before they are taken; a None among the pieces ends what can be seen until ``go_on``."""

    def __init__(self, pieces: Iterator[bytes | None]):
        self.pieces, self.held, self.cut = iter(pieces), bytearray(), False

    def more(self) -> bool:
        if self.cut:
            return False
        piece = next(self.pieces, b"")
        while piece == b"":
            piece = next(self.pieces, False)
        if piece is False:
            return False
        if piece is None:
            self.cut = True
            return False
        self.held += piece
        return True

    def sees(self, n: int) -> bool:
        while len(self.held) < n:
            if not self.more():
                return False
        return True

    def go_on(self) -> None:
        self.held.clear()
        self.cut = False

    def line(self) -> bytes | None:
        """The next line with its end, None if the end is not there."""
        looked = 0
        while (end := self.held.find(b"\n", looked)) < 0:
            looked = len(self.held)
            if not self.more():
                return None
        found = bytes(self.held[: end + 1])
        del self.held[: end + 1]
        return found

    def skip_breaks(self) -> None:
        while self.sees(1) and self.held[0] in b"\r\n":
            del self.held[0]

    def to_header(self) -> None:
        """On to the next record header, or as far as can be seen."""
        while not (found := _HEADER.search(self.held)):
            del self.held[:-10]  # a header's first line may have begun
            if not self.more():
                self.held.clear()
                return
        end = found.start()
        del found  # it holds the buffer
        del self.held[:end]


def _number(text: str | None, digits: int) -> int | None:
    return int(text) if text is not None and re.fullmatch(f"[0-9]{{1,{digits}}}", text) else None


def _record_at(reader: _Reader) -> dict | None:
    """The record that starts here, taken from the reader; None if it is damaged, and then taken in part."""
    if not reader.sees(5) or not reader.held.startswith(b"WARC/") or reader.line() is None:
        return None
    fields = {}
    while True:
        if reader.sees(7) and reader.held.startswith(b"WARC/1."):
            return None  # the header breaks off and another record follows
        line = reader.line()
        if line is None:
            return None
        text = line.decode(errors="replace").rstrip("\r\n")
        if not text:
            break
        name, _, value = text.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = _number(fields.get("content-length", "0"), 18)
    if length is None or (not reader.sees(length + 64) and len(reader.held) < length):
        return None
    after = bytes(reader.held[length : length + 64])
    rest = after.lstrip(b"\r\n")
    if rest and not after.startswith(_BETWEEN) and not rest.startswith(b"WARC/"):
        return None  # the length does not lead to the record's end
    block = bytes(memoryview(reader.held)[:length])
    del reader.held[:length]
    given = [fields.get("warc-segment-number"), fields.get("warc-segment-total-length")]
    number, total = _number(given[0], 9), _number(given[1], 18)
    if any(text is not None and n is None for text, n in zip(given, (number, total), strict=True)):
        return None
    return {
        "record_id": fields.get("warc-record-id"),
        "row": fields.get("warc-page-row"),
        "type": fields.get("warc-type"),
        "origin": fields.get("warc-segment-origin-id") or (fields.get("warc-record-id") if number is not None else None),
        "segment": number,
        "total": total,
        "uri": fields.get("warc-target-uri"),
        "digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
        "refers_to": fields.get("warc-refers-to"),
        "block": block,
    }


def _parse(pieces: Iterator[bytes | None]) -> Iterator[dict]:
    """The sound records of an archive, by their content lengths, and one row of type ``damaged`` for each stretch between
    them that is none. A record that a damaged stretch quotes counts as one."""
    reader, hurt = _Reader(pieces), False
    while True:
        reader.skip_breaks()
        over = not reader.held
        if over and not reader.cut:
            return
        record = None if over else _record_at(reader)
        if record is None:
            if not hurt:
                yield dict.fromkeys(_NAMES) | {"type": DAMAGED}
            if not over:
                reader.to_header()
            if not reader.held and reader.cut:
                reader.go_on()
        else:
            yield record
        hurt = record is None


def _batched(rows: Iterator[dict], schema: pa.Schema, sized: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized] or b"")
        if size > _BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, continuation records as they are, and a row of type ``damaged`` per
    damaged stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for raw in batch.column("content"):
                    yield from _parse(_inflated(memoryview(raw.as_buffer())))

        yield from _batched(rows(), _arrow(RECORD), "block")

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per whole record: ``records`` with segments joined, and ``complete``.

    Segments are grouped by their origin and ordered by number; a number that comes again is ignored.
    ``complete`` is false if a number is missing, the total length is not stated, or the lengths do not add up to it, and
    for damaged stretches.
    """
    schema = RECORD + ", complete boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and (held[0]["origin"], held[0]["row"]) != (row["origin"], row["row"]):
                        yield _joined(held)
                        held = []
                    if not held or held[-1]["segment"] != row["segment"]:
                        held.append(row)
            if held:
                yield _joined(held)

        yield from _batched(rows(), _arrow(schema), "block")

    parts = records.where("segment is not null").repartition("origin", "row").sortWithinPartitions("origin", "row", "segment")
    whole = records.where("segment is null").withColumn("complete", ~F.col("type").eqNullSafe(DAMAGED))
    return whole.unionByName(parts.mapInArrow(run, schema))


def _joined(parts: list[dict]) -> dict:
    block = b"".join(p["block"] for p in parts)
    in_order = [p["segment"] for p in parts] == list(range(1, len(parts) + 1))
    return parts[0] | {"complete": in_order and parts[-1]["total"] == len(block), "block": block, "total": parts[-1]["total"]}


def payloads(records: DataFrame) -> DataFrame:
    """``records`` without their blocks, with ``payload`` (binary): the body of the HTTP message, transfer framing taken off.

    Null for incomplete records, broken framing and revisits.
    """
    schema = "record_id string, type string, uri string, digest string, refers_to string, complete boolean, payload binary"
    names = ["record_id", "type", "uri", "digest", "refers_to", "complete"]

    def body(block: bytes) -> bytes | None:
        head, _, rest = block.partition(b"\r\n\r\n")
        fields = dict(line.split(b":", 1) for line in head.lower().split(b"\r\n")[1:] if b":" in line)
        return dechunked(rest) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(*[batch.column(c).to_pylist() for c in ("type", "complete", "block")], strict=True)
            found = [body(block) if kind == "response" and ok else None for kind, ok, block in own]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(found, pa.binary())], [*names, "payload"])

    return records.mapInArrow(run, schema)


def _id(name: str) -> Column:
    return F.regexp_extract(name, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def archived(pages: DataFrame, least: int = LEAST, segment: int = SEGMENT) -> DataFrame:
    """One row per page, read back from archives written for it: page_id, payload_bytes, payload_digest, record_type,
    refers_to, verified.

    ``verified``: all segments were there, and the payload has the digest that its record states; a
    revisit, that the response it refers to has its digest. Its size is that response's.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least, segment)
    found = payloads(reassemble(read_records(spark, path)))
    measured = found.select(
        _id("record_id").alias("page_id"), F.col("type").alias("record_type"), F.col("digest").alias("stated"),
        _id("refers_to").alias("refers_to"), F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"), "complete",
    )
    measured = written(measured, "read-back").withColumn("found", _base32("sha1"))
    responses = measured.where("record_type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("found").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"), F.coalesce(F.col("complete") & (F.col("found") == F.col("stated")), F.lit(False)).alias("verified"),
    )
    target = responses.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = measured.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "stated")
    revisits = revisits.join(target, ["refers_to", "stated"], "left")
    revisits = revisits.select(
        "page_id", "payload_bytes", F.col("stated").alias("payload_digest"), "record_type", "refers_to", F.col("payload_bytes").isNotNull().alias("verified")
    )
    return responses.unionByName(revisits)


def _base32(hexed: str) -> Column:
    """Base-32 text of a SHA-1 in hexadecimal: eight groups of 20 bits, four letters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def letter(i: Column) -> Column:
        bits = F.conv(F.substr(hexed, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("long")
        place = F.floor(bits / F.element_at(F.array(*[F.lit(32**k) for k in (3, 2, 1, 0)]), (i % 4 + 1).cast("int"))) % 32
        return F.substr(letters, (place + 1).cast("int"), F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")
