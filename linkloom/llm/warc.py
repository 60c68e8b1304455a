"""WARC archives in Zstandard: a writer with revisit records, and a validating reader.

An archive is a skippable frame that holds a dictionary (left out if none could be trained), then
one Zstandard frame with checksum and content size per record. Pages with equal payloads of at
least ``LEAST`` bytes share one response, that of the smallest page id; the others are revisits,
whose blocks are only the HTTP head. Which is which comes from SHA-256 digests: groups are
pre-aggregated to their least id, and only those of two or more pages are joined back, against a
written table, so that Spark can broadcast it when small and split a hot digest when not.

The reader walks the frame's block headers to find its end, decodes exactly one record from it,
and checks version, required headers, content length, the closing blank lines, the HTTP length and,
for responses, the payload's digest; a fault raises ``WarcError`` with its place.

Defined cases: null html is an empty payload; a null url has no target header and control
characters in urls are percent-encoded; rows that repeat the smallest page id of a group are all
responses; a null page id is written without id and revisits a group's least id if there is one;
an empty table gives no archive; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import files
from linkloom.llm.store import Tables, new_path

LEAST, DICT_MAGIC, FRAME_MAGIC = 100, 0x184D2A5D, 0xFD2FB528
SAMPLE, SAMPLE_BYTES, DICT_BYTES = 200, 4 << 20, 32 << 10
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs in RFC 4122


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def _urn(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """The bytes of one record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page, digest)}", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers, digest)}", f"WARC-Refers-To-Page: {refers}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples) if len(samples) > 8 else None
    except zstandard.ZstdError:  # too little text for a dictionary
        return None


def write_archive(out, records: Iterator[bytes]) -> int:
    """Write records to a stream; the dictionary is trained on the first of them. Returns their number."""
    first, held = [], 0
    for x in records:
        first.append(x)
        held += len(x)
        if len(first) >= SAMPLE or held >= SAMPLE_BYTES:
            break
    known = _trained(first)
    if known:
        out.write(struct.pack("<II", DICT_MAGIC, len(known.as_bytes())) + known.as_bytes())
    packer = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True)
    n = 0
    for part in (first, records):
        for x in part:
            out.write(packer.compress(x))
            n += 1
    return n


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame that begins at this place, from its block headers."""
    try:
        head = bytes(data[at : at + 18])
        end = at + zstandard.frame_header_size(head)
        checksum = zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        raise WarcError(f"no frame at byte {at}: {e}") from e
    last = False
    while not last:
        if end + 3 > len(data):
            raise WarcError(f"frame at byte {at} is cut off")
        word = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(word & 1), word >> 1 & 3, word >> 3
        if kind == 3:
            raise WarcError(f"frame at byte {at} has a block of unknown kind")
        end += 3 + (1 if kind == 1 else size)
    end += 4 * checksum
    if end > len(data):
        raise WarcError(f"frame at byte {at} is cut off")
    return end - at


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of exactly one record."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not blank or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name} header")
    if not headers["content-length"].isdecimal() or int(headers["content-length"]) != len(rest) - 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError("content length and record length differ")
    return headers, rest[:-4]


def read_archive(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, validated."""
    at, known = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(data[8 : 8 + size])
        if len(raw) != size:
            raise WarcError("the dictionary is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        at, known = 8 + size, zstandard.ZstdCompressionDict(raw)
    unpacker = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(data):
        length = frame_length(data, at)
        try:
            yield parse_record(unpacker.decompress(data[at : at + length], allow_extra_data=False))
        except (zstandard.ZstdError, WarcError, UnicodeDecodeError) as e:
            raise WarcError(f"record at byte {at}: {e}") from e
        at += length


def page_of(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page id, payload bytes, payload digest, record type, page referred to) of a record, checked."""
    http, blank, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\ncontent-length: *(\d+)", http, re.I)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if not blank or not length or not re.fullmatch("[0-9a-f]{64}", digest):
        raise WarcError("no HTTP head or payload digest")
    kind = headers["warc-type"]
    if kind == "response":
        if int(length[1]) != len(payload) or hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("payload and its length or digest differ")
    elif kind != "revisit" or payload or "warc-refers-to" not in headers:
        raise WarcError(f"not a response nor a revisit: {kind}")
    number = lambda name: int(headers[name]) if name in headers else None
    return number("warc-page-id"), int(length[1]), digest, kind, number("warc-refers-to-page")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as archives below folder; (archive, records) of each."""
    files.make_dir(folder)
    tables = Tables(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = tables.write(groups.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "shared")
    typed = rows.join(shared, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for digest, page, url, payload, first, revisit in zip(*(batch.column(k) for k in range(6)), strict=True):
                    yield record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), first.as_py(), revisit.as_py())

        made = records()
        one = [x for x in (next(made, None),) if x is not None]
        if one:
            with files.writer(folder, "pages.warc.zst") as (uri, out):
                n = write_archive(out, _chain(one, made))
            yield pa.record_batch([pa.array([uri]), pa.array([n], pa.int64())], ["archive", "records"])

    return tables.write(typed.select("digest", "page_id", "url", "payload", "first", "revisit").mapInArrow(run, "archive string, records long"), "archives")


def _chain(one: list[bytes], rest: Iterator[bytes]) -> Iterator[bytes]:
    yield from one
    yield from rest


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for uri, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                for headers, block in read_archive(memoryview(files.whole(uri))):
                    rows.append(page_of(headers, block))
                    seen += 1
                    if len(rows) == 5000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if seen != n:
                    raise WarcError(f"{uri} has {seen} records instead of {n}")
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    n = archives.count()  # rows of a small written table; a given number of partitions isn't coalesced, so each archive has its own task
    return archives.repartitionByRange(max(n, 1), "archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_digests(pages: DataFrame) -> DataFrame:
    """Write pages to archives below the shared folder, read the archives back."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc")))
