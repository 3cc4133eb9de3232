"""WARC archives in Zstandard: one frame per record, the dictionary in the leading skippable frame.

Records are built and compressed inside tasks; each task cuts its rows into
archives of about `archive_bytes`, and Spark's own text writer puts one archive
into one file on whatever store the shared folder is in.  (The writer needs a
separator after each row; an empty skippable frame serves, which readers skip.)
Reading takes whole files as binary rows and decodes them inside tasks.

Equal payloads of at least `least_bytes` are stored once: the smallest page_id is
the response, others are revisits that name it.  Only digests meet in that step,
never payloads.

Edge cases: null html is an empty payload; null page_id is written as `null`,
sorts after all numbers and reads back as null; rows that repeat the smallest
page_id of their payload are responses too; null urls leave the target header
out, and control characters in urls are percent-encoded; a damaged record gives a
row with `error` and does not stop the rest where its frame's end is known; an
empty table gives no archive and an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textbatch as tb
from quern.llm.scratch import new_path, stored

# The WARC and Zstandard formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_SKIPPABLE = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.0", b"WARC/1.1")
DIGESTS = ("md5", "sha1", "sha256", "sha384", "sha512")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP head, which states the payload's length, and no payload."""
    name = "null" if page_id is None else str(page_id)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """Trained on the archive's first records; the records as such where they are too few to train on."""
    if len(samples) < 2:
        return None
    try:
        if len(samples) >= 16:
            return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], samples: int = 128, size: int = 16384, level: int = 3) -> bytes:
    """The records as frames, behind a skippable frame with their dictionary."""
    made = dictionary([r[:16384] for r in records[:samples]], size)
    out = []
    if made is not None:
        packed = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    press = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True, write_content_size=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame at a place, by its block headers."""
    head = bytes(data[at : at + 18])
    end = at + zstandard.frame_header_size(head)
    checked = zstandard.get_frame_parameters(head).has_checksum
    while True:
        if end + 3 > len(data):
            raise ValueError("frame is cut short")
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
        if block & 1:
            break
    end += 4 * checked
    if end > len(data):
        raise ValueError("frame is cut short")
    return end


def frames(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(record bytes, error) of each frame, decoded with the dictionary of the leading skippable frame."""
    data, at, known = memoryview(content), 0, None
    while at < len(data):
        if at + 8 > len(data):
            yield b"", "bytes after the last frame"
            return
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                yield b"", "skippable frame is cut short"
                return
            if at == 0 and magic == DICTIONARY_MAGIC:
                raw = bytes(data[8 : 8 + size])
                if struct.unpack_from("<I", raw)[0] == FRAME_MAGIC:
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                known = zstandard.ZstdCompressionDict(raw)  # trained or plain content, by its first bytes
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            yield b"", "no frame where one should begin"
            return
        try:
            end = frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as e:
            yield b"", str(e)
            return
        try:
            yield zstandard.ZstdDecompressor(dict_data=known).decompress(data[at:end]), None
        except zstandard.ZstdError as e:
            yield b"", str(e)
        at = end


def _page(urn: str | None) -> int | None:
    """The number in a record id of `record`; None for ids of other writers."""
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _is_digest(stated: str, payload: bytes) -> bool:
    """Whether name:value, in hexadecimal or base32, is the payload's digest; names not known here pass."""
    name, _, value = stated.partition(":")
    name = name.lower().replace("-", "")
    if name not in DIGESTS:
        return True
    made = hashlib.new(name, payload).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def parse(data: bytes) -> dict:
    """The fields of one record; raises ValueError where headers, lengths or digests are wrong.

    Records of other writers pass too: any record id, both versions of the
    format, digests by other functions, bodies without an HTTP head, and record
    types other than response and revisit, whose payload is the whole block.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not gap or lines[0] not in VERSIONS:
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if missing := [f for f in REQUIRED if f not in fields]:
        raise ValueError(f"missing {', '.join(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("block length differs from Content-Length")
    kind, block, stated = fields["warc-type"], rest[:-4], fields.get("warc-payload-digest")
    if "warc-block-digest" in fields and not _is_digest(fields["warc-block-digest"], block):
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if kind not in ("response", "revisit") or not http.startswith(b"HTTP/"):
        http, payload = b"", block
    elif not gap:
        raise ValueError("HTTP head without an end")
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    size = int(length[1]) if length else None
    if kind == "revisit":
        if payload:
            raise ValueError("a revisit with a payload")
        digest = stated.removeprefix("sha256:") if stated else None
    else:
        if size is not None and len(payload) != size:
            raise ValueError("payload length differs from the HTTP head")
        if stated is not None and not _is_digest(stated, payload):
            raise ValueError("payload digest differs")
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return {
        "page_id": _page(fields["warc-record-id"]),
        "record_id": fields["warc-record-id"],
        "url": fields.get("warc-target-uri"),
        "payload": None if kind == "revisit" else payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")) if kind == "revisit" else None,
        "error": None,
    }


_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("error", pa.string())])
_BLANK = dict.fromkeys(_SCHEMA.names)


def write(pages: DataFrame, path: str, archive_bytes: int = 16 << 20, least_bytes: int = 100) -> None:
    """Writes (page_id, url, html) as archives under the path."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"), F.sha2(body, 256).alias("digest"))
    long_ones = pages.where(F.length("payload") >= least_bytes).select("page_id", "digest")
    seen = stored(long_ones, "digests")
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    again = stored(seen.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct(), "revisits")
    rows = pages.join(again, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for k in range(b.num_rows):
                held.append(record(*(b.column(c)[k].as_py() for c in range(5))))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["value"])

    made = tb.in_batches(rows, run, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", EMPTY_SKIPPABLE).option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str, payloads: bool = True, glob: str = "*.{txt,zst}") -> DataFrame:
    """A row per record of the archives under the path: page_id (of ids that `write` gave), record_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to, and error for what fails validation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows, size = [], 0
                for data, error in frames(b.column(0)[k].as_py()):
                    try:
                        row = _BLANK | {"error": error} if error else parse(data)
                    except ValueError as e:
                        row = _BLANK | {"error": str(e)}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += len(data)
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content")
    return tb.in_batches(files, run, "page_id long, record_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, error string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages into the shared folder and reads the archives back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path, payloads=False)
