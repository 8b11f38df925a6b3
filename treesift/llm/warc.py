"""WARC archives in Zstandard: a writer, and a reader that checks what it reads.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, then has one Zstandard frame for
each record. Spark's own text writer stores the frames, so archives go through Spark's output committer to any file system
it knows, and a task that runs again replaces its files. A row is a run of frames of about UNIT bytes; the line separator
is an empty skippable frame, which decoders pass over. Each row stands for UNIT bytes: a longer one is followed by empty
rows, and one that doesn't fit into the UNITS rows of an archive starts the next, so that an archive has UNIT * UNITS bytes at most, or
one longer record. This rests on Spark writing a string's bytes as they are; every round trip of the tests checks that.

Rows: a null payload is empty. Records with equal payloads of at least `min_revisit_bytes` bytes are grouped by SHA-1;
the largest id is the response, the others revisit it. Rows repeated with the same id and payload count as that one
record. Payloads below the bound, and rows without an id, are all responses. An empty table gives no archive and no row;
other columns of the input are not read.

The reader takes any archive of WARC 1.0 or 1.1: all record types, ids of any kind, folded header lines, HTTP messages
(whose payload follows their own headers). WarcError is raised for a malformed frame, header, length, date or digest, a
header given twice, and a revisit that doesn't say what it revisits.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.llm.common import checkpointed, id_field, shared_dir, ship

DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
#: Bytes that a row of an archive stands for, and rows of an archive.
UNIT, UNITS = 4 << 20, 16
#: Shared payloads up to which their digests are sent to all executors; beyond, those of at least 1 / HEAVY of the rows are, at most HEAVY.
BROADCAST_ROWS, HEAVY = 200_000, 10_000
#: The dictionary is trained on the first so many payloads that Spark returns, cut to so many characters each; it only affects size.
SAMPLE_PAYLOADS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 16_384, 65_536
DATE = "2024-01-01T00:00:00Z"
_STEP = 1 << 16


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has an empty block, and names its payload's length and digest."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


_DATE = re.compile(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?Z)?)?)?")
_NAME = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_URI = re.compile(r"<[^<>\s]+>|[^<>\s]+")
_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def parse_headers(head: bytes) -> dict[str, str]:
    """Header lines (without the version) by lower-case name; a line that starts with a blank continues the one before. Only WARC-Concurrent-To may come again, and is joined by commas."""
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError("a header is not UTF-8") from e
    headers: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t"):
            if not name:
                raise WarcError("a continued line without a header")
            headers[name] = f"{headers[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not _NAME.fullmatch(name):
            raise WarcError(f"bad header line {line[:40]!r}")
        name, value = name.lower(), value.strip()
        if name in headers and name != "warc-concurrent-to":
            raise WarcError(f"{name} is given twice")
        headers[name] = f"{headers[name]}, {value}" if name in headers else value
    return headers


def _number(headers: dict[str, str], name: str) -> int:
    if not re.fullmatch(r"[0-9]{1,18}", headers[name]):
        raise WarcError(f"{name} is no number")
    return int(headers[name])


def _check_digest(said: str, data: bytes, what: str) -> None:
    """Compares with a digest `algorithm:value`, in base32 or hexadecimal; algorithms that Python lacks are not checked."""
    algorithm, colon, value = said.partition(":")
    if not colon or not value:
        raise WarcError(f"the {what}'s digest has no value")
    if algorithm.lower() not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return
    own = hashlib.new(algorithm.lower(), data, usedforsecurity=False)
    if value.upper().rstrip("=") not in (base64.b32encode(own.digest()).decode().rstrip("="), own.hexdigest().upper()):
        raise WarcError(f"the {what}'s digest differs")


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, bool]:
    """The payload in a record's block, and whether it is there as it was digested: an HTTP message's body may be in a transfer encoding."""
    if not headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        return block, True
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of the HTTP headers")
    return body, not re.search(rb"\r\ntransfer-encoding[ \t]*:", head, re.I)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of the one record in a frame; WarcError where a header, a length or a digest is wrong."""
    version, gap, rest = raw.partition(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"unknown version {version[:20]!r}")
    head, end, block = rest.partition(b"\r\n\r\n")
    if not gap or not end:
        raise WarcError("no end of headers")
    headers = parse_headers(head)
    for name in _REQUIRED:
        if not headers.get(name):
            raise WarcError(f"{name} is missing")
    for name in ("warc-record-id", "warc-refers-to"):
        if name in headers and not _URI.fullmatch(headers[name]):
            raise WarcError(f"{name} is no URI")
    if not _DATE.fullmatch(headers["warc-date"]):
        raise WarcError("warc-date is no date")
    length = _number(headers, "content-length")
    if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
        raise WarcError(f"content-length is {length}, the block has {len(block) - 4} bytes")
    block = block[:length]
    if "warc-block-digest" in headers:
        _check_digest(headers["warc-block-digest"], block, "block")
    if headers["warc-type"] == "revisit":
        if "warc-profile" not in headers or not {"warc-refers-to", "warc-refers-to-target-uri"} & headers.keys():
            raise WarcError("a revisit has no profile or target")
        if "warc-payload-length" in headers:
            _number(headers, "warc-payload-length")
    elif "warc-segment-number" not in headers and {"warc-payload-digest", "warc-payload-length"} & headers.keys():
        payload, as_digested = payload_of(headers, block)
        if "warc-payload-length" in headers and _number(headers, "warc-payload-length") != len(payload):
            raise WarcError("the payload has another length")
        if "warc-payload-digest" in headers and as_digested:
            _check_digest(headers["warc-payload-digest"], payload, "payload")
    return headers, block


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_frames(source: io.BufferedIOBase) -> Iterator[bytes]:
    """The decoded frames of an archive; holds one frame and one step of input at a time."""
    import zstandard

    decoder, held, first = zstandard.ZstdDecompressor(), b"", True
    while True:
        while len(held) < 8 and (more := source.read(_STEP)):
            held += more
        if not held:
            return
        if len(held) < 8:
            raise WarcError("the archive ends inside a frame's head")
        magic, size = struct.unpack_from("<II", held)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            while len(held) < 8 + size and (more := source.read(max(_STEP, 8 + size - len(held)))):
                held += more
            if len(held) < 8 + size:
                raise WarcError("the archive ends inside a skippable frame")
            body, held = held[8 : 8 + size], held[8 + size :]
            if magic == DICTIONARY_MAGIC and first:
                if body[:4] == b"\x28\xb5\x2f\xfd":
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            first = False
            continue
        first, one, parts = False, decoder.decompressobj(), []
        try:
            while not one.eof:
                if not held and not (held := source.read(_STEP)):
                    raise WarcError("the archive ends inside a record's frame")
                step, held = held[:_STEP], held[_STEP:]
                parts.append(one.decompress(step))
                if one.eof:
                    held = one.unused_data + held
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        yield b"".join(parts)


def train_dictionary(df: DataFrame, payload: str) -> bytes:
    """A Zstandard dictionary of at most DICTIONARY_BYTES, b'' where the sample is too small for one."""
    import zstandard

    rows = df.select(F.substring(F.col(payload), 1, SAMPLE_CHARS).alias("x")).limit(SAMPLE_PAYLOADS).collect()
    sample = [r.x.encode() for r in rows if r.x]
    if len(sample) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 8), sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_revisits(rows: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """rows(id, url, payload) with refers_to, null for responses.

    (digest, id) are grouped with a partial aggregate. The digests that several ids have are sent to all executors while
    they are few, and no payload is shuffled. Beyond that, those that very many rows have are, whose number is bounded;
    the others are joined by digest, where none makes a hot task.
    """
    digested = rows.withColumn("digest", F.when((F.octet_length("payload") >= min_revisit_bytes) & F.col("id").isNotNull(), F.unhex(F.sha1(F.col("payload").cast("binary")))))
    by_digest = digested.where("digest is not null").groupBy("digest").agg(F.max("id").alias("last"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    shared = checkpointed(by_digest.where("least < last").select(F.col("digest").alias("s_digest"), "last", "n"))
    n_shared, n_rows = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def joined(df: DataFrame, of: DataFrame, name: str) -> DataFrame:
        return df.join(of.select("s_digest", F.col("last").alias(name)), F.col("digest") == F.col("s_digest"), "left").drop("s_digest")

    if n_shared <= BROADCAST_ROWS:
        found = joined(digested, F.broadcast(shared), "last")
    else:
        least = n_rows / HEAVY
        heavy = joined(digested, F.broadcast(shared.where(F.col("n") >= least)), "h_last")
        # rows of heavy digests are done; they spread by id
        key = F.when(F.col("h_last").isNull(), F.col("digest")).otherwise(F.unhex(F.sha1(F.col("id").cast("string").cast("binary"))))
        found = joined(heavy.withColumn("digest", key), shared.where(F.col("n") < least), "l_last").withColumn("last", F.coalesce("h_last", "l_last"))
    return found.select("id", "url", "payload", F.when(F.col("id") < F.col("last"), F.col("last")).alias("refers_to"))


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write a record for every row to archives in `path`."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    whole = with_revisits(rows, min_revisit_bytes)
    dictionary = train_dictionary(rows, "payload")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from treesift.llm.warc import archive_rows, record

        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        encoder = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **known)
        made = (encoder.compress(record(page, url, payload.encode(), refers)) for b in batches for page, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for row in archive_rows(made, dictionary):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["frame"])

    made = whole.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    made.write.option("lineSep", EMPTY_FRAME.decode("latin-1")).option("maxRecordsPerFile", UNITS).text(path)


def archive_rows(frames: Iterator[bytes], dictionary: bytes, unit: int = UNIT, units: int = UNITS) -> Iterator[bytes]:
    """Rows of frames; every `units` of them are an archive, whose first row starts with the dictionary."""
    head, held, size, at = dictionary_frame(dictionary) if dictionary else b"", [], 0, 0

    def row(parts: list[bytes]) -> Iterator[bytes]:
        nonlocal at
        body = b"".join(parts)
        need = min(units, max(1, -(-len(body) // unit)))
        while at % units and at % units + need > units:
            yield b""
            at += 1
        yield head + body if at % units == 0 else body
        yield from [b""] * (need - 1)
        at += need

    for f in frames:
        if held and size + len(f) > unit:
            yield from row(held)
            held, size = [], 0
        held.append(f)
        size += len(f)
    if held:
        yield from row(held)


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, record_id, url, record_type, refers_to, refers_to_id, payload_bytes, payload_digest, block) of every record in the archives in `path`.

    page_id and refers_to are the numbers of ids `urn:page:N`, null for others. The digest is that of the headers without
    its algorithm, or the payload's SHA-1; payload_bytes is null for a revisit that doesn't say it.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = f"page_id {id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}, url string, block binary, record_id string, refers_to_id string"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treesift.llm.warc import digest, parse_record, payload_of, read_frames

        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "block": pa.binary(), "record_id": pa.string(), "refers_to_id": pa.string()}

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

        def number(uri: str) -> int | None:
            name = uri.removeprefix("urn:page:")
            return int(name) if name != uri and re.fullmatch(r"-?[0-9]{1,18}", name) else None

        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for raw in read_frames(pa.BufferReader(content.as_buffer())):
                    h, block = parse_record(raw)
                    own, target = h["warc-record-id"].strip("<>"), h.get("warc-refers-to", "").strip("<>")
                    said, known = h.get("warc-payload-digest", "").partition(":")[2], h.get("warc-payload-length")
                    payload = b"" if h["warc-type"] == "revisit" else payload_of(h, block)[0]
                    size = int(known) if known else None if h["warc-type"] == "revisit" else len(payload)
                    rows.append((number(own), size, said or digest(payload), h["warc-type"], number(target), h.get("warc-target-uri"), block, own, target or None))
                    held += len(block)
                    if held > 4 << 20 or len(rows) == 2000:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    return files.mapInArrow(records, schema)


def warc_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archives written to the shared folder and read back."""
    if id_field(df, id_col) != "bigint":
        df = df.withColumn(id_col, F.col(id_col).cast("bigint"))
    path = f"{shared_dir(df.sparkSession)}/warc"
    write_archives(df, path, id_col, url_col, payload_col)
    return read_archives(df.sparkSession, path)
