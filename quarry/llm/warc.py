"""Operator 8: WARC archives compressed with Zstandard, one frame per record, and their reader.

An archive is a file of Zstandard frames.  The first is a skippable frame (magic 0x184D2A5D) that
holds the dictionary of all the others; every other non-skippable frame is one WARC record.  The
reader takes the dictionary from that frame, walks from frame to frame by the block headers,
decodes one at a time, and checks version, header lines, lengths, and block and payload digests.
It reads archives of other writers too: all record types, ids of any form, folded header lines,
SHA-1 digests, responses without an HTTP length.

Spark writes and reads the files itself, in any file system it knows: a record's frame is one row
of the text writer, whose line separator is an empty skippable frame, so a lost task's archive is
written anew under the usual commit protocol; archives are read back by the binary file source.

Records with equal payloads of at least ``min_revisit`` bytes are stored once: the smallest id is a
``response``, all others ``revisit`` it and carry the digest and length of the full payload.

Edge cases: a NULL payload is an empty one.  A record without an id has no record id of its own and
can only revisit; if no copy has an id, all are responses.  Repeated rows of the smallest id are all
responses.  Header values lose line breaks (a URL with one cannot be a header otherwise).  An empty
table gives archives without records.  A damaged archive raises.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.splitjoin import Lookup
from .common import col, written

MIN_REVISIT = 100
#: Payload bytes of an archive, on average; an archive is read by one task.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on about SAMPLE payloads (their first SAMPLE_BYTES) that a hash picks.
SAMPLE, SAMPLE_BYTES, DICT_BYTES = 1000, 16 << 10, 64 << 10
BROADCAST_BYTES = 8 << 20
DICT_MAGIC, SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: An empty skippable frame; its bytes are ASCII, so a text writer can put it between rows.
EMPTY_FRAME = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A header's name (fixed by the format).
TOKEN = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
READ = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
        "record_id string, refers_to_id string, date string, content_type string")


class DamagedArchive(ValueError):
    pass


# ---------------------------------------------------------------- records


def _uri(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def _id(uri: str | None) -> int | None:
    """The page of one of our own record ids."""
    own = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", uri or "")
    return int(own[1]) if own else None


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC record; ``refers_to`` makes it a revisit, whose payload is left out."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: {_uri(page_id)}")
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.splitlines()))
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes], strict: bool = True) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with a space or tab continues the one before.

    HTTP headers are as servers sent them: there (``strict`` false) lines that are none are passed over."""
    whole: list[bytes] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and whole:
            whole[-1] += b" " + line.strip(b" \t")
        else:
            whole.append(line)
    out: dict[str, str] = {}
    for line in whole:
        name, colon, value = line.partition(b":")
        if colon and TOKEN.fullmatch(name):
            try:
                out.setdefault(name.decode().lower(), value.strip(b" \t").decode())
                continue
            except UnicodeDecodeError:
                pass
        if strict:
            raise DamagedArchive(f"not a header line: {line[:80]!r}")
    return out


def _check_digest(said: str | None, data: bytes, what: str) -> None:
    """Raise unless a sha256 or sha1 digest (hexadecimal or base 32) is that of ``data``; other kinds can't be checked."""
    kind, _, value = (said or "").partition(":")
    if kind.lower() not in ("sha256", "sha1"):
        return
    right = hashlib.new(kind.lower(), data)
    if value.lower() != right.hexdigest() and value.upper().rstrip("=") != base64.b32encode(right.digest()).decode().rstrip("="):
        raise DamagedArchive(f"{what} of {len(data)} bytes differs from its digest {said}")


def parse(data: bytes) -> dict:
    """A record's fields, after checking version, header lines, lengths, and digests where they are given.

    ``page_id`` and ``refers_to`` are set for records of ``write_archives``; ids of any form are in
    ``record_id`` and ``refers_to_id``.  The payload is an HTTP response's body, else the whole block;
    a SHA-256 digest is given bare, others with their kind."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise DamagedArchive(f"not a WARC record: {data[:40]!r}")
    h = _headers(lines[1:])
    try:
        kind, length = h["warc-type"], int(h["content-length"])
    except (KeyError, ValueError) as e:
        raise DamagedArchive(f"missing or wrong header: {e}") from e
    if length < 0 or rest[length:] != b"\r\n\r\n":
        raise DamagedArchive(f"{kind} record: {len(rest)} bytes for a block of {length}")
    payload, size, said = rest[:length], None, h.get("warc-payload-digest")
    _check_digest(h.get("warc-block-digest"), payload, "block")
    if kind in ("response", "revisit") and h.get("content-type", "application/http").replace(" ", "").startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        http_headers = _headers(http.split(b"\r\n")[1:], strict=False)
        told = http_headers.get("content-length", "")
        size = int(told) if told.isascii() and told.isdigit() else None
        whole = "warc-truncated" not in h and "transfer-encoding" not in http_headers
        if kind == "response" and whole and size not in (None, len(payload)):
            raise DamagedArchive(f"payload of {len(payload)} bytes differs from its headers ({size})")
    if kind == "revisit":
        if payload or not ("warc-refers-to" in h or "warc-refers-to-target-uri" in h or "warc-profile" in h):
            raise DamagedArchive("a revisit must have no payload, and say what it refers to")
    else:
        size = len(payload)
        _check_digest(said, payload, "payload")
    return {
        "page_id": _id(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": _id(h.get("warc-refers-to")), "payload_bytes": size,
        "payload_digest": said[7:] if said and said.startswith("sha256:") else said, "record_id": h.get("warc-record-id"), "refers_to_id": h.get("warc-refers-to"),
        "date": h.get("warc-date"), "content_type": h.get("content-type"), "payload": payload}


# ---------------------------------------------------------------- frames


def frames(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """Magic, start and end of each frame, from frame and block headers alone."""
    at = 0
    try:
        while at < len(data):
            start, (magic,) = at, struct.unpack_from("<I", data, at)
            if magic & 0xFFFFFFF0 == SKIP_MAGIC:
                at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            elif magic == FRAME_MAGIC:
                flags = data[at + 4]
                single = flags >> 5 & 1
                at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
                last = 0
                while not last:
                    block = int.from_bytes(data[at : at + 3], "little")
                    if at + 3 > len(data):
                        raise DamagedArchive("cut off within a frame")
                    last = block & 1
                    at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
                at += 4 * (flags >> 2 & 1)
            else:
                raise DamagedArchive(f"no frame at byte {at}")
            if at > len(data):
                raise DamagedArchive("cut off within a frame")
            yield magic, start, at
    except (struct.error, IndexError) as e:
        raise DamagedArchive("cut off within a frame header") from e


def records(archive: bytes) -> Iterator[dict]:
    """The records of an archive, one frame decoded at a time."""
    import zstandard

    data = memoryview(archive)
    reader = None
    for magic, start, end in frames(data):
        if magic == DICT_MAGIC and start == 0:
            dictionary = bytes(data[8:end])
            if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):  # it may be compressed itself
                dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else None
        elif magic == FRAME_MAGIC:
            reader = reader or zstandard.ZstdDecompressor()
            try:
                one = reader.decompressobj()
                text = one.decompress(data[start:end])
            except zstandard.ZstdError as e:
                raise DamagedArchive(str(e)) from e
            if not one.eof:
                raise DamagedArchive("cut off within a frame")
            yield parse(text)


# ---------------------------------------------------------------- Spark


def trained_dictionary(payloads: DataFrame, rows: int) -> bytes:
    """A dictionary from a bounded sample of (payload, digest); empty where there is too little to learn from."""
    import zstandard

    every = max(1, rows // SAMPLE)
    picked = payloads.where((F.octet_length("payload") > 0) & (F.pmod(F.xxhash64("digest", F.lit("dictionary")), F.lit(every)) == 0))
    # in the order of the digests, so that a job that runs again trains the same dictionary
    sample = [bytes(r[0]) for r in picked.select(F.substring("payload", 1, SAMPLE_BYTES), "digest").orderBy("digest").limit(4 * SAMPLE).collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One row per page: page_id, url, payload, size, digest, refers_to (NULL for responses)."""
    base = pages.select(
        col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"),
        F.coalesce(col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    groups = base.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("value"), "first", "n"), "warc-repeated")
    # a million copies of one error page don't meet in a task
    found = Lookup(groups.select("value", "first"), groups.select("value", "n"), BROADCAST_BYTES).join(base, F.col("digest"))
    both = found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(base.columns)], "first")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return both.select("page_id", "url", "payload", "size", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", level: int = 3, **columns) -> None:
    """Writes the archives of ``pages`` as files under ``path``."""
    rows = with_revisits(pages, **columns)
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    dictionary = trained_dictionary(rows, total["n"])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packed = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=level, dict_data=packed, write_checksum=True)
        frame = [struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary]
        for batch in batches:
            for r in zip(*[c if c.type == pa.binary() else c.to_pylist() for c in batch.columns]):
                page_id, url, payload, size, digest, refers_to = r
                payload = payload.as_py() if refers_to is None else b""
                frame.append(writer.compress(record(page_id, url, payload, size, digest, refers_to, date)))
            yield pa.RecordBatch.from_arrays([pa.array(frame, pa.binary())], ["value"])
            frame = []

    archives = max(1, -(-(total["b"] or 0) // ARCHIVE_BYTES))
    stored = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    out = stored.repartition(archives).mapInArrow(compress, "value binary")
    out.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``, of all types; ``payload`` adds the stored payloads (NULL for revisits)."""
    schema = READ + (", payload binary" if payload else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        kinds = pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])
        for batch in batches:
            for archive in batch.column(0):
                found: list[dict] = []
                held = 0
                for r in records(archive.as_buffer()):
                    held += len(r["payload"])
                    if not payload:
                        del r["payload"]
                    elif r["record_type"] == "revisit":
                        r["payload"] = None
                    found.append(r)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(found, kinds)
                        found, held = [], 0
                yield pa.RecordBatch.from_pylist(found, kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, schema)
