"""WARC archives compressed with Zstandard: one frame per record, the dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or
itself a Zstandard frame; each record follows as a frame of its own. The writer goes through Spark's
text writer, whose commit keeps lost or repeated tasks out and which reaches any store Spark can
write: every row is one frame, and the "line separator" is an empty skippable frame (eight bytes of
plain ASCII), which any Zstandard reader passes over. The reader gets whole archives from Spark's
binary file source and checks frames, headers, lengths and digests. A task starts a new archive, with a
dictionary of its own, after a number of frames or of bytes; the text writer starts files by rows, so an
archive that reached its bytes first is filled up with empty skippable frames (eight bytes each).

Payloads travel once, to the id their digest is first seen under. Digests that hold over one in
``HOT_SHARE`` of the repeated pages, fewer than that many, are looked up by a broadcast, and their rows
are dealt by id, so a payload that most pages share is no hot key.

Defined results: a null payload is empty; a null url or id leaves its header away; of rows with equal
payloads and the same least id, each is a response; an empty table writes no record; damaged archives
raise, or (``on_error="report"``) give a row with ``error`` set for the place that cannot be read. A
payload of any length that fits a cell is one record in one frame; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain, islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICT_MAGIC = 0xEC30A437
#: An empty skippable frame (magic 0x184D2A50, length 0): ASCII bytes only, so Spark takes it as a separator.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payload bytes the dictionary is trained on, per archive; the dictionary's size.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 * 1024 * 1024, 32 * 1024
#: At most this many digests are broadcast: those of more than one in so many repeated pages.
HOT_SHARE = 10_000


def sha1_base32(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url)


def record(kind: str, page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record: header, block and closing lines. A revisit's block has no payload."""
    block = _HTTP + (payload if kind == "response" else b"")
    head = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Date: " + date.encode()]
    add = lambda name, value: head.append(f"{name}: {value}".encode())
    add("WARC-Record-ID", "<urn:x-page:%s>" % ("none" if page_id is None else page_id))
    if url is not None:
        add("WARC-Target-URI", _uri(url))
    if kind == "revisit":
        add("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        add("WARC-Refers-To", f"<urn:x-page:{refers_to}>")
    add("Content-Type", "application/http; msgtype=response")
    add("WARC-Block-Digest", "sha1:" + sha1_base32(block))
    add("WARC-Payload-Digest", "sha1:" + digest)
    add("X-Payload-Length", len(payload))
    add("Content-Length", len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample records, or none if they are too few or too alike to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def parse(raw: bytes) -> dict:
    """A record's headers and payload; ``ValueError`` if header, lengths or digests are wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("record header does not end")
    version, *lines = head.split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("record does not begin with a WARC version")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError("malformed header line")
        key = name.decode("utf-8", "replace").lower()
        if key in headers and key in ("content-length", "warc-type", "warc-record-id", "warc-date"):
            raise ValueError(f"header repeated: {key}")
        headers[key] = value.strip().decode("utf-8", "replace")
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in headers:
            raise ValueError(f"header missing: {needed}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length and record length differ")
    block = rest[:n]
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        _, end, payload = block.partition(b"\r\n\r\n")
        if not end:
            raise ValueError("HTTP header does not end")
    check = [("warc-block-digest", block)] + [("warc-payload-digest", payload)] * (headers["warc-type"] != "revisit")
    for name, content in check:
        if headers.get(name, "").startswith("sha1:") and headers[name][5:] != sha1_base32(content):
            raise ValueError(f"{name} does not match")
    return {"headers": headers, "payload": payload}


def frames(archive: memoryview):
    """(offset, record bytes) of each record frame; ``ValueError`` with the offset for a damaged place."""
    at, dictionary, first = 0, None, True
    engine = zstandard.ZstdDecompressor()
    while at < len(archive):
        if len(archive) - at < 4:
            raise ValueError(f"{at}: trailing bytes")
        (magic,) = struct.unpack_from("<I", archive, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # skippable
            if len(archive) - at < 8:
                raise ValueError(f"{at}: truncated skippable frame")
            (n,) = struct.unpack_from("<I", archive, at + 4)
            if at + 8 + n > len(archive):
                raise ValueError(f"{at}: truncated skippable frame")
            if magic == DICTIONARY_MAGIC:
                if not first:
                    raise ValueError(f"{at}: a dictionary that is not in front")
                content = bytes(archive[at + 8:at + 8 + n])
                if content[:4] == struct.pack("<I", FRAME_MAGIC):
                    content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 27)
                if content:
                    if content[:4] != struct.pack("<I", DICT_MAGIC):
                        raise ValueError(f"{at}: the leading frame holds no dictionary")
                    dictionary = zstandard.ZstdCompressionDict(content)
                    engine = zstandard.ZstdDecompressor(dict_data=dictionary)
            at += 8 + n
            first = False
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"{at}: no Zstandard frame")
        first = False
        begun, unpack, out = at, engine.decompressobj(), []
        try:
            used = zstandard.get_frame_parameters(archive[at:at + 18]).dict_id
            if used and (dictionary is None or used != dictionary.dict_id()):
                raise ValueError(f"{begun}: the frame needs dictionary {used}")
            while not unpack.eof:
                if at >= len(archive):
                    raise ValueError(f"{begun}: truncated frame")
                out.append(unpack.decompress(archive[at:at + 16384]))
                at = min(len(archive), at + 16384)
            at -= len(unpack.unused_data)
        except zstandard.ZstdError as e:
            raise ValueError(f"{begun}: {e}") from None
        yield begun, b"".join(out)


def _referred(rows: DataFrame, min_payload_bytes: int) -> DataFrame:
    """``rows`` (page_id, url, payload, digest) with ``refers_to``, null for a response."""
    large = F.octet_length("payload") >= min_payload_bytes
    # ids and digests only; combined within each task
    repeated = stored(rows.where(large).groupBy("digest").agg(F.min("page_id").alias("least_id"), F.count("*").alias("n"))
                      .where("n > 1"), "repeated")
    share = repeated.agg(F.sum("n")).first()[0] or 0
    hot = repeated.where(F.col("n") * HOT_SHARE > share).select("digest", F.struct("least_id").alias("hot"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    spread = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))  # equals no digest
    cold = repeated.where(F.col("n") * HOT_SHARE <= share).select(F.col("digest").alias("at"), F.col("least_id").alias("cold_id"))
    rows = rows.withColumn("at", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(spread)).join(cold, "at", "left")
    least = F.coalesce(F.col("hot.least_id"), F.col("cold_id"))
    revisit = large & least.isNotNull() & ~F.col("page_id").eqNullSafe(least)
    return rows.select("page_id", "url", "payload", F.when(revisit, least).alias("refers_to"))


def archives_of(records, level: int, archive_rows: int, archive_bytes: int):
    """Lists of frames, an archive each: dictionary, records, and padding if the bytes end it before the rows."""
    records = iter(records)
    while True:
        head, size = [], 0
        for r in islice(records, archive_rows - 1):  # the first records train the dictionary
            head.append(r)
            size += len(r)
            if size >= min(SAMPLE_BYTES, archive_bytes):
                break
        if not head:
            return
        dictionary = train(head)
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        pack = zstandard.ZstdCompressor(level=level, write_checksum=True, **options).compress
        batch = [skippable(dictionary)]
        rows, size, whole = 1, len(batch[0]), 0
        for r in chain(head, records):
            batch.append(pack(r))
            rows, size = rows + 1, size + len(batch[-1])
            if size >= 1 << 20:
                yield batch
                batch, size, whole = [], 0, whole + size
            if rows == archive_rows:
                break
            if rows > len(head) and whole + size >= archive_bytes:
                batch += [b""] * (archive_rows - rows)
                break
        if batch:
            yield batch


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_payload_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
                   level: int = 3, archive_rows: int = 16_384, archive_bytes: int = 256 << 20) -> None:
    """One record per row, into archives under ``path``; each task writes its own.

    An archive has at most ``archive_rows`` frames, dictionary included, and takes no record after
    ``archive_bytes`` (but always those its dictionary was trained on, some 2 MB). Of the rows with
    equal payloads of at least ``min_payload_bytes``, that with the least id is a response and the
    others revisit it.
    """
    if archive_rows < 2:
        raise ValueError("archive_rows is 2 at least: the dictionary and a record")
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = _referred(rows.withColumn("digest", F.sha1("payload")), min_payload_bytes)

    def run(batches):
        records = (record("response" if to is None else "revisit", i, url, body, sha1_base32(body), to, date)
                   for batch in batches
                   for i, url, body, to in zip(*[c.to_pylist() for c in batch.columns]))
        for batch in archives_of(records, level, archive_rows, archive_bytes):
            yield pa.RecordBatch.from_pydict({"frame": pa.array(batch, pa.binary())})

    frames_ = rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    # frames and files must fall together, so the writer gets the rows in the order of the task
    frames_.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", archive_rows).text(path)


def read_archives(spark: SparkSession, path: str, *, on_error: str = "raise", payload: bool = True) -> DataFrame:
    """One row per record: archive, offset, headers, payload, payload_bytes, payload_digest, error."""
    if on_error not in ("raise", "report"):
        raise ValueError("on_error is 'raise' or 'report'")
    schema = ("archive string, offset long, headers map<string,string>, payload binary, payload_bytes long, "
              "payload_digest string, error string")
    types = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = ["archive", "offset", "headers", "payload", "payload_bytes", "payload_digest", "error"]

    def rows_of(name, archive):
        at = 0
        try:
            for at, raw in frames(memoryview(archive)):
                got = parse(raw)
                h, body = got["headers"], got["payload"]
                revisit = h["warc-type"] == "revisit"
                n = int(h.get("x-payload-length", len(body))) if revisit else len(body)
                digest = h.get("warc-payload-digest", "")[5:] if revisit else sha1_base32(body)
                yield (name, at, list(h.items()), body if payload else None, n, digest, None)
        except ValueError as e:
            if on_error == "raise":
                raise ValueError(f"{name}, record at {at}: {e}") from None
            yield (name, at, None, None, None, None, str(e))

    def run(batches):
        for batch in batches:
            for name, archive in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for r in rows_of(name.as_py(), archive.as_buffer()):
                    rows.append(r)
                    size += len(r[3] or b"") + 500
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")
    return files.mapInArrow(run, schema)


def page_records(records: DataFrame) -> DataFrame:
    """The digest columns of records written by ``write_archives``."""
    number = lambda name: F.regexp_extract(F.col("headers")[name], r"^<urn:x-page:(-?\d+)>$", 1)
    as_long = lambda name: F.nullif(number(name), F.lit("")).cast("long")
    return records.select(as_long("warc-record-id").alias("page_id"), "payload_bytes", "payload_digest",
                          F.col("headers")["warc-type"].alias("record_type"), as_long("warc-refers-to").alias("refers_to"))
