"""Web archives (WARC 1.1) with dictionary compression, written and read by Spark tasks.

Each task writes archives of its own: it trains a Zstandard dictionary on the
first records it is to archive, puts it in a skippable frame at the head of the
file, and compresses each record as a frame of its own with it, so that any
record can be read alone. Payloads that occur more than once are stored in the
record with the largest page id; the others become revisit records. Archives
are closed at ARCHIVE_BYTES and have names that no other attempt uses; only those
of attempts that Spark has committed are listed in the index and read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.rows import only
from lexmill.operators.joins import Lookup
from lexmill.storage import materialize, scratch_path

# Equal payloads below this size are all stored.
LEAST_PAYLOAD = 1000
# An archive is closed when it has this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
# Records of about this many bytes in all train the dictionary of an archive; of each the first part counts.
TRAINING_BYTES = 1 << 20
TRAINING_RECORD = 16 << 10
# Records that wait for a dictionary have at most about this many bytes.
WAITING_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

# Fixed values of the formats: the frame that holds a dictionary, and the profile of revisit records.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string())])
RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


# ------------------------------------------------------------------ records


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest.hex()}')}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in fields if v is not None], "\r\n"]).encode()


def page_record(page_id: int | None, url: str | None, payload: bytes, stored: bool, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record with the payload, or without it a revisit record of the page ``refers_to``."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if stored else http
    # blanks, control characters and those beyond ASCII cannot stand in a header line
    uri = None if url is None else quote(url, safe="".join(map(chr, range(33, 127))))
    fields = [
        ("WARC-Type", "response" if stored else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Page-ID", page_id),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("WARC-Profile", None if stored else PROFILE),
        ("WARC-Refers-To", None if stored else record_id(refers_to, digest)),
        ("WARC-Refers-To-Page-ID", None if stored else refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _head(fields) + block + b"\r\n\r\n"


def info_record(name: str, date: str = DATE) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name)]
    return _head([*fields, ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; one that is cut or does not end as it should is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, rest[:size]


def page_of(record: bytes) -> tuple | None:
    """A row of RECORD from a response or revisit record, None for others; a payload that does not fit its digest is an error."""
    fields, block = parsed(record)
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return (number("WARC-Page-ID"), fields.get("WARC-Target-URI"), size, digest.hex(), kind, number("WARC-Refers-To-Page-ID"), payload if kind == "response" else None)


# ----------------------------------------------------------------- archives


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of about ``size`` bytes trained on records; too few of them are one themselves, as raw content."""
    samples = [r[:TRAINING_RECORD] for r in records]
    try:
        # fixed parameters, so that training does not search for better ones
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Archive:
    """One file being written: dictionary frame, warcinfo record, records."""

    def __init__(self, folder: str, sample: list[bytes], level: int = LEVEL):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, path = fs.FileSystem.from_uri(self.path)
        # the name ends in .zst, by which the stream would compress the file once more
        self.out = store.open_output_stream(path, compression=None)
        raw = train_dictionary(sample)
        words = zstandard.ZstdCompressionDict(raw)
        words.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=words)
        self.size = 0
        self._write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.add(info_record(self.path.rsplit("/", 1)[1]))

    def _write(self, data: bytes) -> tuple[int, int]:
        at, self.size = self.size, self.size + len(data)
        self.out.write(data)
        return at, len(data)

    def add(self, record: bytes) -> tuple[int, int]:
        """Append a record as a frame of its own; its offset and length."""
        return self._write(self.compressor.compress(record))

    def close(self) -> None:
        self.out.close()


def _dictionary(head: bytes, source) -> zstandard.ZstdDecompressor:
    """A decompressor with the dictionary of the skippable frame that begins with ``head``."""
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))


def records(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """All records of an archive, frame by frame; no more than a record and a chunk is in memory."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as source:
        decompressor = _dictionary(source.read(8), source)
        data, frame, parts = b"", None, []
        while True:
            data = data or source.read(chunk)
            if not data:
                break
            frame = frame or decompressor.decompressobj()
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
            if frame.eof:
                yield b"".join(parts)
                frame, parts = None, []
        if frame is not None:
            raise ValueError(f"{uri} ends within a record")


def record_at(uri: str, offset: int, length: int) -> bytes:
    """One record by its place in the index, read alone."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        decompressor = _dictionary(source.read(8), source)
        source.seek(offset)
        return decompressor.decompress(source.read(length))


# --------------------------------------------------------------------- jobs


def _with_responses(pages: DataFrame, least: int) -> DataFrame:
    """Pages (page_id, url, payload) with ``stored`` and ``refers_to``."""
    # payloads are equal if their SHA-256 and size are; the SHA-1 of the archive can be made to collide
    keyed = pages.withColumn("_key", F.when(F.octet_length("payload") >= least, F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload").cast("string"))))
    copies = keyed.filter("_key is not null").groupBy("_key").agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    # a payload may have a third of all rows, which must not meet in one task
    joined = Lookup.build(copies, ["_key"], "_rows", 1, "payload_copies").join(keyed, "left")
    stored = F.col("_largest").isNull() | F.col("page_id").eqNullSafe(F.col("_largest"))
    return joined.select("page_id", "url", "payload", stored.alias("stored"), F.when(~stored, F.col("_largest")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES, training_bytes: int = TRAINING_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Archive every row of ``pages`` below ``folder`` and return the stored index: path, offset, length, page_id, record_type.

    ``folder`` is a URI that all executors can write to; by default one in the
    shared scratch folder. Of rows with equal payloads of at least ``least``
    bytes that with the largest page id is a response, the others revisit it.
    Rows that repeat the largest id are all responses; a null id is smaller than
    any other, and if all are null, all are responses. A null payload is an empty
    one, a null url is left out of the record. An empty table gives no archive.
    Other columns are left out.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    pages = only(pages, page_id=id_col, url=url_col, payload=payload_col)
    pages = pages.withColumns({"page_id": F.col("page_id").cast("bigint"), "payload": F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, waiting, size, held, done = None, [], 0, 0, []

        def add(entry: tuple) -> None:
            page_id, stored, record = entry
            done.append((archive.path, *archive.add(record), page_id, "response" if stored else "revisit"))

        def start() -> None:
            nonlocal archive, waiting, size, held
            archive = Archive(folder, [record for *_, record in waiting], level)
            for entry in waiting:
                add(entry)
            waiting, size, held = [], 0, 0

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "stored", "refers_to")]
            for row in zip(*columns):
                page_id, url, payload, stored, refers_to = (v.as_py() for v in row)
                entry = (page_id, stored, page_record(page_id, url, payload, stored, refers_to, date))
                if archive is not None:
                    add(entry)
                else:
                    waiting.append(entry)
                    size += min(len(entry[2]), TRAINING_RECORD)
                    held += len(entry[2])
                    if size >= training_bytes or held >= WAITING_BYTES:
                        start()
                if archive is not None and archive.size >= archive_bytes:
                    archive.close()
                    archive = None
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(INDEX.names, d)) for d in done], INDEX)
                done = []
        if waiting:
            start()
        if archive is not None:
            archive.close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(INDEX.names, d)) for d in done], INDEX)

    # an archive whose task is not committed is in no index
    return materialize(_with_responses(pages, least).mapInArrow(run, _ddl(INDEX)), "warc_index")


def read(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """One row per response or revisit record of the archives in the column ``path``: page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to, payload.

    Size and digest are those of the full payload, also for revisits. Payloads
    are checked against their digests.
    """
    paths = materialize(paths.select("path").distinct(), "warc_paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                rows, size = [], 0
                for record in records(uri):
                    page = page_of(record)
                    if page is None:
                        continue
                    rows.append(page)
                    size += len(record)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r)) for r in rows], RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r)) for r in rows], RECORD)

    # a task per archive
    return paths.repartitionByRange(max(1, paths.count()), "path").mapInArrow(run, _ddl(RECORD))
