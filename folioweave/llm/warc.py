"""WARC archives in Zstandard form: a writer, and a reader that decodes one frame per record.

An archive is a leading skippable frame that holds a dictionary (itself compressed), then one Zstandard frame per record,
compressed with that dictionary. The reader loads the dictionary, walks the frames by their headers (so any frame could be
read alone), and checks of every record the frame's content size, the version line, the mandatory fields, the record's
Content-Length, its two closing line ends, the inner message's length, and the block's and payload's digests.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest page_id is a response, the
others are revisits of it that carry no payload. Digests are made, and equal ones found, in the JVM; payloads cross no
shuffle but the one that hands each page its verdict, which is salted, and which shorter pages don't enter.

Archives are files ``<uuid>.warc.zst`` in a folder that all executors reach. A task streams records to a file of its own and
names it in its result, so the list of archives that Spark commits holds each record once, whatever tasks were repeated; the
reader reads the archives of such a list. ``read_archives`` does the same for any table with a column ``content``, such as
``spark.read.format("binaryFile")`` gives for a folder of archives.

Defined results: null html is the empty payload; null url is written as ``urn:page:<id>``; a null page_id gives a record
without an id field value and is read back null; repeated rows are records each, and a repeated response row beside its
equal stays a response; an empty table gives no archive and no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401  pa.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_REVISIT = 1000
#: Uncompressed bytes of an archive, bytes of a dictionary, records and bytes sampled for it, and salts of a digest.
ARCHIVE_BYTES, DICTIONARY_BYTES, DICTIONARY_RECORDS, DICTIONARY_SAMPLE, SALTS = 16 << 20, 32 << 10, 400, 2 << 20, 32
# Fixed values of the formats.
FRAME_MAGIC, DICTIONARY_MAGIC = 0xFD2FB528, 0x184D2A5D
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


class CorruptArchive(ValueError):
    """An archive, a frame or a record isn't what its headers say."""


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes, digest: str, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; digest is the payload's SHA-1 in hex. A revisit keeps the message's header only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", clean), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).hexdigest())}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The record's fields, validated; payload is None for a revisit."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise CorruptArchive("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise CorruptArchive(f"header line without a colon: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise CorruptArchive(f"no {name}")
    if not fields["content-length"].isdigit():
        raise CorruptArchive("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise CorruptArchive(f"block of {len(rest) - 4} bytes, {size} announced")
    block = rest[:size]
    if (told := fields.get("warc-block-digest")) and told != f"sha1:{_base32(hashlib.sha1(block).hexdigest())}":
        raise CorruptArchive("block digest")
    inner, mark, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in inner.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not mark or length is None:
        raise CorruptArchive("no message header in the block")
    kind = fields["warc-type"]
    digest = base64.b32decode(fields.get("warc-payload-digest", "sha1:").partition(":")[2]).hex()
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise CorruptArchive("payload length or digest")
    if kind == "revisit" and payload:
        raise CorruptArchive("a revisit with a payload")
    number = lambda field: int(x) if (x := fields.get(field, "").strip("<>").removeprefix("urn:page:")) else None
    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to"), "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None}


def dictionary_of(records: list[bytes]) -> bytes:
    """A dictionary learnt from records."""
    sample = [r[: 16 << 10] for r in records[:DICTIONARY_RECORDS]]
    data = b""
    if len(sample) >= 16:
        try:
            data = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # too little or too uniform to learn from
            data = b""
    return data or b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"  # raw content also serves as a dictionary


class ArchiveWriter:
    """Writes records to a binary file: the dictionary frame, then a frame for each."""

    def __init__(self, out, dictionary: bytes):
        packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
        out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        self.out = out
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)

    def add(self, record: bytes) -> None:
        self.out.write(self.compressor.compress(record))


def write_archive(records: list[bytes]) -> bytes:
    """The archive of records."""
    out = io.BytesIO()
    writer = ArchiveWriter(out, dictionary_of(records))
    for record in records:
        writer.add(record)
    return out.getvalue()


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and block headers alone."""
    try:
        end = at + zstandard.frame_header_size(data[at : at + 18])
        checked = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    except zstandard.ZstdError as error:
        raise CorruptArchive(f"frame header at {at}") from error
    while True:
        if end + 3 > len(data):
            raise CorruptArchive(f"frame at {at} is cut off")
        head = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            end += 4 * checked
            if end > len(data):
                raise CorruptArchive(f"frame at {at} is cut off")
            return end


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive, each decoded from its own frame."""
    data, at, known = memoryview(content), 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC:
        at = 8 + int.from_bytes(data[4:8], "little")
        if at > len(data):
            raise CorruptArchive("dictionary frame is cut off")
        raw = bytes(data[8:at])
        if int.from_bytes(raw[:4], "little") == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known = zstandard.ZstdCompressionDict(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic >> 4 == DICTIONARY_MAGIC >> 4:  # another skippable frame
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        if magic != FRAME_MAGIC:
            raise CorruptArchive(f"no frame at {at}")
        end = frame_end(data, at)
        try:
            raw = decompressor.decompress(bytes(data[at:end]))
        except zstandard.ZstdError as error:
            raise CorruptArchive(f"frame at {at}: {error}") from error
        if zstandard.frame_content_size(data[at : at + 18]) not in (-1, len(raw)):
            raise CorruptArchive(f"content size of the frame at {at}")
        yield parse_record(raw)
        at = end


def with_verdicts(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to of each row."""
    pages = common.only(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    pages = pages.withColumn("html", F.coalesce("html", F.lit("")))
    # Only ids and digests are shuffled to find equals; the partial counts make a hot digest one row a task.
    digests = pages.where(F.octet_length("html") >= LEAST_REVISIT).select(F.sha1(F.col("html").cast("binary")).alias("d"), F.octet_length("html").alias("size"), "page_id")
    groups = digests.groupBy("d", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1")
    groups = groups.select("d", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    short = pages.where(F.octet_length("html") < LEAST_REVISIT).select("page_id", "url", "html", "digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    long = pages.where(F.octet_length("html") >= LEAST_REVISIT).withColumns({"d": F.col("digest"), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    joined = long.join(groups, ["d", "salt"], "left").select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))
    return short.unionByName(joined)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            page_id, url, html, digest, kind, refers_to = (x.as_py() for x in row)
            yield record_bytes(page_id, url, kind, refers_to, html.encode(), digest)


def archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, records, bytes: pages written to files below folder, each of about archive_bytes before compression. Files come
    into being when the result is made; those that it names are whole."""
    common.tune(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, out, first, held = _records(batches), None, [], 0
        system, at = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        names, counts, sizes = [], [], []

        def start() -> None:
            nonlocal out, writer, first
            names.append(f"{uuid.uuid4().hex}.warc.zst")
            counts.append(len(first))
            out = system.open_output_stream(f"{at}/{names[-1]}", compression=None)  # the name ends in .zst
            writer = ArchiveWriter(out, dictionary_of(first))
            for r in first:
                writer.add(r)
            first = []

        def stop() -> None:
            nonlocal out, held
            sizes.append(out.tell())
            out.close()
            out, held = None, 0

        writer = None
        for record in found:
            held += len(record)
            if out is None:
                first.append(record)
                if len(first) >= DICTIONARY_RECORDS or held >= min(DICTIONARY_SAMPLE, archive_bytes):
                    start()
            else:
                writer.add(record)
                counts[-1] += 1
            if out is not None and held >= archive_bytes:
                stop()
        if first:
            start()
        if out is not None:
            stop()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(f"{folder.rstrip('/')}/{n}" for n in names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])

    return common.arrow(with_verdicts(pages, id_col, url_col, html_col), write, "archive string, records bigint, bytes bigint")


def _batches(records: Iterator[dict], names: list[str]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    rows: list[dict] = []
    held = 0
    for record in records:
        rows.append(record)
        held += len(record["payload"] or b"")
        if len(rows) >= 1000 or held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def _names(with_payload: bool) -> list[str]:
    return [f.split()[0] for f in RECORD.split(", ")][: None if with_payload else -1]


def read_files(found: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives that column ``archive`` names, each file read by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = pa.fs.FileSystem.from_uri(path)
                with system.open_input_file(at) as file:
                    yield from _batches(read_archive(file.read()), _names(with_payload))

    return common.arrow(found.select("archive"), read, RECORD if with_payload else RECORD.rpartition(", ")[0])


def read_archives(found: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in column ``content``; without payloads only their validated facts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(read_archive(content.as_py() or b""), _names(with_payload))

    return common.arrow(found.select("content"), read, RECORD if with_payload else RECORD.rpartition(", ")[0])


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives into the shared folder and read them back."""
    spark = pages.sparkSession
    listed = common.written(archives(pages, common.shared_dir(spark, "warc")), "archives")
    listed = listed.repartition(max(1, listed.count()))  # a file is the unit of work
    return read_files(listed, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
