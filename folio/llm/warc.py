"""WARC archives with an index: write, index, and read back by byte ranges.

Each record is a gzip member of its own, so that a record can be read alone.
Records go to shards by a hash of their page; a shard is one file, written by
Spark's text writer (any Hadoop file system, committed once, retried safely).
That writer ends each value with a separator: every record is followed by an
empty gzip member, whose last byte is zero, and that byte is the separator.
Files are thus plain multi-member ``.warc.gz`` data.

The index holds file, offset, length, URL and digest of each record. It is made
from the files themselves, which are gone through once after they are written, so
it can't differ from them, and no other copy of the records is kept. Reading sorts
the selected index rows by file and offset, joins near ranges into one read, and
splits the bytes again.

Defined results: a null html is an empty payload. Of rows with equal payloads of
at least ``revisit_bytes`` bytes, the one with the smallest page_id is the
response and all with a larger (or null) page_id are revisits of it; rows that
tie on that smallest page_id are all responses. Where all page_ids are null, all
are responses. A null URL is written as an empty target. Extra columns are
ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_store, saved, scratch_path, slices

DATE = "2024-01-01T00:00:00Z"
#: An empty gzip member: header, empty deflate block, zero checksum and length.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
#: About how many times smaller pages become.
SHRINKS = 3
RECORD_SCHEMA = "page_id long, url string, payload_digest string, record binary"
INDEX_SCHEMA = "shard int, offset long, length long, page_id long, url string, payload_digest string"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.md5(f"{page_id}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def make_record(page_id, url, digest: str, refers_to, payload: bytes) -> bytes:
    """An uncompressed WARC/1.1 record; a revisit carries no payload."""
    revisit = refers_to is not None
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    body = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = header(head)
    return fields, rest[: int(fields["Content-Length"])]


def header(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, whole.schema.get_field_index("html"), 8_000_000):
            rows = batch.to_pydict()
            made = [
                gzip_member(make_record(p, u, d, r, (h or "").encode("utf-8", "surrogatepass"))) + EMPTY_MEMBER[:-1]
                for p, u, d, r, h in zip(rows["page_id"], rows["url"], rows["payload_digest"], rows["refers_to"], rows["html"], strict=True)
            ]
            columns = [batch.column(c) for c in ("page_id", "url", "payload_digest")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.binary())], names=["page_id", "url", "payload_digest", "record"])


def members(handle, chunk: int = 4 << 20, step: int = 1 << 15) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, header) of each record of an archive file, which is read once from its beginning."""
    data, at, before = b"", 0, 0  # a piece of the file, the place in it, and the bytes ahead of it

    def piece(most: int) -> bytes:
        nonlocal data, at, before
        if at >= len(data):
            before += len(data)
            data, at = handle.read(chunk), 0
        out = data[at : at + most]
        at += len(out)
        return out

    while True:
        begin = before + at
        unpacked = zlib.decompressobj(31)
        head = b""
        while not unpacked.eof:
            some = piece(step)
            if not some:
                if before + at > begin:
                    raise ValueError("an archive ends within a record")
                return
            out = unpacked.decompress(some)
            if b"\r\n\r\n" not in head:
                head += out
        at -= len(unpacked.unused_data)
        left = len(EMPTY_MEMBER)
        while left:
            some = piece(left)
            if not some:
                raise ValueError("an archive ends within a record")
            left -= len(some)
        yield begin, before + at - begin, head.partition(b"\r\n\r\n")[0]


def scan_archive(spark: SparkSession, base: str, shards: int) -> DataFrame:
    """The index of an archive, a task for each file."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = open_store(base)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                folder = fs.FileSelector(f"{root}/shard={shard}", allow_not_found=True)
                for file in [f.path for f in store.get_file_info(folder) if f.base_name.startswith("part-")]:
                    rows = []
                    with store.open_input_file(file) as handle:
                        for offset, length, head in members(handle):
                            fields = header(head)
                            page = int(fields["X-Page-Id"]) if fields.get("X-Page-Id") else None
                            rows.append((shard, offset, length, page, fields["WARC-Target-URI"], fields["WARC-Payload-Digest"].removeprefix("sha256:")))
                            if len(rows) >= 10_000:
                                yield indexed(rows)
                                rows = []
                    if rows:
                        yield indexed(rows)

    def indexed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["shard", "offset", "length", "page_id", "url", "payload_digest"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.range(0, shards, 1, int(min(shards, 20_000))).mapInArrow(scan, INDEX_SCHEMA)


def write_archive(
    pages: DataFrame, base: str, revisit_bytes: int = 100, shard_bytes: int = 64 << 20, small_rows: int = 50_000
) -> DataFrame:
    """Write the archive below ``base`` and return its index.

    The index has ``shard, offset, length, page_id, url, payload_digest``. A file
    holds about ``shard_bytes``, by the pages' size and how much they shrink. The
    first page of each payload that repeats is broadcast only while there are
    at most ``small_rows`` of them (about 100 bytes each), else joined by a
    shuffle.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.sha2(payload, 256).alias("payload_digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"),
        "html",
    )
    firsts = saved(
        own.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
        .where("n > 1 and first_page is not null")
        .drop("n"),
        "warc-firsts",
    )
    linked = own.join(F.broadcast(firsts) if firsts.count() <= small_rows else firsts, "payload_digest", "left")
    again = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    typed = linked.select(
        "page_id", "url", "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_page")).alias("refers_to"), "html",
    )
    total = own.agg(F.sum("payload_bytes")).first()[0] or 0
    shards = max(1, -(-total // (SHRINKS * shard_bytes)))
    keyed = typed.mapInArrow(_records, RECORD_SCHEMA).withColumn("shard", F.pmod(F.xxhash64("page_id", "payload_digest", "url"), F.lit(shards)).cast("int"))
    order = ["shard", "page_id", "payload_digest", "url"]
    (
        keyed.select(*order, F.col("record").cast("string").alias("value"))
        .repartition(int(min(shards, 20_000)), "shard")
        .sortWithinPartitions(*order)
        .select("value", "shard")
        .write.partitionBy("shard")
        .option("lineSep", "\0")
        .text(base)
    )
    return saved(scan_archive(pages.sparkSession, base, shards), "warc-index")


def read_records(index: DataFrame, base: str, gap: int = 1 << 16, most: int = 8 << 20, check: bool = True, task_bytes: int = 32 << 20) -> DataFrame:
    """Read the records of the given index rows, about ``task_bytes`` a task.

    Ranges of a file that lie within ``gap`` bytes are fetched by one read of up
    to ``most`` bytes (a longer record is read alone). The payload of a response
    is checked against its digest; a revisit has a null payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = open_store(base)
        handle, name = None, None
        for batch in batches:
            rows = batch.to_pydict()
            spans = list(zip(rows["shard"], rows["offset"], rows["length"], strict=True))
            i = 0
            while i < len(spans):
                shard, start, length = spans[i]
                j, end = i + 1, start + length
                while j < len(spans) and spans[j][0] == shard and spans[j][1] - end <= gap and spans[j][1] + spans[j][2] - start <= most:
                    end = spans[j][1] + spans[j][2]
                    j += 1
                if shard != name:
                    if handle is not None:
                        handle.close()
                    found = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/shard={shard}")) if f.base_name.startswith("part-")]
                    handle, name = store.open_input_file(found[0]), shard
                data = handle.read_at(end - start, start)
                yield decoded([data[o - start : o - start + n] for _, o, n in spans[i:j]])
                i = j
        if handle is not None:
            handle.close()

    def decoded(members: list[bytes]) -> pa.RecordBatch:
        out = []
        for member in members:
            fields, block = parse_record(zlib.decompress(member, 31))
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            revisit = fields["WARC-Type"] == "revisit"
            if check and not revisit and hashlib.sha256(block).hexdigest() != digest:
                raise ValueError(f"digest of {fields['WARC-Record-ID']} does not fit its payload")
            number = lambda name: int(fields[name]) if fields.get(name) else None
            out.append(
                (number("X-Page-Id"), fields["WARC-Target-URI"], number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page-Id"), None if revisit else block)
            )
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes))
    ordered = index.select("shard", "offset", "length").repartitionByRange(int(tasks), "shard", "offset").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(read, READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC, then read every record back through the index."""
    base = scratch_path(pages.sparkSession, "warc")
    return read_records(write_archive(pages, base), base)
