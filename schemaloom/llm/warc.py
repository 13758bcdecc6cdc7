"""WARC archives of pages in seekable Zstandard bundles.

A page becomes a WARC/1.1 record: a response with the page as payload, or, where the
payload is that of a page with a smaller id, a revisit that refers to it. Records are
grouped into frames of about ``FRAME_BYTES`` that are compressed on their own; the frames
of a bundle are followed by a skippable frame with the seek table (compressed and raw size
of every frame), so a bundle is a valid Zstandard file whose parts can be read alone.

Container: a Parquet folder with one row per frame,
    bundle, frame, raw_size, data, records (record_id, page_id, offset and length in the
    decompressed frame),
the seek table being the last frame of its bundle with raw_size 0. The bytes of a bundle in
frame order are its file (``export``); ``record_map`` maps record ids to places. Spark's
commit protocol keeps the folder whole when executors are lost.

Copies are found on digests alone: the first page of every digest that occurs twice is
joined to narrow rows under salts, and what it decides is joined to the pages by row
number, so a payload that a third of the pages share moves like any other page.

Defined cases: null html is an empty payload; empty payloads are copies of each other when
``least_bytes`` is 0; null page ids are after all others, and a revisit of such a page
refers to null; of repeated rows the first is the response; a null url leaves out the
target; an empty table gives an empty archive; a long page makes its frame longer.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from schemaloom.session import shared_dir

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
SALTS = 32
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAMES = "bundle string, frame int, raw_size long, data binary, records array<struct<record_id:string,page_id:string,offset:long,length:long>>"
RECORD = "record_id string, page_id string, url string, record_type string, refers_to_id string, refers_to string, payload_digest string, payload_bytes long, verified boolean"


@dataclass
class Archive:
    """Folder of frames and the type of page ids."""

    spark: SparkSession
    path: str
    page_type: str

    def frames(self) -> DataFrame:
        return self.spark.read.schema(FRAMES).parquet(self.path)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: str | None, at: int) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{at}'.encode()).digest(), version=4)}"


def header_value(value: str) -> str:
    """The value without characters that a header line cannot hold."""
    return quote(value, safe="".join(chr(c) for c in range(0x21, 0x7F)))


def make_record(record_id: str, page_id: str | None, url: str | None, digest: str, payload_bytes: int, payload: bytes | None,
                refers_to_id: str | None = None, refers_to: str | None = None) -> bytes:
    """A response if there is a payload, else a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if page_id is not None:
        lines.append(f"Page-Id: {header_value(page_id)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to_id}>"]
        if refers_to is not None:
            lines.append(f"Refers-To-Page-Id: {header_value(refers_to)}")
    body = http + (payload or b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Fields and payload of the record at a place, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    named = dict(line.split(": ", 1) for line in lines)
    begin = end + 4
    stop = begin + int(named["Content-Length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("WARC record of another length")
    cut = data.index(b"\r\n\r\n", begin) + 4
    http = dict(line.split(": ", 1) for line in data[begin:cut - 4].decode().split("\r\n")[1:])
    payload, size = data[cut:stop], int(http["Content-Length"])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    response = named["WARC-Type"] == "response"
    return {
        "record_id": named["WARC-Record-ID"][1:-1], "page_id": named.get("Page-Id"), "url": named.get("WARC-Target-URI"), "record_type": named["WARC-Type"],
        "refers_to_id": named["WARC-Refers-To"][1:-1] if "WARC-Refers-To" in named else None, "refers_to": named.get("Refers-To-Page-Id"),
        "payload_digest": digest, "payload_bytes": size, "verified": len(payload) == size and digest32(payload) == digest if response else not payload,
    }, payload, stop + 4


def make_seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, raw) sizes, a count, a descriptor and the magic number at the end."""
    content = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(content)) + content


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and raw size of every frame, from the end of a bundle."""
    count, descriptor, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if descriptor & 0x80 else 8
    out, at = [], 0
    table = data[-9 - count * entry:-9]
    for k in range(count):
        size, raw = struct.unpack_from("<II", table, k * entry)
        out.append((at, size, raw))
        at += size
    return out


def decide(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Revisits only: __at with the id and the row number of the page that they repeat."""
    same = ["__sha1", "__size", "__hash"]
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "__at")
    narrow = pages.where(F.col("__size") >= least_bytes).select("__at", order.alias("__order"), *same)
    firsts = narrow.groupBy(*same).agg(F.min("__order").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    firsts = firsts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = narrow.withColumn("__salt", F.pmod(F.xxhash64("__at"), F.lit(SALTS)).cast("int")).join(firsts, [*same, "__salt"])
    return joined.where("__order.__at <> __first.__at").select("__at", F.col("__first.page_id").alias("__of"), F.col("__first.__at").alias("__of_at"))


def _bundles(rows: DataFrame, frame_bytes: int, bundle_bytes: int) -> DataFrame:
    schema = StructType.fromDDL(FRAMES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        sizes: list[tuple[int, int]] = []
        raw, records, raw_size, bundle_size = [], [], 0, 0
        out: list[dict] = []

        def name() -> str:
            return f"{part:06d}-{number:06d}"

        def close_frame():
            nonlocal raw, records, raw_size
            if raw:
                data = pack.compress(b"".join(raw))
                out.append({"bundle": name(), "frame": len(sizes), "raw_size": raw_size, "data": data, "records": records})
                sizes.append((len(data), raw_size))
                raw, records, raw_size = [], [], 0

        def close_bundle():
            nonlocal number, bundle_size, sizes
            close_frame()
            if sizes:
                out.append({"bundle": name(), "frame": len(sizes), "raw_size": 0, "data": make_seek_table(sizes), "records": []})
                number, bundle_size, sizes = number + 1, 0, []

        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            for k in range(batch.num_rows):
                at, page, url, html, size, digest, of, of_at = (columns[n][k].as_py() for n in
                                                               ("__at", "page", "url", "html", "__size", "__sha1", "__of", "__of_at"))
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                record_id = record_name(page, at)
                if of_at is None:
                    record = make_record(record_id, page, url, digest, size, html or b"")
                else:
                    record = make_record(record_id, page, url, digest, size, None, record_name(of, of_at), of)
                if raw and raw_size + len(record) > frame_bytes:
                    close_frame()
                if sizes and bundle_size + len(record) > bundle_bytes:
                    close_bundle()
                records.append({"record_id": record_id, "page_id": page, "offset": raw_size, "length": len(record)})
                raw.append(record)
                raw_size += len(record)
                bundle_size += len(record)
                if len(out) >= 16:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        close_bundle()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def write(pages: DataFrame, path: str | None = None, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> Archive:
    """Archive of all pages (page_id, url, html); a payload of ``least_bytes`` or more is kept once."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    page_type = pages.schema["page_id"].dataType.simpleString()
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("html"), F.monotonically_increasing_id().alias("__at"))
    html = F.col("html")
    # Written once: row numbers and digests are then the same for whoever reads them.
    numbered, copy = pages.withColumns({"__sha1": F.sha1(html), "__size": F.length(html).cast("long"), "__hash": F.xxhash64(html)}), shared_dir(spark, "warc-pages")
    numbered.write.option("compression", "zstd").parquet(copy)
    pages = spark.read.schema(numbered.schema).parquet(copy)
    revisits = decide(pages, least_bytes).select("__at", F.col("__of").cast("string").alias("__of"), "__of_at")
    full = pages.select("__at", F.col("page_id").cast("string").alias("page"), "url", "html", "__sha1", "__size")
    joined = full.join(revisits, "__at", "left").withColumn("html", F.when(F.col("__of_at").isNull(), html))
    _bundles(joined, frame_bytes, bundle_bytes).write.parquet(path)
    return Archive(spark, path, page_type)


def _typed(rows: DataFrame, page_type: str) -> DataFrame:
    typed: dict[str, Column] = {c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")}
    return rows.withColumns(typed)


def read(archive: Archive, payload: bool = True) -> DataFrame:
    """All records of an archive, each payload held against its digest."""
    schema = StructType.fromDDL(RECORD + (", payload binary" if payload else ""))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("data")):
                raw, at, out = unpack.decompress(data.as_py()), 0, []
                while at < len(raw):
                    fields, body, at = parse_record(raw, at)
                    out.append(fields | ({"payload": body if fields["record_type"] == "response" else None} if payload else {}))
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _typed(archive.frames().where("raw_size > 0").select("data").mapInArrow(run, schema), archive.page_type)


def record_map(archive: Archive) -> DataFrame:
    """Place of every record: record_id, page_id, bundle, frame, offset and length in the decompressed frame. Reads no page."""
    placed = archive.frames().select("bundle", "frame", F.explode("records").alias("r"))
    return placed.select("r.record_id", F.col("r.page_id").cast(archive.page_type).alias("page_id"), "bundle", "frame", "r.offset", "r.length")


def lookup(archive: Archive, ids: DataFrame, key: str = "page_id") -> DataFrame:
    """Records of the given ids (page_id or record_id); a revisit comes with the payload it refers to.

    Only frames with a wanted record are decompressed, each once.
    """
    schema = StructType.fromDDL(RECORD + ", payload binary")
    arrow = to_arrow_schema(schema)
    places = record_map(archive)

    def fetch(wanted: DataFrame) -> DataFrame:
        by_frame = wanted.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))  # at most one frame
        frames = archive.frames().select("bundle", "frame", "data").join(by_frame, ["bundle", "frame"]).select("data", "offsets")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor()
            for batch in batches:
                for data, offsets in zip(batch.column(0), batch.column(1)):
                    raw, out = unpack.decompress(data.as_py()), []
                    for at in offsets.as_py():
                        fields, body, _ = parse_record(raw, at)
                        out.append(fields | {"payload": body if fields["record_type"] == "response" else None})
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

        return frames.mapInArrow(run, schema)

    found = fetch(places.join(ids.select(key).distinct(), key, "left_semi"))
    referred = found.where("refers_to_id IS NOT NULL").select(F.col("refers_to_id").alias("record_id")).distinct()
    bodies = fetch(places.join(referred, "record_id", "left_semi")).select(F.col("record_id").alias("refers_to_id"), F.col("payload").alias("__payload"))
    whole = found.join(bodies, "refers_to_id", "left").withColumn("payload", F.coalesce("payload", "__payload"))
    return _typed(whole.select(*schema.names), archive.page_type)


def export(archive: Archive, bundle: str, path: str) -> None:
    """Write one bundle, which is bounded by ``bundle_bytes`` and one page, as a file on the driver."""
    with open(path, "wb") as out:
        for row in archive.frames().where(F.col("bundle") == bundle).orderBy("frame").select("data").toLocalIterator():
            out.write(row.data)


def read_at(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """A record of a bundle file, through its seek table."""
    begin, size, _ = read_seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[begin:begin + size])[offset:offset + length]
