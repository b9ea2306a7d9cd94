"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of some records, followed by a seek table in a
skippable frame.  An index maps each record's id to its bundle, its frame, and its offset within the frame's
content, so one record is read by decompressing one frame.
"""

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KeyFilter, Scratch, col

#: Fixed values of the seekable format: magic numbers of a skippable frame and of the footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
#: Content after which a frame, and compressed size after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 32 << 20
#: Fixed value: the profile of a revisit whose payload is that of another record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame long, frame_at long, frame_bytes long, record_at long, record_bytes long"
READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
        T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("sound", T.BooleanType()),
        T.StructField("url", T.StringType()), T.StructField("bundle", T.StringType()), T.StructField("frame", T.LongType()),
    ]
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, sha1: str, when: str = "2020-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record; a revisit has no block but names the full payload's digest and length."""
    block = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers by lower-cased name, block, offset after the record) of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    return headers, data[end + 4 : end + 4 + n], end + 4 + n + 4


def number(uri: str | None) -> int | None:
    got = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(got) if got else None


class Bundler:
    """Frames of records; ``close`` gives the bundle's bytes and a (page_id, frame, offset, bytes) entry a record."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open, self.entries, self.size = bytearray(), [], 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > self.frame_bytes:
            self.flush()
        self.entries.append((page_id, len(self.frames), len(self.open), len(data)))
        self.open += data

    def flush(self) -> None:
        if self.open:
            frame = self.pack.compress(bytes(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.open)))
            self.size += len(frame)
            self.open = bytearray()

    def close(self) -> tuple[bytes, list[tuple]]:
        self.flush()
        starts = [0]
        for n, _ in self.sizes:
            starts.append(starts[-1] + n)
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER)
        entries = [(i, f, starts[f], self.sizes[f][0], at, n) for i, f, at, n in self.entries]
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table, entries


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, content bytes) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != FOOTER:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    for k in range(n):
        packed, content = struct.unpack_from("<II", bundle, len(bundle) - 9 - (n - k) * width)
        out.append((at, packed, content))
        at += packed
    return out


def frame_content(bundle: bytes, at: int, n: int, content: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + n], max_output_size=content)


def read_record(bundle: bytes, frame_at: int, frame_bytes: int, record_at: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: only its frame is decompressed."""
    data = zstandard.ZstdDecompressor().decompress(bundle[frame_at : frame_at + frame_bytes])
    return parse(data, record_at)[:2]


def decisions(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to) of ``pages``: of payloads of ``least_bytes`` at least, the smallest id with the same payload, if another's.

    Payloads are told apart by SHA-1 and length.  A null id is never referred to, and its record is a
    response unless another record has its payload.  Rows that repeat an id and payload are all alike.

    Scale: payloads are counted by digest and length.  A filter of at most 16 MB holds the digests that several pages
    have; pages that it doesn't hold pass without a shuffle, only the others are joined with the first page of their payload.
    """
    html = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = pages.select(col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("_payload", F.concat(F.sha1(F.encode("html", "UTF-8")), F.lit("-"), F.octet_length("html")))
    counted = rows.where(F.octet_length("html") >= least_bytes).groupBy("_payload").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = Scratch(pages.sparkSession, "payloads").keep(counted.select("_payload", "first"))
    shared = KeyFilter(firsts, F.col("_payload"))
    rows = rows.withColumn("_shared", shared.column(F.col("_payload")))
    # Another form of the key makes both sides of the join exchange, so that adaptive execution splits a payload that many pages have.
    joined = rows.where("_shared").join(firsts.select(F.concat(F.lit("p"), "_payload").alias("_key"), "first"), F.concat(F.lit("p"), "_payload") == F.col("_key"), "left")
    other = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("first") != F.col("page_id")))
    own = ["page_id", "url", "html"]
    return joined.select(*own, F.when(other, F.col("first")).alias("refers_to")).unionByName(rows.where("not _shared").select(*own, F.lit(None).cast("long").alias("refers_to")))


def store(path: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder under another name, then rename it: readers see all of it or none."""
    from pyarrow import fs

    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    system, at = fs.FileSystem.from_uri(uri.replace("file:///", "/").replace("file:/", "/") if uri.startswith("file:") else uri)
    system.create_dir(at, recursive=True)
    draft = f"{at}/_{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{at}/{name}")


def write_bundles(rows: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles in the folder ``path`` from rows of ``decisions``; the index, a row a record.

    A task writes its rows as they come, at most one open bundle in memory.  Bundles have names of their
    own, so a task that runs again leaves files that no index entry names; readers skip those.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundler = Bundler(frame_bytes)

        def out() -> pd.DataFrame:
            data, entries = bundler.close()
            name = f"{uuid.uuid4().hex}.warc.zst"
            store(path, name, data)
            return pd.DataFrame([(i, name, *e) for i, *e in entries], columns=["page_id", "bundle", "frame", "frame_at", "frame_bytes", "record_at", "record_bytes"]).astype({"page_id": "Int64"})

        for batch in batches:
            for page_id, url, html, refers_to in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"], batch["refers_to"].astype("Int64"), strict=True):
                i = None if page_id is pd.NA else int(page_id)
                to = None if refers_to is pd.NA else int(refers_to)
                payload = html.encode("utf-8", "surrogatepass")
                bundler.add(i, record(i, url if isinstance(url, str) else None, payload, "response" if to is None else "revisit", to, digest(payload)))
                if bundler.size >= bundle_bytes:
                    yield out()
                    bundler = Bundler(frame_bytes)
        if bundler.entries:
            yield out()

    return rows.select("page_id", "url", "html", "refers_to").mapInPandas(write, INDEX)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles in ``path``: READ's columns.

    ``payload_digest`` and ``payload_bytes`` are of the full payload: computed from a response's block, as
    stated by a revisit.  ``sound`` tells whether a response's block has the digest and length its headers state.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = READ.fieldNames()
        for batch in batches:
            for file, bundle in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                for k, (at, n, content) in enumerate(seek_table(bundle)):
                    data, pos, rows = frame_content(bundle, at, n, content), 0, []
                    while pos < len(data):
                        h, block, pos = parse(data, pos)
                        stated, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                        full = h["warc-type"] == "response"
                        got = digest(block) if full else stated
                        rows.append((number(h["warc-record-id"]), h["warc-type"], number(h.get("warc-refers-to")), got, len(block) if full else size, got == stated and (not full or size == len(block)), h.get("warc-target-uri"), file.rpartition("/")[2], k))
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("path", "content").mapInArrow(read, READ)


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write ``pages`` (page_id, url, html) as bundles below ``path`` and return (index, records read back).

    Without a ``path`` the archive goes to the shared folder and is deleted after it was read back; index and records
    are kept by reliable checkpoints.  A null html is an empty payload, a null url leaves the header
    out, a null page_id leaves the record's id empty; repeated rows give as many records; an empty table
    gives no bundle.  Other columns are not archived.
    """
    spark = pages.sparkSession
    own = Scratch(spark, "warc")
    at = path or own.path
    index = write_bundles(decisions(pages, least_bytes), f"{at}/bundles")
    index.write.parquet(f"{at}/index")
    index = spark.read.schema(index.schema).parquet(f"{at}/index")
    if index.isEmpty():
        records = spark.createDataFrame([], READ)
    else:
        records = read_bundles(spark, f"{at}/bundles").join(index.select("bundle").distinct(), "bundle", "left_semi")
    if path is None:
        index, records = own.keep(index), own.keep(records)
        own.drop()
    return index, records
