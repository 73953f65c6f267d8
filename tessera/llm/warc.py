"""WARC archives as seekable Zstandard bundles.

Each scan task writes one bundle: records are grouped into independent Zstandard frames of
about `frame_bytes`, and the file ends with a seek table in a skippable frame (per frame its
compressed and decompressed size, then the number of frames), so a reader finds any frame
from the file's end. The index maps a record's identifier to bundle, frame, offset in the
decompressed frame, and length. It is written as Parquet to shared storage; only bundles it
names count, so what a failed attempt left behind is never read.

Records with equal payloads of at least `revisit_bytes` are linked through the payload's
SHA-256: the one with the smallest identifier is the response, the others revisit it and
store no payload. The smallest identifier per digest comes from a partially aggregated
groupBy; the join back on the digest is a plain equi-join, whose hot digests the adaptive
skew join splits.

Defined results: a null payload counts as empty; a null identifier is written as such and
never chosen as the first; repeated rows (same identifier and payload) are all responses;
very long payloads are one record in a frame of their own size; an empty table gives no bundle
and no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialise, ship

# fixed values of the Zstandard seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, bundle string, frame long, frame_offset long, record_bytes long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; payload is empty for a revisit."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def page_of(value: str):
    x = value.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "null" else int(x)


class BundleWriter:
    def __init__(self, out, frame_bytes: int, level: int):
        import zstandard

        self.out, self.frame_bytes, self.z = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frame, self.sizes = io.BytesIO(), []

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        place = len(self.sizes), self.frame.tell()
        self.frame.write(data)
        if self.frame.tell() >= self.frame_bytes:
            self._end_frame()
        return place

    def _end_frame(self) -> None:
        plain = self.frame.getvalue()
        packed = self.z.compress(plain)
        self.out.write(packed)
        self.sizes.append((len(packed), len(plain)))
        self.frame = io.BytesIO()

    def close(self) -> None:
        if self.frame.tell():
            self._end_frame()
        body = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class BundleReader:
    """Random access to the frames of a seekable file."""

    def __init__(self, source):
        import zstandard

        self.source, self.z = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(end - 9 - 8 * n)
        table = struct.unpack(f"<{2 * n}I", source.read(8 * n))
        self.starts, self.sizes, at = [], [], 0
        for k in range(n):
            self.starts.append(at)
            self.sizes.append((table[2 * k], table[2 * k + 1]))
            at += table[2 * k]
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.source.seek(self.starts[k])
            self.last = k, self.z.decompress(self.source.read(self.sizes[k][0]), max_output_size=self.sizes[k][1])
        return self.last[1]

    def record(self, frame: int, offset: int, size: int) -> bytes:
        return self.frame(frame)[offset : offset + size]


def link(pages: DataFrame, revisit_bytes: int, folder: str) -> DataFrame:
    """page_id, url, payload, digest, size and refers_to of each page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    first = p.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    first = materialise(first, f"{folder}/first")  # read from a table, so that the join's other side is one shuffle that the adaptive skew join can split
    p = p.join(first, (F.col("digest") == F.col("d")) & (F.col("size") >= revisit_bytes), "left")
    return p.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("d", "first")


def write_bundles(pages: DataFrame, folder: str, revisit_bytes: int = 100, frame_bytes: int = 1 << 18, level: int = 3) -> DataFrame:
    """Write the archives below `folder` (shared storage) and return their index."""
    ship(pages.sparkSession)
    linked = link(pages, revisit_bytes, folder).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{folder}/bundle-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        out = writer = None
        for b in batches:
            if not len(b):
                continue
            if writer is None:
                fs, path = filesystem(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
                writer = BundleWriter(out, frame_bytes, level)
            places = []
            columns = [b.column(c) for c in ("page_id", "url", "payload", "size", "digest", "refers_to")]
            for k in range(len(b)):
                page, url, payload, size, digest, refers = (c[k].as_py() for c in columns)
                data = record(page, url, payload, size, digest, refers)
                places.append((page, name, *writer.add(data), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*places), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["page_id", "bundle", "frame", "frame_offset", "record_bytes"])
        if writer is not None:
            writer.close()
            out.close()

    return materialise(linked.mapInArrow(run, INDEX), f"{folder}/index")


def read_records(index: DataFrame) -> DataFrame:
    """Fetch the records that `index` lists (all or any part of it) and return ROWS.

    A response's size and digest are computed from the stored payload, a revisit's come from its headers.
    """
    ship(index.sparkSession)

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            where = sorted(zip(b.column("bundle").to_pylist(), b.column("frame").to_pylist(), b.column("frame_offset").to_pylist(), b.column("record_bytes").to_pylist()))
            name, source, reader = None, None, None
            for bundle, frame, offset, size in where:
                if bundle != name:
                    if source is not None:
                        source.close()
                    fs, path = filesystem(bundle)
                    name, source = bundle, fs.open_input_file(path)
                    reader = BundleReader(source)
                fields, payload = parse(reader.record(frame, offset, size))
                kind = fields["WARC-Type"]
                full = kind == "response"
                digest = hashlib.sha256(payload).hexdigest() if full else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                rows.append((page_of(fields["WARC-Record-ID"]), len(payload) if full else int(fields["X-Payload-Length"]), digest, kind, None if full else page_of(fields["WARC-Refers-To"])))
            if source is not None:
                source.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.mapInArrow(run, ROWS)
