"""Fixed-width bit packing of token ids in shard files.

A shard file: header (magic, version, bits per id, ids per block), blocks of `BLOCK` ids each
packed in the minimum number of bits for the vocabulary (little-endian bit order), then the
blocks' byte offsets, then a footer (number of ids, number of blocks, magic). A range of ids
is read by seeking to the blocks that hold it; whole blocks unpack with a few numpy calls.

Writing in ascending doc_id order: boundaries of ranges come from approximate quantiles of
doc_id alone; texts are encoded where they are scanned and only packed ids are shuffled, to
their range, sorted there and written, one file per range. Global starts are sums over the
ranges' totals (one row per range on the driver). The index is written to shared storage;
files it does not name, left by failed attempts, are never read.

Defined results: null text is empty (the end id alone); a null doc_id sorts first; repeated
doc_ids keep one entry each, in an order fixed by their ids' bytes; other columns are
ignored; very long texts are encoded whole and span as many blocks as they need; an empty
table gives no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, filesystem, materialise, ship
from .textops import slices
from .tokens import drop_encoders, encoder

MAGIC = 0x5449504B  # "TIPK"
BLOCK = 4096
HEADER = struct.Struct("<IHHI")  # magic, version, bits, ids per block
FOOTER = struct.Struct("<QQI")  # ids, blocks, magic

INDEX = "doc_id long, bucket int, file string, local_start long, n_tokens long"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, lowest bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    flat = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flat.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    if bits == 32:
        return np.frombuffer(data, "<u4", n)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = flat
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


class TokenFileWriter:
    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.at, self.offsets, self.n, self.held, self.parts = HEADER.size, [], 0, 0, []
        out.write(HEADER.pack(MAGIC, 1, bits, BLOCK))

    def add(self, ids: np.ndarray) -> int:
        """Position of the first id."""
        start, self.n = self.n, self.n + len(ids)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK:
            self._blocks(False)
        return start

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            data = pack_bits(ids[k : min(k + BLOCK, whole)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.parts, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._blocks(True)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(FOOTER.pack(self.n, len(self.offsets), MAGIC))


class TokenFileReader:
    def __init__(self, source):
        self.source = source
        source.seek(0)
        magic, version, self.bits, self.block = HEADER.unpack(source.read(HEADER.size))
        source.seek(0, 2)
        end = source.tell() - FOOTER.size
        source.seek(end)
        self.n, blocks, again = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC or again != MAGIC or version != 1:
            raise ValueError("not a token file")
        source.seek(end - 8 * blocks)
        self.offsets = np.append(np.frombuffer(source.read(8 * blocks), "<u8"), np.uint64(end - 8 * blocks)).astype(np.int64)
        self.span: tuple[int, int, np.ndarray] = (0, 0, np.zeros(0, "<u4"))

    def read(self, start: int, n: int) -> np.ndarray:
        """ids start .. start + n."""
        if start < 0 or start + n > self.n:
            raise IndexError("outside the file")
        if n == 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        if not (self.span[0] <= first and last < self.span[1]):
            stop = min(max(last + 1, first + 64), len(self.offsets) - 1)
            self.source.seek(int(self.offsets[first]))
            data = self.source.read(int(self.offsets[stop] - self.offsets[first]))
            ids = [unpack_bits(data[self.offsets[k] - self.offsets[first] : self.offsets[k + 1] - self.offsets[first]], self.bits, min(self.block, self.n - k * self.block)) for k in range(first, stop)]
            self.span = first, stop, np.concatenate(ids)
        at = start - self.span[0] * self.block
        return self.span[2][at : at + n]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, ranges_per_partition: int = 4) -> DataFrame:
    """Encode docs (doc_id, text), write shard files below `folder`, return the index with global starts."""
    spark = docs.sparkSession
    ship(spark)
    bits = max(1, max(encoder(tokenizer).vocab - 1, end_id).bit_length())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = partitions * ranges_per_partition
    marks = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)], 20 * n).alias("q")).first()["q"] or []
    marks = np.unique(np.array(marks, np.int64))

    def encode(batches):
        enter("tokens", drop_encoders)
        enc = encoder(tokenizer, 600_000)
        end = np.array([end_id], "<u4")
        for b in batches:
            ids, text = b.column("doc_id"), b.column("text")
            for lo, hi in slices(text):
                doc = ids.slice(lo, hi - lo).to_pylist()
                tokens = [np.concatenate([enc.encode(t), end]) for t in text.slice(lo, hi - lo).to_pylist()]
                bucket = [0 if d is None else int(np.searchsorted(marks, d, side="left")) for d in doc]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(bucket, pa.int32()), pa.array([len(t) for t in tokens], pa.int64()), pa.array([pack_bits(t, bits) for t in tokens], pa.binary())], ["doc_id", "bucket", "n", "packed"])

    packed = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(encode, "doc_id long, bucket int, n long, packed binary")
    packed = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "packed")

    def write(batches):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        now, out, writer, name = None, None, None, None
        for b in batches:
            doc, buckets, sizes, data = b.column("doc_id"), b.column("bucket").to_pylist(), b.column("n").to_pylist(), b.column("packed")
            files, starts = [], []
            for k, bucket in enumerate(buckets):
                if bucket != now:
                    if writer is not None:
                        writer.close()
                        out.close()
                    now, name = bucket, f"{folder}/tokens-{bucket:06d}-{attempt}.bin"
                    fs, path = filesystem(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                    writer = TokenFileWriter(out, bits)
                starts.append(writer.add(unpack_bits(data[k].as_py(), bits, sizes[k])))
                files.append(name)
            if len(b):
                yield pa.RecordBatch.from_arrays([doc, b.column("bucket"), pa.array(files, pa.string()), pa.array(starts, pa.int64()), b.column("n")], ["doc_id", "bucket", "file", "local_start", "n_tokens"])
        if writer is not None:
            writer.close()
            out.close()

    index = materialise(packed.mapInArrow(write, INDEX), f"{folder}/index")
    totals = sorted((r["bucket"], r["n"]) for r in index.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())  # a row per range
    base, rows = 0, []
    for bucket, size in totals:
        rows.append((bucket, base))
        base += size
    bases = spark.createDataFrame(rows, "bucket int, base long")
    return index.join(F.broadcast(bases), "bucket").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "file", "local_start", "n_tokens")


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(index: DataFrame) -> DataFrame:
    """Read the listed documents back from the files: ROWS, the checksum over the ids as read."""
    ship(index.sparkSession)

    def run(batches):
        for b in batches:
            files, at, n = b.column("file").to_pylist(), b.column("local_start").to_pylist(), b.column("n_tokens").to_pylist()
            crc, name, source, reader = [0] * len(b), None, None, None
            for k in sorted(range(len(b)), key=lambda k: (files[k], at[k])):
                if files[k] != name:
                    if source is not None:
                        source.close()
                    fs, path = filesystem(files[k])
                    name, source = files[k], fs.open_input_file(path)
                    reader = TokenFileReader(source)
                crc[k] = zlib.crc32(np.ascontiguousarray(reader.read(at[k], n[k]), "<u4").tobytes())
            if source is not None:
                source.close()
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.mapInArrow(run, ROWS)
