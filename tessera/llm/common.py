"""Helpers shared by the training-data operators: shared storage, shipping code, graph components."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
ARROW_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that workers import it anywhere.

    Also lowers the session's Arrow batches from the default of 64 MB to 4 MB, which bounds
    the memory that a batch of long texts takes on both sides of the pipe.
    """
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") or 0) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join(os.path.basename(root), os.path.relpath(path, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-py-"), f"{os.path.basename(root)}_src.zip")
    with open(path, "wb") as f:
        f.write(blob.getvalue())
    sc.addPyFile(path)  # Spark's driver serves the file to every executor
    _SHIPPED.add(sc.applicationId)


_CACHES: dict[str, object] = {}  # this process's caches by operator: functions that empty them
_NOW: list[str] = [""]


def trim() -> None:
    """Give freed memory back to the system (glibc keeps large freed blocks otherwise)."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # fixed values: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        libc.mallopt(-1, 1 << 20)
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def enter(operator: str, empty=None) -> None:
    """Called where a task of an operator begins: Python workers outlive stages, so what another operator has cached goes first."""
    if empty is not None:
        _CACHES[operator] = empty
    if _NOW[0] != operator:
        for name in list(_CACHES):
            if name != operator:
                _CACHES.pop(name)()
        _NOW[0] = operator
        trim()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a local master gets a temporary folder (tests); a cluster
    must name one, because a machine-local folder would not be seen by other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
        os.makedirs(base, exist_ok=True)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet to shared storage and read it back: lineage ends here, and losing an executor loses nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI; used inside Python workers."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(col: str):
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


BITS = 26  # bits of a membership bitmap: 8 MB, whatever the data


def _hashed(column: str) -> str:
    return f"(xxhash64(cast({column} as bigint)) & {(1 << BITS) - 1}L)"


def bit_table(values: DataFrame, column: str, path: str) -> DataFrame:
    """Bitmap of the hashed values of a column, as at most 2048 rows of 4 KB.

    The bound is fixed, so it may be broadcast. It only sorts out rows that cannot match
    before a shuffle: rows it lets through still meet an exact join, so a full bitmap (very
    many values) costs a larger shuffle and never changes a result.
    """
    bits = values.selectExpr(f"{_hashed(column)} as h").groupBy(F.expr("shiftright(h, 15)").alias("__bucket")).agg(F.expr("bitmap_construct_agg(h & 32767L)").alias("__bits"))
    return materialise(bits, path)


def by_bits(df: DataFrame, column: str, bits: DataFrame, present: bool) -> DataFrame:
    """Rows whose value may be among the bitmap's values (present), or cannot be."""
    d = df.withColumn("__h", F.expr(_hashed(column))).withColumn("__bucket", F.expr("shiftright(__h, 15)"))
    d = d.join(F.broadcast(bits), "__bucket", "left")
    byte = "cast(conv(hex(substring(__bits, cast(shiftright(__h & 32767L, 3) as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"coalesce(shiftright({byte}, cast(__h & 7L as int)) & 1, 0)")
    return d.where(bit == (1 if present else 0)).drop("__h", "__bucket", "__bits")


def components(edges: DataFrame, workdir: str, limit: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component = smallest node).

    Alternates the large-star and small-star contractions; each round is one join keyed by
    node (a hot node's rows are split by the adaptive skew join) and ends in a table in shared
    storage. Nodes without edges do not appear. Duplicate edges and self-loops are ignored.
    """
    spark = edges.sparkSession
    at = f"{workdir}/cc"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, f"{at}-0")
    before = None
    for k in range(1, limit):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        low = low.repartition(parts)  # breaks the co-partitioning, so that the adaptive skew join may split a hot node
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low.repartition(parts), "a")
        small = pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        e = materialise(small, f"{at}-{k}")
        remove(spark, f"{at}-{k - 1}")
        now = e.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if now[0] == now[3] and tuple(now) == before:
            break
        before = tuple(now)
        if not now[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
