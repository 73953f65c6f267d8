"""Parquet sources, key look-ups, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_SCHEMAS: dict[tuple, StructType] = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose schema is inferred (a Spark job) once per path and modification time."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _SCHEMAS:
        if len(_SCHEMAS) > 1000:
            _SCHEMAS.clear()
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def scan(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A table of `sf_dir`; columns and predicate reach the Parquet scan."""
    df = read_parquet(spark, f"{sf_dir}/{table}.parquet")
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def point_lookup(df: DataFrame, key: str, value, columns: list[str] | None = None) -> DataFrame:
    """Rows with key = value; row-group statistics prune what a sorted layout allows."""
    df = df.where(F.col(key) == F.lit(value))
    return df.select(*columns) if columns else df


def literal_row(spark: SparkSession, **columns: Column) -> DataFrame:
    """SELECT without FROM: one row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()])


def append(df: DataFrame, path: str) -> None:
    """Bulk ingest without constraint checks."""
    df.write.mode("append").parquet(path)


def write_clustered(df: DataFrame, path: str, key: str, files: int) -> None:
    """Lay a table out in ranges of a key, so that look-ups on it skip row groups; Spark's stand-in for an index."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def encrypt_column(df: DataFrame, column: str, key: bytes, aad: Column) -> DataFrame:
    """Replace a text column by its AES-GCM ciphertext (base64), bound to `aad`."""
    secret = F.lit(key)
    return df.withColumn(column, F.base64(F.call_function("aes_encrypt", F.col(column), secret, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)))


def decrypt_column(df: DataFrame, column: str, key: bytes, aad: Column) -> DataFrame:
    """Undo `encrypt_column`; a wrong key or aad raises."""
    return df.withColumn(column, F.call_function("aes_decrypt", F.unbase64(F.col(column)), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string"))
