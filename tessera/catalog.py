"""Tables as lists of immutable Parquet folders under one manifest.

A manifest is a JSON file `catalog-<n>.json`; the one with the largest number counts. A writer
creates the next number and fails if another process has created it meanwhile (a hard link on a
local file system, a rename without overwriting through Hadoop's file API elsewhere), so no
commit is lost. The engine's folder may lie on any file system Spark reaches. A table's state
is its columns, keys, policies and the folders that make up its rows; a version number rises
with every change. Folders are never rewritten: an append adds one, an update or delete
replaces those it touches, and a reader that holds an older manifest keeps its rows until the
table is dropped or `Engine.vacuum` removes what no manifest lists.
"""

from __future__ import annotations

import copy
import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


KEPT = 8  # manifests that stay behind the newest, for readers between listing and opening


class Outdated(RuntimeError):
    """Another process has written a newer manifest."""


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)
        self._local = self._fs.getScheme() == "file"
        self.number = 0
        self.state: dict = {"version": 0, "tables": {}}
        self.reload()

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._file("")):
            return []
        found = (re.fullmatch(r"catalog-(\d+)\.json", f.getPath().getName()) for f in self._fs.listStatus(self._file("")))
        return sorted(int(m[1]) for m in found if m)

    def reload(self) -> None:
        numbers = self._numbers()
        if not numbers or numbers[-1] == self.number:
            return
        stream = self._fs.open(self._file(f"catalog-{numbers[-1]}.json"))
        try:
            self.state = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        self.number = numbers[-1]

    def save(self, state: dict) -> None:
        """Create the manifest after the one last loaded; raises Outdated if there is one already."""
        text = json.dumps(state, sort_keys=True, indent=1)
        name, final = f".catalog-{uuid.uuid4().hex}", f"catalog-{self.number + 1}.json"
        out = self._fs.create(self._file(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self._local:
                try:
                    os.link(self._fs.makeQualified(self._file(name)).toUri().getPath(), self._fs.makeQualified(self._file(final)).toUri().getPath())
                except FileExistsError:
                    raise Outdated(final) from None
            elif not self._fs.rename(self._file(name), self._file(final)):
                raise Outdated(final)
        finally:
            self._fs.delete(self._file(name), False)
        self.number += 1
        self.state = state
        for old in self._numbers():
            if old < self.number - KEPT:
                self._fs.delete(self._file(f"catalog-{old}.json"), False)

    def remove(self, folder: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(folder), True)

    def folders(self) -> list[str]:
        """All data folders on storage, listed by a manifest or not."""
        top = self._file("data")
        if not self._fs.exists(top):
            return []
        return [f"{self.path}/data/{t.getPath().getName()}/{f.getPath().getName()}" for t in self._fs.listStatus(top) for f in self._fs.listStatus(t.getPath())]

    def draft(self) -> dict:
        return copy.deepcopy(self.state)

    def new_folder(self, table: str) -> str:
        return f"{self.path}/data/{table.lower()}/{uuid.uuid4().hex}"


def schema_of(table: dict) -> T.StructType:
    """Spark schema of a table; sizes of VECTOR and VARCHAR are kept as metadata."""
    out = T.StructType()
    for c in table["columns"]:
        out = out.add(T.StructField(c["name"], T._parse_datatype_string(c["type"]), True, {"size": c["size"]} if c.get("size") else {}))
    return out


def read(spark: SparkSession, table: dict) -> DataFrame:
    """Rows of a table at the state given; columns added later read as null in older folders."""
    schema = schema_of(table)
    if not table["folders"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*table["folders"])
