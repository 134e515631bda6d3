"""A table of documents on disk: create, append, upsert by key, open and count."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.relational import upsert


class Store:
    """Versions of a table under one folder. Each is named by a pointer with a number, and the highest is read. A version
    is written whole before its pointer is, and a pointer is put in place by one rename that fails if its number is taken:
    readers never see half of a version or none, a crash leaves the one before, and of two writers one gets an error."""

    KEPT = 10

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removeprefix("CURRENT-")) for n in names if n.startswith("CURRENT-") and n[8:].isdigit())

    def _current(self) -> list[str]:
        numbers = self._numbers()
        return [r[0] for r in self.spark.read.text(f"{self.path}/CURRENT-{numbers[-1]:010d}").collect()] if numbers else []

    def _name(self, parts: list[str], on: int) -> None:
        """Names the parts as the version after number ``on``, the one they were made from."""
        jvm, fs = self._fs()
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        new, to = path(f".new-{uuid.uuid4().hex}"), path(f"CURRENT-{on + 1:010d}")
        out = fs.create(new, True)
        out.write(bytearray("\n".join(parts), "utf-8"))
        out.close()
        if fs.exists(to) or not fs.rename(new, to):
            fs.delete(new, False)
            raise RuntimeError(f"another writer has made version {on + 1} of {self.path}")
        for old in self._numbers()[: -self.KEPT]:
            fs.delete(path(f"CURRENT-{old:010d}"), False)

    def _last(self) -> int:
        return max(self._numbers(), default=0)

    def _write(self, df: DataFrame) -> str:
        part = f"{self.path}/v-{uuid.uuid4().hex}"
        df.write.parquet(part)
        return part

    def create(self, df: DataFrame) -> None:
        on = self._last()
        self._name([self._write(df)], on)

    def append(self, df: DataFrame) -> None:
        on, before = self._last(), self._current()
        self._name([*before, self._write(df)], on)

    def upsert(self, batch: DataFrame, key: str, seq: str) -> None:
        on, base = self._last(), self.open()
        self._name([self._write(upsert(base, batch, key, seq) if base is not None else upsert(batch.limit(0), batch, key, seq))], on)

    def open(self, schema: T.StructType | None = None) -> DataFrame | None:
        """The table as it is now; an empty one of the schema, or None, before anything was written."""
        parts = self._current()
        if not parts:
            return self.spark.createDataFrame([], schema) if schema is not None else None
        return self.spark.read.option("mergeSchema", "true").parquet(*parts)

    def stats(self) -> dict[str, int]:
        df = self.open()
        return {"total": 0 if df is None else df.agg(F.count("*")).first()[0], "deleted": 0}
