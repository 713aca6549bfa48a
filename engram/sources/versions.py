"""Tables under versions: all-or-nothing commits over several tables, readers pinned to a version.

A store is a folder that all drivers and executors share. A transaction writes Parquet folders that nobody reads yet, and
``commit`` publishes them in one step: the manifest of version n + 1 is put in place only if no such file exists, so of two
transactions that began at version n one commits and the other gets ``Conflict``; ``update`` runs it again on the newer
state. A driver that dies before its commit leaves folders without a manifest, which ``vacuum`` takes away later.

A table with a key is a log: ``upsert`` and ``delete`` add a folder of changed rows, and a reader sees the row of the newest
folder for each key (one partially aggregated maximum). ``compact`` rewrites a table to one folder. So a small change to a
large table costs its own rows.

The file system must be able to create a name only if it is absent: hard links for local folders, rename without
replacement elsewhere (HDFS and what behaves like it).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, GONE = "_version", "_gone"


class Conflict(RuntimeError):
    """Another transaction has committed on the same version."""


@dataclass
class Table:
    """Folders with the version of each, oldest first; ``key`` is empty for tables that only grow or are replaced."""

    schema: str
    key: list[str] = field(default_factory=list)
    folders: list[list] = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop(f"{self.path}/_versions"))

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.path}/_versions") if n.isdigit())

    def version(self) -> int:
        """The newest version; 0 for a store without commits."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict[str, Table]:
        if version == 0:
            return {}
        stream = self._fs.open(self._hadoop(f"{self.path}/_versions/{version:020d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {name: Table(**t) for name, t in json.loads(text).items()}

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(self.version() if version is None else version))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table at a version, the newest by default; later commits do not change the frame."""
        return self.state(self.manifest(self.version() if version is None else version)[name])

    def state(self, table: Table) -> DataFrame:
        schema = f"{table.schema}, {GONE} boolean" if table.key else table.schema
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").withColumn(VERSION, F.lit(v).cast("long")) for folder, v in table.folders]
        if not parts:
            return self.spark.createDataFrame([], table.schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if table.key and len(parts) > 1:
            rest = [c for c in rows.columns if c not in table.key]
            rows = rows.groupBy(*table.key).agg(F.max_by(F.struct(*rest), F.col(VERSION)).alias("_row")).select(*table.key, "_row.*")
        columns = [c for c in rows.columns if c not in (VERSION, GONE)]
        live = rows.where(f"not coalesce({GONE}, false)") if table.key else rows
        names = self.spark.createDataFrame([], table.schema).columns
        return live.select(*[c for c in names if c in columns])

    def begin(self) -> Transaction:
        return Transaction(self)

    def update(self, change: Callable[[Transaction], object], retries: int = 20) -> object:
        """Runs ``change`` in a transaction and commits it, again from the newer version after each conflict."""
        for _ in range(retries + 1):
            tx = self.begin()
            out = change(tx)
            try:
                tx.commit()
                return out
            except Conflict:
                continue
        raise Conflict(f"no commit in {retries + 1} attempts")

    def compact(self, name: str) -> None:
        """Rewrites a table to one folder without deleted rows."""
        self.update(lambda tx: tx.replace(name, tx.read(name)))

    def vacuum(self, keep: int = 10) -> int:
        """Deletes manifests before the last ``keep`` and folders that none of these uses, except those of transactions that
        may still be open (begun at a kept version); the number of folders deleted."""
        kept = self.versions()[-keep:]
        if not kept:
            return 0
        used = {folder.split("/")[1] for v in kept for t in self.manifest(v).values() for folder, _ in t.folders}
        gone = [n for n in self._names(f"{self.path}/data") if n not in used and int(n.split("-")[0]) < kept[0]]
        for n in gone:
            self._fs.delete(self._hadoop(f"{self.path}/data/{n}"), True)
        for v in self.versions():
            if v < kept[0]:
                self._fs.delete(self._hadoop(f"{self.path}/_versions/{v:020d}"), False)
        return len(gone)

    def _publish(self, version: int, text: str) -> None:
        """Puts a whole file in place if its name is free."""
        tmp, to = f"{self.path}/_versions/tmp-{uuid.uuid4().hex}", f"{self.path}/_versions/{version:020d}"
        out = self._fs.create(self._hadoop(tmp), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self._fs.getScheme() == "file":
                plain = lambda p: self._hadoop(p).toUri().getPath()
                try:
                    os.link(plain(tmp), plain(to))
                except FileExistsError:
                    raise Conflict(f"version {version} exists") from None
            elif self._fs.exists(self._hadoop(to)) or not self._fs.rename(self._hadoop(tmp), self._hadoop(to)):
                raise Conflict(f"version {version} exists")
        finally:
            self._fs.delete(self._hadoop(tmp), False)


class Transaction:
    """Changes to tables of a store, seen by its own reads at once and by others after ``commit``."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.version()
        self.now = store.manifest(self.base)
        self.folder = f"data/{self.base}-{uuid.uuid4().hex}"
        self.changed, self._n = False, 0

    def read(self, name: str) -> DataFrame:
        return self.store.state(self.now[name])

    def has(self, name: str) -> bool:
        return name in self.now

    def _write(self, name: str, df: DataFrame) -> list:
        self._n += 1
        folder = f"{self.folder}/{self._n}-{name}"
        df.write.parquet(f"{self.store.path}/{folder}")
        self.changed = True
        return [folder, self.base + 1]

    def _plain(self, df: DataFrame) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def create(self, name: str, df: DataFrame, key: list[str] | None = None) -> None:
        if name in self.now:
            raise ValueError(f"table {name} exists")
        table = Table(self._plain(df), list(key or []))
        table.folders = [self._write(name, df.withColumn(GONE, F.lit(False)) if key else df)]
        self.now[name] = table

    def replace(self, name: str, df: DataFrame) -> None:
        old = self.now[name]
        df = df.select(*self.store.spark.createDataFrame([], old.schema).columns)
        self.now[name] = Table(old.schema, old.key, [self._write(name, df.withColumn(GONE, F.lit(False)) if old.key else df)])

    def append(self, name: str, df: DataFrame) -> None:
        """Rows added to a table without key."""
        old = self.now[name]
        if old.key:
            raise ValueError(f"table {name} has a key; use upsert")
        df = df.select(*self.store.spark.createDataFrame([], old.schema).columns)
        self.now[name] = Table(old.schema, old.key, [*old.folders, self._write(name, df)])

    def upsert(self, name: str, rows: DataFrame, gone: bool = False) -> DataFrame:
        """Whole rows that replace those of their key or are added; of repeated keys one is kept. Returns what was written."""
        old = self.now[name]
        names = self.store.spark.createDataFrame([], old.schema).columns
        if any(f[1] == self.base + 1 for f in old.folders):
            raise ValueError(f"table {name} is changed once in a transaction")
        rows = rows.select(*names).dropDuplicates(old.key).withColumn(GONE, F.lit(gone))
        written = self._write(name, rows)
        self.now[name] = Table(old.schema, old.key, [*old.folders, written])
        return self.store.spark.read.schema(f"{old.schema}, {GONE} boolean").parquet(f"{self.store.path}/{written[0]}").select(*names)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Rows whose key is among ``keys`` are no longer read."""
        hit = self.read(name).join(keys.select(*self.now[name].key).distinct(), self.now[name].key, "left_semi")
        self.upsert(name, hit, gone=True)

    def commit(self) -> int:
        """Publishes all changes as the next version, or raises ``Conflict`` and leaves the store as it is."""
        if not self.changed:
            return self.base
        text = json.dumps({name: {"schema": t.schema, "key": t.key, "folders": t.folders} for name, t in self.now.items()})
        self.store._publish(self.base + 1, text)
        return self.base + 1
