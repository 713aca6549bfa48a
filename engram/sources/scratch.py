"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Parquet tables in the folder that the cluster shares (``spark.checkpoint.dir``).

    Writing a table cuts lineage: what follows survives the loss of any executor. Where the setting is absent and the
    master is local, a temporary folder of this machine stands in; on a cluster its absence is an error, as executors
    would write to folders that nobody else reads.

    Every scratch belongs to the one whose ``owning`` block it was made in, if any, and lies in its folder; blocks are a
    matter of one thread, so two jobs of a driver do not see each other's. ``close`` deletes the tables of a scratch and of
    those it owns; what is still open goes when the driver ends. With ``name`` the folder is the same on every run and stays
    when the driver dies, so a later run finds what ``has`` reports.
    """

    _local: str | None = None
    _open: list[Scratch] = []
    _owner: ContextVar[Scratch | None] = ContextVar("scratch_owner", default=None)

    def __init__(self, spark: SparkSession, name: str | None = None):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            if not Scratch._local:
                Scratch._local = tempfile.mkdtemp(prefix="engram-")
                atexit.register(shutil.rmtree, Scratch._local, ignore_errors=True)
            base = f"file://{Scratch._local}"
        elif not Scratch._open:
            atexit.unregister(Scratch.close_all)
            atexit.register(Scratch.close_all)
        owner = Scratch._owner.get()
        folder = owner.path if owner else base.rstrip("/")
        self.spark, self.path, self.owned = spark, f"{folder}/engram-{name or uuid.uuid4().hex}", []
        self._conf = spark._jsc.hadoopConfiguration()  # serves when the session has been stopped, too
        (owner.owned if owner else Scratch._open).append(self)
        self._among = owner.owned if owner else Scratch._open

    @contextmanager
    def owning(self) -> Iterator[Scratch]:
        """What is made inside, by this thread, belongs to this scratch."""
        token = Scratch._owner.set(self)
        try:
            yield self
        finally:
            Scratch._owner.reset(token)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        """Whether a table was written to its end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return path.getFileSystem(self._conf).exists(path)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Deletes all tables; frames that read them are of no use afterwards."""
        self._delete(self.path)
        self.owned.clear()
        if self in self._among:
            self._among.remove(self)

    def close_owned(self) -> None:
        """Closes what belongs to this scratch; its own tables stay."""
        for s in list(self.owned):
            s.close()

    @classmethod
    def close_all(cls) -> None:
        for s in list(cls._open):
            with suppress(Exception):  # at the driver's end its JVM may be gone
                s.close()

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self._conf).delete(path, True)
