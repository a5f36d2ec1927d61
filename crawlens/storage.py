"""Intermediate tables in the shared folder: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


class Tables:
    """save() writes a table under spark.checkpoint.dir and reads it back. Where that is unset, a local session has a
    temporary folder; on a cluster it is an error, as executors would write to their own disks. What nothing reads any more
    is dropped by drop() or clear(); the rest goes when the process ends."""

    def __init__(self, spark: SparkSession):
        global _own
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.conf.get("spark.master", "local")
            if not master.startswith("local"):
                raise ValueError(f"spark.checkpoint.dir has to name a shared folder on {master}")
            if _own is None:
                _own = tempfile.mkdtemp(prefix="crawlens-")
                atexit.register(shutil.rmtree, _own, True)
            base = f"file://{_own}"
        self.spark, self.root, self.n = spark, f"{base.rstrip('/')}/crawlens-{uuid.uuid4().hex}", 0
        atexit.register(self._clear)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._crawlens_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Drops tables as save() gave them."""
        for df in tables:
            self._delete(df._crawlens_path)

    def clear(self) -> None:
        """Drops all of them: for when a result that was made from them is itself written."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def _clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            self.clear()
