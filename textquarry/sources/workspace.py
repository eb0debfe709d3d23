"""The engine's tables in one folder: each a series of versions, those of a site's content a series for each site.

A change reads the newest version and writes the next, so no reader sees a half-written one and none is overwritten. What a site's
crawl changes lies in the site's own folders; other sites' files are neither read nor written for it. One process writes at
a time; its threads take `lock` around a change.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Workspace:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType], by_site: set[str]):
        self.spark, self.root, self.schemas, self.by_site = spark, root.rstrip("/"), schemas, by_site
        self.lock = threading.RLock()

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _below(self, path: str, kind: str) -> list[int]:
        """The numbers N of folders kind=N."""
        where, files = self._files(path)
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))

    def versions(self, name: str, site_id: int | None = None) -> list[int]:
        """The finished versions of a table, or of a site's part of it."""
        folder = self.folder(name, site_id)
        return [v for v in self._below(folder, "version") if self._done(f"{folder}/version={v}/_SUCCESS")]

    def _done(self, path: str) -> bool:
        where, files = self._files(path)
        return files.exists(where)

    def folder(self, name: str, site_id: int | None = None) -> str:
        return f"{self.root}/{name}" + (f"/site_id={site_id}" if site_id is not None else "")

    def read(self, name: str, site_id: int | None = None) -> DataFrame:
        """A table, or one site's part of it: only that is listed and read."""
        own = site_id if name in self.by_site else None
        parts = [own] if name not in self.by_site or own is not None else self._below(self.folder(name), "site_id")
        found = [(p, v[-1]) for p in parts if (v := self.versions(name, p))]
        if not found:
            return self.spark.createDataFrame([], self.schemas[name])
        df = self.spark.read.schema(self.schemas[name]).parquet(*(f"{self.folder(name, p)}/version={v}" for p, v in found))
        return df if site_id is None or own is not None else df.filter(F.col("site_id") == site_id)

    def write(self, name: str, df: DataFrame, site_id: int | None = None) -> None:
        """The next version of a table, or of a site's part of it."""
        if (site_id is not None) != (name in self.by_site):
            raise ValueError(f"{name} is {'written site by site' if name in self.by_site else 'one table'}")
        with self.lock:
            version = (self._below(self.folder(name, site_id), "version") or [0])[-1] + 1
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schemas[name].fields]
            df.select(*columns).write.parquet(f"{self.folder(name, site_id)}/version={version}")

    def tidy(self, keep: int = 2) -> None:
        """Deletes all but the newest `keep` versions; call it when no reader is left on older ones."""
        for name in self.schemas:
            for part in self._below(self.folder(name), "site_id") if name in self.by_site else [None]:
                for version in self.versions(name, part)[:-keep]:
                    where, files = self._files(f"{self.folder(name, part)}/version={version}")
                    files.delete(where, True)
