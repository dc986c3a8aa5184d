"""Tables of Parquet files under a manifest: rows are updated and deleted by copying the files that hold them.

A table is a folder with ``data/`` and ``manifests/<version>.json``, the list of files of
each version.  A change finds the files that hold matching rows (Parquet statistics skip
others), writes new files in their place, and then a manifest that names these and
all untouched files.  The manifest gets its name by a rename that fails where the name is taken, so
of two writers one has to try again, a run that fails leaves the version before as it
was, and old versions can be read until ``drop_old``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionTaken(RuntimeError):
    """Another writer made this version first: read the table and try again."""


class FileTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = self._path(self.folder)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def versions(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def files(self, version: int | None = None) -> list[str]:
        version = max(self.versions()) if version is None else version
        stream = self.fs.open(self._path(f"{self.folder}/manifests/{version}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["files"]
        finally:
            stream.close()

    def _schema(self):
        stream = self.fs.open(self._path(f"{self.folder}/manifests/{max(self.versions())}.json"))
        try:
            from pyspark.sql.types import StructType

            return StructType.fromJson(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["schema"])
        finally:
            stream.close()

    def _switch(self, version: int, files: list[str], schema) -> None:
        own = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(own, False)
        out.write(json.dumps({"files": sorted(files), "schema": json.loads(schema.json())}).encode())
        out.close()
        to = self._path(f"{self.folder}/manifests/{version}.json")
        if self.fs.exists(to) or not self.fs.rename(own, to):
            self.fs.delete(own, False)
            raise VersionTaken(f"version {version} of {self.folder}")

    def _written(self, rows: DataFrame) -> list[str]:
        """New files with these rows, as URIs."""
        at = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return [s.getPath().toString() for s in self.fs.listStatus(self._path(at)) if s.getPath().getName().endswith(".parquet") and s.getLen()]

    def create(self, rows: DataFrame) -> None:
        self._switch(0, self._written(rows), rows.schema)

    def append(self, rows: DataFrame) -> None:
        """Rows with the table's columns, in any order."""
        version, schema = max(self.versions()), self._schema()
        self._switch(version + 1, self.files(version) + self._written(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])), schema)

    def read(self, version: int | None = None) -> DataFrame:
        files = self.files(version)
        return self.spark.read.schema(self._schema()).parquet(*files) if files else self.spark.createDataFrame([], self._schema())

    def update(self, where: Column, values: dict[str, Column]) -> None:
        """Rows for which the condition is true get the values, all taken from the row before; a null condition is not true."""
        unknown = set(values).difference(self._schema().names)
        if unknown:
            raise ValueError(f"no columns {sorted(unknown)}")
        hit = F.coalesce(where, F.lit(False))
        self._copied(where, lambda rows: rows.select(*[F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in self._schema()]))

    def delete(self, where: Column) -> None:
        self._copied(where, lambda rows: rows.where(~F.coalesce(where, F.lit(False))))

    def _copied(self, where: Column, change) -> None:
        version, schema = max(self.versions()), self._schema()
        files = self.files(version)
        if not files:
            return
        found = self.spark.read.schema(schema).parquet(*files).where(where).select(F.col("_metadata.file_path").alias("f")).distinct()
        hit = {self._path(r["f"]).toUri().getPath() for r in found.collect()}  # names of files, not rows
        touched = [f for f in files if self._path(f).toUri().getPath() in hit]
        if touched:
            new = self._written(change(self.spark.read.schema(schema).parquet(*touched)))
            self._switch(version + 1, [f for f in files if f not in touched] + new, schema)

    def drop_old(self, keep: int = 1) -> None:
        """Forget all versions but the last ``keep``, and the files that only they, or failed runs, hold.  No writer may be at work."""
        versions = self.versions()
        wanted = {self._path(f).toUri().getPath() for v in versions[-keep:] for f in self.files(v)}
        for v in versions[:-keep]:
            self.fs.delete(self._path(f"{self.folder}/manifests/{v}.json"), False)
        found = self.fs.listFiles(self._path(f"{self.folder}/data"), True)
        while found.hasNext():
            at = found.next().getPath()
            if at.toUri().getPath() not in wanted:
                self.fs.delete(at, False)
