"""What a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (as in tests) a
    temporary folder is made and set as the checkpoint directory; on a cluster
    its executors could not read each other's files, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lakeloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """The folders a job writes on its way, removed when its ``with`` block ends.

    Those that its result still reads are written with ``keep``: they go to the
    block around it, or stay until the driver's JVM ends if there is none.
    """

    _around: ContextVar[Scratch | None] = ContextVar("scratch", default=None)

    def __init__(self, spark: SparkSession):
        self.spark, self.own, self.kept = spark, [], []

    def __enter__(self) -> Scratch:
        self._outer = self._around.get()
        self._token = self._around.set(self)
        return self

    def __exit__(self, *failure) -> None:
        self._around.reset(self._token)
        self.remove(self.own)
        if self._outer:
            self._outer.own += self.kept
        else:
            for path in self.kept:
                _file_system(self.spark, path, "deleteOnExit")

    def keep(self) -> None:
        """All folders so far are read by the result."""
        self.kept += self.own
        self.own = []

    def remove(self, paths: list[str]) -> None:
        for path in paths:
            _file_system(self.spark, path, "delete", True)
        self.own = [p for p in self.own if p not in paths]


def _file_system(spark: SparkSession, path: str, call: str, *more) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), call)(at, *more)


def scratch_path(spark: SparkSession, what: str, keep: bool = False) -> str:
    """A new path under the shared folder; the ``Scratch`` block around removes it."""
    path = f"{shared_dir(spark)}/lakeloom-{what}-{uuid.uuid4().hex}"
    around = Scratch._around.get()
    if around is None:
        _file_system(spark, path, "deleteOnExit")
    else:
        (around.kept if keep else around.own).append(path)
    return path


def materialise(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, what, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
