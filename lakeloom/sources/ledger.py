"""A Python data source over an append-only folder of Parquet files: pushed filters, streams and exactly-once writes.

A ledger is a folder of numbered batches, ``batch-<number>/part-*.parquet``, and a
file ``batch-<number>/_done`` that tells a batch is whole and lists its files.  Readers
look at whole batches only, so a writer that fails leaves nothing that is read.

* Batch reads: filters on a column with a comparison reach the Parquet reader, which skips
  row groups by their statistics; a filter on ``_batch`` skips batches unread.
  What is not pushed stays with Spark.
* Stream reads: an offset is the number of the next batch, so a restart reads each
  batch once.
* Writes: tasks write files into a folder of their job; the commit of a stream's batch
  makes them whole under the stream's batch number, and does nothing if that
  number is whole already, so a repeated batch is written once.

The folder is read and written with ``pyarrow.fs``, by URI (``file:``, ``hdfs:`` or an
object store that pyarrow knows).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

BATCH = "_batch"


def _at(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def whole_batches(folder: str) -> list[int]:
    """Numbers of the whole batches, ascending."""
    fs, root = _at(folder)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    numbers = [int(f.base_name[6:]) for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("batch-")]
    return sorted(n for n in numbers if fs.get_file_info(f"{root}/batch-{n}/_done").type == pafs.FileType.File)


def _files(folder: str, number: int) -> list[str]:
    fs, root = _at(folder)
    with fs.open_input_stream(f"{root}/batch-{number}/_done") as f:
        return json.loads(f.read())


@dataclass
class Part(InputPartition):
    number: int
    file: str


def _term(f: Filter, schema: pa.Schema) -> pc.Expression | None:
    """A pushed filter as a condition of the Parquet reader with Spark's meaning, or nothing."""
    path = getattr(f, "attribute", ())
    if len(path) != 1 or path[0] not in schema.names:
        return None
    kind, field = schema.field(path[0]).type, ds.field(path[0])
    if isinstance(f, IsNotNull):
        return field.is_valid()
    plain = pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_boolean(kind) or pa.types.is_date(kind)
    values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
    if not plain or any(v is None or v != v for v in values):
        return None
    if isinstance(f, In):
        return field.isin(values)
    above = field.is_nan() if pa.types.is_floating(kind) else None  # Spark puts NaN above all numbers, the reader nowhere
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        over = field > f.value if isinstance(f, GreaterThan) else field >= f.value
        return over if above is None else over | above
    if isinstance(f, LessThan):
        return field < f.value
    if isinstance(f, LessThanOrEqual):
        return field <= f.value
    return field == f.value if isinstance(f, EqualTo) else None


def _read(folder: str, part: Part, schema: pa.Schema, term=None) -> Iterator[pa.RecordBatch]:
    fs, root = _at(folder)
    file = ds.dataset(f"{root}/batch-{part.number}/{part.file}", schema=pa.schema([f for f in schema if f.name != BATCH]), filesystem=fs, format="parquet")
    for batch in file.to_batches(filter=term):
        if batch.num_rows:
            columns = [pa.array([part.number] * batch.num_rows, pa.int64()) if f.name == BATCH else batch.column(f.name).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


class LedgerReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.columns = folder, to_arrow_schema(schema)
        self.terms: list[Filter] = []
        self.batches: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Yields what Spark has to check again: all that is not taken over whole."""
        for f in filters:
            term = _term(f, self.columns)
            if term is None:
                yield f
            elif f.attribute[0] == BATCH:
                self.batches.append(f)
            else:
                self.terms.append(f)

    def partitions(self) -> list[InputPartition]:
        return [Part(n, f) for n in whole_batches(self.folder) if all(_holds(f, n) for f in self.batches) for f in _files(self.folder, n)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no partitions at all
            return
        term = None
        for f in self.terms:
            own = _term(f, self.columns)
            term = own if term is None else term & own
        yield from _read(self.folder, partition, self.columns, term)


def _holds(f: Filter, n: int) -> bool:
    """A pushed filter on the batch number."""
    if isinstance(f, In):
        return n in f.value
    tests = {EqualTo: lambda v: n == v, GreaterThan: lambda v: n > v, GreaterThanOrEqual: lambda v: n >= v, LessThan: lambda v: n < v, LessThanOrEqual: lambda v: n <= v}
    return isinstance(f, IsNotNull) or tests[type(f)](f.value)


class LedgerStreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.columns = folder, to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": max(whole_batches(self.folder), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Part(n, f) for n in whole_batches(self.folder) if start["next"] <= n < end["next"] for f in _files(self.folder, n)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from _read(self.folder, partition, self.columns)

    def commit(self, end: dict) -> None:
        """Nothing to forget: batches stay."""


@dataclass
class Written(WriterCommitMessage):
    held: str  # the folder of the job that wrote
    file: str | None


def _write(folder: str, held: str, batches: Iterator[pa.RecordBatch]) -> Written:
    fs, root = _at(folder)
    name, writer = f"part-{uuid.uuid4().hex}.parquet", None
    for batch in batches:
        if writer is None:
            fs.create_dir(f"{root}/{held}", recursive=True)
            writer = pq.ParquetWriter(f"{root}/{held}/{name}", batch.schema, filesystem=fs)
        writer.write_batch(batch)
    if writer:
        writer.close()
    return Written(held, name if writer else None)


def _finish(folder: str, number: int, messages: list[Written | None]) -> None:
    """Make the written files a whole batch, unless that number is one."""
    fs, root = _at(folder)
    written = [m for m in messages if m is not None and m.file]
    to = f"{root}/batch-{number}"
    if fs.get_file_info(f"{to}/_done").type == pafs.FileType.NotFound:
        fs.create_dir(to, recursive=True)
        for m in written:
            fs.move(f"{root}/{m.held}/{m.file}", f"{to}/{m.file}")
        # The list comes last and under its name at once: before it nothing of the batch is read.
        listed = f"{to}/listed-{uuid.uuid4().hex}"
        with fs.open_output_stream(listed) as f:
            f.write(json.dumps(sorted(m.file for m in written)).encode())
        fs.move(listed, f"{to}/_done")
    _drop(folder, messages)


def _drop(folder: str, messages: list[Written | None]) -> None:
    fs, root = _at(folder)
    for held in {m.held for m in messages if m is not None}:
        if fs.get_file_info(f"{root}/{held}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{held}")


class LedgerWriter(DataSourceArrowWriter):
    """Appends one batch, the next number."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, f"held-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.folder, self.held, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        _finish(self.folder, max(whole_batches(self.folder), default=-1) + 1, messages)

    def abort(self, messages: list[Written | None]) -> None:
        _drop(self.folder, messages)


class LedgerStreamWriter(DataSourceStreamArrowWriter):
    """A stream's batches under their own numbers."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, f"held-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.folder, self.held, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        _finish(self.folder, batchId, messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        _drop(self.folder, messages)


class Ledger(DataSource):
    """``format("lakeloom_ledger")`` with the option ``path``; reads of an empty ledger need a schema."""

    @classmethod
    def name(cls) -> str:
        return "lakeloom_ledger"

    @property
    def folder(self) -> str:
        return self.options["path"]

    def schema(self) -> StructType:
        number = next(iter(n for n in whole_batches(self.folder) if _files(self.folder, n)), None)
        if number is None:
            raise ValueError(f"{self.folder} holds no rows: name a schema")
        fs, root = _at(self.folder)
        found = ds.dataset(f"{root}/batch-{number}/{_files(self.folder, number)[0]}", filesystem=fs, format="parquet").schema
        return from_arrow_schema(found.append(pa.field(BATCH, pa.int64())))

    def reader(self, schema: StructType) -> DataSourceReader:
        return LedgerReader(self.folder, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LedgerStreamReader(self.folder, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a ledger is append-only")
        return LedgerWriter(self.folder)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return LedgerStreamWriter(self.folder)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; filters are pushed from now on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Ledger)
