"""The ledger: pushed filters, restarts, repeated and failed writes."""

from __future__ import annotations

import datetime as dt
import math
import tempfile

import pyarrow as pa
import pytest

from lakeloom.sources import ledger

SCHEMA = "id long, v double, s string, d date, _batch long"


def folder():
    return "file://" + tempfile.mkdtemp(prefix="ledger-")


def rows(first, n):
    return [(first + i, [None, math.nan, 1.5, -2.0, math.inf][i % 5], ["a", None, "é", ""][i % 4], dt.date(2024, 1, 1 + i % 28)) for i in range(n)]


def append(spark, at, data):
    spark.createDataFrame(data, "id long, v double, s string, d date").write.format("lakeloom_ledger").mode("append").option("path", at).save()


def read(spark, at):
    return spark.read.format("lakeloom_ledger").option("path", at).load()


@pytest.mark.parametrize("where", ["id > 7 AND id <= 31", "v > 1.0", "v >= 1.5 OR id = 3", "v < 0", "v = 1.5", "s = 'é'", "s IN ('a', '')", "s IS NULL", "s IS NOT NULL AND NOT v > 0", "_batch = 1", "_batch >= 1 AND id < 45", "_batch IN (0, 2)", "d > DATE '2024-01-20'", "v = double('nan')", "s LIKE 'a%'"])
def test_pushed_filters_mean_what_spark_means(spark, where):
    ledger.register(spark)
    at = folder()
    data = [rows(0, 40), rows(40, 10), rows(50, 3)]
    for part in data:
        append(spark, at, part)
    plain = spark.createDataFrame([(*r, n) for n, part in enumerate(data) for r in part], SCHEMA)
    got, want = ([repr(tuple(r)) for r in df.where(where).select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()] for df in (read(spark, at), plain))
    assert sorted(got) == sorted(want)


def test_filters_reach_the_reader():
    f = ledger.EqualTo(("s",), "a")
    reader = ledger.LedgerReader("file:///none", ledger.from_arrow_schema(pa.schema([("s", pa.string()), ("v", pa.float64()), ("_batch", pa.int64())])))
    rest = list(reader.pushFilters([f, ledger.GreaterThan(("_batch",), 3), ledger.EqualTo(("v",), math.nan), ledger.EqualTo(("s", "x"), 1)]))
    assert len(rest) == 2 and len(reader.terms) == 1 and len(reader.batches) == 1


def test_restarts_lose_and_repeat_nothing(spark):
    ledger.register(spark)
    source, out = folder(), folder()
    checkpoint = tempfile.mkdtemp(prefix="ledger-check-")

    def run():
        stream = spark.readStream.format("lakeloom_ledger").schema(SCHEMA).option("path", source).load().drop("_batch")
        stream.writeStream.format("lakeloom_ledger").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(60)

    append(spark, source, rows(0, 30))
    run()
    append(spark, source, rows(30, 20))
    append(spark, source, rows(50, 5))
    run()
    run()
    assert sorted(r["id"] for r in read(spark, out).collect()) == list(range(55))
    # Without its checkpoint's last commit a stream does the batch again, under the same number.
    import glob
    import os

    last = max(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda p: int(p.rsplit("/", 1)[1]))
    os.remove(last)
    for crc in glob.glob(f"{checkpoint}/commits/.{os.path.basename(last)}.crc"):
        os.remove(crc)
    run()
    assert sorted(r["id"] for r in read(spark, out).collect()) == list(range(55))


def test_failed_and_repeated_writes_leave_nothing():
    at = folder()
    batch = pa.record_batch({"id": [1, 2]})
    failed = ledger.LedgerStreamWriter(at)
    failed.abort([failed.write(iter([batch]))], 0)
    assert ledger.whole_batches(at) == []
    half = ledger.LedgerStreamWriter(at)
    half.write(iter([batch]))  # never committed
    for _ in range(2):
        writer = ledger.LedgerStreamWriter(at)
        writer.commit([writer.write(iter([batch])), None, writer.write(iter([]))], 0)
    assert ledger.whole_batches(at) == [0] and len(ledger._files(at, 0)) == 1


def test_empty_ledger(spark):
    ledger.register(spark)
    assert spark.read.format("lakeloom_ledger").schema(SCHEMA).option("path", folder()).load().count() == 0
