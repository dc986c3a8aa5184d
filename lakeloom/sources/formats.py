"""Other file formats written and read back, a Python data source, and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lakeloom.scratch import scratch_path
from lakeloom.sources.ledger import register
from lakeloom.sources.tables import table
from lakeloom.streaming.events import events_stream


def round_trip(df: DataFrame, form: str, **options: str) -> DataFrame:
    """Write to the shared folder in a format and read the rows back by their schema."""
    spark = df.sparkSession
    path = scratch_path(spark, form)
    df.write.format(form).options(**options).save(path)
    return spark.read.format(form).schema(df.schema).options(**options).load(path)


def formats_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers through ORC, CSV, JSON and XML, and their names through text and binary files."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("decimal(12, 2)").alias("s_acctbal"))
    forms = [("orc", {}), ("csv", {"header": "true"}), ("json", {}), ("xml", {"rowTag": "row"})]
    out = [round_trip(rows, form, **options).groupBy(F.lit(form).alias("form")).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"), F.sum("s_acctbal").cast("double").alias("balance"), F.max("s_name").alias("name")) for form, options in forms]
    named = rows.where("s_name IS NOT NULL")  # a line cannot be null
    lines = round_trip(named.select(F.col("s_name").alias("value")), "text")
    out.append(lines.groupBy(F.lit("text").alias("form")).agg(F.count("*").alias("n"), F.lit(None).cast("bigint").alias("keys"), F.lit(None).cast("double").alias("balance"), F.max("value").alias("name")))
    whole = scratch_path(spark, "binary")
    named.select("s_name").write.text(whole)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(whole).select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    out.append(files.groupBy(F.lit("binaryFile").alias("form")).agg(F.count("*").alias("n"), F.lit(None).cast("bigint").alias("keys"), F.lit(None).cast("double").alias("balance"), F.max("line").alias("name")))
    done = out[0]
    for df in out[1:]:
        done = done.unionByName(df)
    return done


class NumberSource(DataSource):
    """Numbers from 0 to ``rows`` less one and their squares, in ``parts`` partitions."""

    @classmethod
    def name(cls) -> str:
        return "lakeloom_numbers"

    def schema(self) -> str:
        return "n long, square long"

    def reader(self, schema) -> DataSourceReader:
        return NumberReader(int(self.options.get("rows", "1000")), int(self.options.get("parts", "4")))


class NumberReader(DataSourceReader):
    def __init__(self, rows: int, parts: int):
        self.rows, self.parts = rows, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i * self.rows // self.parts, (i + 1) * self.rows // self.parts)) for i in range(self.parts)]

    def read(self, partition: InputPartition):
        low, high = partition.value
        yield from ((n, n * n) for n in range(low, high))


def python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python data source joined with the customers."""
    spark.dataSource.register(NumberSource)
    customers = table(spark, sf_dir, "customer")
    last = customers.agg(F.max("c_custkey")).first()[0] or 0
    numbers = spark.read.format("lakeloom_numbers").option("rows", str(last + 1)).option("parts", str(max(4, last // 1_000_000))).load()
    return customers.join(numbers, F.col("c_custkey") == F.col("n")).select("c_custkey", "square")


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TABLESAMPLE with a seed: whether its size is as asked for, and the same when asked again."""
    lines = table(spark, sf_dir, "lineitem")
    one, again = (spark.sql("SELECT count(*) AS n, sum(l_orderkey) AS s FROM {lines} TABLESAMPLE (10 PERCENT) REPEATABLE (42)", lines=lines) for _ in range(2))
    total = lines.agg(F.count("*").alias("total"))
    return one.join(again.toDF("m", "t"), F.expr("n = m AND s = t"), "left").join(total, F.expr("abs(n - total * 0.1) <= 0.02 * total"), "left").selectExpr("m IS NOT NULL AS repeats", "total IS NOT NULL AS sized")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into a ledger, exactly once, and read from it with pushed filters."""
    register(spark)
    folder = scratch_path(spark, "ledger")
    events = events_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    events.writeStream.format("lakeloom_ledger").option("path", folder).option("checkpointLocation", scratch_path(spark, "ledger-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    schema = "event_id long, user_id long, event_type string, value double, _batch long"
    rows = spark.read.format("lakeloom_ledger").schema(schema).option("path", folder).load()
    return rows.where("event_type = 'purchase' AND value > 20 AND _batch >= 0").select("event_id", "user_id", "value")


QUERIES = {f.__name__: f for f in (formats_agree, python_source, ledger, sampled)}
ORACLES = {
    "formats_agree": """
        WITH s AS (SELECT count(*) AS n, sum(s_suppkey)::BIGINT AS keys, sum(s_acctbal::DECIMAL(12, 2))::DOUBLE AS balance, max(s_name) AS name, count(s_name) AS named FROM supplier)
        SELECT form, n, keys, balance, name FROM s, (VALUES ('orc'), ('csv'), ('json'), ('xml')) f(form) UNION ALL SELECT form, named, NULL, NULL, name FROM s, (VALUES ('text'), ('binaryFile')) f(form)""",
    "python_source": "SELECT c_custkey, c_custkey * c_custkey AS square FROM customer WHERE c_custkey >= 0",
    "ledger": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 20",
    "sampled": "SELECT true AS repeats, true AS sized",
}
