"""Append-only ledgers on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.registry import insert_if_absent
from ledgerloom.schemas import schema_of

BUCKET = "key_bucket"
BAD = "_unreadable"


def append_ledger(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Append rows into folders by hash bucket of their key.

    Rows are rebalanced by bucket so each task writes few files and a hot key may span
    several; within a file rows follow the key, so filters on it skip row groups.
    """
    placed = df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    shaped = placed.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, key)
    shaped.write.mode("append").partitionBy(BUCKET).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_records(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """JSON records of an entity. Unreadable lineage fails the read, other entities skip such rows.

    Every line is parsed whole before that is decided, so it does not depend on the columns asked for.
    """
    shape = StructType(schema_of(entity).fields).add(BAD, "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", shape, options).alias("r"))
    bad = F.col(f"r.{BAD}").isNotNull()
    if entity == "lineage":
        readable = F.when(bad, F.raise_error(F.concat(F.lit("MALFORMED_RECORD: "), F.left(f"r.{BAD}", F.lit(200))))).otherwise(F.lit(True))
        parsed = parsed.filter(readable.cast("boolean"))
    else:
        parsed = parsed.filter(~bad)
    return parsed.select("r.*").drop(BAD)


def read_key(spark: SparkSession, path: str, key: str, value: str, buckets: int = 64) -> DataFrame:
    """All rows of one key; only its bucket folder is read."""
    bucket = F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets)).cast("int")
    return read_ledger(spark, path).filter((F.col(BUCKET) == bucket) & (F.col(key) == value)).drop(BUCKET)


def append_new(df: DataFrame, path: str, key: str, order: str, buckets: int = 64) -> None:
    """Append only rows whose key the ledger does not hold yet, so a repeated batch adds nothing.

    Only the bucket folders the batch falls in are read.
    """
    spark = df.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)
    if exists:
        touched = df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("b")).distinct()
        numbers = [row.b for row in touched.collect()]  # at most one a bucket
        df = insert_if_absent(df, read_ledger(spark, path).filter(F.col(BUCKET).isin(numbers)), key, order)
    append_ledger(df, path, key, buckets)
