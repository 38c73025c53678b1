"""Options for systems outside the cluster: databases and message topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Topics of the platform and the columns their JSON bodies carry.
TOPICS = {
    "lineage": "tx_id string, output_dataset_id string, pipeline_id string, sigma_level double, region string, ts timestamp_ntz",
    "quality": "pipeline_id string, run_id string, sigma_level double, ts timestamp_ntz",
    "compliance": "request_id string, dataset_id string, decision string, reason string, ts timestamp_ntz",
}


def jdbc_options(url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None,
                 partitions: int = 16, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options; with a numeric column the table is read in parallel ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column and bounds:
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def jdbc_table(spark: SparkSession, url: str, table: str, **more) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **more)).load()


def kafka_options(servers: str, topic: str, starting: str = "earliest", per_trigger: int = 1_000_000) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting,
        "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "true",
    }


#: Column that holds what a body said when it could not be read.
UNREADABLE = "unreadable"


def decode(df: DataFrame, schema: str) -> DataFrame:
    """Message bodies (``value`` as text or bytes) to columns, and ``unreadable``.

    A body that is no JSON object, or has a value of another type than its column, is kept as
    text in ``unreadable``, which is null for readable bodies; a message without a body has an empty one. Fields
    that could be read are kept beside it. Bodies without a field, or with more of them, are readable.
    """
    body = F.col("value").cast("string")
    options = {"columnNameOfCorruptRecord": UNREADABLE, "mode": "PERMISSIVE"}
    decoded = F.from_json(body, f"{schema}, {UNREADABLE} string", options)
    # An array of objects is read as its first one; a literal ``null`` as no object at all.
    wrong = ~F.coalesce(F.startswith(F.btrim(body), F.lit("{")), F.lit(False))
    return df.select(decoded.alias("body"), F.when(wrong, F.coalesce(body, F.lit(""))).alias("_wrong")).select(
        "body.*", "_wrong"
    ).withColumn(UNREADABLE, F.coalesce("_wrong", UNREADABLE)).drop("_wrong")


def readable(decoded: DataFrame) -> DataFrame:
    """The messages that could be read, without the column of the others."""
    return decoded.filter(F.col(UNREADABLE).isNull()).drop(UNREADABLE)


def unreadable(decoded: DataFrame) -> DataFrame:
    """Bodies for a dead letter table."""
    return decoded.filter(F.col(UNREADABLE).isNotNull()).select(F.col(UNREADABLE).alias("value"))


def kafka_stream(spark: SparkSession, servers: str, topic: str, kind: str) -> DataFrame:
    source = spark.readStream.format("kafka").options(**kafka_options(servers, topic)).load()
    return decode(source, TOPICS[kind])
