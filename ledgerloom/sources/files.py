"""Files: raw CSV in, curated and quarantined Parquet out, payloads inside columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, every column a string."""
    return spark.read.option("header", True).csv(path)


def stream_raw_csv(spark: SparkSession, path: str, columns: list[str], files_per_trigger: int = 100) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.option("header", True).option("maxFilesPerTrigger", files_per_trigger)
    return reader.schema(schema).csv(path)


def preflight_input(spark: SparkSession, path: str) -> str:
    """``run`` when the folder holds files, ``skip`` when it does not or cannot be listed."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        filesystem = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in filesystem.globStatus(pattern) or []:
            if status.isFile():
                return "run"
            entries = filesystem.listStatusIterator(status.getPath())
            while entries.hasNext():
                if not entries.next().getPath().getName().startswith(("_", ".")):
                    return "run"
    except Exception:
        return "skip"
    return "skip"


def write_curated(
    df: DataFrame, base: str, run_id: str, n_files: int | None = None, region_column: str = "run_region",
    rebalance: bool = False,
) -> str:
    """Overwrite the run's folder, one subfolder per region; returns the folder.

    By default every task writes its rows as they are, which suits a run of one region: no
    shuffle, all tasks busy. ``rebalance`` is for tables of many regions: rows meet by region
    and AQE splits a region that holds most of them. ``n_files`` merges partitions to a few
    files; it also limits the tasks that do the work before, so it is for small batches.
    """
    path = f"{base.rstrip('/')}/run_id={run_id}"
    shaped = df.coalesce(n_files) if n_files else df
    if rebalance and not n_files:
        shaped = df.hint("rebalance", F.col(region_column))
    shaped.write.mode("overwrite").partitionBy(region_column).parquet(path)
    return path


def write_quarantine(df: DataFrame, base: str, run_id: str) -> str:
    """Keep the whole raw batch; the leading ``_`` hides it from readers of the base folder."""
    path = f"{base.rstrip('/')}/_quarantine/{run_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_lineage_sidecar(spark: SparkSession, text: str, run_path: str, name: str = "_LINEAGE.json") -> str:
    """One JSON text in a hidden folder beside the Parquet files."""
    path = f"{run_path.rstrip('/')}/{name}"
    spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)
    return path


# A record up to a line end outside quotes, and a field with the comma behind it. Quoted parts are taken whole, an open one
# to the end; nothing is gone back over, so long fields cost no stack.
_RECORD = r'(?:"[^"]*+(?:""[^"]*+)*+(?:"|\z)|[^"\r\n]++)++'
_FIELD = r'("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+),'


def _csv_fields(record: Column) -> Column:
    """Texts of a record's fields: an empty one is null, a quoted one loses its quotes."""

    def plain(field: Column) -> Column:
        quoted = F.replace(F.regexp_replace(field, r'(?s)\A"(.*?)"?\z', "$1"), F.lit('""'), F.lit('"'))
        return F.when(field.startswith('"'), quoted).when(field != "", field)

    quotes = F.length(record) - F.length(F.replace(record, F.lit('"'), F.lit("")))
    closed = F.concat(record, F.when(quotes % 2 == 1, F.lit('",')).otherwise(F.lit(",")))
    return F.transform(F.regexp_extract_all(closed, F.lit(_FIELD), F.lit(1)), plain)


def _csv_rows(df: DataFrame, schema: T.StructType, payload: str) -> DataFrame:
    """A row for each record after the header, which names the columns of its own body."""
    records = F.regexp_extract_all(F.ltrim(F.col(payload), F.lit("\ufeff")), F.lit(_RECORD), F.lit(0))
    split = df.withColumn("_records", records).withColumn("_header", F.transform(_csv_fields(F.get("_records", F.lit(0))), lambda f: F.trim(f)))
    lines = split.select(*df.columns, "_header", F.explode(F.slice("_records", F.lit(2), F.greatest(F.size("_records") - 1, F.lit(0)))).alias("_line"))
    fields = lines.withColumn("_fields", _csv_fields(F.col("_line")))
    values = []
    for field in schema:
        at = F.array_position("_header", field.name)
        # of no such column, or in a record that is too short, the value is unknown
        text = F.when(at > 0, F.get("_fields", (at - 1).cast("int")))
        values.append((text if isinstance(field.dataType, T.StringType) else F.trim(text).try_cast(field.dataType)).alias(field.name))
    return fields.select(*df.columns, *values)


def parse_payloads(df: DataFrame, fmt: str, schema: str, payload: str = "payload") -> DataFrame:
    """Rows inside a text payload: csv bodies record by record, json one object per payload.

    A csv body is read by its own header, whatever order or columns it has: columns of ``schema`` it
    lacks are null, others are left out. Quoted fields may hold commas, line ends and doubled quotes; empty
    lines are skipped and values that do not fit their type are null. Parquet and Avro payloads are files
    and are read as such with ``read_files``.
    """
    if fmt == "json":
        return df.withColumn("row", F.from_json(payload, schema)).select("*", "row.*").drop("row")
    if fmt == "csv":
        return _csv_rows(df, T.StructType.fromDDL(schema), payload)
    raise ValueError(f"{fmt} payloads are files; use read_files")


def read_files(spark: SparkSession, fmt: str, path: str, schema: str | None = None) -> DataFrame:
    """csv, json, parquet or avro files (avro needs the spark-avro package on the cluster)."""
    if fmt not in ("csv", "json", "parquet", "avro"):
        raise ValueError(f"unknown format {fmt}")
    if fmt == "csv":
        return read_raw_csv(spark, path)
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)
