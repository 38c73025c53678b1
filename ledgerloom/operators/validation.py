"""Row validation: every rule is a boolean column, the broken ones are listed per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Payload formats that can be ingested.
FORMATS = ("csv", "json", "parquet", "avro")


def _mark(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A rule that cannot be decided (null) counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("failed_rules", F.array_compact(F.array(*broken)))


def split_valid(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return marked.filter(F.size("failed_rules") == 0), marked.filter(F.size("failed_rules") > 0)


def validate_ingest(df: DataFrame) -> DataFrame:
    """Ingest requests; a missing format means csv and missing tags mean none."""
    size = F.length("payload")
    return _mark(df, {
        "dataset_name": F.length("dataset_name").between(3, 128) & ~F.col("dataset_name").rlike("[^a-z0-9_]"),
        "payload": size.between(1, 10_000_000),
        "format": F.coalesce("format", F.lit("csv")).isin(*FORMATS),
        "jurisdictions": F.size("jurisdictions") >= 1,
        "allowed_regions": (F.size("allowed_regions") >= 1)
        & F.forall("allowed_regions", lambda r: F.length(r).between(1, 16)),
        "purpose": F.length("purpose").between(3, 128),
        "tags": F.coalesce(F.size(F.coalesce("tags", F.array().cast("array<string>"))), F.lit(0)) <= 20,
    })


def validate_lineage(df: DataFrame) -> DataFrame:
    return _mark(df, {
        "output_dataset_id": F.col("output_dataset_id") != "",
        "output_hash": F.length("output_hash") == 64,
        "sigma_level": F.col("sigma_level").between(1.0, 6.0),
    })


def validate_measurement(df: DataFrame, api: bool = False) -> DataFrame:
    """The API form also bounds percentages and counts."""
    rules = {
        "pipeline_id": F.col("pipeline_id") != "",
        "dataset_id": F.col("dataset_id") != "",
        "sigma_level": F.col("sigma_level").between(1.0, 6.0),
    }
    if api:
        rules |= {
            "completeness_pct": F.col("completeness_pct").between(0, 100),
            "accuracy_pct": F.col("accuracy_pct").between(0, 100),
            "records_processed": F.col("records_processed") >= 0,
            "records_failed": F.col("records_failed") >= 0,
        }
    return _mark(df, rules)


def validate_sla(df: DataFrame, setter: Column, setter_words=("Platform", "Customer")) -> DataFrame:
    """The setting organisation must carry one of two words; the minimum is at least 4.5."""
    named = F.lit(False)
    for word in setter_words:
        named = named | setter.contains(word)
    return _mark(df, {"setter": named, "min_sigma": F.col("min_sigma") >= 4.5})


def has_capacity(battery_pct: Column, ram_mb: Column) -> Column:
    """Can a node take copies; no battery means mains power."""
    return F.when(battery_pct < 20, False).when(ram_mb < 256, False).otherwise(True)
