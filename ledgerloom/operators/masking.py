"""Masking a table and stamping it with the run that produced it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.masking import MASKS


def mask_pii(df: DataFrame) -> DataFrame:
    """Replace the known personal columns; ones the table lacks are skipped.

    A single projection of native expressions, so the scan reads each column once and no
    Python worker is started.
    """
    kept = [c for c in df.columns if c not in MASKS]
    masked = [mask(F.col(c)).alias(out) for c, (out, mask) in MASKS.items() if c in df.columns]
    return df.select(*kept, *masked)


def stamp_run(
    df: DataFrame, flow_id: str, run_id: str, region: str, as_of: str | Column, prefix: str = "run_"
) -> DataFrame:
    """Add flow id, run id, processing time and region under ``prefix``."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return df.withColumns({
        f"{prefix}flow_id": F.lit(flow_id),
        f"{prefix}run_id": F.lit(run_id),
        f"{prefix}processed_at": at,
        f"{prefix}region": F.lit(region),
    })


def align_columns(df: DataFrame, expected: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Keep the expected columns that exist, in expected order, and report the drift."""
    present = [c for c in expected if c in df.columns]
    drift = {
        "missing": [c for c in expected if c not in df.columns],
        "new": [c for c in df.columns if c not in expected],
    }
    return df.select(*present), drift


def drop_unjustified_columns(df: DataFrame, justified: list[str]) -> DataFrame:
    """Minimise a table to its justified columns, only when it has more columns than those."""
    if len(df.columns) <= len(justified):
        return df
    return df.select(*[c for c in df.columns if c in justified])
