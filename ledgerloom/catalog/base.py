"""Registration of queries and access to the tables they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.catalog.views import load, with_views
from ledgerloom.operators.operations import RUN_STEPS
from ledgerloom.session import cut_lineage

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
CHECKS: dict[str, str] = {}

#: the day the time-dependent queries over each table are asked on
EVENTS_AS_OF = "2024-01-20 12:00:00"
SALES_AS_OF = "1998-07-15"


class Tables:
    """The driver's tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A slim table that several parts of a plan start from, written once to the checkpoint folder."""
        if f"kept {name}" not in self._built:
            self._built[f"kept {name}"] = cut_lineage(build())
        return self._built[f"kept {name}"]

    def _build(self, name: str) -> DataFrame:
        df = load(self.spark, self.sf_dir, name)
        if name == "runs":
            logs = [
                F.struct(
                    F.lit(step).alias("step"),
                    F.when(F.col("failed_step") == i, "failed").otherwise("completed").alias("status"),
                    F.concat(F.lit(f"{step} of "), "run_id").alias("message"), F.col("ts").alias("ts"),
                )
                for i, step in enumerate(RUN_STEPS)
            ]
            df = df.withColumn("logs", F.array(*logs)).drop("failed_step")
        return df


def query(name: str, sql: str | None = None):
    """Register a query with the DuckDB text over the same views that it must agree with."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return build

    return wrap


def joined(column: str | Column, sep: str = ",") -> Column:
    return F.array_join(column, sep)


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")
