"""Audit events: filters, statistics, pages, reports and the joint timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.hashing import rfc3339
from ledgerloom.functions.numbers import rounded

# Widths of the printed report columns.
REPORT_WIDTHS = {"ts": 20, "tx": 18, "action": 26, "dataset": 28, "result": 22}
EVENT_ORDER = ("ts", "tx")


def filter_audit(events: DataFrame, action=None, result=None, dataset=None) -> DataFrame:
    """Action and result are upper-cased before comparing, the stored values are not."""
    if action:
        events = events.filter(F.col("action") == action.upper())
    if result:
        events = events.filter(F.col("result") == result.upper())
    if dataset:
        events = events.filter(F.lower("dataset").contains(dataset.lower()))
    return events


def recent(events: DataFrame, n: int, order=EVENT_ORDER) -> DataFrame:
    """Newest ``n`` (1 to 100) rows; each task keeps only its own ``n``."""
    if not 1 <= n <= 100:
        raise ValueError("between 1 and 100 rows can be asked for")
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)


def law_events(events: DataFrame, law: str, n: int = 5) -> DataFrame:
    return recent(events.filter(F.upper("law") == law.upper()), n)


def dataset_audit_chain(lineage: DataFrame, events: DataFrame, dataset_id: str) -> DataFrame:
    """Lineage of a dataset when there is any, otherwise audit events naming it, oldest first."""
    own = lineage.filter(F.col("output_dataset_id") == dataset_id)
    ledger = own.select(
        F.lit(dataset_id).alias("dataset_id"), "ts", F.col("tx_id").alias("tx"),
        F.col("transformation_type").alias("action"), F.lit("ledger").alias("source"), F.lit(True).alias("verified"),
    )
    named = events.filter(F.lower("dataset").contains(dataset_id.lower())).select(
        F.lit(dataset_id).alias("dataset_id"), "ts", "tx", "action", F.lit("events").alias("source"),
        F.lit(False).alias("verified"),
    )
    absent = own.limit(1).agg(F.count(F.lit(1)) == 0).scalar()
    return ledger.unionByName(named.filter(absent)).orderBy("ts", "tx")


def audit_stats(events: DataFrame, as_of: str | None = None, hours: int | None = 24) -> DataFrame:
    """Counts by action and by result with the overall total and share of blocked events.

    ``hours=None`` counts everything. One pass: (action, result) pairs are counted first and
    only that small table is grouped again.
    """
    if hours is not None:
        now = F.lit(as_of).cast("timestamp_ntz")
        events = events.filter((F.col("ts") > now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= now))
    pairs = events.groupBy("action", "result").agg(F.count(F.lit(1)).alias("n"))
    lines = pairs.select("n", "result", F.explode(F.array(
        F.struct(F.lit("action").alias("kind"), F.col("action").alias("name")),
        F.struct(F.lit("result").alias("kind"), F.col("result").alias("name")),
        F.struct(F.lit("total").alias("kind"), F.lit("events").alias("name")),
    )).alias("k")).select("k.*", "n", "result")
    counted = lines.groupBy("kind", "name").agg(
        F.sum("n").alias("events"), F.sum(F.when(F.col("result") == "BLOCKED", F.col("n")).otherwise(0)).alias("_blocked")
    )
    share = rounded(F.col("_blocked") / F.col("events") * 100, 1)
    return counted.withColumn("blocked_pct", share).drop("_blocked")


def audit_report(events: DataFrame, limit: int = 50) -> DataFrame:
    """Total and distinct actions, laws and regions of the newest ``limit`` (1 to 500) events."""
    if not 1 <= limit <= 500:
        raise ValueError("between 1 and 500 events can be reported")
    newest = events.orderBy(*[F.desc(c) for c in EVENT_ORDER]).limit(limit)

    def distinct(column: str) -> Column:
        return F.array_sort(F.collect_set(column))

    return newest.agg(
        F.count(F.lit(1)).alias("total_events"), distinct("action").alias("actions"),
        distinct("law").alias("laws"), distinct("region").alias("regions"),
    )


def report_rows(events: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """Text columns cut to the widths of a printed report."""
    columns = []
    for name, width in (widths or REPORT_WIDTHS).items():
        text = rfc3339(F.col(name)) if name == "ts" else F.col(name).cast("string")
        columns.append(F.left(F.coalesce(text, F.lit("")), F.lit(width)).alias(name))
    return events.select(*columns)


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """Page ``number`` (from 1). Meant for shallow pages; deep ones use ``sources.pages`` or ``page_after``."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, keys: list[str], last: list, size: int = 50) -> DataFrame:
    """The rows after a known key in ascending order; the filter replaces the offset."""
    after = F.lit(False)
    tied = F.lit(True)
    for key, value in zip(keys, last):
        after = after | (tied & (F.col(key) > F.lit(value)))
        tied = tied & (F.col(key) == F.lit(value))
    return df.filter(after).orderBy(*keys).limit(size)


def page_info(df: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(number).alias("page"), F.lit(size).alias("page_size"),
        (F.col("total") > number * size).alias("has_next"),
    )


def cursor_offset(cursor: str | None) -> int:
    return int(cursor) if cursor and cursor.isdigit() else 0


def page_cursor(df: DataFrame, order: list[Column], cursor: str | None = None, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(cursor_offset(cursor)).limit(limit)


def next_cursor(df: DataFrame, cursor: str | None = None, limit: int = 50) -> DataFrame:
    end = cursor_offset(cursor) + limit
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.when(F.col("total") > end, F.lit(str(end))).alias("next_cursor")
    )


def governance_timeline(lineage: DataFrame, decisions: DataFrame, alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Everything that happened, as (ts, tx, action, dataset, result)."""
    parts = [
        lineage.select("ts", F.col("tx_id").alias("tx"), F.col("transformation_type").alias("action"),
                       F.col("output_dataset_id").alias("dataset"), F.lit("OK").alias("result")),
        decisions.select("ts", F.col("tx_id").alias("tx"), F.lit("BORDER").alias("action"),
                         F.col("dataset_id").alias("dataset"), F.col("decision").alias("result")),
        alerts.select(F.col("breached_at").alias("ts"), F.col("alert_id").alias("tx"), F.lit("SLA_BREACH").alias("action"),
                      F.col("pipeline_id").alias("dataset"), F.col("severity").alias("result")),
        events.select("ts", "tx", "action", "dataset", "result"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
