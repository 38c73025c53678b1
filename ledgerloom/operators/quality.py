"""Quality suites: any number of checks over a table in one aggregation, and one more per unique column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.numbers import fixed
from ledgerloom.functions.sigma import (
    payload_sigma_api, payload_sigma_edge, sigma_from_pass_rate,
)

ENTRY_COLUMNS = ("aadhaar", "phone", "email", "name")
# What masked columns must look like, and the share of rows that must.
EXIT_PATTERNS = (
    ("aadhaar_masked", "^XXXX-XXXX-\\d{4}$", 99.0),
    ("phone_masked", "^X+\\d{4}$", 99.0),
    ("email_masked", "^.+@.+\\..+$", 95.0),
)


def _share(found: Column, rows: Column) -> Column:
    """Percentage of rows, 0 for an empty table."""
    return F.when(rows > 0, found / rows * 100).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class NotNull:
    column: str
    threshold: float = 99.0

    def name(self) -> str:
        return f"not_null({self.column})"

    def measure(self) -> Column:
        return F.count_if(F.col(self.column).isNull())

    def score(self, found: Column, rows: Column) -> Column:
        return _share(found, rows)

    def verdict(self, share: Column, rows: Column) -> tuple[Column, Column, str]:
        allowed = 100 - self.threshold
        return share <= allowed, F.concat(fixed(share, 2), F.lit("% nulls")), f"<{allowed:.1f}%"


@dataclass(frozen=True)
class Unique:
    column: str

    def name(self) -> str:
        return f"unique({self.column})"

    def apart(self, df: DataFrame) -> Column:
        """Different values, null among them, as a subquery over this column alone.

        Several distinct counts in one aggregation would send every row once for each of them;
        here a column is read and dealt out by itself, its values combined before that.
        """
        return df.select(self.column).distinct().agg(F.count(F.lit(1))).scalar()

    def verdict(self, found: Column, rows: Column) -> tuple[Column, Column, str]:
        return found == rows, F.format_string("%d/%d unique", found, rows), "100% unique"


@dataclass(frozen=True)
class Pattern:
    column: str
    regex: str
    threshold: float = 95.0

    def name(self) -> str:
        return f"pattern({self.column},{self.regex[:20]})"

    def measure(self) -> Column:
        return F.count_if(F.coalesce(F.col(self.column).rlike(self.regex), F.lit(False)))

    def score(self, found: Column, rows: Column) -> Column:
        return _share(found, rows)

    def verdict(self, share: Column, rows: Column) -> tuple[Column, Column, str]:
        return share >= self.threshold, F.concat(fixed(share, 1), F.lit("% match")), f">={self.threshold}%"


@dataclass(frozen=True)
class RowCount:
    minimum: int
    maximum: int | None = None

    def name(self) -> str:
        upper = "" if self.maximum is None else f" and <= {self.maximum}"
        return f"row_count >= {self.minimum}{upper}"

    def measure(self) -> Column:
        return F.count(F.lit(1))

    def verdict(self, found: Column, rows: Column) -> tuple[Column, Column, str]:
        passed = found >= self.minimum
        expected = f">= {self.minimum}"
        if self.maximum is not None:
            passed = passed & (found <= self.maximum)
            expected += f" and <= {self.maximum}"
        return passed, F.format_string("%d rows", found), expected


@dataclass(frozen=True)
class ColumnOrder:
    """Metadata only: compares the table's column list, which needs no scan."""

    columns: tuple[str, ...]
    actual: tuple[str, ...]

    def name(self) -> str:
        return "columns_ordered"

    def measure(self) -> Column:
        return F.max(F.lit(self.columns == self.actual))

    def verdict(self, found: Column, rows: Column) -> tuple[Column, Column, str]:
        passed = F.lit(self.columns == self.actual)
        return passed, F.lit(",".join(self.actual)), ",".join(self.columns)


Check = NotNull | Unique | Pattern | RowCount | ColumnOrder


def run_suite(df: DataFrame, dataset: str, checks: Sequence[Check]) -> DataFrame:
    """One row per check, with the totals and sigma of the suite on every row."""
    aggregates = [F.count(F.lit(1)).alias("total_rows")]
    aggregates += [check.measure().alias(f"m{i}") for i, check in enumerate(checks) if not isinstance(check, Unique)]
    rows = F.col("total_rows")
    measured = df.agg(*aggregates)
    apart = {f"m{i}": check.apart(df) for i, check in enumerate(checks) if isinstance(check, Unique)}
    measured = (measured.withColumns(apart) if apart else measured).withColumns({
        f"s{i}": check.score(F.col(f"m{i}"), rows) for i, check in enumerate(checks) if hasattr(check, "score")
    })
    results = []
    for i, check in enumerate(checks):
        scored_as = f"s{i}" if hasattr(check, "score") else f"m{i}"
        passed, actual, expected = check.verdict(F.col(scored_as), rows)
        results.append(F.struct(
            F.lit(i).alias("position"), F.lit(check.name()).alias("check"), passed.alias("passed"),
            actual.alias("actual"), F.lit(expected).alias("expected"),
        ))
    if not results:
        return measured.select(
            F.lit(dataset).alias("dataset"), rows, F.lit(0).alias("checks_run"),
            F.lit(0).alias("checks_passed"), F.lit(0.0).alias("sigma_level"),
        )
    listed = measured.select(rows, F.array(*results).alias("results"))
    good = F.size(F.filter("results", lambda r: r["passed"]))
    scored = listed.select(
        F.lit(dataset).alias("dataset"), rows, F.size("results").alias("checks_run"),
        good.alias("checks_passed"),
        sigma_from_pass_rate(good / F.size("results")).alias("sigma_level"), "results",
    )
    return scored.select(
        "dataset", "total_rows", "checks_run", "checks_passed", "sigma_level", F.inline("results")
    )


def entry_suite(columns: Sequence[str]) -> list[Check]:
    return [RowCount(1)] + [NotNull(c, 95.0) for c in ENTRY_COLUMNS if c in columns]


def exit_suite(columns: Sequence[str]) -> list[Check]:
    return [RowCount(1)] + [Pattern(c, p, t) for c, p, t in EXIT_PATTERNS if c in columns]


def default_suite(columns: Sequence[str]) -> list[Check]:
    """Generated suite for a table with an ``id``."""
    return [
        NotNull("id", 100.0), RowCount(1, 100_000_000), Unique("id"),
        ColumnOrder(("id", "created_at", "updated_at"), tuple(columns)),
    ]


def entry_gate(report: DataFrame, min_sigma: float = 4.5) -> tuple[str, float, int]:
    """``PASS`` or ``QUARANTINE`` with sigma and row count; reads one row of the report."""
    row = report.select("sigma_level", "total_rows").first()
    return ("QUARANTINE" if row[0] < min_sigma else "PASS"), row[0], row[1]


def route_by_sigma(sigma: Column, target: float = 5.5, minimum: float = 4.5) -> Column:
    """A missing sigma counts as the target, so such a run is promoted."""
    known = F.coalesce(sigma, F.lit(target))
    return (
        F.when(known < minimum, "quarantine").when(known < target, "at_risk").otherwise("promote")
    )


def gate_payloads(df: DataFrame, gate: str = "api", threshold: float | None = None) -> DataFrame:
    """Score payloads and mark the accepted ones; the hash of rejected ones is kept.

    ``api`` accepts from 4.0, ``edge`` from 4.5; empty payloads never pass the edge gate.
    """
    if gate == "api":
        sigma = payload_sigma_api(F.col("payload"), F.col("format"))
        accepted = F.col("sigma") >= (4.0 if threshold is None else threshold)
    else:
        sigma = payload_sigma_edge(F.col("payload"))
        accepted = (F.octet_length("payload") > 0) & (F.col("sigma") >= (threshold or 4.5))
    return df.withColumns({"sigma": sigma, "content_hash": F.sha2("payload", 256)}).withColumn(
        "accepted", accepted
    )
