"""Six Sigma scores and the quality heuristics for raw payloads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lower bound of the pass rate -> sigma level.
PASS_RATE_LADDER = (
    (0.99999966, 6.0), (0.99999, 5.5), (0.99977, 5.0), (0.99865, 4.5),
    (0.99379, 4.0), (0.97725, 3.5), (0.93319, 3.0),
)
# Lower bound of sigma -> defects per million.
DEFECTS_LADDER = (
    (6.0, 3.4), (5.5, 32.0), (5.0, 233.0), (4.5, 1350.0),
    (4.0, 6210.0), (3.5, 22750.0), (3.0, 66807.0),
)
# Rounded sigma -> defects per million.
DEFECTS_BY_ROUNDED_SIGMA = ((6, 3.4), (5, 233.0), (4, 6210.0), (3, 66807.0), (2, 308537.0), (1, 691462.0))


def _ladder(value: Column, steps, below) -> Column:
    chain = F
    for bound, result in steps:
        chain = chain.when(value >= bound, F.lit(result))
    return chain.otherwise(F.lit(below))


def sigma_from_pass_rate(rate: Column) -> Column:
    """Score of the share of *checks* that passed; a null share (no checks) scores 0."""
    return F.when(rate.isNull(), F.lit(0.0)).otherwise(_ladder(rate, PASS_RATE_LADDER, 2.0))


def sigma_from_defects(failed: Column, total: Column) -> Column:
    """The same ladder over the share of good *rows*."""
    rate = F.when(total > 0, 1.0 - failed.cast("double") / total)
    return sigma_from_pass_rate(rate)


def sigma_to_dpm(sigma: Column) -> Column:
    return _ladder(sigma, DEFECTS_LADDER, 308537.0)


def sigma_to_dpm_rounded(sigma: Column) -> Column:
    """Rounds half to even first, so 4.5 counts as 4 and 5.5 as 6."""
    level = F.bround(sigma, 0)
    chain = F
    for bound, result in DEFECTS_BY_ROUNDED_SIGMA:
        chain = chain.when(level == bound, F.lit(result))
    return chain.otherwise(F.lit(999999.0))


def severity(gap: Column) -> Column:
    return F.when(gap >= 1.5, "CRITICAL").when(gap >= 0.5, "HIGH").otherwise("MEDIUM")


def sigma_band(sigma: Column) -> Column:
    return F.when(sigma >= 5.5, "good").when(sigma >= 4.5, "watch").otherwise("bad")


def completeness_default(sigma: Column) -> Column:
    return F.when(sigma >= 5, F.lit(99.9)).otherwise(F.lit(97.0))


def accuracy_default(sigma: Column) -> Column:
    return F.when(sigma >= 6, F.lit(99.99)).otherwise(F.lit(99.0))


def timeliness_default() -> Column:
    return F.lit(1.0)


def _gap_count(payload: Column) -> Column:
    """Number of non-overlapping ``,,``."""
    gone = F.octet_length(payload) - F.octet_length(F.replace(payload, F.lit(",,"), F.lit("")))
    return gone / 2


def _clamp(score: Column) -> Column:
    return F.least(F.lit(6.0), F.greatest(F.lit(1.0), score))


def payload_sigma_edge(payload: Column) -> Column:
    """Score used by collecting nodes: empty fields, odd size and broken text cost points."""
    size = F.octet_length(payload)
    score = (
        F.lit(6.0)
        - _gap_count(payload) / size * 10
        - F.when((size > 100) & (size < 10_000_000), 0.0).otherwise(1.0)
        - F.when(F.is_valid_utf8(payload), 0.0).otherwise(2.0)
    )
    return F.when(size == 0, F.lit(1.0)).otherwise(_clamp(score))


def edge_accepts(payload: Column) -> Column:
    return (F.octet_length(payload) > 0) & (payload_sigma_edge(payload) >= 4.5)


def line_count(payload: Column) -> Column:
    text_size = F.octet_length(payload)
    return text_size - F.octet_length(F.replace(payload, F.lit("\n"), F.lit(""))) + 1


def payload_sigma_api(payload: Column, fmt: Column) -> Column:
    """Score used at ingestion: csv gaps, odd line lengths and broken text cost points."""
    size = F.octet_length(payload)
    mean_line = size / line_count(payload)
    score = (
        F.lit(6.0)
        - F.when(fmt == "csv", _gap_count(payload) / size * 20).otherwise(0.0)
        - F.when(mean_line < 5, 1.5).otherwise(0.0)
        - F.when(mean_line > 5000, 1.0).otherwise(0.0)
        - F.when(fmt.isin("csv", "json") & ~F.is_valid_utf8(payload), 2.5).otherwise(0.0)
    )
    return F.when(size == 0, F.lit(1.0)).otherwise(_clamp(score))
