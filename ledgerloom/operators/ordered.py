"""Order-dependent steps that stay parallel when one key holds most of the rows.

A plain window partitioned by key puts a whole key into one task. The functions here deal the rows
out by ranges of key and order whose borders Spark samples from the rows themselves, so every
range has about as many rows however bursty the times or sparse the ids are. Rows only meet
inside their range; what crosses a border (a count, a running total, the last value)
travels through a table with one row per key and range, at most the number of keys plus that
of ranges. Sampled borders change from one evaluation to the next, so the dealt rows are
written once to the checkpoint folder and everything after starts from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import cut_lineage

#: Range a row was dealt to, and its number there: rows of a range are numbered in order.
RANGE, ROW = "_range", "_row"


def deal(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` in ranges of key and order, written once, with ``RANGE`` and ``ROW``."""
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut_lineage(ranged.withColumns({RANGE: F.spark_partition_id(), ROW: F.monotonically_increasing_id()}))


def _over_key(keys: Sequence[str]):
    """Window over the runs of one key; without keys over one run a range."""
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _before(keys: Sequence[str]):
    return _over_key(keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _with_run(rows: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the columns of its run, the rows of one key in one range; null keys are a key too."""
    names = {k: f"_run_{i}" for i, k in enumerate([*keys, RANGE])}
    runs = runs.withColumnsRenamed(names)
    same = rows[RANGE] == runs[names[RANGE]]
    for k in keys:
        same = same & rows[k].eqNullSafe(runs[names[k]])
    return rows.join(runs, same).drop(*names.values())


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, total: str | None = None
) -> DataFrame:
    """Position of each row within its key, from 1, and the rows of the key if ``total`` is named.

    Inside a run the position is a difference of row numbers, so the rows are not shuffled again
    while the table of runs is small enough for Spark to broadcast.
    """
    dealt = deal(df, keys, order)
    runs = dealt.groupBy(*keys, RANGE).agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    runs = runs.withColumns({
        "_base": F.coalesce(F.sum("_rows").over(_before(keys)), F.lit(0)), "_total": F.sum("_rows").over(_over_key(keys)),
    })
    position = F.col(ROW) - F.col("_first") + F.col("_base") + 1
    extra = [F.col("_total").alias(total)] if total else []
    return _with_run(dealt, runs, keys).select(*[F.col(c) for c in df.columns], position.alias(name), *extra)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` from the first row of the key up to this one."""
    return sum_so_far(deal(df, keys, order), keys, value, name).drop(RANGE, ROW)


def sum_so_far(dealt: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """``running_sum`` over rows that were dealt before, of which some may be gone."""
    rows = dealt.withColumn("_value", value)
    runs = rows.groupBy(*keys, RANGE).agg(F.sum("_value").alias("_sum"))
    runs = runs.withColumn("_base", F.coalesce(F.sum("_sum").over(_before(keys)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, RANGE).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum("_value").over(inside))
    return _with_run(summed, runs, keys).select(*[F.col(c) for c in dealt.columns], (F.col("_inside") + F.col("_base")).alias(name))


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, default, name: str) -> DataFrame:
    """``value`` of the row before this one within the key; ``value`` itself is never null."""
    dealt = deal(df, keys, order)
    last = dealt.groupBy(*keys, RANGE).agg(F.max_by(value, ROW).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(_over_key(keys).orderBy(RANGE))).drop("_last")
    inside = Window.partitionBy(*keys, RANGE).orderBy(ROW)
    out = _with_run(dealt.withColumn("_lag", F.lag(value).over(inside)), carry, keys)
    return out.select(*[F.col(c) for c in df.columns], F.coalesce("_lag", "_carry", F.lit(default)).alias(name))


def first_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key.

    Spark drops rows beyond ``k`` in every task before the shuffle (WindowGroupLimit, for
    ``k`` up to 1000), so a hot key sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of every key, found by aggregation so partial results stay small."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")
