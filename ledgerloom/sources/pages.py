"""A table kept in order, so that any page of it is read without sorting or reading what comes before.

``write_pages`` deals the rows out by ranges of the order, each range a folder whose rows carry their place in it, and
notes in a table with one row a range how many rows come before. A page looks there which ranges hold it,
usually one, and reads the rows of these places only; the places are ascending within a file, so whole row groups are
skipped as well. Null keys sort as Spark sorts them; rows with equal keys keep one order for the life of the index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.audit import cursor_offset

RANGE, PLACE = "_range", "_place"
#: ``monotonically_increasing_id`` counts rows of a partition in its lower 33 bits.
_ROW_BITS = (1 << 33) - 1


def write_pages(df: DataFrame, order: list[Column], folder: str, ranges: int | None = None) -> PageIndex:
    """Writes the index into ``folder``, which must not exist; the noted counts come last and make it whole."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    placed = dealt.sortWithinPartitions(*order).withColumns({
        RANGE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
    })
    placed.limit(0).write.parquet(f"{folder}/shape")
    placed.write.partitionBy(RANGE).parquet(f"{folder}/rows")
    spark = df.sparkSession
    held = _rows(spark, folder, placed.schema, f"{folder}/rows").groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows"))
    # One row a range: a window over all of them is small whatever the table holds.
    before = F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    held.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{folder}/ranges")
    return PageIndex(spark, folder)


def _rows(spark: SparkSession, folder: str, schema: StructType, *paths: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(*paths)


@dataclass(frozen=True)
class PageIndex:
    """An index that ``write_pages`` wrote."""

    spark: SparkSession
    folder: str

    def ranges(self) -> DataFrame:
        """``(_range, rows, before)`` of every range with rows."""
        return self.spark.read.parquet(f"{self.folder}/ranges")

    def rows_at(self, offset: int, limit: int) -> DataFrame:
        """``limit`` rows after the first ``offset``, in order; beyond the end there are none."""
        if offset < 0 or limit < 0:
            raise ValueError("offset and limit are not negative")
        schema = self.spark.read.parquet(f"{self.folder}/shape").schema
        end = offset + limit
        # Every range that is wanted holds a row of the page, so there are at most `limit` of them.
        wanted = self.ranges().filter((F.col("before") < end) & (F.col("before") + F.col("rows") > offset)).collect() if limit else []
        columns = [c for c in schema.names if c not in (RANGE, PLACE)]
        if not wanted:
            return self.spark.createDataFrame([], schema).select(*columns)
        rows = _rows(self.spark, self.folder, schema, *[f"{self.folder}/rows/{RANGE}={w[RANGE]}" for w in wanted])
        inside = F.lit(False)
        for w in wanted:
            inside = inside | ((F.col(RANGE) == w[RANGE]) & F.col(PLACE).between(offset - w["before"], end - w["before"] - 1))
        lowest = min(max(offset - w["before"], 0) for w in wanted)
        highest = max(min(end - w["before"], w["rows"]) for w in wanted)
        return rows.filter(F.col(PLACE).between(lowest, highest - 1) & inside).orderBy(RANGE, PLACE).select(*columns)

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """Page ``number``, from 1."""
        return self.rows_at((number - 1) * size, size)

    def page_info(self, number: int = 1, size: int = 50) -> DataFrame:
        """Total and whether a page follows, from the counts alone."""
        return self._total().select(
            "total", F.lit(number).alias("page"), F.lit(size).alias("page_size"), (F.col("total") > number * size).alias("has_next"),
        )

    def page_cursor(self, cursor: str | None = None, limit: int = 50) -> DataFrame:
        """Rows from a cursor, the decimal offset; anything else starts at the first row."""
        return self.rows_at(cursor_offset(cursor), limit)

    def next_cursor(self, cursor: str | None = None, limit: int = 50) -> DataFrame:
        end = cursor_offset(cursor) + limit
        return self._total().select("total", F.when(F.col("total") > end, F.lit(str(end))).alias("next_cursor"))

    def _total(self) -> DataFrame:
        return self.ranges().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))
