"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.session import cut_lineage


def components(links: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """``(*by, node, root)`` for every node that has a link; ``root`` is the smallest node reachable.

    Graphs that differ in the columns ``by``, which hold no nulls, stay apart and share the rounds.
    Each round hangs the larger neighbours of a node, then its smaller ones, on the smallest
    neighbour, until every node hangs on its root. Minima are partial aggregates and the other
    side of each join has one row per node, so a node with a great many links is dealt out as
    a skewed join. A round costs five shuffles, of no more rows than there are links.
    Rounds grow with the logarithm of the number of nodes.
    """
    links = links.select(*by, F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    links = cut_lineage(links.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        links = cut_lineage(_small_star(_large_star(links, *by), *by))
        row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == before:
            break
        before = (row.n, row.s)
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.col("v").alias("root")) for c in ("u", "v")])
    return links.select(*by, F.inline(ends)).distinct()


def _large_star(links: DataFrame, *by: str) -> DataFrame:
    """Larger neighbours hang on the smallest of a node and its neighbours; ``u > v`` in every row, rows may repeat."""
    least = links.groupBy(*by, F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return links.join(least, [*by, "v"], "left").select(*by, "u", F.coalesce("m", "v").alias("v"))


def _small_star(links: DataFrame, *by: str) -> DataFrame:
    """Smaller neighbours and the node itself hang on its smallest neighbour; ``u > v`` in every row."""
    least = links.groupBy(*by, "u").agg(F.min("v").alias("m"))
    # the row of the smallest neighbour itself stands for the node
    hung = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return links.join(least, [*by, "u"]).select(*by, hung.alias("u"), F.col("m").alias("v")).distinct()
