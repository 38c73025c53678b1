"""Lineage ledger: chains, integrity, ancestry and audit reports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.hashing import lineage_hash, piped, sha256
from ledgerloom.functions.numbers import exact_mean
from ledgerloom.operators.ordered import first_k_per_key, latest_per_key, numbered
from ledgerloom.session import cut_lineage

# The record that seeds an empty ledger.
GENESIS = {
    "tx_id": "GENESIS", "output_hash": "0" * 64, "transformation_type": "GENESIS", "pipeline_id": "system",
    "pipeline_version": "1.0.0", "sigma_level": 6.0, "region": "GLOBAL",
}


def genesis_row(like: DataFrame, dataset_id: str, job_id: str, owner_org: str, timestamp: str) -> DataFrame:
    """The first row of a ledger with the columns of ``like``; its hash is computed, not given."""
    given = GENESIS | {
        "output_dataset_id": dataset_id, "job_id": job_id, "owner_org": owner_org, "timestamp": timestamp,
    }
    columns = []
    for field in like.schema:
        kind = field.dataType.simpleString()
        if field.name in given:
            value = F.lit(given[field.name])
        elif kind.startswith("array"):
            value = F.array()
        else:
            value = F.lit("" if kind == "string" else None)
        columns.append(value.cast(field.dataType).alias(field.name))
    one = like.sparkSession.range(1).select(*columns)
    return one.withColumn("genome_hash", lineage_hash()) if "genome_hash" in like.columns else one


def lineage_chain(lineage: DataFrame, dataset_id: str) -> DataFrame:
    """All records of one dataset, newest first; equal times are ordered by transaction."""
    return lineage.filter(F.col("output_dataset_id") == dataset_id).orderBy(F.desc("timestamp"), F.desc("tx_id"))


def lineage_chains(lineage: DataFrame) -> DataFrame:
    """Every dataset's chain at once, each record with its position from the newest."""
    return numbered(lineage, ["output_dataset_id"], [F.desc("ts"), F.desc("tx_id")], "position")


def latest_metadata(lineage: DataFrame) -> DataFrame:
    """The newest record of each dataset is its canonical metadata."""
    return latest_per_key(lineage, ["output_dataset_id"], ["ts", "tx_id"])


def verify_integrity(lineage: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Recompute every hash; one verdict per dataset. A record without a hash counts as tampered with.

    ``expected`` may name the output hash a dataset's newest record must carry, and datasets
    that have no records at all, which fail.
    """
    checked = lineage.withColumn("_bad", ~F.col("genome_hash").eqNullSafe(lineage_hash()))
    newest = F.struct("ts", "tx_id")
    verdict = checked.groupBy(F.col("output_dataset_id").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("_bad").alias("tampered"),
        F.max_by(F.when(F.col("_bad"), F.col("tx_id")), F.when(F.col("_bad"), newest)).alias("first_bad_tx"),
        F.max_by("output_hash", newest).alias("latest_hash"),
    )
    mismatch = F.lit(False)
    if expected is not None:
        verdict = expected.join(verdict, "dataset_id", "full_outer").withColumn(
            "records", F.coalesce("records", F.lit(0))
        )
        asked = F.coalesce("expected_hash", F.lit(""))
        mismatch = (asked != "") & (asked != F.col("latest_hash"))
    message = (
        F.when(F.col("records") == 0, F.concat(F.lit("no lineage found for "), "dataset_id"))
        .when(F.col("tampered") > 0, F.concat(
            F.lit("TAMPERING: tx "), F.left("first_bad_tx", F.lit(12)), F.lit(" hash mismatch")))
        .when(mismatch, F.lit("output hash mismatch in latest tx"))
        .otherwise(F.format_string("verified %d records on-chain", F.col("records")))
    )
    verified = (F.col("records") > 0) & (F.coalesce("tampered", F.lit(0)) == 0) & ~mismatch
    return verdict.select("dataset_id", "records", verified.alias("verified"), message.alias("message"))


def lineage_of_flow(lineage: DataFrame, flow_id: str, distinct: bool = False) -> DataFrame:
    """All records of the datasets a flow wrote, whoever wrote them.

    The index lists a dataset once per record of the flow, so a record comes back several
    times; ``copies`` says how often instead of repeating the row. ``distinct`` sets it to 1.
    """
    index = lineage.filter(F.col("pipeline_id") == flow_id).groupBy("output_dataset_id").agg(
        F.count(F.lit(1)).alias("copies")
    )
    if distinct:
        index = index.withColumn("copies", F.lit(1).cast("bigint"))
    return lineage.join(index, "output_dataset_id")


def edges(lineage: DataFrame) -> DataFrame:
    """Distinct (child, parent) pairs."""
    return lineage.select(
        F.col("output_dataset_id").alias("child"), F.explode("input_dataset_ids").alias("parent")
    ).distinct()


#: Roots of one row while a graph is walked: 16 whole numbers of 64 bits.
LANES, LANE_BITS = 16, 64


def reach(steps: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """Vertices within ``max_depth`` levels of each root with their least depth.

    ``steps`` has columns ``at`` and ``to``, ``roots`` has ``root``. A vertex goes through a level
    once for all roots that reach it there: a row carries them as bits, 1024 roots to a group, and rows that meet
    at a vertex are combined by bitwise or. A level therefore joins at most one row an edge and group,
    however many roots share the way. What an earlier level has seen is taken off at the end, vertex by
    vertex, and only then do bits become pairs. Each level is written to the checkpoint folder,
    so the plan stays short and a lost executor costs one level; on a cycle the walk ends at ``max_depth``.
    """
    width = LANES * LANE_BITS
    steps = cut_lineage(steps)
    names = cut_lineage(numbered(roots.select("root").distinct(), [], [F.col("root")], "nth").withColumn("nth", F.col("nth") - 1))
    lanes = [f"b{i}" for i in range(LANES)]
    bit = F.expr(f"shiftleft(1L, CAST(nth % {LANE_BITS} AS INT))")
    of_lane = F.expr(f"nth div {LANE_BITS} % {LANES}")
    level = names.select(
        F.expr(f"nth div {width}").alias("roots"), F.col("root").alias("vertex"),
        *[F.when(of_lane == i, bit).otherwise(F.lit(0)).cast("bigint").alias(lane) for i, lane in enumerate(lanes)],
    )
    walked = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth if max_depth > 0 else 10):
        met = level.join(steps, level.vertex == steps["at"]).groupBy("roots", F.col("to").alias("vertex"))
        level = cut_lineage(met.agg(*[F.bit_or(lane).alias(lane) for lane in lanes]))
        if level.isEmpty():
            break
        walked = walked.unionByName(level.withColumn("depth", F.lit(depth)))
    earlier = Window.partitionBy("roots", "vertex").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    seen = {lane: F.coalesce(F.bit_or(lane).over(earlier), F.lit(0)) for lane in lanes}
    fresh = walked.select("roots", "vertex", "depth", F.array(*[F.col(lane).bitwiseAND(F.bitwise_not(seen[lane])) for lane in lanes]).alias("bits"))
    parts = fresh.select("roots", "vertex", "depth", F.posexplode("bits").alias("lane", "bits")).filter("bits <> 0")
    pairs = parts.select("vertex", "depth", F.explode(F.expr(
        f"transform(filter(sequence(0, {LANE_BITS - 1}), k -> getbit(bits, k) = 1), k -> roots * {width} + lane * {LANE_BITS} + k)")).alias("nth"))
    return pairs.join(names, "nth").select("root", F.col("vertex").alias("dataset_id"), "depth")


def lineage_graph(lineage: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """Ancestors of each root with the number of their records; unknown ids have none."""
    steps = edges(lineage).select(F.col("child").alias("at"), F.col("parent").alias("to"))
    counts = lineage.groupBy(F.col("output_dataset_id").alias("dataset_id")).agg(F.count(F.lit(1)).alias("records"))
    found = reach(steps, roots, max_depth).join(counts, "dataset_id", "left")
    return found.withColumn("records", F.coalesce("records", F.lit(0)))


def impact(lineage: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """The same edges followed downstream."""
    steps = edges(lineage).select(F.col("parent").alias("at"), F.col("child").alias("to"))
    return reach(steps, roots, max_depth)


def audit_report(lineage: DataFrame) -> DataFrame:
    """Counts, integrity, mean sigma, jurisdictions and proof per dataset.

    Only partial aggregates cross the network, so datasets with many records are no
    burden. The chain itself is ``lineage_chain``.
    """
    oldest_first = F.struct("ts", "tx_id")
    report = lineage.groupBy(F.col("output_dataset_id").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.bool_and(F.col("genome_hash").eqNullSafe(lineage_hash())).alias("integrity_ok"),
        exact_mean(F.col("sigma_level")).alias("avg_sigma"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("jurisdictions")))).alias("jurisdictions"),
        F.max_by("tx_id", oldest_first).alias("newest_tx"),
        F.min_by("tx_id", oldest_first).alias("oldest_tx"),
    )
    proof = sha256(piped(*map(F.col, ("dataset_id", "newest_tx", "oldest_tx", "total_records"))))
    return report.withColumn("proof", proof)


def combined_audit_report(lineage: DataFrame, decisions: DataFrame) -> DataFrame:
    """Lineage and decisions side by side for every dataset that has either."""
    checks = decisions.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("compliance_checks"))
    joined = verify_integrity(lineage).join(checks, "dataset_id", "full_outer")
    records = F.coalesce("records", F.lit(0)).cast("bigint")
    made = F.coalesce("compliance_checks", F.lit(0)).cast("bigint")
    return joined.select(
        "dataset_id", records.alias("lineage_records"), made.alias("compliance_checks"),
        F.coalesce("verified", F.lit(False)).alias("integrity_verified"),
        F.coalesce("message", F.concat(F.lit("no lineage found for "), "dataset_id")).alias("integrity_message"),
        sha256(piped(F.col("dataset_id"), records, made)).alias("proof"),
    )


def newest_lineage(lineage: DataFrame, k: int = 10) -> DataFrame:
    return first_k_per_key(lineage, ["output_dataset_id"], [F.desc("ts"), F.desc("tx_id")], k)


def period(df: DataFrame, start: str, end: str, column: str = "timestamp", typed: str = "ts") -> DataFrame:
    """Rows between two times given as text to the second, both included.

    Where the table has the time as a timestamp too, its range goes along, which the scan can use.
    """
    inside = df.filter(F.col(column).between(start, end))
    if typed not in df.columns:
        return inside
    first, last = (datetime.strptime(t, "%Y-%m-%dT%H:%M:%SZ") for t in (start, end))
    kind = dict(df.dtypes)[typed]
    low, high = (F.lit(str(t)).cast(kind) for t in (first, last + timedelta(seconds=1)))
    return inside.filter((F.col(typed) >= low) & (F.col(typed) < high))
