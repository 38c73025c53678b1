"""Streams: gate, deduplicate, monitor, alert, decide, count, watch nodes, mask.

Every job applies the expressions of its batch twin. Sinks written by ``foreachBatch`` put
each batch in a folder of its own and overwrite it, so a replayed batch leaves one copy.
Late rows are dropped after one hour and counted in the query's progress
(``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.functions.hashing import sha256
from ledgerloom.operators.compliance import decide
from ledgerloom.operators.masking import mask_pii, stamp_run
from ledgerloom.operators.ordered import latest_per_key, previous_value
from ledgerloom.operators.quality import gate_payloads
from ledgerloom.operators.sla import monitor_state, sla_breaches
from ledgerloom.sources.files import stream_raw_csv

WATERMARK = "1 hour"
HEARTBEAT_SECONDS = 30
MISSED_BEATS = 3


def batch_folder(base: str, batch_id: int) -> str:
    return f"{base.rstrip('/')}/batch_id={batch_id}"


def _put(df: DataFrame, base: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_folder(base, batch_id))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def start(writer: DataStreamWriter, checkpoint: str, available_now: bool = True):
    """Start a query on its checkpoint; by default it works off what is there and ends."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_gate(payloads: DataFrame, accepted: str, quarantined: str, gate: str = "edge") -> DataStreamWriter:
    """Score and hash each payload, keep the good ones, keep only hash and score of the others."""

    def split(batch: DataFrame, batch_id: int) -> None:
        scored = gate_payloads(batch, gate).persist()
        try:
            _put(scored.filter("accepted"), accepted, batch_id)
            _put(scored.filter("NOT accepted").drop("payload"), quarantined, batch_id)
        finally:
            scored.unpersist()

    return payloads.writeStream.foreachBatch(split)


#: Buckets of a catalogue, blocks of its filter in a bucket, and bits a key sets in its block of 4096 bytes.
BUCKETS, BLOCKS, KEY_BITS = 16, 4096, 4
BLOCK_BITS = 8 * 4096
#: Every so many batches the filter is written whole; the others write what they add.
WHOLE_FILTER = 16


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _in_blocks(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with the filter block of their key, its bucket and the bits it sets there."""
    rows = rows.withColumn("_key", F.xxhash64(*keys)).withColumn("_block", F.pmod("_key", F.lit(BUCKETS * BLOCKS)).cast("int"))
    bits = F.array(*[F.pmod(F.xxhash64("_key", F.lit(i)), F.lit(BLOCK_BITS)) for i in range(KEY_BITS)])
    return rows.withColumns({"key_bucket": F.expr(f"CAST(_block div {BLOCKS} AS INT)"), "_bits": bits}).drop("_key")


def _filter_of(rows: DataFrame) -> DataFrame:
    """``(block, bitmap)`` over rows in blocks."""
    return rows.select(F.col("_block").alias("block"), F.explode("_bits").alias("bit")).groupBy("block").agg(
        F.bitmap_construct_agg("bit").alias("bitmap"))


def _filter_before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """The filter over all batches before this one: the last one written whole and what came after it."""
    parts = []
    for earlier in range(batch_id - 1, -1, -1):
        part = batch_folder(folder, earlier)
        if _exists(spark, part):
            parts.append(part)
        if earlier % WHOLE_FILTER == 0:
            break
    if not parts:
        return None
    return spark.read.schema("block int, bitmap binary").parquet(*parts).groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _maybe_held(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Rows in blocks whose key the filter may hold: all its bits are set. Held keys always pass, few others do."""
    joined = rows.join(held, F.col("_block") == F.col("block"))
    byte = "conv(hex(substring(bitmap, CAST(p div 8 AS INT) + 1, 1)), 16, 10)"
    return joined.filter(F.expr(f"forall(_bits, p -> getbit(CAST({byte} AS INT), CAST(p % 8 AS INT)) = 1)")).drop("block", "bitmap")


def catalogue_step(spark: SparkSession, catalogue: str, keys: tuple[str, ...] = ("content_hash",), ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """Store the first arrival of each key that the catalogue does not hold yet, however late a copy comes.

    With ``keys`` of content and node, a later copy on another node adds that node. The catalogue lies in
    buckets of its keys with a Bloom filter beside it (``<catalogue>_filter``), blocks of 32768 bits of which a
    key sets four. A batch looks its keys up in the blocks they fall in and reads only the buckets that may hold
    one; new content reads next to nothing, whatever the catalogue holds. A replayed batch sees the state before it.
    """
    filters = f"{catalogue.rstrip('/')}_filter"

    def step(batch: DataFrame, batch_id: int) -> None:
        hashed = batch.withColumn("content_hash", sha256(F.col("payload"))).drop("payload")
        rest = [c for c in hashed.columns if c not in keys]
        firsts = hashed.groupBy(*keys).agg(F.min(F.struct(ts, *[c for c in rest if c != ts])).alias("_row")).select(*keys, "_row.*")
        firsts, maybe = _in_blocks(firsts, keys).persist(), None
        try:
            held = _filter_before(spark, filters, batch_id)
            new = firsts
            if held is not None:
                maybe = _maybe_held(firsts, held).select(*keys, "key_bucket").persist()
                buckets = [r.key_bucket for r in maybe.select("key_bucket").distinct().collect()]  # at most BUCKETS
                if buckets:
                    stored = spark.read.parquet(catalogue).filter((F.col("batch_id") < batch_id) & F.col("key_bucket").isin(buckets))
                    known = stored.select(*keys).join(maybe.select(*keys), list(keys), "left_semi")
                    new = firsts.join(known, list(keys), "left_anti")
            new.drop("_block", "_bits").write.mode("overwrite").partitionBy("key_bucket").parquet(batch_folder(catalogue, batch_id))
            added = _filter_of(new)
            if held is not None and batch_id % WHOLE_FILTER == 0:
                added = added.unionByName(held).groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            _put(added, filters, batch_id)
        finally:
            firsts.unpersist()
            if maybe is not None:
                maybe.unpersist()

    return step


def catalogue_firsts(puts: DataFrame, catalogue: str, keys: tuple[str, ...] = ("content_hash",)) -> DataStreamWriter:
    return puts.writeStream.foreachBatch(catalogue_step(puts.sparkSession, catalogue, keys))


def first_copies(puts: DataFrame, ts: str = "ts") -> DataFrame:
    """The first arrival of each content within the watermark, without a catalogue.

    A copy later than the watermark passes again; ``catalogue_firsts`` decides by the catalogue.
    """
    hashed = puts.withColumn("content_hash", sha256(F.col("payload"))).drop("payload")
    return hashed.withWatermark(ts, WATERMARK).dropDuplicatesWithinWatermark(["content_hash"])


def new_holders(puts: DataFrame, ts: str = "ts") -> DataFrame:
    """First arrival of each content on each node: the nodes later copies add."""
    hashed = puts.withColumn("content_hash", sha256(F.col("payload"))).drop("payload")
    return hashed.withWatermark(ts, WATERMARK).dropDuplicatesWithinWatermark(["content_hash", "node_id"])


def sigma_monitor_step(spark: SparkSession, out: str, state: str) -> Callable[[DataFrame, int], None]:
    """Judge a batch against the last sigma of every flow, then store the new last sigmas.

    The state is a table with one row per flow and batch number. Batch n reads the table of
    batch n-1, so a replay of n starts from the same state; older tables are removed. Rows of a
    busy flow are compared in ranges of their order, not in one task.
    """
    kept = ["pipeline_id", "ts", "run_id", "sigma_level"]

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*kept).persist()
        before = (
            spark.read.parquet(batch_folder(state, batch_id - 1)) if batch_id > 0
            else spark.createDataFrame([], rows.schema)
        )
        compared = previous_value(rows, ["pipeline_id"], [F.col("ts"), F.col("run_id")], "sigma_level", None, "_within")
        carried = before.select("pipeline_id", F.col("sigma_level").alias("_carried"))
        judged = compared.join(carried, "pipeline_id", "left").withColumn(
            "previous_sigma", F.coalesce("_within", "_carried", F.lit(6.0))
        ).drop("_within", "_carried")
        judged = judged.withColumn("state", monitor_state(F.col("sigma_level"), F.col("previous_sigma")))
        _put(judged, out, batch_id)
        # A later batch wins over an earlier one even when its times are older.
        current = latest_per_key(rows, ["pipeline_id"], ["ts", "run_id"])
        untouched = before.join(current.select("pipeline_id"), "pipeline_id", "left_anti")
        _put(current.unionByName(untouched), state, batch_id)
        rows.unpersist()
        _remove(spark, batch_folder(state, batch_id - 2))

    return step


def sigma_monitor(measurements: DataFrame, out: str, state: str) -> DataStreamWriter:
    return measurements.writeStream.foreachBatch(sigma_monitor_step(measurements.sparkSession, out, state))


def sla_alerts(measurements: DataFrame, sla: DataFrame) -> DataFrame:
    """Alerts as measurements arrive; one per flow and time."""
    timed = measurements.withWatermark("ts", WATERMARK)
    return sla_breaches(timed, sla).dropDuplicatesWithinWatermark(["pipeline_id", "breached_at"])


def decisions(requests: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Decision events; stateless, because the rules travel inside the plan."""
    return decide(requests, rules).select("decision_id", "request_id", "dataset_id", "decision", "reason", "ts")


def audit_stats(events: DataFrame, slide: str | None = "1 hour") -> DataFrame:
    """Counts per action and result over 24 hours, sliding by ``slide`` or tumbling when null."""
    timed = events.withWatermark("ts", WATERMARK)
    span = F.window("ts", "24 hours", slide) if slide else F.window("ts", "24 hours")
    counted = timed.groupBy(span.alias("span"), "action", "result").agg(F.count(F.lit(1)).alias("events"))
    return counted.select(
        F.col("span.start").alias("start"), F.col("span.end").alias("end"), "action", "result", "events"
    )


_LIVENESS = "node_id string, status string, at timestamp, items bigint, avg_sigma double"


def _watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Remember only the newest heartbeat of a node; report when it appears and when it falls silent."""

    def row(status: str, at_ms: int, items: int, sigma: float) -> pd.DataFrame:
        at = pd.Timestamp(at_ms, unit="ms")
        return pd.DataFrame({"node_id": [key[0]], "status": [status], "at": [at], "items": [items], "avg_sigma": [sigma]})

    silence = HEARTBEAT_SECONDS * MISSED_BEATS * 1000
    if state.hasTimedOut:
        last, items, sigma = state.get
        state.remove()
        yield row("DOWN", last + silence, items, sigma)
        return
    known = state.exists
    last, items, sigma = state.get if known else (0, 0, 0.0)
    for frame in frames:
        newest = frame.loc[frame["ts"].idxmax()]
        ms = int(pd.Timestamp(newest["ts"]).timestamp() * 1000)
        if ms >= last:
            last, items, sigma = ms, int(newest["items"]), float(newest["avg_sigma"])
    state.update((last, items, sigma))
    state.setTimeoutTimestamp(max(last + silence, state.getCurrentWatermarkMs() + 1))
    if not known:
        yield row("UP", last, items, sigma)


def liveness(heartbeats: DataFrame) -> DataFrame:
    """UP when a node is first heard of or comes back, DOWN after three missed heartbeats."""
    timed = heartbeats.select("node_id", F.col("ts").cast("timestamp").alias("ts"), "items", "avg_sigma")
    return timed.withWatermark("ts", "10 seconds").groupBy("node_id").applyInPandasWithState(
        _watch, _LIVENESS, "last bigint, items bigint, sigma double", "append", GroupStateTimeout.EventTimeTimeout
    )


def mask_stream(
    spark: SparkSession, path: str, columns: list[str], flow_id: str, run_id: str, region: str, as_of: str
) -> DataFrame:
    """Masked rows of CSV files as they arrive."""
    return stamp_run(mask_pii(stream_raw_csv(spark, path, columns)), flow_id, run_id, region, as_of)
