"""Service levels over quality measurements: alerts, certificates, trends, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.hashing import measurement_hash, piped, sha256
from ledgerloom.functions.numbers import exact_mean, fixed
from ledgerloom.functions.sigma import severity, sigma_to_dpm
from ledgerloom.operators.lineage import period
from ledgerloom.operators.ordered import first_k_per_key, previous_value


def log_measurements(measurements: DataFrame) -> DataFrame:
    """Complete valid measurements: defects per million when missing or zero, id and hash."""
    dpm = F.col("defects_per_million") if "defects_per_million" in measurements.columns else F.lit(0.0)
    return measurements.withColumns({
        "defects_per_million": F.when(F.coalesce(dpm, F.lit(0.0)) == 0, sigma_to_dpm(F.col("sigma_level")))
        .otherwise(dpm),
        "measurement_id": F.concat(F.lit("M-"), "pipeline_id", F.lit("-"), F.left("tx_id", F.lit(12))),
        "measurement_hash": measurement_hash(),
    })


def sla_breaches(measurements: DataFrame, sla: DataFrame, platform_org: str = "Platform") -> DataFrame:
    """Alerts for measurements below the breach threshold of an active agreement.

    Severity follows the distance to the contractual minimum, not to the threshold.
    """
    active = sla.filter("active").select("pipeline_id", "min_sigma", "breach_threshold", "customer_org")
    hit = measurements.join(active, "pipeline_id").filter(F.col("sigma_level") < F.col("breach_threshold"))
    return hit.select(
        F.concat(F.lit("SLA-BREACH-"), "pipeline_id", F.lit("-"), F.left("tx_id", F.lit(8))).alias("alert_id"),
        "pipeline_id", F.col("ts").alias("breached_at"), F.col("min_sigma").alias("expected_min"),
        F.col("sigma_level").alias("actual_sigma"),
        severity(F.col("min_sigma") - F.col("sigma_level")).alias("severity"),
        F.lit(True).alias("auto_quarantined"),
        F.array(F.lit(platform_org), F.col("customer_org")).alias("notified_orgs"),
    )


def with_sla(measurements: DataFrame, sla: DataFrame) -> DataFrame:
    """Attach the agreement; flows without one count as meeting a target of 5.0."""
    terms = sla.select("pipeline_id", "min_sigma", "customer_org")
    joined = measurements.join(terms, "pipeline_id", "left")
    return joined.withColumns({
        "met": F.coalesce(F.col("sigma_level") >= F.col("min_sigma"), F.lit(True)),
        "sla_target": F.coalesce("min_sigma", F.lit(5.0)),
        "customer_org": F.coalesce("customer_org", F.lit("Unknown")),
    }).drop("min_sigma")


def quality_certificate(measurements: DataFrame, sla: DataFrame, start: str, end: str) -> DataFrame:
    """One certificate per flow with measurements in the period; a breach is below the minimum."""
    inside = period(measurements, start, end)
    counted = with_sla(inside, sla).groupBy("pipeline_id", "customer_org", "sla_target").agg(
        F.count(F.lit(1)).alias("measurements"), exact_mean(F.col("sigma_level")).alias("avg_sigma"),
        F.min("sigma_level").alias("min_sigma"), F.max("sigma_level").alias("max_sigma"),
        F.sum("records_failed").alias("total_defects"), F.sum("records_processed").alias("total_records"),
        F.count_if(~F.col("met")).alias("breaches"),
    )
    proof = piped(
        F.col("pipeline_id"), F.lit(start), F.lit(end), fixed(F.col("avg_sigma"), 2),
        F.col("total_records"), F.col("total_defects"),
    )
    return counted.withColumns({"sla_met": F.col("breaches") == 0, "proof": sha256(proof)})


def trend_limit(limit: int, service_limit: bool = False) -> int:
    """Points to show, 30 if none are asked for; the service shows 30 beyond 1000 as well."""
    return 30 if limit <= 0 or (service_limit and limit > 1000) else limit


def sigma_trend(measurements: DataFrame, limit: int = 30, service_limit: bool = False) -> DataFrame:
    """The last ``limit`` points of every flow, oldest first."""
    newest = [F.desc("ts"), F.desc("run_id")]
    kept = first_k_per_key(
        measurements.select("pipeline_id", "ts", "sigma_level", "run_id"), ["pipeline_id"], newest,
        trend_limit(limit, service_limit)
    )
    return kept.drop("position").orderBy("pipeline_id", "ts", "run_id")


def sigma_trend_hours(measurements: DataFrame, hours: int = 24) -> DataFrame:
    return sigma_trend(measurements, hours * 4)


def monitor_state(sigma: Column, previous: Column) -> Column:
    return F.when(sigma < 4.5, "ALERT").when(sigma < previous - 0.5, "WARNING").otherwise("OK")


def sigma_monitor(measurements: DataFrame) -> DataFrame:
    """State of every measurement against the one before it; the first compares with 6.0."""
    before = previous_value(
        measurements, ["pipeline_id"], [F.col("ts"), F.col("run_id")], "sigma_level", 6.0, "previous_sigma"
    )
    state = monitor_state(F.col("sigma_level"), F.col("previous_sigma"))
    return before.withColumn("state", state).withColumn("heal", F.col("state") == "ALERT")


def flow_status(measurements: DataFrame, sla: DataFrame, as_of: str) -> DataFrame:
    """Current standing of every flow at ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    past = measurements.filter(F.col("ts") <= now)
    last_day = F.col("ts") > now - F.expr("interval 24 hours")
    state = past.groupBy("pipeline_id").agg(
        F.max_by("sigma_level", F.struct("ts", "run_id")).alias("current_sigma"),
        exact_mean(F.when(last_day, F.col("sigma_level"))).alias("avg_sigma_24h"),
        F.max("ts").alias("last_run"),
        F.count_if(F.to_date("ts") == F.to_date(now)).alias("runs_today"),
        (F.count_if(F.col("records_failed") == 0) / F.count(F.lit(1)) * 100).alias("heal_rate"),
    )
    terms = sla.select("pipeline_id", F.col("target_sigma").alias("_target"))
    joined = state.join(terms, "pipeline_id", "left").withColumn("sla_target", F.coalesce("_target", F.lit(5.0)))
    met = F.col("current_sigma") >= F.col("sla_target")
    return joined.withColumns({
        "sla_met": met,
        "status": F.when(met, "healthy").when(F.col("current_sigma") >= 4.5, "warning").otherwise("critical"),
    }).drop("_target")


def quality_rollup(measurements: DataFrame) -> DataFrame:
    """Mean sigma, runs and defects per flow, worst first."""
    return measurements.groupBy("pipeline_id").agg(
        exact_mean(F.col("sigma_level")).alias("avg_sigma"), F.count(F.lit(1)).alias("runs"),
        F.sum("records_failed").alias("total_defects"),
    ).orderBy("avg_sigma", "pipeline_id")
