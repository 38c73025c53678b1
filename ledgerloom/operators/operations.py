"""Failures and remedies, entitlements, runs, request metrics and overall reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions.numbers import exact_sum, fixed, rounded
from ledgerloom.functions.text import normalize_path

# Failure type, diagnosis, action, code.
REMEDIES = (
    ("connection_timeout", "Source system connection timed out",
     "Retry with exponential backoff (3 attempts, 30s max wait)",
     "task.retry_delay=timedelta(seconds=30); task.retries=3"),
    ("schema_mismatch", "Schema drift detected — new column added to source",
     "Quarantine new data; alert owner; apply schema evolution",
     "df = df.select([c for c in expected_cols if c in df.columns])"),
    ("quality_drop", "Sigma level dropped below 4.5 threshold",
     "Quarantine batch; trigger root-cause analysis; rollback",
     "if sigma < 4.5: quarantine(df); alert_owner(); rollback()"),
    ("oom_error", "Spark executor out of memory", "Reduce batch size by 50%; increase executor memory",
     "spark.conf.set('spark.executor.memory','8g'); reduce_batch()"),
    ("source_unavailable", "Source system unavailable", "Switch to backup source; cache last known good data",
     "source = backup_source if primary_down() else primary_source"),
)
# Permissions, and what each role may do.
PERMISSIONS = (
    "dataset:read", "dataset:write", "dataset:delete", "data:ingest", "data:query", "pipeline:manage",
    "lineage:view", "report:generate", "transfer:approve", "users:manage", "audit:view",
)
ROLE_PERMISSIONS = {
    "super_admin": PERMISSIONS,
    "tenant_admin": (
        "dataset:read", "dataset:write", "data:ingest", "data:query", "pipeline:manage", "lineage:view",
        "report:generate", "transfer:approve", "users:manage", "audit:view",
    ),
    "data_owner": (
        "dataset:read", "dataset:write", "data:ingest", "data:query", "lineage:view", "report:generate",
        "transfer:approve", "audit:view",
    ),
    "data_engineer": (
        "dataset:read", "dataset:write", "data:ingest", "data:query", "pipeline:manage", "lineage:view",
        "report:generate",
    ),
    "analyst": ("dataset:read", "data:query", "lineage:view"),
    "auditor": ("dataset:read", "lineage:view", "report:generate", "audit:view"),
    "service_account": ("dataset:read", "dataset:write", "data:ingest", "data:query", "lineage:view"),
}
# Steps of a run, and upper bounds of the latency histogram in seconds.
RUN_STEPS = ("queued", "source_connect", "quality_scan", "compliance_guard", "target_write", "audit_commit")
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def remedy_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(REMEDIES), "failure_type string, diagnosis string, action string, code string"
    )


def remedies(failures: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Attach the remedy; an unknown failure goes to a human and counts as not healed."""
    known = F.col("action").isNotNull()
    return failures.join(catalogue, "failure_type", "left").withColumns({
        "success": known,
        "diagnosis": F.coalesce("diagnosis", F.concat(F.lit("Unknown error: "), "failure_type")),
        "action": F.coalesce("action", F.lit("Escalate to human operator")),
        "code": F.coalesce("code", F.lit("alert_human(pipeline_id, error_type)")),
    })


def remedies_or_retry(failures: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Planner's variant: an unknown failure is treated like a timeout."""
    known = F.array(*[F.lit(row[0]) for row in REMEDIES])
    typed = failures.withColumn("_asked", F.col("failure_type")).withColumn(
        "failure_type",
        F.when(F.array_contains(known, F.col("failure_type")), F.col("failure_type")).otherwise("connection_timeout"),
    )
    return typed.join(catalogue, "failure_type").drop("failure_type").withColumnRenamed("_asked", "failure_type")


def role_permissions(spark: SparkSession) -> DataFrame:
    rows = [(role, permission) for role, granted in ROLE_PERMISSIONS.items() for permission in granted]
    return spark.createDataFrame(rows, "role string, permission string")


def entitlements(users: DataFrame, granted: DataFrame) -> DataFrame:
    """Distinct (user, permission) pairs over all roles of a user."""
    return users.select("user_id", F.explode("roles").alias("role")).join(granted, "role").select(
        "user_id", "permission"
    ).distinct()


def permission_sets(users: DataFrame, granted: DataFrame) -> DataFrame:
    """Sorted permissions per user; there are never more than the fixed list has."""
    return entitlements(users, granted).groupBy("user_id").agg(
        F.array_sort(F.collect_list("permission")).alias("permissions")
    )


def allowed_requests(requests: DataFrame, users: DataFrame, granted: DataFrame) -> DataFrame:
    return requests.join(entitlements(users, granted), ["user_id", "permission"], "left_semi")


def denied_requests(requests: DataFrame, users: DataFrame, granted: DataFrame) -> DataFrame:
    return requests.join(entitlements(users, granted), ["user_id", "permission"], "left_anti")


def has_role(roles: Column, role: str) -> Column:
    return F.array_contains(roles, role) | F.array_contains(roles, "super_admin")


def ops_status(active: DataFrame, intents: DataFrame, heals: DataFrame, latest_sigma: DataFrame) -> DataFrame:
    parts = [
        active.agg(F.count(F.lit(1)).alias("active_flows")),
        intents.agg(F.count(F.lit(1)).alias("intents_processed")),
        heals.agg(F.count(F.lit(1)).alias("heals_applied"), F.count_if("success").alias("_healed")),
        latest_sigma.agg(
            exact_sum(F.col("sigma_level")).alias("_sum"), F.count(F.lit(1)).alias("_n")),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    one = union.agg(*[F.max(c).alias(c) for c in union.columns])
    rate = F.col("_healed") / F.greatest("heals_applied", F.lit(1)) * 100
    mean = F.coalesce("_sum", F.lit(0.0)) / F.greatest("_n", F.lit(1))
    return one.select(
        "active_flows", "intents_processed", "heals_applied",
        F.concat(fixed(rate, 0), F.lit("%")).alias("heal_success_rate"),
        rounded(mean, 2).alias("avg_sigma"),
    )


def health_score(checks: DataFrame) -> DataFrame:
    """Share of checks that hold, with the two published bandings."""
    counted = checks.agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))
    share = F.when(F.col("total") > 0, F.col("passed") / F.col("total") * 100).otherwise(0.0)
    out = counted.withColumn("score", rounded(share, 1))
    complete = F.col("passed") == F.col("total")
    return out.withColumns({
        "status": F.when(complete, "passed").otherwise("warning"),
        "readiness": F.when(complete, "READY").when(F.col("score") >= 80, "MOSTLY READY").otherwise("NEEDS FIX"),
    })


def table_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """One check per table: does it hold any row. Each reads no further than its first row."""
    parts = [
        df.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("ok")).select(F.lit(name).alias("name"), "ok")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_kpis(runs: DataFrame) -> DataFrame:
    mean = F.sum("duration_ms") / F.greatest(F.count(F.lit(1)), F.lit(1))
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.coalesce(F.max_by("tx", F.struct("ts", "run_id")), F.lit("NA")).alias("latest_tx"),
        F.floor(F.coalesce(mean, F.lit(0.0)) + 0.5).alias("avg_duration_ms"),
    )


def run_step_stats(runs: DataFrame) -> DataFrame:
    steps = runs.select(F.explode("logs").alias("log"))
    return steps.groupBy(F.col("log.step").alias("step")).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("log.status") == "completed").alias("completed")
    )


def request_counts(log: DataFrame) -> DataFrame:
    shaped = log.withColumn("path", normalize_path(F.col("path")))
    return shaped.groupBy("method", "path", "status").agg(F.count(F.lit(1)).alias("requests"))


def request_latency(log: DataFrame) -> DataFrame:
    """Cumulative latency histogram per method and path; the last bucket counts everything."""
    shaped = log.withColumn("path", normalize_path(F.col("path")))
    counts = [F.count_if(F.col("duration_s") <= bound).alias(f"le{i}") for i, bound in enumerate(LATENCY_BUCKETS)]
    wide = shaped.groupBy("method", "path").agg(*counts, F.count(F.lit(1)).alias("inf"))
    entries = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le{i}").alias("requests")) for i, b in enumerate(LATENCY_BUCKETS)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("requests")))
    return wide.select("method", "path", F.inline(F.array(*entries)))


def full_report(overview: DataFrame, registry: DataFrame, newest_events: DataFrame, frameworks: DataFrame) -> DataFrame:
    """The whole state as JSON lines, one item per row, so no row holds a whole table."""
    sections = {"overview": overview, "flows": registry, "audit": newest_events, "compliance": frameworks}
    parts = [
        df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("document"))
        for name, df in sections.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
