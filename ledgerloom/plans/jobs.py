"""End-to-end jobs: masking a batch, ingesting payloads, compliance, quality, catalogue."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions.hashing import content_cid, lineage_hash, rfc3339, sha256, table_digest
from ledgerloom.functions.sigma import line_count
from ledgerloom.operators import catalogue as K, quality
from ledgerloom.operators.compliance import compliance_report, decide
from ledgerloom.operators.dna import dna_from_ingest
from ledgerloom.operators.masking import mask_pii, stamp_run
from ledgerloom.operators.sla import log_measurements, quality_certificate, sigma_trend, sla_breaches
from ledgerloom.operators.validation import split_valid, validate_ingest, validate_measurement
from ledgerloom.schemas import conform, schema_of
from ledgerloom.session import cut_lineage
from ledgerloom.sources import files
from ledgerloom.sources.commits import Ledgers


@dataclass(frozen=True)
class MaskingJob:
    """Arguments of the masking job."""

    input_path: str
    output_base: str
    flow_id: str
    run_id: str
    as_of: str
    jurisdictions: tuple[str, ...] = ("DPDP_2023",)
    region: str = "IN-TG"
    min_sigma: float = 4.5
    target_sigma: float = 5.5
    output_files: int | None = None


@dataclass
class JobResult:
    status: str
    exit_code: int
    route: str = ""
    record: dict = field(default_factory=dict)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _ledger_tx(record: dict) -> str:
    """Transaction id of a record, derived from its content so that a rerun repeats it."""
    return f"TX_{_hash(json.dumps(record, sort_keys=True))[:24]}"


def _log_run(spark: SparkSession, ledgers: Ledgers | None, job: MaskingJob, record: dict, suites: list[DataFrame]) -> None:
    """Lineage, measurement, check results and audit event of a masking run as one batch, named by flow and run."""
    if ledgers is None:
        return
    given = {
        "tx_id": record["fabric_tx_id"], "job_id": job.run_id, "pipeline_id": job.flow_id, "dataset_id": record["dataset_id"],
        "hash": record["content_hash"], "kind": record["transformation"], "sigma": float(record["sigma_level"]), "region": job.region,
        "rows": int(record.get("input_rows", 0)), "source": job.input_path,
    }
    one = spark.range(1).select(
        *[F.lit(v).alias(k) for k, v in given.items()], F.lit(job.as_of).cast("timestamp_ntz").alias("ts"),
        F.array(*[F.lit(j) for j in job.jurisdictions]).cast("array<string>").alias("jurisdictions"),
    )
    lineage = lineage_records(one.select(
        "tx_id", "job_id", "ts", F.array("source").alias("input_dataset_ids"), F.array(sha256(F.col("source"))).alias("input_hashes"),
        F.col("dataset_id").alias("output_dataset_id"), F.col("hash").alias("output_hash"), F.col("kind").alias("transformation_type"),
        "pipeline_id", F.col("sigma").alias("sigma_level"), "jurisdictions", "region",
    ))
    measured = log_measurements(one.select(
        "pipeline_id", "dataset_id", F.col("job_id").alias("run_id"), "ts", rfc3339(F.col("ts")).alias("timestamp"), F.col("sigma").alias("sigma_level"),
        F.col("rows").cast("bigint").alias("records_processed"), F.lit(0).cast("bigint").alias("records_failed"), F.lit("").alias("node_id"), "region", "tx_id",
    ))
    event = one.select(
        "ts", F.col("tx_id").alias("tx"), F.col("kind").alias("action"), F.col("dataset_id").alias("dataset"),
        F.when(F.col("kind") == "QUARANTINE", "QUARANTINED").otherwise("OK").alias("result"), F.lit("masking-job").alias("actor"),
        F.get("jurisdictions", F.lit(0)).alias("law"), "region", F.col("sigma"),
    )
    checks = suites[0].withColumn("run_id", F.lit(job.run_id))
    for suite in suites[1:]:
        checks = checks.unionByName(suite.withColumn("run_id", F.lit(job.run_id)))
    ledgers.commit(f"mask/{job.flow_id}/{job.run_id}", {
        "lineage": (lineage, "output_dataset_id"), "measurements": (conform(measured, "measurements"), "pipeline_id"),
        "audit_events": (conform(event, "audit_events"), "dataset"), "check_results": (checks, "run_id"),
    })


def mask_job(spark: SparkSession, job: MaskingJob, ledgers: Ledgers | None = None) -> JobResult:
    """CSV to masked Parquet with gates before and after.

    Two passes: one aggregate over the input, one projection to Parquet. The exit suite then
    reads the masked columns back from the files written, which also counts them. With
    ``ledgers`` the run's lineage record, measurement, check results and audit event enter them once.
    """
    if files.preflight_input(spark, job.input_path) == "skip":
        return JobResult("SKIPPED", 0)
    raw = files.read_raw_csv(spark, job.input_path)
    entry = cut_lineage(quality.run_suite(raw, f"{job.flow_id}_raw", quality.entry_suite(raw.columns)))  # a row a check
    gate, entry_sigma, input_rows = quality.entry_gate(entry, job.min_sigma)
    if gate == "QUARANTINE":
        path = files.write_quarantine(raw, job.output_base, job.run_id)
        record = {
            "pipeline_id": job.flow_id, "dataset_id": f"{job.flow_id}_quarantine_{job.run_id}",
            "content_hash": _hash(job.run_id),
            "transformation": "QUARANTINE", "sigma_level": entry_sigma, "jurisdictions": list(job.jurisdictions),
            "region": job.region,
        }
        record["fabric_tx_id"] = _ledger_tx(record)
        _log_run(spark, ledgers, job, record | {"input_rows": input_rows}, [entry])
        return JobResult("QUARANTINED", 2, "quarantine", record | {"output_path": path})
    masked = stamp_run(mask_pii(raw), job.flow_id, job.run_id, job.region, job.as_of)
    path = files.write_curated(masked, job.output_base, job.run_id, job.output_files)
    written = spark.read.parquet(path)
    left = cut_lineage(quality.run_suite(written, f"{job.flow_id}_masked", quality.exit_suite(written.columns)))
    _, exit_sigma, output_rows = quality.entry_gate(left, 0.0)
    record = {
        "pipeline_id": job.flow_id, "run_id": job.run_id, "dataset_id": f"{job.flow_id}_curated_{job.run_id}",
        "content_hash": _hash(f"{job.flow_id}|{job.run_id}|{output_rows}"), "transformation": "SPARK_PII_MASKING",
        "input_rows": input_rows, "output_rows": output_rows, "sigma_level": exit_sigma, "entry_sigma": entry_sigma,
        "exit_sigma": exit_sigma, "jurisdictions": list(job.jurisdictions), "region": job.region, "output_path": path,
    }
    record["fabric_tx_id"] = _ledger_tx(record)
    files.write_lineage_sidecar(spark, json.dumps(record, indent=2, ensure_ascii=False), path)
    route = spark.range(1).select(quality.route_by_sigma(F.lit(exit_sigma), job.target_sigma, job.min_sigma)).first()[0]
    _log_run(spark, ledgers, job, record, [entry, left])
    return JobResult("COMPLETED", 0, route, record)


def lineage_records(rows: DataFrame) -> DataFrame:
    """Full lineage records of ``rows``; fields they lack stay empty, and the hash covers what is there.

    ``ts`` is required; an output needs an id and a SHA-256 and its sigma lies from 1 to 6, as the ledger demands.
    """
    have = rows.columns
    lists = [c for c in ("input_dataset_ids", "input_hashes", "jurisdictions") if c not in have]
    texts = [f.name for f in schema_of("lineage") if f.dataType.simpleString() == "string" and f.name not in have]
    full = rows.withColumns({c: F.array().cast("array<string>") for c in lists} | {c: F.lit("") for c in texts})
    full = full.withColumn("timestamp", rfc3339(F.col("ts")))
    sound = (F.coalesce("output_dataset_id", F.lit("")) != "") & (F.length("output_hash") == 64) & F.col("sigma_level").between(1.0, 6.0)
    return conform(full.filter(sound).withColumn("genome_hash", lineage_hash()), "lineage")


def ingest_job(
    payloads: DataFrame, threshold: float = 4.0, ledgers: Ledgers | None = None, batch: str | None = None
) -> dict[str, DataFrame]:
    """Validate, score and gate payloads; accepted ones leave dataset, lineage and quality rows.

    With ``ledgers`` all outputs enter them as one batch: datasets, lineage, measurements, the refused payloads with their
    rules and the quarantined ones, of which only hash and score are kept. The payloads are then
    read once; what the ledgers get is slim. Payloads may name their ``pipeline_id`` and ``node_id``.
    """
    given = payloads
    for name, empty in (("pipeline_id", "manual-ingest"), ("node_id", "")):
        known = F.col(name) if name in payloads.columns else F.lit(None).cast("string")
        given = given.withColumn(name, F.coalesce(F.nullif(known, F.lit("")), F.lit(empty)))
    checked = validate_ingest(given)
    gated = quality.gate_payloads(checked, "api", threshold)
    judged = gated.withColumn("rows_in", F.when(F.col("format") == "csv", line_count(F.col("payload"))).otherwise(1)).drop("payload")
    if ledgers is not None:
        judged = cut_lineage(judged)
    valid, invalid = split_valid(judged)
    datasets = dna_from_ingest(valid.filter("accepted"))
    region = F.coalesce(F.get("allowed_regions", F.lit(0)), F.lit("IN"))
    dataset_id = F.concat(F.lit("ds-"), F.left(sha256(F.concat_ws("|", "dataset_name", "content_hash")), F.lit(12)))
    # the transaction the dataset's own record names
    tx = F.concat(F.lit("TX_"), F.left(sha256(F.concat(F.lit("ingest|"), "content_hash")), F.lit(24)))
    slim = valid.filter("accepted").select(
        "payload_id", "dataset_name", "content_hash", "sigma", "classification", "jurisdictions", "ts", "pipeline_id", "node_id",
        dataset_id.alias("dataset_id"), region.alias("region"), F.col("rows_in").cast("bigint").alias("records_processed"), tx.alias("tx_id"),
    )
    lineage = lineage_records(slim.select(
        "tx_id", F.concat(F.lit("ingest-"), "dataset_id").alias("job_id"), "ts", F.col("dataset_id").alias("output_dataset_id"),
        F.col("content_hash").alias("output_hash"), F.lit("INGEST").alias("transformation_type"), "pipeline_id",
        F.col("sigma").alias("sigma_level"), "classification", "jurisdictions", "node_id", "region",
        content_cid(F.col("content_hash")).alias("ipfs_cid"),
    ))
    measured = slim.select(
        "pipeline_id", "dataset_id", "content_hash", F.col("sigma").alias("sigma_level"), "records_processed",
        F.lit(0).cast("bigint").alias("records_failed"), F.lit(12).alias("expectations_run"), F.lit(12).alias("expectations_passed"),
        "node_id", "region", "ts", rfc3339(F.col("ts")).alias("timestamp"), "tx_id",
        F.concat(F.lit("run-"), F.left(sha256(F.concat_ws("|", "tx_id", "dataset_id", "ts")), F.lit(8))).alias("run_id"),
    )
    out = {
        "invalid": invalid.select("payload_id", "dataset_name", "content_hash", "failed_rules", "ts"),
        "quarantined": valid.filter("NOT accepted").select("payload_id", "content_hash", "sigma"),
        "datasets": datasets, "lineage": lineage, "measurements": log_measurements(measured),
    }
    if ledgers is not None:
        ledgers.commit(batch or _content_batch("ingest", judged, "content_hash"), {
            "lineage": (out["lineage"], "output_dataset_id"), "measurements": (conform(out["measurements"], "measurements"), "pipeline_id"),
            "dataset_dna": (conform(datasets, "dataset_dna"), "dataset_id"), "ingest_refused": (out["invalid"], "content_hash"),
            "ingest_quarantined": (out["quarantined"], "content_hash"),
        })
    return out


def _content_batch(kind: str, rows: DataFrame, *columns: str) -> str:
    """Names a batch by what is in it, so that a repeated one has the same id."""
    digest = rows.agg(table_digest(rows.select(*columns).schema)).first()[0]
    return f"{kind}/{digest}"


def compliance_job(
    requests: DataFrame, rules: list[tuple] | None = None, ledgers: Ledgers | None = None, batch: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Decisions for all requests and the report per dataset: (report, decisions).

    With ``ledgers`` the decisions, one record a violation and the report enter them as one batch.
    """
    made = decide(requests, rules)
    if ledgers is None:
        return compliance_report(made), made
    made = cut_lineage(made)
    report = compliance_report(made)
    broken = made.select("decision_id", "request_id", "dataset_id", "ts", F.inline("violations"))
    records = conform(made, "decisions")
    name = batch or _content_batch("compliance", records, "decision_id", "decision")
    ledgers.commit(name, {
        "decisions": (records, "dataset_id"), "violations": (broken, "dataset_id"),
        "compliance_reports": (report.withColumn("batch", F.lit(name)), "dataset_id"),
    })
    return report, made


def quality_job(
    measurements: DataFrame, sla: DataFrame, period: tuple[str, str] | None = None, trend: int = 30,
    ledgers: Ledgers | None = None, batch: str | None = None,
) -> dict[str, DataFrame]:
    """Measurements with ids and hashes, alerts, certificates of ``period``, the last ``trend`` points of every flow.

    Certificates and trend look at what the ledger holds beside these measurements. With ``ledgers``
    measurements, alerts, certificates and refused measurements enter them as one batch; a measurement
    whose transaction the ledger holds is not logged again.
    """
    valid, refused = split_valid(validate_measurement(measurements))
    logged = log_measurements(valid.drop("failed_rules"))
    known = logged
    if ledgers is not None:
        logged = conform(logged, "measurements")
        logged = cut_lineage(ledgers.unseen("measurements", logged, "pipeline_id", "tx_id", "ts"))
        known = ledgers.read("measurements").unionByName(logged) if ledgers.has("measurements") else logged
    out = {"measurements": logged, "alerts": sla_breaches(logged, sla), "trend": sigma_trend(known, trend), "refused": refused}
    if period is not None:
        out["certificates"] = quality_certificate(known, sla, *period)
    if ledgers is not None:
        rows = {
            "measurements": (logged, "pipeline_id"), "sla_alerts": (conform(out["alerts"], "sla_alerts"), "pipeline_id"),
            "measurements_refused": (conform(refused, "measurements", "failed_rules"), "pipeline_id"),
        }
        if period is not None:
            rows["certificates"] = (conform(out["certificates"], "certificates").withColumns({
                "period_start": F.lit(period[0]), "period_end": F.lit(period[1])}), "pipeline_id")
        ledgers.commit(batch or _content_batch("quality", logged, "measurement_id", "measurement_hash"), rows)
    return out


def catalogue_job(puts: DataFrame, needs: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Deduplicate content, resolve needs and place what has to move."""
    particles = cut_lineage(K.dedup_content(puts))  # five outputs start from it
    resolved = K.resolve_needs(needs, particles)
    plan = K.plan_placement(resolved.filter("status = 'MOVE'"), nodes, particles)
    moved = K.move_records(plan, particles, nodes)
    return {
        "particles": particles, "resolved": resolved, "plan": plan, "moves": moved,
        "status": K.catalogue_status(particles, nodes, moved, needs),
    }


def catalogue_run(
    ledgers: Ledgers, batch: str, puts: DataFrame, needs: DataFrame, nodes: DataFrame, as_of: str, cold_days: int = 30,
) -> dict[str, DataFrame]:
    """One run over the catalogue's state: new content, needs, moves, then eviction of cold copies.

    Particles, nodes and access counts are states, each run's made from the version before; moves and
    evictions are ledgers. ``nodes`` adds nodes the catalogue does not know. A copy put by its owner takes none of a node's space, a
    copy moved there does, and an evicted copy gives its space back. All enters ``ledgers`` as one batch; the batch done
    again, or needs that were met, change nothing.
    """
    before = ledgers.snapshot()
    version = before.version
    if batch in before.batches:
        return {name: ledgers.read(name) for name in ("particles", "nodes", "accesses", "movements", "evictions")}
    held = ledgers.read("particles", version) if "particles" in before.folders else None
    known = ledgers.read("nodes", version) if "nodes" in before.folders else None
    counted = ledgers.read("accesses", version) if "accesses" in before.folders else None

    fresh = nodes.select("node_id", "region", "capacity_bytes", "used_bytes", "node_type", "online")
    places = fresh if known is None else known.unionByName(fresh.join(known, "node_id", "left_anti"))
    particles = cut_lineage(K.merge_particles(held, K.dedup_content(puts)))
    resolved = cut_lineage(K.resolve_needs(needs, particles))
    plan = cut_lineage(K.plan_placement(resolved.filter("status = 'MOVE'"), places, particles))
    moved = K.move_records(plan, particles, places)
    accessed = resolved.filter("status = 'NEAR'").select("content_hash", F.lit(as_of).cast("timestamp_ntz").alias("ts"))
    stats = cut_lineage(K.add_accesses(counted, K.access_stats(accessed, "content_hash")))
    spread = cut_lineage(K.apply_moves(particles, plan))
    cold = cut_lineage(K.eviction_candidates(spread, stats, as_of, cold_days))
    kept = K.apply_evictions(spread, cold)
    filled = K.apply_space(places, plan, cold)
    evicted = cold.select("content_hash", "evict_node", "size_bytes", F.lit(as_of).cast("timestamp_ntz").alias("evicted_at"))
    ledgers.commit(batch, {
        "particles": (kept, "content_hash"), "nodes": (filled, "node_id"), "accesses": (stats, "content_hash"),
        "movements": (conform(moved, "movements").withColumn("batch", F.lit(batch)), "content_hash"),
        "evictions": (evicted.withColumn("batch", F.lit(batch)), "content_hash"),
    }, replace=("particles", "nodes", "accesses"), based_on=version)
    return {name: ledgers.read(name) for name in ("particles", "nodes", "accesses", "movements", "evictions")} | {
        "resolved": resolved, "plan": plan,
        "status": K.catalogue_status(ledgers.read("particles"), ledgers.read("nodes"), ledgers.read("movements"), needs),
    }
