"""Record layouts of the ledgers and control tables, and their closed value lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

_VIOLATION = (
    "struct<violation_id: string, rule_id: string, law: string, law_section: string, description: string, "
    "penalty: string, auto_fixed: boolean>"
)
_ENTITIES = {
    "lineage": (
        "tx_id string, job_id string, ts timestamp_ntz, timestamp string, input_dataset_ids array<string>, "
        "input_hashes array<string>, output_dataset_id string, output_hash string, transformation_type string, "
        "pipeline_id string, pipeline_version string, operator_code string, sigma_level double, classification string, "
        "jurisdictions array<string>, owner_org string, operator_msp string, node_id string, region string, "
        "ipfs_cid string, genome_hash string"
    ),
    "rules": (
        "rule_id string, law string, law_section string, description string, applies_to array<string>, "
        "blocked_regions array<string>, rule_regions array<string>, needs_consent boolean, needs_signatures boolean, "
        "min_signatures int, auto_fix string, penalty string, active boolean, enacted_at string"
    ),
    "transfer_requests": (
        "request_id string, dataset_id string, classification string, jurisdictions array<string>, source_region string, "
        "target_region string, purpose string, has_consent boolean, consent_id string, requester_msp string, "
        "ts timestamp_ntz, signature_count int"
    ),
    "decisions": (
        "decision_id string, request_id string, dataset_id string, decision string, reason string, rules_evaluated int, "
        f"rules_passed int, violations array<{_VIOLATION}>, auto_fixes array<string>, ts timestamp_ntz, tx_id string"
    ),
    "measurements": (
        "measurement_id string, pipeline_id string, dataset_id string, run_id string, ts timestamp_ntz, timestamp string, "
        "dmaic_phase string, sigma_level double, defects_per_million double, completeness_pct double, accuracy_pct double, "
        "timeliness_score double, records_processed bigint, records_failed bigint, expectations_run int, "
        "expectations_passed int, node_id string, region string, operator_msp string, measurement_hash string, tx_id string"
    ),
    "sla": (
        "pipeline_id string, min_sigma double, target_sigma double, breach_threshold double, customer_org string, "
        "contract_start string, active boolean"
    ),
    "sla_alerts": (
        "alert_id string, pipeline_id string, breached_at timestamp_ntz, expected_min double, actual_sigma double, "
        "severity string, auto_quarantined boolean, notified_orgs array<string>"
    ),
    "certificates": (
        "pipeline_id string, customer_org string, measurements bigint, avg_sigma double, min_sigma double, max_sigma double, "
        "total_defects bigint, total_records bigint, sla_target double, sla_met boolean, breaches bigint, proof string"
    ),
    "dataset_dna": (
        "dataset_id string, dataset_name string, creator_id string, created_at double, classification string, "
        "jurisdictions array<string>, tags array<string>, parent_ids array<string>, transformation string, pipeline_id string, "
        "quality struct<sigma_level: double, completeness_pct: double, accuracy_pct: double, timeliness_score: double, "
        "defects_per_million: double>, consent struct<owner_id: string, purpose: string, granted_at: string, "
        "expires_at: timestamp_ntz, revocable: boolean>, border_policy struct<allowed_regions: array<string>, "
        "blocked_regions: array<string>, requires_consent: boolean, requires_multisig: boolean, multisig_count: int>, "
        "content_hash string, ipfs_cid string, fabric_tx_id string, genome_hash string"
    ),
    "particles": (
        "content_hash string, cid string, size_bytes bigint, state string, home_nodes array<string>, sigma double, puts bigint"
    ),
    "nodes": "node_id string, region string, capacity_bytes bigint, used_bytes bigint, node_type string, online boolean",
    "compute_needs": "need_id string, node_id string, region string, content_hash string, seq bigint",
    "movements": (
        "move_id string, content_hash string, cid string, from_node string, to_node string, to_region string, "
        "size_bytes bigint, reason string"
    ),
    "registry": (
        "id string, name string, sigma double, status string, laws array<string>, tx string, region string, runs bigint, "
        "last_run timestamp_ntz, healing_rate bigint, classification string, owner string, source string, target string, "
        "created_at timestamp_ntz"
    ),
    "audit_events": (
        "ts timestamp_ntz, tx string, action string, dataset string, result string, actor string, law string, region string, "
        "sigma double, reason string, target string, details string"
    ),
    "runs": (
        "run_id string, pipeline_id string, status string, duration_ms bigint, source string, target string, region string, "
        "law string, tx string, ts timestamp_ntz, logs array<struct<step: string, status: string, message: string, ts: timestamp_ntz>>"
    ),
    "heal_actions": "heal_id string, pipeline_id string, failure_type string, diagnosis string, action string, success boolean, applied_at timestamp_ntz",
    "intents": "intent_id string, raw_text string, language string, user_id string, intent_type string, translated string, created_at timestamp_ntz",
    "role_permissions": "role string, permission string",
}

# Closed lists.
ALLOWED_VALUES = {
    "classification": ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "PII", "HEALTH", "FINANCIAL", "BIOMETRIC"),
    "jurisdiction": ("IN_DPDP_2023", "EU_GDPR_2018", "US_HIPAA_1996", "US_SOX_2002", "GLOBAL_OPEN"),
    "decision": ("ALLOWED", "BLOCKED", "ALLOWED_WITH_FIX"),
    "particle_state": ("floating", "anchored", "migrating", "replicated"),
    "severity": ("CRITICAL", "HIGH", "MEDIUM"),
    "status": ("healthy", "warning", "critical"),
}


def schema_of(entity: str) -> StructType:
    return StructType.fromDDL(_ENTITIES[entity])


def conform(df: DataFrame, entity: str, *extra: str) -> DataFrame:
    """Columns of the entity in order and type, then ``extra`` ones as they are; ones the table lacks become null."""
    columns = []
    for field in schema_of(entity):
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns, *extra)


def is_allowed(column: Column, kind: str) -> Column:
    return column.isin(*ALLOWED_VALUES[kind])
