"""Dataset records that carry their own policy: who may use a dataset and where it may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.hashing import content_cid, dna_hash, rfc3339, sha256
from ledgerloom.functions.sigma import (
    accuracy_default, completeness_default, sigma_to_dpm_rounded, timeliness_default,
)

# Countries the policy text counts as the EU.
EU_COUNTRIES = ("DE", "FR", "IT", "ES", "PL", "NL", "BE", "SE", "AT", "DK")


def can_cross_border(df: DataFrame, target: str = "target_region") -> DataFrame:
    """Add ``allowed`` and ``note``; the first jurisdiction that objects names the reason.

    Missing lists are empty and a missing region is on none, so what is unknown is refused.
    """
    region = F.coalesce(target, F.lit(""))
    empty = F.array().cast("array<string>")
    blocked, allowed, laws = (F.coalesce(c, empty) for c in ("blocked_regions", "allowed_regions", "jurisdictions"))

    def objection(law: Column) -> Column:
        return F.when(
            (law == "IN_DPDP_2023") & ~region.startswith("IN"),
            "BLOCKED: DPDP 2023 — data cannot leave India without explicit approval",
        ).when(
            (law == "EU_GDPR_2018") & ~region.isin(*EU_COUNTRIES),
            "BLOCKED: GDPR — data cannot leave EU without adequacy decision",
        )

    objections = F.array_compact(F.transform(laws, objection))
    refused = F.array_contains(blocked, region)
    listed = F.array_contains(allowed, region)
    note = (
        F.when(refused, F.concat(F.lit("BLOCKED: "), region, F.lit(" is explicitly blocked by border policy")))
        .when(~listed, F.coalesce(
            F.get(objections, F.lit(0)),
            F.concat(F.lit("BLOCKED: "), region, F.lit(" not in allowed regions")),
        ))
        .when(F.coalesce("requires_multisig", F.lit(False)), F.format_string(
            "ALLOWED: %s — requires %d signatures", region, F.coalesce("multisig_count", F.lit(0))))
        .otherwise(F.concat(F.lit("ALLOWED: "), region, F.lit(" — compliant with all jurisdictions")))
    )
    return df.withColumns({"note": note, "allowed": ~refused & listed})


def can_access(df: DataFrame, as_of: Column) -> DataFrame:
    """Owners always may; others need a purpose that contains the consented one, still valid.

    Without a known owner, purpose or consent nobody may.
    """
    no = F.lit(False)
    owner = F.coalesce(F.col("owner_id") == F.col("user_id"), no)
    fits = F.coalesce(F.col("purpose").contains(F.col("consent_purpose")), no)
    asked, given = (F.coalesce(c, F.lit("")) for c in ("purpose", "consent_purpose"))
    expired = F.coalesce(as_of > F.col("consent_expires"), F.lit(False))
    note = (
        F.when(owner, "ALLOWED: owner access")
        .when(~fits, F.concat(
            F.lit("BLOCKED: purpose '"), asked, F.lit("' does not match consent '"), given, F.lit("'")))
        .when(expired, "BLOCKED: consent has expired")
        .otherwise("ALLOWED: valid consent")
    )
    return df.withColumns({"note": note, "allowed": owner | (fits & ~expired)})


def consent_violations(datasets: DataFrame, uses: DataFrame) -> DataFrame:
    """Uses of a dataset its consent did not cover at that time, those without any policy included."""
    policy = datasets.select("dataset_id", "owner_id", "consent_purpose", "consent_expires")
    return can_access(uses.join(policy, "dataset_id", "left"), F.col("ts")).filter(~F.col("allowed"))


def dna_from_ingest(df: DataFrame, version_tag: str = "v3") -> DataFrame:
    """Build dataset records from ingested payloads; ids derive from content and name.

    Payloads that were hashed before come with their ``content_hash`` instead.
    """
    body = F.col("content_hash") if "content_hash" in df.columns else sha256(F.col("payload"))
    return df.select(
        F.concat(F.lit("ds-"), F.left(sha256(F.concat_ws("|", "dataset_name", body)), F.lit(12))).alias("dataset_id"),
        "dataset_name", F.col("owner_id").alias("creator_id"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("created_at"),
        "classification", "jurisdictions",
        F.array(F.col("classification"), F.lit(version_tag)).alias("tags"),
        F.array().cast("array<string>").alias("parent_ids"), F.lit("raw_ingest").alias("transformation"),
        F.concat(F.lit("manual-ingest-"), F.left(body, F.lit(6))).alias("pipeline_id"),
        F.struct(
            F.col("sigma").alias("sigma_level"), completeness_default(F.col("sigma")).alias("completeness_pct"),
            accuracy_default(F.col("sigma")).alias("accuracy_pct"), timeliness_default().alias("timeliness_score"),
            sigma_to_dpm_rounded(F.col("sigma")).alias("defects_per_million"),
        ).alias("quality"),
        F.struct(
            F.col("owner_id"), F.col("purpose"), rfc3339(F.col("ts")).alias("granted_at"),
            F.lit(None).cast("timestamp_ntz").alias("expires_at"), F.lit(True).alias("revocable"),
        ).alias("consent"),
        F.struct(
            F.col("allowed_regions"), F.array().cast("array<string>").alias("blocked_regions"),
            F.lit(True).alias("requires_consent"),
            F.array_contains("jurisdictions", "IN_DPDP_2023").alias("requires_multisig"),
            F.lit(3).alias("multisig_count"),
        ).alias("border_policy"),
        body.alias("content_hash"), content_cid(body).alias("ipfs_cid"),
        F.concat(F.lit("TX_"), F.left(sha256(F.concat(F.lit("ingest|"), body)), F.lit(24))).alias("fabric_tx_id"),
        F.col("sigma").alias("quality_sigma"),
    ).withColumn("genome_hash", dna_hash())


def verify_dna(df: DataFrame) -> DataFrame:
    return df.withColumn("integrity_ok", F.col("genome_hash").eqNullSafe(dna_hash()))
