"""The catalogue of legal rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RULE_SCHEMA = (
    "rule_id string, law string, law_section string, description string, applies_to array<string>, "
    "blocked_regions array<string>, rule_regions array<string>, needs_consent boolean, "
    "needs_signatures boolean, min_signatures int, auto_fix string, penalty string, active boolean, "
    "enacted_at string"
)

# The rules, in key order.
_INDIA = ["IN", "IN-TG", "IN-MH", "IN-DL", "IN-KA", "IN-AP", "IN-TN"]
_EU = [
    "EU-DE", "EU-FR", "EU-IT", "EU-ES", "EU-NL", "EU-BE", "EU-AT", "EU-DK", "EU-FI", "EU-SE", "EU-PL",
    "EU-PT", "EU-IE", "EU-CZ", "EU-HU", "EU-GR",
]
_ADEQUATE = ["UK", "CH", "NO", "JP", "CA", "NZ", "AR", "IL", "UY", "KR"]
RULES = [
    ("DPDP-001", "DPDP_2023", "Sec 16(2)",
     "Personal data of Indian citizens cannot leave India without explicit consent",
     ["PII", "HEALTH", "FINANCIAL", "BIOMETRIC"], ["non-IN"], _INDIA, True, False, 0,
     "request_consent_workflow", "₹250 crore or 4% of global turnover", True, "2023-08-11T00:00:00Z"),
    ("DPDP-002", "DPDP_2023", "Sec 6", "Data use must match purpose declared in consent",
     ["PII", "HEALTH", "FINANCIAL", "BIOMETRIC"], [], [], True, False, 0,
     "", "₹100 crore", True, "2023-08-11T00:00:00Z"),
    ("DPDP-003", "DPDP_2023", "Sec 8(7)", "Data fiduciary must maintain processing records",
     ["PII", "HEALTH", "FINANCIAL"], [], [], False, False, 0,
     "log_to_fabric_lineage", "₹50 crore", True, "2023-08-11T00:00:00Z"),
    ("DPDP-004", "DPDP_2023", "Sec 10",
     "Significant data fiduciary requires multi-sig for cross-border transfers",
     ["PII"], [], [], False, True, 3, "", "License revocation", True, "2023-08-11T00:00:00Z"),
    ("GDPR-001", "GDPR", "Art 45", "EU personal data cannot leave EU without adequacy decision",
     ["PII", "HEALTH"], [], _EU + _ADEQUATE, True, False, 0,
     "", "€20M or 4% of global turnover", True, "2018-05-25T00:00:00Z"),
    ("GDPR-002", "GDPR", "Art 17", "Right to erasure — data must be deletable on request",
     ["PII"], [], [], False, False, 0,
     "mark_for_erasure_review", "€10M or 2% of global turnover", True, "2018-05-25T00:00:00Z"),
    ("GDPR-003", "GDPR", "Art 5(1)(c)", "Data minimisation — only fields necessary for the purpose",
     ["PII"], [], [], False, False, 0,
     "drop_unjustified_columns", "€10M or 2% of global turnover", True, "2018-05-25T00:00:00Z"),
    ("HIPAA-001", "HIPAA", "164.312(a)(2)(iv)",
     "Protected Health Information must be encrypted in transit and at rest",
     ["HEALTH"], [], [], False, False, 0,
     "force_encryption_now", "$1.5M per violation per year", True, "2003-04-14T00:00:00Z"),
    ("HIPAA-002", "HIPAA", "164.502(b)", "PHI access requires minimum necessary standard",
     ["HEALTH"], [], [], False, False, 0, "", "$1.5M per violation per year", True, "2003-04-14T00:00:00Z"),
    ("SOX-001", "SOX", "Sec 302", "Financial data integrity requires immutable audit trail",
     ["FINANCIAL"], [], [], False, False, 0,
     "log_to_fabric_lineage", "$5M criminal, 20 years prison", True, "2002-07-30T00:00:00Z"),
]
FIELDS = [part.split()[0] for part in RULE_SCHEMA.split(", ")]


def rule_catalogue(spark: SparkSession, rules=None) -> DataFrame:
    """Rules as a table whose size Spark knows, so joins broadcast them and never the other side.

    Plain Python rows would count as larger than any table.
    """
    schema = StructType.fromDDL(RULE_SCHEMA)
    rows = [dict(zip(FIELDS, rule)) for rule in (RULES if rules is None else rules)]
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)), schema)


RULE_LISTS = ("applies_to", "blocked_regions", "rule_regions")


def closed_rules(rules: DataFrame) -> DataFrame:
    """Stored rules with missing lists as empty ones (applies to all), missing flags as false."""
    filled = {name: F.coalesce(name, F.array().cast("array<string>")) for name in RULE_LISTS}
    filled |= {name: F.coalesce(name, F.lit(False)) for name in ("needs_consent", "needs_signatures", "active")}
    filled |= {"min_signatures": F.coalesce("min_signatures", F.lit(0)), "auto_fix": F.coalesce("auto_fix", F.lit(""))}
    return rules.withColumns(filled)


def admin_changes(changes: DataFrame, setter: Column, admin_orgs: list[str], as_of: str) -> DataFrame:
    """Rule changes an administering organisation made, stamped as enacted then; others are refused."""
    return changes.filter(setter.isin(*admin_orgs)).withColumn("enacted_at", F.lit(as_of))
