"""Transfer requests against legal rules: decisions, reports and the other rule profiles.

The rule table is the canonical engine. The profiles below it disagree with it and with
each other on purpose; each reproduces one published behaviour over the same requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.hashing import piped, sha256
from ledgerloom.functions.numbers import fixed
from ledgerloom.operators.ordered import first_k_per_key
from ledgerloom.operators.rules import FIELDS, RULE_LISTS, RULES, closed_rules

REQUEST_COLUMNS = (
    "request_id", "dataset_id", "classification", "jurisdictions", "source_region", "target_region",
    "has_consent", "signature_count", "ts", "tx_id",
)


#: What a missing field of a request stands for: nothing was granted, nothing was named.
MISSING = {"has_consent": False, "signature_count": 0, "classification": "", "source_region": "", "target_region": "", "allow_auto_fix": False}


def closed_requests(requests: DataFrame) -> DataFrame:
    """Requests whose missing fields count as not given, so no profile lets an unknown pass."""
    filled = {name: F.coalesce(name, F.lit(value)) for name, value in MISSING.items() if name in requests.columns}
    lists = [name for name in ("jurisdictions", "laws") if name in requests.columns]
    filled |= {name: F.coalesce(name, F.array().cast("array<string>")) for name in lists}
    return requests.withColumns(filled)


def _broken_test(rule, target: Column, consent: Column, signatures: Column) -> Column:
    """Name of the first test a request fails, null when it passes."""
    blocked = F.exists(
        rule["blocked_regions"],
        lambda region: ((region == "non-IN") & ~target.startswith("IN")) | (region == target),
    )
    outside = (F.size(rule["rule_regions"]) > 0) & ~F.array_contains(rule["rule_regions"], target)
    return (
        F.when(blocked, "blocked_region")
        .when(outside, "not_allowed_region")
        .when(rule["needs_consent"] & ~consent, "consent")
        .when(rule["needs_signatures"] & (signatures < rule["min_signatures"]), "signatures")
    )


def _fix(rule, broken: Column) -> Column:
    """The rule's own remedy; missing signatures have none."""
    return F.when(broken.isNull() | (broken == "signatures"), F.lit("")).otherwise(rule["auto_fix"])


def applicable_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per request, listed jurisdiction and rule that applies.

    A jurisdiction listed twice counts twice. The join key is the law; Spark broadcasts the
    rule table when its size allows.
    """
    closed = closed_requests(requests)
    listed = closed.select(*closed.columns, F.posexplode("jurisdictions").alias("law_position", "law"))
    kept = closed_rules(rules).filter("active")
    joined = listed.join(kept, "law")
    return joined.filter(
        (F.size("applies_to") == 0) | F.expr("array_contains(applies_to, classification)")
    )


def evaluate_rules(applicable: DataFrame) -> DataFrame:
    rule = {name: F.col(name) for name in applicable.columns}
    broken = _broken_test(rule, F.col("target_region"), F.col("has_consent"), F.col("signature_count"))
    return applicable.withColumn("failed_test", broken).withColumns({
        "passed": F.col("failed_test").isNull(),
        "fix": _fix(rule, F.col("failed_test")),
    })


PASSED, FIXED, OPEN = 0, 1, 2


def _outcome(rule: dict) -> Column:
    """Outcome of one known rule for a request, null when it does not apply to the classification."""
    target = F.col("target_region")
    remedy = F.lit(FIXED if rule["auto_fix"] else OPEN)
    chain = F
    if rule["applies_to"]:
        chain = chain.when(~F.col("classification").isin(*rule["applies_to"]), F.lit(None).cast("int"))
    named = [region for region in rule["blocked_regions"] if region != "non-IN"]
    if named:
        chain = chain.when(target.isin(*named), remedy)
    if "non-IN" in rule["blocked_regions"]:
        chain = chain.when(~target.startswith("IN"), remedy)
    if rule["rule_regions"]:
        chain = chain.when(~target.isin(*rule["rule_regions"]), remedy)
    if rule["needs_consent"]:
        chain = chain.when(~F.col("has_consent"), remedy)
    if rule["needs_signatures"]:
        chain = chain.when(F.col("signature_count") < rule["min_signatures"], F.lit(OPEN))
    return F.lit(PASSED) if chain is F else chain.otherwise(F.lit(PASSED))


def decide(requests: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """One decision per request, without a shuffle.

    The rules are known when the plan is built, so each becomes a plain condition and a row
    carries only a small number per tested rule (position and outcome); names and texts are
    looked up for violations alone. For rule tables too large for that see ``decide_joined``.
    """
    requests = closed_requests(requests)
    known = [dict(zip(FIELDS, rule)) for rule in sorted(RULES if rules is None else rules, key=lambda r: r[0])]
    known = [rule | {name: rule[name] or [] for name in RULE_LISTS} | {"auto_fix": rule["auto_fix"] or ""} for rule in known]
    known = [rule for rule in known if rule["active"]]
    by_law: dict[str, list[Column]] = {}
    for position, rule in enumerate(known):
        by_law.setdefault(rule["law"], []).append(_outcome(rule) + position * 3)
    per_law = {law: F.array_compact(F.array(*outcomes)) for law, outcomes in by_law.items()}
    out = requests.withColumns({f"_law{i}": results for i, results in enumerate(per_law.values())})

    def of_law(asked: Column) -> Column:
        chain = F
        for i, law in enumerate(per_law):
            chain = chain.when(asked == law, F.col(f"_law{i}"))
        return chain.otherwise(F.array().cast("array<int>")) if per_law else F.array().cast("array<int>")

    def texts(field: str) -> Column:
        return F.array(*[F.lit(rule[field]) for rule in known]).cast("array<string>")

    def named(code: Column, field: str) -> Column:
        return F.get(texts(field), F.floor(code / 3).cast("int"))

    out = out.withColumn("_tested", F.flatten(F.transform("jurisdictions", of_law)))
    out = out.withColumn("_broken", F.filter("_tested", lambda code: code % 3 != PASSED))
    out = out.withColumn("_open", F.filter("_broken", lambda code: code % 3 == OPEN))
    fixes = F.transform(F.filter("_broken", lambda code: code % 3 == FIXED), lambda code: named(code, "auto_fix"))
    causes = F.transform("_open", lambda code: F.concat(
        named(code, "rule_id"), F.lit(" ("), named(code, "law_section"), F.lit(")")))
    violations = F.transform("_broken", lambda code: F.struct(
        F.concat(F.lit("V-"), named(code, "rule_id"), F.lit("-"), F.left("tx_id", F.lit(8))).alias("violation_id"),
        *[named(code, field).alias(field) for field in ("rule_id", "law", "law_section", "description", "penalty")],
        (code % 3 == FIXED).alias("auto_fixed"),
    ))
    return _verdict(out, F.size("_tested"), causes, violations, fixes).drop("_tested", "_broken", "_open", *[f"_law{i}" for i in range(len(per_law))])


def _verdict(df: DataFrame, tested: Column, causes: Column, violations: Column, fixes: Column) -> DataFrame:
    """Decision columns from the number of rules tested and the arrays ``_broken`` and ``_open``."""
    blocked, any_broken = F.size("_open") > 0, F.size("_broken") > 0
    fixed = F.size("_broken") - F.size("_open")
    return df.withColumns({
        "decision_id": F.concat(F.lit("DEC-"), F.left("tx_id", F.lit(12))),
        "decision": F.when(blocked, "BLOCKED").when(any_broken, "ALLOWED_WITH_FIX").otherwise("ALLOWED"),
        "reason": F.when(blocked, F.concat(F.lit("BLOCKED by: "), F.array_join(causes, ", ")))
        .when(any_broken, F.format_string("Allowed after %d auto-fixes applied", fixed))
        .otherwise("All compliance rules satisfied"),
        "rules_evaluated": tested,
        "rules_passed": tested - F.size("_open"),
        "violations": violations, "auto_fixes": fixes,
    })


def decide_joined(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """The same decisions from a stored rule table of any size, by join and grouping.

    A group is one request with the rules of its own jurisdictions, so no group is large. Only broken
    rules are gathered, the others are counted.
    """
    requests = closed_requests(requests)
    broken = F.when(~F.col("passed"), F.struct("law_position", "rule_id", "law", "law_section", "description", "penalty", "fix"))
    per_request = evaluate_rules(applicable_rules(requests, rules)).groupBy("request_id").agg(
        F.count(F.lit(1)).cast("int").alias("_tested"), F.array_sort(F.collect_list(broken)).alias("_broken")
    )
    none = F.array().cast(per_request.schema["_broken"].dataType)
    out = requests.join(per_request, "request_id", "left").withColumns({
        "_tested": F.coalesce("_tested", F.lit(0)), "_broken": F.coalesce("_broken", none),
    })
    out = out.withColumn("_open", F.filter("_broken", lambda v: v["fix"] == ""))
    fixes = F.transform(F.filter("_broken", lambda v: v["fix"] != ""), lambda v: v["fix"])
    causes = F.transform("_open", lambda v: F.concat(v["rule_id"], F.lit(" ("), v["law_section"], F.lit(")")))
    violations = F.transform("_broken", lambda v: F.struct(
        F.concat(F.lit("V-"), v["rule_id"], F.lit("-"), F.left("tx_id", F.lit(8))).alias("violation_id"),
        *[v[field].alias(field) for field in ("rule_id", "law", "law_section", "description", "penalty")],
        (v["fix"] != "").alias("auto_fixed"),
    ))
    return _verdict(out, F.col("_tested"), causes, violations, fixes).drop("_tested", "_broken", "_open")


def compliance_report(decisions: DataFrame) -> DataFrame:
    """Totals and proof per dataset; first and last follow transaction-key order."""
    counted = decisions.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("decision") == "ALLOWED").alias("allowed"),
        F.count_if(F.col("decision") == "BLOCKED").alias("blocked"),
        F.count_if(F.col("decision") == "ALLOWED_WITH_FIX").alias("auto_fixed"),
        F.min("tx_id").alias("_first"), F.max("tx_id").alias("_last"),
    )
    rate = (F.col("allowed") + F.col("auto_fixed")) / F.col("total") * 100
    return counted.withColumns({
        "compliance_rate": rate,
        "proof": sha256(piped(*map(F.col, ("dataset_id", "total", "_first", "_last")))),
    }).drop("_first", "_last")


def recent_decisions(decisions: DataFrame, k: int = 10) -> DataFrame:
    """Last ``k`` decisions per dataset in transaction-key order, newest key first."""
    return first_k_per_key(decisions, ["dataset_id"], [F.desc("tx_id")], k)


def violation_report(checks: DataFrame) -> DataFrame:
    """Checks, violations and fixes per dataset; the rate goes below zero when a check breaks several rules."""
    counted = checks.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.sum(F.size("violated_rules")).alias("violations"),
        F.sum(F.size("fixed_rules")).alias("auto_fixes"),
    )
    rate = (1 - F.col("violations") / F.greatest(F.col("total_checks"), F.lit(1))) * 100
    return counted.withColumn("compliance_rate", F.concat(fixed(rate, 1), F.lit("%")))


def framework_summary(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rules, violations and auto-fixes per law; laws without decisions stay."""
    broken = decisions.select(F.explode("violations").alias("v")).groupBy(F.col("v.law").alias("law")).agg(
        F.count(F.lit(1)).alias("violations"), F.count_if("v.auto_fixed").alias("auto_fixes")
    )
    counted = rules.groupBy("law").agg(F.count(F.lit(1)).alias("rules"))
    return counted.join(broken, "law", "left").select(
        "law", "rules", F.coalesce("violations", F.lit(0)).alias("violations"),
        F.coalesce("auto_fixes", F.lit(0)).alias("auto_fixes"),
        F.when(F.coalesce("violations", F.lit(0)) > 0, "active").otherwise("monitoring").alias("status"),
    )


def framework_totals(summary: DataFrame) -> DataFrame:
    totals = summary.agg(
        F.count(F.lit(1)).alias("framework_count"), F.sum("rules").alias("total_rules"),
        F.sum("violations").alias("total_violations"), F.sum("auto_fixes").alias("total_auto_fixes"),
    )
    status = F.when(F.col("total_violations") == 0, "passed").otherwise("review_required")
    return totals.withColumn("status", status)


def framework_checks(summary: DataFrame, as_of: str) -> DataFrame:
    """One audit row per law, as each framework check leaves in the audit table."""
    return summary.select(
        F.lit(as_of).cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("TX_"), F.left(sha256(F.concat_ws("|", "law", F.lit(as_of))), F.lit(12))).alias("tx"),
        F.lit("COMPLIANCE_CHECK").alias("action"),
        F.concat(F.lower("law"), F.lit("_policy_scan")).alias("dataset"),
        F.when(F.col("violations") == 0, "PASSED").otherwise("REVIEW_REQUIRED").alias("result"),
        F.lit("compliance-engine").alias("actor"), "law", F.lit("GLOBAL").alias("region"),
    )


# ---- profiles ---------------------------------------------------------------------------

# Regions of the simulation profile.
SIM_INDIA = ("IN", "IN-TG", "IN-MH", "IN-DL", "IN-KA", "IN-AP", "IN-TN")
SIM_ADEQUATE = (
    "EU-DE", "EU-FR", "EU-IT", "EU-ES", "EU-NL", "EU-BE", "EU-AT", "EU-DK", "EU-FI", "EU-SE", "EU-PL",
    "EU-PT", "EU-IE", "EU-CZ", "EU-HU", "EU-GR", "UK", "CH", "NO", "JP", "CA", "NZ", "AR", "IL", "UY", "KR",
)
# Countries of the fallback profile.
FALLBACK_ADEQUATE = (
    "DE", "FR", "IT", "ES", "NL", "BE", "SE", "AT", "DK", "FI", "PL", "PT", "IE", "GB", "UK", "CH", "NO",
    "IS", "LI", "JP", "CA", "NZ", "AR", "IL", "UY", "KR",
)
# Countries of the expression profile.
EXPRESSION_ADEQUATE = (
    "DE", "FR", "IT", "ES", "NL", "BE", "SE", "AT", "DK", "FI", "PL", "PT", "GR", "CZ", "RO", "HU", "SK",
    "BG", "HR", "LT", "LV", "EE", "SI", "MT", "CY", "LU", "IE", "UK", "CH", "NO", "IS", "LI", "JP", "CA",
    "NZ", "AR", "IL", "UY", "KR", "GB",
)


def _int(flag: Column) -> Column:
    return flag.cast("int")


def _listed(law: str) -> Column:
    return F.array_contains("jurisdictions", law)


def _named(*rules: tuple[Column, str]) -> Column:
    """Names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for flag, name in rules]))


# Violation records of the two profiles: rule -> (law, section, description, penalty).
SIM_VIOLATIONS = {
    "DPDP-001": ("DPDP_2023", "Sec 16(2)", "Indian PII cannot leave India without explicit consent", "₹250 crore or 4% of global turnover"),
    "DPDP-004": ("DPDP_2023", "Sec 10", "Cross-region transfer requires 3 signatures", "License revocation"),
    "GDPR-001": ("GDPR", "Art 45", "EU data cannot leave EU without adequacy decision", "€20M or 4% of global turnover"),
}
FALLBACK_VIOLATIONS = {
    "DPDP-001": ("DPDP_2023", "Cross-border transfer", "Indian personal data must not leave India without explicit consent", "BLOCK transfer"),
    "DPDP-002": ("DPDP_2023", "Consent / multisig", "Within-India transfer requires consent or multisig approval", "BLOCK transfer"),
    "GDPR-001": ("GDPR", "International transfer", "EU PII cannot be transferred to a non-adequate country", "BLOCK transfer"),
}


def _violation_records(broken: dict[str, Column], texts: dict[str, tuple[str, str, str, str]], prefix: str) -> Column:
    """Records like those of ``decide`` for the rules whose condition holds; nothing is fixed in these profiles."""
    records = []
    for rule_id, flag in broken.items():
        fields = dict(zip(("law", "law_section", "description", "penalty"), texts[rule_id]))
        records.append(F.when(flag, F.struct(
            F.concat(F.lit(f"{prefix}-{rule_id}-"), F.coalesce("request_id", F.lit(""))).alias("violation_id"),
            F.lit(rule_id).alias("rule_id"), *[F.lit(text).alias(name) for name, text in fields.items()], F.lit(False).alias("auto_fixed"),
        )))
    return F.array_compact(F.array(*records))


def decide_simulation(requests: DataFrame) -> DataFrame:
    """Consent lets data leave India with a note; signatures count only when they are missing."""
    requests = closed_requests(requests)
    region = F.col("target_region")
    dpdp = _listed("DPDP_2023") & F.col("classification").isin("PII", "HEALTH", "FINANCIAL", "BIOMETRIC")
    gdpr = _listed("GDPR") & F.col("classification").isin("PII", "HEALTH")
    hipaa = _listed("HIPAA") & (F.col("classification") == "HEALTH")
    leaves = dpdp & ~region.isin(*SIM_INDIA)
    no_consent = leaves & ~F.col("has_consent")
    unsigned = dpdp & (region != F.col("source_region")) & (F.col("signature_count") < 3)
    inadequate = gdpr & ~region.isin(*SIM_ADEQUATE)
    broken = {"DPDP-001": no_consent, "DPDP-004": unsigned, "GDPR-001": inadequate}
    out = requests.withColumn("violated_rules", _named(*[(flag, name) for name, flag in broken.items()]))
    blocked = F.size("violated_rules") > 0
    return out.withColumns({
        "decision": F.when(blocked, "BLOCKED").otherwise("ALLOWED"),
        "reason": F.when(blocked, F.concat(F.lit("BLOCKED by: "), F.array_join("violated_rules", ", ")))
        .otherwise("All compliance rules satisfied"),
        "rules_evaluated": _int(dpdp) + _int(unsigned) + _int(gdpr) + _int(hipaa),
        "rules_passed": _int(dpdp & ~no_consent) + _int(gdpr & ~inadequate) + _int(hipaa),
        "violations": _violation_records(broken, SIM_VIOLATIONS, "SIM"),
        "auto_fixes": _named((leaves & F.col("has_consent"), "request_consent_workflow")),
    })


def decide_fallback(requests: DataFrame) -> DataFrame:
    """The service's own check when no ledger answers; classification plays no part."""
    requests = closed_requests(requests)
    region = F.col("target_region")
    inside = region.startswith("IN")
    approved = F.col("has_consent") | (F.col("signature_count") >= 3)
    dpdp, gdpr = _listed("DPDP_2023"), _listed("GDPR")
    broken = {
        "DPDP-001": dpdp & ~inside & ~F.col("has_consent"), "DPDP-002": dpdp & inside & ~approved,
        "GDPR-001": gdpr & ~region.isin(*FALLBACK_ADEQUATE),
    }
    out = requests.withColumn("violations", _violation_records(broken, FALLBACK_VIOLATIONS, "FALLBACK"))
    causes = F.transform("violations", lambda v: F.concat(v["rule_id"], F.lit(": "), v["description"]))
    blocked = F.size("violations") > 0
    evaluated = F.greatest(_int(dpdp) + _int(gdpr), F.lit(1))
    return out.withColumns({
        "decision": F.when(blocked, "BLOCKED").otherwise("ALLOWED"),
        "reason": F.when(blocked, F.array_join(causes, "; ")).otherwise("ALL COMPLIANCE CHECKS PASSED"),
        "rules_evaluated": evaluated,
        "rules_passed": evaluated - F.size("violations"),
        "violated_rules": F.transform("violations", lambda v: v["rule_id"]),
    })


# Rule -> (law, description, remedy or null).
EXPRESSION_RULES = {
    "DPDP-001": ("IN_DPDP_2023",
                 "Personal data of Indian citizens must not leave India without explicit consent",
                 "request_consent() if can_request else block_transfer()"),
    "DPDP-002": ("IN_DPDP_2023", "Sensitive personal data requires purpose limitation", None),
    "DPDP-003": ("IN_DPDP_2023", "Data fiduciary must maintain processing records",
                 "log_to_fabric() and retry()"),
    "GDPR-001": ("EU_GDPR_2018", "Data of EU residents cannot leave EU without adequacy decision", None),
    "GDPR-002": ("EU_GDPR_2018", "Right to erasure — data must be deletable on request",
                 "mark_for_erasure_review()"),
    "GDPR-003": ("EU_GDPR_2018", "Data minimisation — only necessary data collected",
                 "drop_unjustified_columns()"),
    "HIPAA-001": ("US_HIPAA_1996", "PHI must be encrypted in transit and at rest",
                  "encrypt_now() and retry_access()"),
    "HIPAA-002": ("US_HIPAA_1996", "PHI access requires minimum necessary standard", None),
}


def _expression_holds(columns: list[str]) -> dict[str, Column]:
    """Whether each rule holds; what the request leaves open takes the rule's default.

    The purpose counts as consented to unless the request lists ``allowed_purposes``.
    """
    yes, zero = F.lit(True), F.lit(0)
    purpose = yes
    if "allowed_purposes" in columns:
        listed = F.coalesce(F.array_contains("allowed_purposes", F.coalesce("purpose", F.lit(""))), F.lit(False))
        purpose = F.col("allowed_purposes").isNull() | listed
    return {
        "DPDP-001": (F.col("target_region") == "IN") | F.col("has_consent"),
        "DPDP-002": purpose,
        "DPDP-003": F.coalesce("fabric_tx_id", F.lit("")) != "",
        "GDPR-001": F.col("target_region").isin(*EXPRESSION_ADEQUATE),
        "GDPR-002": F.coalesce("is_erasable", F.lit(False)),
        "GDPR-003": F.coalesce("field_count", zero) <= F.coalesce("justified_field_count", zero),
        "HIPAA-001": F.coalesce("encrypted_at_rest", yes) & F.coalesce("encrypted_in_transit", yes),
        "HIPAA-002": F.coalesce("clearance_level", F.lit(999)) >= F.coalesce("required_clearance", zero),
    }


def decide_expressions(requests: DataFrame) -> DataFrame:
    """Rules over optional attributes of the request; ``laws`` holds full law codes.

    Laws are checked in the order listed. With ``allow_auto_fix`` a request goes through
    only if every rule it breaks has a remedy.
    """
    requests = closed_requests(requests)
    holds = _expression_holds(requests.columns)

    def rules_of(law: Column) -> Column:
        parts = []
        for rule_id, (code, description, remedy) in EXPRESSION_RULES.items():
            parts.append(F.when((law == code) & ~holds[rule_id], F.struct(
                F.lit(rule_id).alias("rule_id"), F.lit(description).alias("description"),
                F.lit(remedy).cast("string").alias("remedy"),
            )))
        return F.array_compact(F.array(*parts))

    out = requests.withColumn("_broken", F.flatten(F.transform("laws", rules_of)))
    fixed = F.filter("_broken", lambda v: v["remedy"].isNotNull())
    text = F.transform("_broken", lambda v: F.concat(
        v["rule_id"], F.lit(": "), v["description"],
        F.coalesce(F.concat(F.lit(" |   AUTO-FIXED: "), v["remedy"]), F.lit("")),
    ))
    clean = F.size("_broken") == 0
    all_fixable = F.size(fixed) == F.size("_broken")
    return out.withColumns({
        "violated_rules": F.transform("_broken", lambda v: v["rule_id"]),
        "fixed_rules": F.transform(fixed, lambda v: v["rule_id"]),
        "decision": F.when(clean | (F.col("allow_auto_fix") & all_fixable), "ALLOWED").otherwise("BLOCKED"),
        "reason": F.when(clean, "ALL COMPLIANCE CHECKS PASSED").otherwise(F.array_join(text, " | ")),
    }).drop("_broken")


def recent_checks(checks: DataFrame, k: int = 5) -> DataFrame:
    return first_k_per_key(checks, ["dataset_id"], [F.desc("ts"), F.desc("request_id")], k)
