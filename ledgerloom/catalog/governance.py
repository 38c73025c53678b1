"""Rules, decisions, dataset policies, lineage and service levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.base import EVENTS_AS_OF, Tables, big, joined, query
from ledgerloom.functions import hashing as H
from ledgerloom.operators import audit, compliance as C, dna, lineage as L, rules as R, sla as SL
from ledgerloom.operators.ordered import latest_per_key

_RULE_ROWS = ",\n".join(
    "('{}', '{}', '{}', '{}', '{}', '{}', {}, {}, {}, '{}')".format(
        r[0], r[1], r[2], ",".join(r[4]), ",".join(r[5]), ",".join(r[6]), r[7], r[8], r[9], r[10])
    for r in R.RULES
)
_CLOSED = "asked AS (SELECT * REPLACE (coalesce(has_consent, false) AS has_consent, coalesce(signature_count, 0) AS signature_count, coalesce(target_region, '') AS target_region) FROM transfer_requests)"
_RULES = f"""{_CLOSED}, rules(rule_id, law, section, applies_to, blocked, allowed, needs_consent, needs_signatures, min_signatures, auto_fix) AS (VALUES
{_RULE_ROWS})"""
_EVALUATED = _RULES + """,
listed AS (SELECT q.*, u.law AS asked_law, u.pos AS law_position FROM asked q,
  (SELECT seq AS s, unnest(NAMES(laws_text)) AS law, generate_subscripts(NAMES(laws_text), 1) - 1 AS pos FROM transfer_requests) u WHERE u.s = q.seq),
evaluated AS (SELECT listed.*, rule_id, law, section, auto_fix,
  CASE WHEN blocked = 'non-IN' AND NOT starts_with(target_region, 'IN') THEN 'blocked_region'
       WHEN allowed <> '' AND NOT list_contains(NAMES(allowed), target_region) THEN 'not_allowed_region'
       WHEN needs_consent AND NOT has_consent THEN 'consent'
       WHEN needs_signatures AND signature_count < min_signatures THEN 'signatures' END AS failed_test
  FROM listed JOIN rules ON law = asked_law AND (applies_to = '' OR list_contains(NAMES(applies_to), classification)))"""
_DECIDED = _EVALUATED + """,
summed AS (SELECT seq, count(*) AS n, count(failed_test) AS broken,
  count(*) FILTER (WHERE failed_test IS NOT NULL AND (auto_fix = '' OR failed_test = 'signatures')) AS open,
  string_agg(concat(rule_id, ' (', section, ')'), ', ' ORDER BY law_position, rule_id)
    FILTER (WHERE failed_test IS NOT NULL AND (auto_fix = '' OR failed_test = 'signatures')) AS causes,
  string_agg(auto_fix, ',' ORDER BY law_position, rule_id) FILTER (WHERE failed_test IS NOT NULL AND auto_fix <> '' AND failed_test <> 'signatures') AS fixes,
  string_agg(concat('V-', rule_id, '-', left(tx_id, 8)), ',' ORDER BY law_position, rule_id) FILTER (WHERE failed_test IS NOT NULL) AS violations
  FROM evaluated GROUP BY seq),
decided AS (SELECT q.*, concat('DEC-', left(tx_id, 12)) AS decision_id,
  CASE WHEN coalesce(open, 0) > 0 THEN 'BLOCKED' WHEN coalesce(broken, 0) > 0 THEN 'ALLOWED_WITH_FIX' ELSE 'ALLOWED' END AS decision,
  CASE WHEN coalesce(open, 0) > 0 THEN concat('BLOCKED by: ', causes) WHEN coalesce(broken, 0) > 0
    THEN concat('Allowed after ', broken - open, ' auto-fixes applied') ELSE 'All compliance rules satisfied' END AS reason,
  coalesce(n, 0) AS rules_evaluated, coalesce(n - open, 0) AS rules_passed, coalesce(violations, '') AS violations, coalesce(fixes, '') AS auto_fixes
  FROM asked q LEFT JOIN summed USING (seq))"""


def decisions(t: Tables):
    return C.decide(t("transfer_requests"))


@query("j1_applicable_rules", f"WITH {_EVALUATED} SELECT request_id, law_position, rule_id FROM evaluated")
def j1(t):
    return C.applicable_rules(t("transfer_requests"), R.rule_catalogue(t.spark)).select("request_id", big("law_position").alias("law_position"), "rule_id")


@query("c1_evaluate_rules", f"""WITH {_EVALUATED} SELECT request_id, law_position, rule_id, coalesce(failed_test, '') AS failed_test, failed_test IS NULL AS passed,
  CASE WHEN failed_test IS NULL OR failed_test = 'signatures' THEN '' ELSE auto_fix END AS fix FROM evaluated""")
def c1(t):
    out = C.evaluate_rules(C.applicable_rules(t("transfer_requests"), R.rule_catalogue(t.spark)))
    return out.select("request_id", big("law_position").alias("law_position"), "rule_id", F.coalesce("failed_test", F.lit("")).alias("failed_test"), "passed", "fix")


@query("c2_rule_catalogue_use", f"""WITH {_EVALUATED}
SELECT r.rule_id, r.law, r.section AS law_section, r.auto_fix, count(e.seq) AS evaluated, count(e.failed_test) AS violated
FROM rules r LEFT JOIN evaluated e ON e.rule_id = r.rule_id GROUP BY ALL""")
def c2(t):
    rules = R.rule_catalogue(t.spark)
    used = C.evaluate_rules(C.applicable_rules(t("transfer_requests"), rules)).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("evaluated"), F.count("failed_test").alias("violated"))
    return rules.join(used, "rule_id", "left").select(
        "rule_id", "law", "law_section", "auto_fix", F.coalesce("evaluated", F.lit(0)).alias("evaluated"),
        F.coalesce("violated", F.lit(0)).alias("violated"))


@query("a8_decide", f"WITH {_DECIDED} SELECT request_id, decision_id, decision, reason, rules_evaluated, rules_passed, violations, auto_fixes FROM decided")
def a8(t):
    return decisions(t).select(
        "request_id", "decision_id", "decision", "reason", big("rules_evaluated").alias("rules_evaluated"),
        big("rules_passed").alias("rules_passed"), joined(F.transform("violations", lambda v: v["violation_id"])).alias("violations"),
        joined("auto_fixes").alias("auto_fixes"))


#: One more rule as a table may store it: lists missing, so it applies to all and no region.
_OPEN_RULE = ("OTHER-001", "OTHER", "Sec 1", "Signed twice", None, None, None, None, True, 2, None, "none", True, None)
_DECIDED_STORED = _DECIDED.replace(_RULE_ROWS, _RULE_ROWS + ",\n('OTHER-001', 'OTHER', 'Sec 1', '', '', '', false, true, 2, '')")


@query("a8_decide_joined", f"WITH {_DECIDED_STORED} SELECT request_id, decision, reason, rules_evaluated, rules_passed, violations, auto_fixes FROM decided")
def a8_joined(t):
    stored = R.rule_catalogue(t.spark, [*R.RULES, _OPEN_RULE])
    return C.decide_joined(t("transfer_requests"), stored).select(
        "request_id", "decision", "reason", big("rules_evaluated").alias("rules_evaluated"),
        big("rules_passed").alias("rules_passed"), joined(F.transform("violations", lambda v: v["violation_id"])).alias("violations"),
        joined("auto_fixes").alias("auto_fixes"))


@query("a9_compliance_report", f"""WITH {_DECIDED}
SELECT dataset_id, count(*) AS total, count(*) FILTER (WHERE decision = 'ALLOWED') AS allowed, count(*) FILTER (WHERE decision = 'BLOCKED') AS blocked,
  count(*) FILTER (WHERE decision = 'ALLOWED_WITH_FIX') AS auto_fixed,
  count(*) FILTER (WHERE decision <> 'BLOCKED') / CAST(count(*) AS DOUBLE) * 100 AS compliance_rate,
  sha256(concat(dataset_id, '|', count(*), '|', min(tx_id), '|', max(tx_id))) AS proof FROM decided GROUP BY dataset_id""")
def a9(t):
    return C.compliance_report(decisions(t))


@query("g8_last_decisions", f"""WITH {_DECIDED} SELECT dataset_id, position, request_id, decision FROM (SELECT dataset_id, request_id, decision,
  row_number() OVER (PARTITION BY dataset_id ORDER BY tx_id DESC) AS position FROM decided) WHERE position <= 10""")
def g8(t):
    return C.recent_decisions(decisions(t)).select("dataset_id", big("position").alias("position"), "request_id", "decision")


@query("g1_decisions_for_dataset", f"WITH {_DECIDED} SELECT request_id, decision, tx_id FROM decided WHERE dataset_id = 'ds-7'")
def g1c(t):
    return decisions(t).filter("dataset_id = 'ds-7'").orderBy("tx_id").select("request_id", "decision", "tx_id")


_IN_SET = "('IN', 'IN-TG', 'IN-MH', 'IN-DL', 'IN-KA', 'IN-AP', 'IN-TN')"
_ADEQUATE = "(starts_with(target_region, 'EU-') OR target_region IN ('UK','CH','NO','JP','CA','NZ','AR','IL','UY','KR'))"


@query("c3_profile_simulation", f"""
WITH {_CLOSED}, b AS (SELECT *, contains(laws_text, 'DPDP_2023') AND classification <> 'PUBLIC' AS d, contains(laws_text, 'GDPR') AND classification IN ('PII', 'HEALTH') AS g,
  contains(laws_text, 'HIPAA') AND classification = 'HEALTH' AS h FROM asked),
v AS (SELECT *, d AND target_region NOT IN {_IN_SET} AND NOT has_consent AS v1, d AND target_region <> source_region AND signature_count < 3 AS v4,
  g AND NOT {_ADEQUATE} AS vg FROM b)
SELECT request_id, CASE WHEN v1 OR v4 OR vg THEN 'BLOCKED' ELSE 'ALLOWED' END AS decision,
  CASE WHEN v1 OR v4 OR vg THEN concat('BLOCKED by: ', concat_ws(', ', CASE WHEN v1 THEN 'DPDP-001' END, CASE WHEN v4 THEN 'DPDP-004' END, CASE WHEN vg THEN 'GDPR-001' END))
    ELSE 'All compliance rules satisfied' END AS reason,
  CAST(d AS BIGINT) + CAST(v4 AS BIGINT) + CAST(g AS BIGINT) + CAST(h AS BIGINT) AS rules_evaluated,
  CAST(d AND NOT v1 AS BIGINT) + CAST(g AND NOT vg AS BIGINT) + CAST(h AS BIGINT) AS rules_passed,
  CASE WHEN d AND target_region NOT IN {_IN_SET} AND has_consent THEN 'request_consent_workflow' ELSE '' END AS auto_fixes FROM v""")
def c3(t):
    return C.decide_simulation(t("transfer_requests")).select(
        "request_id", "decision", "reason", big("rules_evaluated").alias("rules_evaluated"), big("rules_passed").alias("rules_passed"),
        joined("auto_fixes").alias("auto_fixes"))


_C3_TEXTS = ", ".join(f"('{rule}', '{law}', '{section}', '{text}', '{penalty}')" for rule, (law, section, text, penalty) in C.SIM_VIOLATIONS.items())
_C4_TEXTS = ", ".join(f"('{rule}', '{law}', '{section}', '{text}', '{penalty}')" for rule, (law, section, text, penalty) in C.FALLBACK_VIOLATIONS.items())


def _records(made):
    return made.select("request_id", F.inline("violations"))


@query("c3_violation_records", f"""
WITH {_CLOSED}, wording(rule_id, law, law_section, description, penalty) AS (VALUES {_C3_TEXTS}),
b AS (SELECT *, contains(laws_text, 'DPDP_2023') AND classification <> 'PUBLIC' AS d, contains(laws_text, 'GDPR') AND classification IN ('PII', 'HEALTH') AS g FROM asked),
v AS (SELECT request_id, 'DPDP-001' AS rule_id FROM b WHERE d AND target_region NOT IN {_IN_SET} AND NOT has_consent
  UNION ALL SELECT request_id, 'DPDP-004' FROM b WHERE d AND target_region <> source_region AND signature_count < 3 UNION ALL SELECT request_id, 'GDPR-001' FROM b WHERE g AND NOT {_ADEQUATE})
SELECT request_id, concat('SIM-', rule_id, '-', request_id) AS violation_id, rule_id, law, law_section, description, penalty, false AS auto_fixed FROM v JOIN wording USING (rule_id)""")
def c3b(t):
    return _records(C.decide_simulation(t("transfer_requests")))


@query("c4_violation_records", f"""
WITH {_CLOSED}, wording(rule_id, law, law_section, description, penalty) AS (VALUES {_C4_TEXTS}),
v AS (SELECT request_id, 'DPDP-001' AS rule_id FROM asked WHERE contains(laws_text, 'DPDP_2023') AND NOT starts_with(target_region, 'IN') AND NOT has_consent
  UNION ALL SELECT request_id, 'DPDP-002' FROM asked WHERE contains(laws_text, 'DPDP_2023') AND starts_with(target_region, 'IN') AND NOT (has_consent OR signature_count >= 3)
  UNION ALL SELECT request_id, 'GDPR-001' FROM asked WHERE contains(laws_text, 'GDPR')
    AND target_region NOT IN ('DE','FR','IT','ES','NL','BE','SE','AT','DK','FI','PL','PT','IE','GB','UK','CH','NO','IS','LI','JP','CA','NZ','AR','IL','UY','KR'))
SELECT request_id, concat('FALLBACK-', rule_id, '-', request_id) AS violation_id, rule_id, law, law_section, description, penalty, false AS auto_fixed FROM v JOIN wording USING (rule_id)""")
def c4b(t):
    return _records(C.decide_fallback(t("transfer_requests")))


@query("c4_profile_fallback", f"""
WITH {_CLOSED}, v AS (SELECT *, contains(laws_text, 'DPDP_2023') AS d, contains(laws_text, 'GDPR') AS g,
  contains(laws_text, 'DPDP_2023') AND NOT starts_with(target_region, 'IN') AND NOT has_consent AS v1,
  contains(laws_text, 'DPDP_2023') AND starts_with(target_region, 'IN') AND NOT (has_consent OR signature_count >= 3) AS v2,
  contains(laws_text, 'GDPR') AND target_region NOT IN ('DE','FR','IT','ES','NL','BE','SE','AT','DK','FI','PL','PT','IE','GB','UK','CH','NO','IS','LI','JP','CA','NZ','AR','IL','UY','KR') AS vg
  FROM asked)
SELECT request_id, CASE WHEN v1 OR v2 OR vg THEN 'BLOCKED' ELSE 'ALLOWED' END AS decision,
  CASE WHEN v1 OR v2 OR vg THEN concat_ws('; ', CASE WHEN v1 THEN 'DPDP-001: Indian personal data must not leave India without explicit consent' END,
    CASE WHEN v2 THEN 'DPDP-002: Within-India transfer requires consent or multisig approval' END,
    CASE WHEN vg THEN 'GDPR-001: EU PII cannot be transferred to a non-adequate country' END) ELSE 'ALL COMPLIANCE CHECKS PASSED' END AS reason,
  greatest(CAST(d AS BIGINT) + CAST(g AS BIGINT), 1) AS rules_evaluated,
  greatest(CAST(d AS BIGINT) + CAST(g AS BIGINT), 1) - CAST(v1 AS BIGINT) - CAST(v2 AS BIGINT) - CAST(vg AS BIGINT) AS rules_passed FROM v""")
def c4(t):
    return C.decide_fallback(t("transfer_requests")).select(
        "request_id", "decision", "reason", big("rules_evaluated").alias("rules_evaluated"), big("rules_passed").alias("rules_passed"))


def expression_checks(t: Tables):
    codes = {"DPDP_2023": "IN_DPDP_2023", "GDPR": "EU_GDPR_2018", "HIPAA": "US_HIPAA_1996", "SOX": "US_SOX_2002"}

    def full(law):
        chain = F
        for short, code in codes.items():
            chain = chain.when(law == short, F.lit(code))
        return chain.otherwise(F.lit("GLOBAL_OPEN"))

    return C.decide_expressions(t("transfer_requests").withColumn("laws", F.transform("jurisdictions", full)))


_EXPRESSIONS = f"""
{_CLOSED}, facts AS (SELECT *, target_region = 'IN' OR has_consent AS h1, coalesce(fabric_tx_id, '') <> '' AS h3,
  target_region IN ('DE','FR','IT','ES','NL','BE','SE','AT','DK','FI','PL','PT','GR','CZ','RO','HU','SK','BG','HR','LT','LV','EE','SI','MT','CY','LU','IE','UK','CH','NO','IS','LI','JP','CA','NZ','AR','IL','UY','KR','GB') AS h4,
  coalesce(is_erasable, false) AS h5, coalesce(field_count, 0) <= coalesce(justified_field_count, 0) AS h6,
  coalesce(encrypted_at_rest, true) AND coalesce(encrypted_in_transit, true) AS h7, coalesce(clearance_level, 999) >= coalesce(required_clearance, 0) AS h8 FROM asked),
laws AS (SELECT seq AS s, unnest(NAMES(laws_text)) AS law, generate_subscripts(NAMES(laws_text), 1) AS pos FROM transfer_requests),
broken AS (SELECT seq, pos, r.* FROM facts JOIN laws ON seq = s, LATERAL (SELECT * FROM (VALUES
    ('DPDP-001', law = 'DPDP_2023' AND NOT h1, 'Personal data of Indian citizens must not leave India without explicit consent', 'request_consent() if can_request else block_transfer()'),
    ('DPDP-003', law = 'DPDP_2023' AND NOT h3, 'Data fiduciary must maintain processing records', 'log_to_fabric() and retry()'),
    ('GDPR-001', law = 'GDPR' AND NOT h4, 'Data of EU residents cannot leave EU without adequacy decision', NULL),
    ('GDPR-002', law = 'GDPR' AND NOT h5, 'Right to erasure — data must be deletable on request', 'mark_for_erasure_review()'),
    ('GDPR-003', law = 'GDPR' AND NOT h6, 'Data minimisation — only necessary data collected', 'drop_unjustified_columns()'),
    ('HIPAA-001', law = 'HIPAA' AND NOT h7, 'PHI must be encrypted in transit and at rest', 'encrypt_now() and retry_access()'),
    ('HIPAA-002', law = 'HIPAA' AND NOT h8, 'PHI access requires minimum necessary standard', NULL)) AS x(rule_id, hit, description, remedy) WHERE hit) r),
per AS (SELECT seq, count(*) AS n, count(remedy) AS fixed, string_agg(rule_id, ',' ORDER BY pos, rule_id) AS ids,
  string_agg(CASE WHEN remedy IS NULL THEN concat(rule_id, ': ', description) ELSE concat(rule_id, ': ', description, ' |   AUTO-FIXED: ', remedy) END, ' | ' ORDER BY pos, rule_id) AS reason
  FROM broken GROUP BY seq)"""


@query("c5_profile_expressions", f"""WITH {_EXPRESSIONS.strip()}
SELECT request_id, coalesce(ids, '') AS violated_rules, coalesce(reason, 'ALL COMPLIANCE CHECKS PASSED') AS reason,
  CASE WHEN n IS NULL OR (allow_auto_fix AND n = fixed) THEN 'ALLOWED' ELSE 'BLOCKED' END AS decision FROM transfer_requests LEFT JOIN per USING (seq)""")
def c5(t):
    return expression_checks(t).select("request_id", joined("violated_rules").alias("violated_rules"), "reason", "decision")


@query("a10_violation_report", f"""WITH {_EXPRESSIONS.strip()}
SELECT dataset_id, count(*) AS total_checks, CAST(coalesce(sum(n), 0) AS BIGINT) AS violations, CAST(coalesce(sum(fixed), 0) AS BIGINT) AS auto_fixes,
  printf('%.1f%%', (1 - coalesce(sum(n), 0) / CAST(greatest(count(*), 1) AS DOUBLE)) * 100) AS compliance_rate
FROM transfer_requests LEFT JOIN per USING (seq) GROUP BY dataset_id""")
def a10(t):
    return C.violation_report(expression_checks(t))


@query("g8_last_checks", """SELECT dataset_id, position, request_id FROM (SELECT dataset_id, request_id,
  row_number() OVER (PARTITION BY dataset_id ORDER BY ts DESC, request_id DESC) AS position FROM transfer_requests) WHERE position <= 5""")
def g8b(t):
    return C.recent_checks(expression_checks(t)).select("dataset_id", big("position").alias("position"), "request_id")


_FRAMEWORKS = _DECIDED + """,
per_law AS (SELECT law, count(*) AS violations, count(*) FILTER (WHERE auto_fix <> '' AND failed_test <> 'signatures') AS auto_fixes FROM evaluated WHERE failed_test IS NOT NULL GROUP BY law),
summary AS (SELECT r.law, r.n AS rules, coalesce(violations, 0) AS violations, coalesce(auto_fixes, 0) AS auto_fixes,
  CASE WHEN coalesce(violations, 0) > 0 THEN 'active' ELSE 'monitoring' END AS status
  FROM (SELECT law, count(*) AS n FROM rules GROUP BY law) r LEFT JOIN per_law USING (law))"""


@query("a17_framework_summary", f"WITH {_FRAMEWORKS} SELECT * FROM summary")
def a17(t):
    return C.framework_summary(R.rule_catalogue(t.spark), decisions(t))


@query("a18_framework_totals", f"""WITH {_FRAMEWORKS} SELECT count(*) AS framework_count, CAST(sum(rules) AS BIGINT) AS total_rules,
  CAST(sum(violations) AS BIGINT) AS total_violations, CAST(sum(auto_fixes) AS BIGINT) AS total_auto_fixes,
  CASE WHEN sum(violations) = 0 THEN 'passed' ELSE 'review_required' END AS status FROM summary""")
def a18(t):
    return C.framework_totals(a17(t))


@query("a18_framework_checks", f"""WITH {_FRAMEWORKS} SELECT concat('TX_', left(sha256(concat(law, '|', '2024-01-20 12:00:00')), 12)) AS tx, 'COMPLIANCE_CHECK' AS action,
  concat(lower(law), '_policy_scan') AS dataset, CASE WHEN violations = 0 THEN 'PASSED' ELSE 'REVIEW_REQUIRED' END AS result, law, 'GLOBAL' AS region FROM summary""")
def a18b(t):
    return C.framework_checks(a17(t), EVENTS_AS_OF).select("tx", "action", "dataset", "result", "law", "region")


_POLICY = """FROM dataset_uses u LEFT JOIN datasets d USING (dataset_id)"""


@query("c6_can_cross_border", f"""
SELECT u.seq, NOT list_contains(NAMES(coalesce(blocked_text, '')), target_region) AND list_contains(NAMES(coalesce(allowed_text, '')), target_region) AS allowed,
  CASE WHEN list_contains(NAMES(coalesce(blocked_text, '')), target_region) THEN concat('BLOCKED: ', target_region, ' is explicitly blocked by border policy')
    WHEN NOT list_contains(NAMES(coalesce(allowed_text, '')), target_region) THEN
      CASE WHEN starts_with(laws_text, 'IN_') AND NOT starts_with(target_region, 'IN') THEN 'BLOCKED: DPDP 2023 — data cannot leave India without explicit approval'
           WHEN starts_with(laws_text, 'EU_') AND target_region NOT IN ('DE','FR','IT','ES','PL','NL','BE','SE','AT','DK') THEN 'BLOCKED: GDPR — data cannot leave EU without adequacy decision'
           WHEN contains(laws_text, ',IN_') AND NOT starts_with(target_region, 'IN') THEN 'BLOCKED: DPDP 2023 — data cannot leave India without explicit approval'
           ELSE concat('BLOCKED: ', target_region, ' not in allowed regions') END
    WHEN requires_multisig THEN concat('ALLOWED: ', target_region, ' — requires ', multisig_count, ' signatures')
    ELSE concat('ALLOWED: ', target_region, ' — compliant with all jurisdictions') END AS note {_POLICY}""")
def c6(t):
    joined_uses = t("dataset_uses").join(t("datasets").drop("seq"), "dataset_id", "left")
    return dna.can_cross_border(joined_uses).select("seq", "allowed", "note")


_ACCESS = f"""SELECT u.seq, u.dataset_id, coalesce(owner_id = user_id, false) OR (coalesce(contains(purpose, consent_purpose), false) AND NOT coalesce(u.ts > consent_expires, false)) AS allowed,
  CASE WHEN owner_id = user_id THEN 'ALLOWED: owner access'
    WHEN NOT coalesce(contains(purpose, consent_purpose), false) THEN concat('BLOCKED: purpose ''', purpose, ''' does not match consent ''', coalesce(consent_purpose, ''), '''')
    WHEN u.ts > consent_expires THEN 'BLOCKED: consent has expired' ELSE 'ALLOWED: valid consent' END AS note {_POLICY}"""


@query("c7_can_access", f"SELECT seq, allowed, note FROM ({_ACCESS})")
def c7(t):
    joined_uses = t("dataset_uses").join(t("datasets").drop("seq"), "dataset_id", "left")
    return dna.can_access(joined_uses, F.col("ts")).select("seq", "allowed", "note")


@query("c13_consent_violations", f"SELECT seq, dataset_id, note FROM ({_ACCESS}) WHERE NOT allowed")
def c13(t):
    return dna.consent_violations(t("datasets").drop("seq"), t("dataset_uses")).select("seq", "dataset_id", "note")


@query("c8_dna_from_ingest", """
SELECT concat('ds-', left(sha256(concat(dataset_name, '|', sha256(payload))), 12)) AS dataset_id, concat('manual-ingest-', left(sha256(payload), 6)) AS pipeline_id,
  concat(classification, ',v3') AS tags, contains(laws_text, 'IN_DPDP_2023') AS requires_multisig, RFC3339(ts) AS granted_at,
  concat('Qm', left(sha256(sha256(payload)), 44)) AS cid FROM payloads""")
def c8(t):
    scored = t("payloads").withColumn("sigma", F.lit(5.0))
    return dna.dna_from_ingest(scored).select(
        "dataset_id", "pipeline_id", joined("tags").alias("tags"), F.col("border_policy.requires_multisig").alias("requires_multisig"),
        F.col("consent.granted_at").alias("granted_at"), F.col("ipfs_cid").alias("cid"))


# ---- lineage ----------------------------------------------------------------------------

_HASH = """sha256(concat_ws('|', tx_id, job_id, timestamp, inputs_text, hashes_text, output_dataset_id, output_hash, transformation_type, pipeline_id,
  pipeline_version, CAST(CAST(sigma_level AS DECIMAL(12,4)) AS VARCHAR), classification, laws_text, owner_org, operator_msp, node_id, region, ipfs_cid))"""


@query("x8_lineage_hash", f"SELECT tx_id, {_HASH} AS recomputed, {_HASH} IS NOT DISTINCT FROM genome_hash AS intact FROM lineage")
def x8(t):
    return t("lineage").select("tx_id", H.lineage_hash().alias("recomputed"), H.lineage_hash().eqNullSafe(F.col("genome_hash")).alias("intact"))


@query("g1_lineage_chains", """SELECT output_dataset_id, tx_id, row_number() OVER (PARTITION BY output_dataset_id ORDER BY ts DESC, tx_id DESC) AS position FROM lineage""")
def g1(t):
    chains = L.lineage_chains(t("lineage").select("output_dataset_id", "tx_id", "ts"))
    return chains.select("output_dataset_id", "tx_id", big("position").alias("position"))


@query("g1_lineage_chain_of_dataset", "SELECT tx_id, timestamp, pipeline_id FROM lineage WHERE output_dataset_id = 'ds-0'")
def g1b(t):
    return L.lineage_chain(t("lineage"), "ds-0").select("tx_id", "timestamp", "pipeline_id")


@query("p13_latest_metadata", """SELECT output_dataset_id, tx_id, timestamp, sigma_level, operator_msp FROM lineage
QUALIFY row_number() OVER (PARTITION BY output_dataset_id ORDER BY ts DESC, tx_id DESC) = 1""")
def p13(t):
    return L.latest_metadata(t("lineage")).select("output_dataset_id", "tx_id", "timestamp", "sigma_level", "operator_msp")


@query("p15_period", "SELECT tx_id FROM lineage WHERE timestamp BETWEEN '1996-01-01T00:00:00Z' AND '1997-06-30T23:59:59Z'")
def p15(t):
    return L.period(t("lineage"), "1996-01-01T00:00:00Z", "1997-06-30T23:59:59Z").select("tx_id")


_VERDICT = f"""checked AS (SELECT *, {_HASH} IS DISTINCT FROM genome_hash AS bad FROM lineage),
verdict AS (SELECT output_dataset_id AS dataset_id, count(*) AS records, count(*) FILTER (WHERE bad) AS tampered,
  arg_max(tx_id, concat(timestamp, tx_id)) FILTER (WHERE bad) AS first_bad, arg_max(output_hash, concat(timestamp, tx_id)) AS latest_hash FROM checked GROUP BY 1)"""


@query("g12_verify_integrity", f"""WITH {_VERDICT} SELECT dataset_id, records, tampered = 0 AS verified,
  CASE WHEN tampered > 0 THEN concat('TAMPERING: tx ', left(first_bad, 12), ' hash mismatch') ELSE concat('verified ', records, ' records on-chain') END AS message FROM verdict""")
def g12(t):
    return L.verify_integrity(t("lineage"))


@query("j10_expected_hash_check", f"""WITH {_VERDICT},
expected AS (SELECT concat('ds-', CAST(c_custkey * 5 AS VARCHAR)) AS dataset_id, CASE WHEN c_custkey % 3 = 0 THEN sha256(concat('out-', CAST(c_custkey AS VARCHAR))) ELSE '' END AS expected_hash FROM customer)
SELECT dataset_id, coalesce(records, 0) AS records, coalesce(records > 0 AND tampered = 0 AND (coalesce(expected_hash, '') = '' OR expected_hash = latest_hash), false) AS verified,
  CASE WHEN records IS NULL THEN concat('no lineage found for ', dataset_id) WHEN tampered > 0 THEN concat('TAMPERING: tx ', left(first_bad, 12), ' hash mismatch')
    WHEN coalesce(expected_hash, '') <> '' AND expected_hash <> latest_hash THEN 'output hash mismatch in latest tx'
    ELSE concat('verified ', records, ' records on-chain') END AS message FROM verdict FULL JOIN expected USING (dataset_id)""")
def j10(t):
    key = F.col("c_custkey")
    expected = t("customer").select(
        F.concat(F.lit("ds-"), (key * 5).cast("string")).alias("dataset_id"),
        F.when(key % 3 == 0, H.sha256(F.concat(F.lit("out-"), key.cast("string")))).otherwise("").alias("expected_hash"))
    return L.verify_integrity(t("lineage"), expected)


@query("j4_lineage_of_flow", """WITH i AS (SELECT output_dataset_id AS d, count(*) AS copies FROM lineage WHERE pipeline_id = 'pl-003' GROUP BY 1)
SELECT tx_id, output_dataset_id, copies FROM lineage JOIN i ON d = output_dataset_id""")
def j4(t):
    return L.lineage_of_flow(t("lineage"), "pl-003").select("tx_id", "output_dataset_id", "copies")


_EDGES = "edges AS (SELECT DISTINCT output_dataset_id AS child, unnest(NAMES(inputs_text)) AS parent FROM lineage WHERE inputs_text <> '')"


def flow_datasets(lineage):
    """What one flow wrote; asking for every dataset would give roots times reachable vertices."""
    return lineage.filter("pipeline_id = 'pl-003'").select(F.col("output_dataset_id").alias("root")).distinct()


@query("g13_lineage_graph", f"""WITH RECURSIVE {_EDGES},
walk(root, dataset_id, depth) AS (SELECT DISTINCT output_dataset_id, output_dataset_id, 0 FROM lineage WHERE pipeline_id = 'pl-003'
  UNION SELECT root, parent, depth + 1 FROM walk JOIN edges ON child = dataset_id WHERE depth + 1 < 10),
n AS (SELECT output_dataset_id AS dataset_id, count(*) AS records FROM lineage GROUP BY 1)
SELECT root, dataset_id, min(depth) AS depth, coalesce(any_value(records), 0) AS records FROM walk LEFT JOIN n USING (dataset_id) GROUP BY root, dataset_id""")
def g13(t):
    lineage = t("lineage")
    return L.lineage_graph(lineage, flow_datasets(lineage)).select("root", "dataset_id", "depth", big("records").alias("records"))


@query("g14_impact", f"""WITH RECURSIVE {_EDGES},
walk(root, dataset_id, depth) AS (SELECT DISTINCT output_dataset_id, output_dataset_id, 0 FROM lineage WHERE pipeline_id = 'pl-003'
  UNION SELECT root, child, depth + 1 FROM walk JOIN edges ON parent = dataset_id WHERE depth + 1 < 10)
SELECT root, count(DISTINCT dataset_id) - 1 AS affected FROM walk GROUP BY root""")
def g14(t):
    lineage = t("lineage")
    return L.impact(lineage, flow_datasets(lineage)).groupBy("root").agg((F.count(F.lit(1)) - 1).alias("affected"))


@query("a11_lineage_audit_report", f"""WITH c AS (SELECT *, {_HASH} IS NOT DISTINCT FROM genome_hash AS ok FROM lineage),
j AS (SELECT output_dataset_id AS d, string_agg(DISTINCT law, ',' ORDER BY law) AS jurisdictions FROM (SELECT output_dataset_id, unnest(NAMES(laws_text)) AS law FROM lineage) GROUP BY 1)
SELECT output_dataset_id AS dataset_id, count(*) AS total_records, bool_and(ok) AS integrity_ok,
  CAST(sum(CAST(sigma_level AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_sigma, any_value(jurisdictions) AS jurisdictions,
  sha256(concat(output_dataset_id, '|', arg_max(tx_id, concat(timestamp, tx_id)), '|', arg_min(tx_id, concat(timestamp, tx_id)), '|', count(*))) AS proof
FROM c JOIN j ON d = output_dataset_id GROUP BY output_dataset_id""")
def a11(t):
    report = L.audit_report(t("lineage")).drop("newest_tx", "oldest_tx")
    return report.withColumn("jurisdictions", joined("jurisdictions"))


@query("a12_combined_audit_report", f"""WITH {_VERDICT}, k AS (SELECT dataset_id, count(*) AS n FROM transfer_requests GROUP BY 1)
SELECT dataset_id, coalesce(records, 0) AS lineage_records, coalesce(n, 0) AS compliance_checks, coalesce(tampered = 0, false) AS integrity_verified,
  CASE WHEN records IS NULL THEN concat('no lineage found for ', dataset_id) WHEN tampered > 0 THEN concat('TAMPERING: tx ', left(first_bad, 12), ' hash mismatch')
    ELSE concat('verified ', records, ' records on-chain') END AS integrity_message,
  sha256(concat(dataset_id, '|', coalesce(records, 0), '|', coalesce(n, 0))) AS proof FROM verdict FULL JOIN k USING (dataset_id)""")
def a12(t):
    return L.combined_audit_report(t("lineage"), t("transfer_requests"))


@query("g8_newest_lineage", """SELECT output_dataset_id, position, tx_id FROM (SELECT output_dataset_id, tx_id,
  row_number() OVER (PARTITION BY output_dataset_id ORDER BY ts DESC, tx_id DESC) AS position FROM lineage) WHERE position <= 10""")
def g8c(t):
    return L.newest_lineage(t("lineage")).select("output_dataset_id", big("position").alias("position"), "tx_id")


# ---- service levels ---------------------------------------------------------------------

_BREACHES = """breaches AS (SELECT concat('SLA-BREACH-', pipeline_id, '-', left(tx_id, 8)) AS alert_id, pipeline_id, ts, min_sigma AS expected_min, sigma_level AS actual_sigma,
  CASE WHEN min_sigma - sigma_level >= 1.5 THEN 'CRITICAL' WHEN min_sigma - sigma_level >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  concat('Platform,', customer_org) AS notified FROM measurements JOIN sla USING (pipeline_id) WHERE active AND sigma_level < breach_threshold)"""


@query("j2_sla_breaches", f"WITH {_BREACHES} SELECT * EXCLUDE (ts), RFC3339(ts) AS breached_at FROM breaches")
def j2(t):
    return SL.sla_breaches(t("measurements"), t("sla")).select(
        "alert_id", "pipeline_id", "expected_min", "actual_sigma", "severity", joined("notified_orgs").alias("notified"),
        H.rfc3339(F.col("breached_at")).alias("breached_at"))


@query("j3_with_sla", """SELECT run_id, coalesce(sigma_level >= min_sigma, true) AS met, coalesce(min_sigma, 5.0) AS sla_target, coalesce(customer_org, 'Unknown') AS customer_org
FROM measurements LEFT JOIN sla USING (pipeline_id)""")
def j3(t):
    return SL.with_sla(t("measurements"), t("sla")).select("run_id", "met", "sla_target", "customer_org")


@query("a13_quality_certificate", """
WITH m AS (SELECT m.*, coalesce(min_sigma, 5.0) AS target, coalesce(customer_org, 'Unknown') AS org, coalesce(sigma_level < min_sigma, false) AS breach
  FROM measurements m LEFT JOIN sla USING (pipeline_id) WHERE timestamp BETWEEN '2024-01-05T00:00:00Z' AND '2024-01-15T00:00:00Z')
SELECT pipeline_id, org AS customer_org, target AS sla_target, count(*) AS measurements, CAST(sum(CAST(sigma_level AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_sigma,
  min(sigma_level) AS min_sigma, max(sigma_level) AS max_sigma, CAST(sum(records_failed) AS BIGINT) AS total_defects, CAST(sum(records_processed) AS BIGINT) AS total_records,
  count(*) FILTER (WHERE breach) AS breaches, count(*) FILTER (WHERE breach) = 0 AS sla_met,
  sha256(concat(pipeline_id, '|2024-01-05T00:00:00Z|2024-01-15T00:00:00Z|', printf('%.2f', CAST(sum(CAST(sigma_level AS DECIMAL(18,4))) AS DOUBLE) / count(*)),
    '|', CAST(sum(records_processed) AS BIGINT), '|', CAST(sum(records_failed) AS BIGINT))) AS proof
FROM m GROUP BY pipeline_id, org, target""")
def a13(t):
    return SL.quality_certificate(t("measurements"), t("sla"), "2024-01-05T00:00:00Z", "2024-01-15T00:00:00Z")


@query("g2_sigma_trend", """SELECT pipeline_id, run_id, timestamp, sigma_level FROM measurements
QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY ts DESC, run_id DESC) <= 30""")
def g2(t):
    return SL.sigma_trend(t("measurements"), 0).select("pipeline_id", "run_id", H.rfc3339(F.col("ts")).alias("timestamp"), "sigma_level")


_MONITOR = """monitored AS (SELECT *, CASE WHEN sigma_level < 4.5 THEN 'ALERT' WHEN sigma_level < previous_sigma - 0.5 THEN 'WARNING' ELSE 'OK' END AS state
  FROM (SELECT *, lag(sigma_level, 1, 6.0) OVER (PARTITION BY pipeline_id ORDER BY ts, run_id) AS previous_sigma FROM measurements))"""


@query("g3_sigma_monitor", f"WITH {_MONITOR} SELECT run_id, pipeline_id, previous_sigma, state FROM monitored")
def g3(t):
    return SL.sigma_monitor(t("measurements")).select("run_id", "pipeline_id", "previous_sigma", "state")


@query("g1_measurements_for_flow", "SELECT run_id, timestamp, sigma_level FROM measurements WHERE pipeline_id = 'pl-007'")
def g1d(t):
    return t("measurements").filter("pipeline_id = 'pl-007'").orderBy(F.desc("ts"), F.desc("run_id")).select("run_id", "timestamp", "sigma_level")


@query("g9_latest_per_key", "SELECT pipeline_id, run_id, sigma_level FROM measurements QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY ts DESC, run_id DESC) = 1")
def g9(t):
    return latest_per_key(t("measurements"), ["pipeline_id"], ["ts", "run_id"]).select("pipeline_id", "run_id", "sigma_level")


@query("a27_flow_status", """
WITH m AS (SELECT *, ts > NTZ('2024-01-19 12:00:00') AS recent FROM measurements WHERE ts <= NTZ('2024-01-20 12:00:00')),
s AS (SELECT pipeline_id, arg_max(sigma_level, concat(CAST(ts AS VARCHAR), run_id)) AS current_sigma,
  CAST(sum(CAST(sigma_level AS DECIMAL(18,4))) FILTER (WHERE recent) AS DOUBLE) / nullif(count(*) FILTER (WHERE recent), 0) AS avg_sigma_24h, RFC3339(max(ts)) AS last_run,
  count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-20') AS runs_today, count(*) FILTER (WHERE records_failed = 0) / CAST(count(*) AS DOUBLE) * 100 AS heal_rate FROM m GROUP BY 1)
SELECT s.pipeline_id, current_sigma, coalesce(avg_sigma_24h, 0) AS avg_sigma_24h, last_run, runs_today, heal_rate, coalesce(target_sigma, 5.0) AS sla_target, current_sigma >= coalesce(target_sigma, 5.0) AS sla_met,
  CASE WHEN current_sigma >= coalesce(target_sigma, 5.0) THEN 'healthy' WHEN current_sigma >= 4.5 THEN 'warning' ELSE 'critical' END AS status
FROM s LEFT JOIN sla USING (pipeline_id)""")
def a27(t):
    out = SL.flow_status(t("measurements"), t("sla"), EVENTS_AS_OF)
    return out.withColumns({"last_run": H.rfc3339(F.col("last_run")), "avg_sigma_24h": F.coalesce("avg_sigma_24h", F.lit(0.0))})


@query("e3_compliance_run", f"""WITH {_DECIDED} SELECT dataset_id, decision, count(*) AS requests, min(decision_id) AS least_decision FROM decided GROUP BY ALL""")
def e3(t):
    from ledgerloom.plans.jobs import compliance_job

    _, made = compliance_job(t("transfer_requests"))
    return made.groupBy("dataset_id", "decision").agg(F.count(F.lit(1)).alias("requests"), F.min("decision_id").alias("least_decision"))


@query("e3_violations", f"""WITH {_EVALUATED} SELECT request_id, dataset_id, concat('DEC-', left(tx_id, 12)) AS decision_id, concat('V-', rule_id, '-', left(tx_id, 8)) AS violation_id, rule_id, law,
  section AS law_section, auto_fix <> '' AND failed_test <> 'signatures' AS auto_fixed FROM evaluated WHERE failed_test IS NOT NULL""")
def e3b(t):
    from ledgerloom.plans.jobs import compliance_job

    _, made = compliance_job(t("transfer_requests"))
    return made.select("request_id", "dataset_id", "decision_id", F.inline("violations")).drop("description", "penalty")


@query("e4_quality_outputs", f"""WITH {_BREACHES}, m AS (SELECT m.*, coalesce(min_sigma, 5.0) AS target, coalesce(customer_org, 'Unknown') AS org, coalesce(sigma_level < min_sigma, false) AS breach
  FROM measurements m LEFT JOIN sla USING (pipeline_id))
SELECT 'alert' AS kind, pipeline_id, alert_id AS item, concat(severity, ' ', RFC3339(ts), ' ', notified) AS detail FROM breaches
UNION ALL SELECT 'trend', pipeline_id, run_id, concat(timestamp, ' ', CAST(sigma_level AS DECIMAL(12,4))) FROM measurements QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY ts DESC, run_id DESC) <= 30
UNION ALL SELECT 'certificate', pipeline_id, org, concat(count(*), ' ', count(*) FILTER (WHERE breach), ' ', CAST(sum(records_failed) AS BIGINT), ' ', CAST(sum(records_processed) AS BIGINT)) FROM m
  WHERE timestamp BETWEEN '2024-01-05T00:00:00Z' AND '2024-01-15T00:00:00Z' GROUP BY pipeline_id, org""")
def e4b(t):
    from ledgerloom.plans.jobs import quality_job

    out = quality_job(t("measurements"), t("sla"), ("2024-01-05T00:00:00Z", "2024-01-15T00:00:00Z"))
    told = {
        "alert": out["alerts"].select("pipeline_id", F.col("alert_id").alias("item"), F.concat_ws(" ", "severity", H.rfc3339(F.col("breached_at")), joined("notified_orgs")).alias("detail")),
        "trend": out["trend"].select("pipeline_id", F.col("run_id").alias("item"), F.concat_ws(" ", H.rfc3339(F.col("ts")), F.col("sigma_level").cast("decimal(12,4)")).alias("detail")),
        "certificate": out["certificates"].select("pipeline_id", F.col("customer_org").alias("item"), F.concat_ws(" ", "measurements", "breaches", "total_defects", "total_records").alias("detail")),
    }
    parts = [df.select(F.lit(kind).alias("kind"), "pipeline_id", "item", "detail") for kind, df in told.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("e4_quality_run", f"""WITH {_BREACHES} SELECT m.pipeline_id, count(*) AS measurements, CAST(coalesce(any_value(b.alerts), 0) AS BIGINT) AS alerts,
  min(concat('M-', m.pipeline_id, '-', left(tx_id, 12))) AS least_id FROM measurements m LEFT JOIN (SELECT pipeline_id, count(*) AS alerts FROM breaches GROUP BY 1) b USING (pipeline_id) GROUP BY m.pipeline_id""")
def e4(t):
    from ledgerloom.plans.jobs import quality_job

    out = quality_job(t("measurements"), t("sla"))
    logged, alerts = out["measurements"], out["alerts"]
    per_flow = alerts.groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("alerts"))
    counted = logged.groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("measurements"), F.min("measurement_id").alias("least_id"))
    return counted.join(per_flow, "pipeline_id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


@query("u1_governance_timeline", f"""WITH {_DECIDED}, {_BREACHES},
line AS (SELECT ts, tx_id AS tx, transformation_type AS action, output_dataset_id AS dataset, 'OK' AS result FROM lineage
  UNION ALL SELECT ts, tx_id, 'BORDER', dataset_id, decision FROM decided UNION ALL SELECT ts, alert_id, 'SLA_BREACH', pipeline_id, severity FROM breaches
  UNION ALL SELECT ts, tx, action, dataset, result FROM audit_events)
SELECT RFC3339(ts) AS at, tx, action, dataset, result FROM line""")
def u1(t):
    line = audit.governance_timeline(t("lineage"), decisions(t), SL.sla_breaches(t("measurements"), t("sla")), t("audit_events"))
    return line.select(H.rfc3339(F.col("ts")).alias("at"), "tx", "action", "dataset", "result")
