"""Text functions over whole conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.base import query
from ledgerloom.functions import text as T
from ledgerloom.operators import registry as reg
from ledgerloom.plans import questions

_LANGUAGE = "CASE WHEN regexp_matches(text, '[\\x{0C00}-\\x{0C7F}]') THEN 'te' WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'hi' WHEN regexp_matches(text, '[\\x{0B80}-\\x{0BFF}]') THEN 'ta' ELSE 'en' END"


def _replaced(column: str, phrases) -> str:
    for native, english in phrases:
        column = f"replace({column}, '{native}', '{english}')"
    return column


_TRANSLATED = (
    f"CASE {_LANGUAGE} WHEN 'te' THEN {_replaced('text', T.PHRASES['te'])} "
    f"WHEN 'hi' THEN {_replaced('text', T.PHRASES['hi'])} ELSE text END"
)
_PLANNER = f"CASE {_LANGUAGE} WHEN 'en' THEN text ELSE {_replaced('text', T.PLANNER_PHRASES)} END"
_B, _E = "(^|[^\\p{L}\\p{N}_])", "([^\\p{L}\\p{N}_]|$)"


def _has(words: str, column: str = "q") -> str:
    return f"regexp_matches({column}, '{words}')"


def _word(words: str, column: str = "q") -> str:
    return f"regexp_matches({column}, '{_B}({words}){_E}')"


_INTENT = f"""CASE WHEN {_word('report|dashboard|show me|daily|weekly')} THEN 'REPORT'
  WHEN {_word('alert|notify')} OR regexp_matches(q, '{_B}when[^\\p{{L}}\\p{{N}}_\\n]([^\\n]*[^\\p{{L}}\\p{{N}}_\\n])?(drops?|exceeds?|above|below){_E}') THEN 'ALERT'
  WHEN {_word('quality|clean|validate|sigma')} THEN 'QUALITY'
  WHEN {_word('dpdp|gdpr|compliant|audit')} THEN 'COMPLIANCE' ELSE 'PIPELINE' END"""
_KEYWORDS = f"""CASE WHEN {_has('report|dashboard|show me|నివేదిక|रिपोर्ट')} THEN 'report' WHEN {_has('alert|notify|when|if|హెచ్చరిక|सूचित')} THEN 'alert'
  WHEN {_has('move|transfer|ingest|sync|తరలించు')} THEN 'pipeline' WHEN {_has('quality|clean|validate|నాణ్యత|गुणवत्ता')} THEN 'quality'
  WHEN {_has('compliant|dpdp|gdpr|audit|అనుగుణత')} THEN 'compliance' WHEN {_has('pattern|trend|analyse|insight|అంతర్దృష్టి')} THEN 'insight' ELSE 'pipeline' END"""
_HOUR = "TRY_CAST(regexp_extract(q, 'at ([0-9]{1,2})\\s*(am|pm)?', 1) AS INT)"
_HALF = "regexp_extract(q, 'at ([0-9]{1,2})\\s*(am|pm)?', 2)"
_SCHEDULE = f"""CASE WHEN {_HOUR} IS NOT NULL THEN concat('0 ', CASE WHEN {_HALF} = 'pm' AND {_HOUR} < 12 THEN {_HOUR} + 12
    WHEN {_HALF} = 'am' AND {_HOUR} = 12 THEN 0 ELSE {_HOUR} END, ' * * *')
  WHEN regexp_matches(q, 'every [0-9]+ minutes?') THEN concat('*/', CAST(regexp_extract(q, 'every ([0-9]+) minutes?', 1) AS HUGEINT), ' * * * *')
  WHEN {_word('day')} OR {_has('daily')} THEN '0 6 * * *' WHEN {_word('hour')} OR {_has('hourly')} THEN '0 * * * *'
  WHEN {_word('week')} OR {_has('weekly')} THEN '0 6 * * MON' WHEN {_word('month')} OR {_has('monthly')} THEN '0 6 1 * *'
  WHEN {_word('real[- ]?time')} OR {_has('streaming')} THEN '@continuous' ELSE '0 6 * * *' END"""
_SIMPLE = f"CASE WHEN {_has('6am|6 am|daily|every day')} THEN '0 6 * * *' WHEN {_has('hourly')} THEN '0 * * * *' ELSE '@continuous' END"
_ROUTE = f"""CASE WHEN {_has('risk|warning|failed|issue|problem')} THEN 'risk_pipeline_search' WHEN {_has('dpdp|india|privacy')} THEN 'dpdp_compliance_query'
  WHEN {_has('gdpr|eu')} THEN 'gdpr_compliance_query' WHEN {_has('audit|transaction|tx|fabric')} THEN 'audit_chain_query'
  WHEN {_has('best|sigma|quality|healthy')} THEN 'quality_score_query' WHEN {_has('run|executed')} THEN 'pipeline_run_query' ELSE 'general_dashboard_query' END"""
_CREATES = f"({_has('create|build|generate|make|add|setup|set up|configure')} AND {_has('pipeline|dataflow|data flow|stream|ingestion')})"
_SPEC = {
    "source": f"CASE WHEN {_has('kafka')} THEN 'kafka' WHEN {_has('postgres')} THEN 'postgres' WHEN {_has('s3')} THEN 's3' WHEN {_has('csv')} THEN 'csv' WHEN {_has('api')} THEN 'api' ELSE 'manual' END",
    "law": f"CASE WHEN {_has('gdpr|europe|eu ')} THEN 'GDPR' WHEN {_has('hipaa')} THEN 'HIPAA' WHEN {_has('sox')} THEN 'SOX' ELSE 'DPDP' END",
    "region": f"CASE WHEN {_has('mumbai|maharashtra')} THEN 'IN-MH' WHEN {_has('hyderabad|telangana')} THEN 'IN-TG' WHEN {_has('andhra|ap ')} THEN 'IN-AP' WHEN {_has('delhi')} THEN 'IN-DL' WHEN {_has('europe|germany|eu ')} THEN 'EU-DE' ELSE 'IN-TG' END",
    "target": f"CASE WHEN {_has('mumbai|maharashtra')} THEN 'fabric_node_mumbai' WHEN {_has('hyderabad|telangana')} THEN 'fabric_node_hyderabad' WHEN {_has('andhra|ap ')} THEN 'fabric_node_ap' WHEN {_has('delhi')} THEN 'fabric_node_delhi' WHEN {_has('europe|germany|eu ')} THEN 'fabric_node_frankfurt' ELSE 'fabric_node_hyderabad' END",
    "domain": f"CASE WHEN {_has('fraud')} THEN 'fraud' WHEN {_has('payment')} THEN 'payments' WHEN {_has('customer')} AND {_has('churn')} THEN 'customer_churn' WHEN {_has('customer')} THEN 'customer_profile' WHEN {_has('churn')} THEN 'customer_churn' WHEN {_has('iot|sensor')} THEN 'iot_sensors' WHEN {_has('health|patient')} THEN 'patient_records' WHEN {_has('billing')} THEN 'billing' WHEN {_has('telecom')} THEN 'telecom' ELSE 'custom' END",
}
_TEMPLATE = f"""CASE WHEN {_has('top|highest')} AND {_has('region')} AND {_has('last month')} THEN 'top_regions_last_month'
  WHEN {_has('top|highest')} AND {_has('region')} THEN 'top_regions_this_month' WHEN {_has('sigma|quality')} THEN 'flows_below_sigma'
  WHEN {_has('sales|revenue')} THEN 'daily_revenue' ELSE 'scan' END"""
_LOWERED = "(SELECT text_id, text, lower(text) AS q FROM texts)"
_LOWERED_EN = f"(SELECT text_id, lower({_TRANSLATED}) AS q FROM texts)"


@query("x21_detect_language", f"SELECT text_id, {_LANGUAGE} AS language FROM texts")
def x21(t):
    return t("texts").select("text_id", T.detect_language(F.col("text")).alias("language"))


@query("x22_translate_phrases", f"SELECT text_id, {_TRANSLATED} AS translated, {_PLANNER} AS planner FROM texts")
def x22(t):
    language = T.detect_language(F.col("text"))
    return t("texts").select(
        "text_id", T.translate_phrases(F.col("text"), language).alias("translated"),
        T.translate_for_planner(F.col("text"), language).alias("planner"),
    )


_API = (
    f"CASE {_LANGUAGE} WHEN 'te' THEN {_replaced('text', T.API_PHRASES['te'])} "
    f"WHEN 'hi' THEN {_replaced('text', T.API_PHRASES['hi'])} ELSE text END"
)


@query("x22_translate_short", f"SELECT text_id, {_API} AS translated FROM texts")
def x22b(t):
    """The short phrase list of the plain API."""
    language = T.detect_language(F.col("text"))
    return t("texts").select("text_id", T.translate_phrases(F.col("text"), language, T.API_PHRASES).alias("translated"))


@query("x23_safe_identifier", "SELECT text_id, regexp_replace(text, '[^a-z0-9_]', '', 'g') AS identifier FROM texts")
def x23(t):
    return t("texts").select("text_id", T.safe_identifier(F.col("text")).alias("identifier"))


@query("x24_classify_intent", f"SELECT text_id, {_INTENT} AS intent FROM {_LOWERED}")
def x24(t):
    return t("texts").select("text_id", T.classify_intent(F.col("text")).alias("intent"))


@query("x25_classify_intent_keywords", f"SELECT text_id, {_KEYWORDS} AS intent FROM {_LOWERED}")
def x25(t):
    return t("texts").select("text_id", T.classify_intent_keywords(F.col("text")).alias("intent"))


@query("x26_extract_schedule", f"SELECT text_id, {_SCHEDULE} AS schedule FROM {_LOWERED}")
def x26(t):
    return t("texts").select("text_id", T.extract_schedule(F.col("text")).alias("schedule"))


@query("x27_extract_schedule_simple", f"SELECT text_id, {_SIMPLE} AS schedule FROM {_LOWERED}")
def x27(t):
    return t("texts").select("text_id", T.extract_schedule_simple(F.col("text")).alias("schedule"))


@query("x28_route_question", f"SELECT text_id, {_ROUTE} AS route FROM {_LOWERED}")
def x28(t):
    return t("texts").select("text_id", T.route_question(F.col("text")).alias("route"))


@query("x29_is_create_request", f"SELECT text_id, {_CREATES} AS creates FROM {_LOWERED}")
def x29(t):
    return t("texts").select("text_id", T.is_create_request(F.col("text")).alias("creates"))


@query("x30_extract_flow_spec", "SELECT text_id, " + ", ".join(f"{sql} AS {name}" for name, sql in _SPEC.items()) + f" FROM {_LOWERED}")
def x30(t):
    spec = T.flow_spec(F.col("text"))
    return t("texts").select("text_id", *[column.alias(name) for name, column in spec.items()])


# The r-th request for a base takes the r-th number whose name is free, where number 1 is the bare base.
_NAMED = f"""
asked AS (SELECT text_id AS seq, text, {', '.join(f'{sql} AS {name}' for name, sql in _SPEC.items())} FROM {_LOWERED} WHERE {_CREATES}),
ranked AS (SELECT *, concat(domain, '_', source, '_pipeline') AS base,
  row_number() OVER (PARTITION BY concat(domain, '_', source, '_pipeline') ORDER BY seq) AS r FROM asked),
bases AS (SELECT base, count(*) AS wanted FROM ranked GROUP BY base),
taken AS (SELECT count(*) AS n FROM registry),
numbers AS (SELECT base, unnest(range(1, wanted + (SELECT n FROM taken) + 2)) AS k FROM bases),
free AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) AS r FROM numbers
  WHERE CASE WHEN k = 1 THEN base ELSE concat(base, '_', k) END NOT IN (SELECT name FROM registry)),
named AS (SELECT ranked.*, CASE WHEN k = 1 THEN base ELSE concat(base, '_', k) END AS name FROM ranked JOIN free USING (base, r)),
built AS (SELECT *, concat('pl-', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) AS id
  FROM (SELECT *, row_number() OVER (ORDER BY seq) + (SELECT n FROM taken) AS n FROM named))
"""


@query("x31_unique_name", f"WITH {_NAMED} SELECT seq, base, name FROM named")
def x31(t):
    asked = t("texts").filter(T.is_create_request(F.col("text")))
    spec = T.flow_spec(F.col("text"))
    based = asked.select(F.col("text_id").alias("seq"), F.concat_ws("_", spec["domain"], spec["source"], F.lit("pipeline")).alias("base"))
    return reg.unique_names(based, t("registry").select("name"), "base", "seq")


@query("q12_build_flows", f"""WITH {_NAMED} SELECT seq, id, name, 5.1 AS sigma, 'healthy' AS status, law, region,
  concat('TX_', left(sha256(concat(id, '|', name)), 12)) AS tx, source, target, domain FROM built""")
def q12(t):
    return reg.build_flows(t("texts"), t("registry")).select(
        "seq", "id", "name", "sigma", "status", F.get("laws", F.lit(0)).alias("law"), "region", "tx", "source", "target", "domain")


@query("q12_build_audit", f"""WITH {_NAMED}
SELECT seq, 'INTENT_BUILD_PIPELINE' AS action, name AS dataset, 'intent-builder' AS actor, 'OK' AS result, law, region FROM built
UNION ALL SELECT seq, 'AI_QUERY', 'intent_pipeline_builder', 'query-assistant', 'OK', law, region FROM built
UNION ALL SELECT text_id, 'INTENT_REJECTED', 'non_creation_query', 'intent-builder', 'USE_ASK_QUERY', 'NA', 'GLOBAL' FROM {_LOWERED} WHERE NOT {_CREATES}""")
def q12b(t):
    return reg.build_audit(t("texts"), reg.build_flows(t("texts"), t("registry")))


@query("q11_classify_batch", f"""
WITH l AS (SELECT text_id, text, {_LANGUAGE} AS language, {_TRANSLATED} AS translated, lower({_PLANNER}) AS planner, lower(text) AS said FROM texts),
e AS (SELECT *, lower(translated) AS q FROM l),
i AS (SELECT text_id, language, translated, {_INTENT} AS intent, {_SCHEDULE} AS schedule, {_TEMPLATE} AS template,
  coalesce(TRY_CAST(nullif(regexp_extract(translated, '([0-9]\\.?[0-9]*)', 1), '') AS DOUBLE), 4.5) AS threshold FROM e),
k AS (SELECT text_id, {_KEYWORDS.replace('(q,', '(planner,')} AS planner_intent, {_SIMPLE.replace('(q,', '(said,')} AS simple_schedule,
  {_ROUTE.replace('(q,', '(said,')} AS route, {_CREATES.replace('(q,', '(said,')} AS creates FROM e)
SELECT * FROM i JOIN k USING (text_id)""")
def q11(t):
    return questions.classify_batch(t("texts")).select(
        "text_id", "language", "translated", "intent", "schedule", "template", "threshold", "planner_intent",
        "simple_schedule", "route", "creates")


@query("q12_planned_flows", f"""
SELECT text_id, type, concat('auto-', type, '-', left(sha256(CAST(text_id AS VARCHAR)), 6)) AS flow_id,
  CASE WHEN type = 'report' THEN '0 6 * * *' ELSE '' END AS schedule, CASE WHEN type = 'report' THEN 5.2 ELSE 0 END AS estimated_sigma
FROM (SELECT text_id, CASE WHEN k = 'insight' THEN 'pipeline' ELSE k END AS type
      FROM (SELECT text_id, {_KEYWORDS} AS k FROM (SELECT text_id, lower({_PLANNER}) AS q FROM texts)))""")
def q12c(t):
    return questions.planned_flows(t("texts")).select(
        "text_id", "type", "flow_id", F.coalesce("schedule", F.lit("")).alias("schedule"),
        F.coalesce("estimated_sigma", F.lit(0.0)).alias("estimated_sigma"))


@query("q13_create_flows", """
WITH n AS (SELECT count(*) AS n FROM registry),
f AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 9 = 0 THEN '   ' ELSE concat(' flow_', CAST(c_custkey AS VARCHAR), ' ') END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN NULL ELSE ' s3 ' END AS source, 'node_x' AS target,
  CASE WHEN c_custkey % 2 = 0 THEN 'gdpr' ELSE ' ' END AS law FROM customer),
k AS (SELECT seq, trim(name) AS name, coalesce(nullif(trim(source), ''), 'manual') AS source, target, upper(coalesce(nullif(trim(law), ''), 'DPDP')) AS law,
  row_number() OVER (ORDER BY seq) + (SELECT n FROM n) AS i FROM f WHERE trim(name) <> '')
SELECT seq, concat('pl-', CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END) AS id, name, 5.0 AS sigma, law, 'IN-TG' AS region,
  'dashboard_user' AS owner, source, target FROM k""")
def q13(t):
    key = F.col("c_custkey")
    forms = t("customer").select(
        key.alias("seq"),
        F.when(key % 9 == 0, "   ").otherwise(F.concat(F.lit(" flow_"), key.cast("string"), F.lit(" "))).alias("name"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, F.lit(None)).otherwise(" s3 ").alias("source"), F.lit("node_x").alias("target"),
        F.when(key % 2 == 0, "gdpr").otherwise(" ").alias("law"), F.lit("").alias("region"), F.lit(None).cast("string").alias("owner"))
    return reg.create_flows(forms, t("registry")).select(
        "seq", "id", "name", "sigma", F.get("laws", F.lit(0)).alias("law"), "region", "owner", "source", "target")


@query("x32_normalize_path", """
SELECT seq, regexp_replace(regexp_replace(path, '/[a-f0-9-]{8,}', '/{id}', 'g'), '/[0-9]+', '/{id}', 'g') AS path FROM request_log""")
def x32(t):
    return t("request_log").select("seq", T.normalize_path(F.col("path")).alias("path"))
