"""Views that give the driver's tables the shapes the operators work on.

Each view is one SQL text that Spark and DuckDB both run, so a query and the SQL it is
checked against start from the same rows. A few calls differ between the two engines and
are spelled in capitals below; ``render`` turns them into the engine's own functions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: tables that grow; the others are dimensions

#: call -> (Spark text, DuckDB text); {0}, {1} are the arguments.
_CALLS = {
    "SHA256": ("sha2({0}, 256)", "sha256({0})"),
    "RFC3339": ("date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"),
    "IDIV": ("({0} div {1})", "({0} // {1})"),
    "NTZ": ("TIMESTAMP_NTZ {0}", "TIMESTAMP {0}"),
    "PLUS_SECONDS": ("({0} + make_dt_interval(0, 0, 0, {1}))", "({0} + to_seconds({1}))"),
    "JSON_K": ("CAST(get_json_object({0}, '$.k') AS INT)", "CAST(json_extract_string({0}, '$.k') AS INT)"),
    "NAMES": ("split({0}, ',')", "string_split({0}, ',')"),
}


def _arguments(text: str) -> list[str]:
    parts, depth, start, quoted = [], 0, 0, False
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch == "(":
            depth += 1
        elif not quoted and ch == ")":
            depth -= 1
        elif not quoted and ch == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return parts + [text[start:].strip()]


def render(sql: str, engine: str) -> str:
    """Spell the capital calls for ``spark`` or ``duckdb``."""
    which = 0 if engine == "spark" else 1
    pattern = re.compile(r"\b(" + "|".join(_CALLS) + r")\(")
    while found := pattern.search(sql):
        depth, end, quoted = 1, found.end(), False
        while depth:
            ch = sql[end]
            if ch == "'":
                quoted = not quoted
            elif not quoted:
                depth += (ch == "(") - (ch == ")")
            end += 1
        body = _CALLS[found.group(1)][which].format(*_arguments(sql[found.end():end - 1]))
        sql = sql[:found.start()] + body + sql[end:]
    return sql


_PIPELINE = "concat('pl-', CASE WHEN {n} < 1000 THEN lpad(CAST({n} AS STRING), 3, '0') ELSE CAST({n} AS STRING) END)"


def _pipeline(n: str) -> str:
    return _PIPELINE.format(n=n)


_REGION_6 = "CASE {n} % 6 WHEN 0 THEN 'IN-TG' WHEN 1 THEN 'IN-MH' WHEN 2 THEN 'IN-DL' WHEN 3 THEN 'IN-KA' WHEN 4 THEN 'EU-DE' ELSE 'US' END"

PEOPLE = """
SELECT c_custkey AS person_id, c_acctbal AS balance,
  CASE WHEN c_custkey % 50 = 0 THEN NULL
       WHEN c_custkey % 37 = 0 THEN '12-'
       WHEN c_custkey % 41 = 0 THEN '1234 5678'
       WHEN c_custkey % 43 = 0 THEN concat('12345678901', 'x')
       WHEN c_custkey % 3 = 0 THEN concat(substr(a, 1, 4), '-', substr(a, 5, 4), '-', substr(a, 9, 4))
       WHEN c_custkey % 7 = 0 THEN concat(substr(a, 1, 4), ' ', substr(a, 5, 4), ' ', substr(a, 9, 4))
       ELSE a END AS aadhaar,
  CASE WHEN c_custkey % 61 = 0 THEN NULL
       WHEN c_custkey % 43 = 0 THEN '+91-12 34'
       WHEN c_custkey % 47 = 0 THEN 'phone-unknown'
       WHEN c_custkey % 3 = 0 THEN concat('+91-', p)
       WHEN c_custkey % 5 = 0 THEN concat(substr(p, 1, 5), ' ', substr(p, 6, 5))
       ELSE p END AS phone,
  CASE WHEN c_custkey % 53 = 0 THEN NULL
       WHEN c_custkey % 29 = 0 THEN 'no-at-sign'
       WHEN c_custkey % 31 = 0 THEN 'x@mail.example'
       WHEN c_custkey % 59 = 0 THEN '@mail.example'
       WHEN c_custkey % 47 = 0 THEN 'a.b@c@d.example'
       ELSE concat('user', CAST(c_custkey AS STRING), '@', lower(c_mktsegment), '.example') END AS email,
  CASE WHEN c_custkey % 67 = 0 THEN NULL
       WHEN c_custkey % 71 = 0 THEN ''
       WHEN c_custkey % 13 = 0 THEN concat('  ravi   ', lower(c_mktsegment), ' ', n_name)
       WHEN c_custkey % 11 = 0 THEN 'élodie de la tour'
       ELSE concat(lower(c_mktsegment), ' ', n_name) END AS name,
  """ + _REGION_6.format(n="c_nationkey") + """ AS region
FROM (SELECT customer.*, n_name,
        lpad(CAST(c_custkey * 7919 + 200000000001 AS STRING), 12, '0') AS a,
        lpad(CAST(c_custkey * 104729 % 10000000000 AS STRING), 10, '9') AS p
      FROM customer JOIN nation ON c_nationkey = n_nationkey) c
"""

SALES = """
SELECT CAST(o_orderdate AS DATE) AS sale_date, r_name AS region,
  l_partkey AS product_id, p_name AS product_name, l_orderkey AS order_id,
  CAST(CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * (100 - CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4)) AS revenue
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""

# The same sales with only what a template groups by, so none joins more tables than it needs.
_REVENUE = "CAST(CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * (100 - CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4)) AS revenue"
SALES_REGION = "SELECT CAST(o_orderdate AS DATE) AS sale_date, r_name AS region, " + _REVENUE + """
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""
SALES_DAY = "SELECT CAST(o_orderdate AS DATE) AS sale_date, " + _REVENUE + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
SALES_PART = "SELECT l_partkey AS product_id, " + _REVENUE + " FROM lineitem"
SALE_PRODUCTS = "SELECT p_partkey AS product_id, p_name AS product_name FROM part"

MEASUREMENTS = """
SELECT event_id, """ + _pipeline("user_id % 40") + """ AS pipeline_id,
  concat('ds-', CAST(user_id AS STRING)) AS dataset_id,
  concat('run-', CAST(event_id AS STRING)) AS run_id,
  ts, RFC3339(ts) AS timestamp,
  concat('TX', substr(SHA256(concat('measure-', CAST(event_id AS STRING))), 1, 30)) AS tx_id,
  CAST(round(greatest(CAST(1 AS DOUBLE), CAST(6 AS DOUBLE) - value / CAST(100 AS DOUBLE)), 4) AS DOUBLE) AS sigma_level,
  CAST(1000 + k * 10 AS BIGINT) AS records_processed,
  CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS BIGINT) AS records_failed,
  CAST(100 - k / CAST(50 AS DOUBLE) AS DOUBLE) AS completeness_pct,
  CAST(100 - k / CAST(20 AS DOUBLE) AS DOUBLE) AS accuracy_pct,
  concat('node-', CAST(event_id % 7 AS STRING)) AS node_id,
  """ + _REGION_6.format(n="user_id") + """ AS region
FROM (SELECT events.*, JSON_K(props) AS k FROM events) e
"""

SLA = """
SELECT """ + _pipeline("n") + """ AS pipeline_id,
  CAST(4.5 + (n % 3) * 0.5 AS DOUBLE) AS min_sigma,
  CAST(4.0 + (n % 3) * 0.5 AS DOUBLE) AS breach_threshold,
  CAST(5.0 + (n % 3) * 0.5 AS DOUBLE) AS target_sigma,
  concat('Customer-', CAST(n % 5 AS STRING)) AS customer_org,
  n % 7 <> 0 AS active
FROM (SELECT DISTINCT user_id % 40 AS n FROM events) u
WHERE n % 9 <> 5
"""

REGISTRY = """
SELECT s_suppkey AS seq, """ + _pipeline("s_suppkey") + """ AS id,
  CASE WHEN s_suppkey % 11 = 3 THEN concat('custom_name_', CAST(s_suppkey AS STRING))
       WHEN s_suppkey < 16 THEN concat(domain, '_', source, '_pipeline')
       ELSE concat(domain, '_', source, '_pipeline_', CAST(IDIV(s_suppkey, 16) + 1 AS STRING)) END AS name,
  CAST(round(CAST(6 AS DOUBLE) - CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 250 AS DOUBLE) / CAST(100 AS DOUBLE), 2) AS DOUBLE) AS sigma,
  CASE WHEN s_suppkey % 17 = 0 THEN 'Healthy'
       WHEN CAST(floor(abs(s_acctbal)) AS BIGINT) % 250 <= 120 THEN 'healthy'
       WHEN CAST(floor(abs(s_acctbal)) AS BIGINT) % 250 <= 180 THEN 'warning' ELSE 'critical' END AS status,
  CASE s_suppkey % 5 WHEN 0 THEN 'DPDP' WHEN 1 THEN 'GDPR' WHEN 2 THEN 'DPDP,HIPAA' WHEN 3 THEN 'gdpr,SOX' ELSE 'SOX' END AS laws_text,
  concat('TX_', substr(SHA256(concat('registry-', CAST(s_suppkey AS STRING))), 1, 11)) AS tx,
  """ + _REGION_6.format(n="s_nationkey") + """ AS region,
  CAST(s_suppkey * 37 % 5000 AS BIGINT) AS runs,
  CAST(70 + s_suppkey % 30 AS BIGINT) AS healing_rate,
  CASE s_suppkey % 3 WHEN 0 THEN 'HEALTH' WHEN 1 THEN 'PII' ELSE 'BUSINESS' END AS classification,
  s_name AS owner, source, concat('node_', CAST(s_nationkey AS STRING)) AS target,
  PLUS_SECONDS(NTZ('2024-01-01 00:00:00'), s_suppkey * 60) AS created_at
FROM (SELECT supplier.*,
        CASE s_suppkey % 4 WHEN 0 THEN 'fraud' WHEN 1 THEN 'custom' WHEN 2 THEN 'customer_profile' ELSE 'iot_sensors' END AS domain,
        CASE IDIV(s_suppkey, 4) % 4 WHEN 0 THEN 'kafka' WHEN 1 THEN 'manual' WHEN 2 THEN 'csv' ELSE 'api' END AS source
      FROM supplier) s
"""

AUDIT_EVENTS = """
SELECT event_id, ts, RFC3339(ts) AS timestamp,
  concat('TX_', substr(SHA256(concat('audit-', CAST(event_id AS STRING))), 1, 20)) AS tx,
  CASE event_type WHEN 'view' THEN 'QUERY' WHEN 'click' THEN 'TRANSFORM' WHEN 'signup' THEN 'INGEST'
       WHEN 'error' THEN 'AUTO-HEAL' ELSE 'BORDER' END AS action,
  concat(CASE user_id % 4 WHEN 0 THEN 'Patient_Records_' WHEN 1 THEN 'sales_' WHEN 2 THEN 'factory_sensors_' ELSE 'eu_profile_' END,
         CAST(user_id AS STRING)) AS dataset,
  CASE WHEN event_type = 'purchase' AND k < 30 THEN 'BLOCKED' WHEN event_type = 'purchase' THEN 'ALLOWED'
       WHEN event_type = 'error' THEN 'FIXED' ELSE 'OK' END AS result,
  concat('user-', CAST(user_id AS STRING)) AS actor,
  CASE user_id % 5 WHEN 0 THEN 'GDPR' WHEN 1 THEN 'HIPAA' WHEN 2 THEN 'SOX' ELSE 'DPDP' END AS law,
  """ + _REGION_6.format(n="user_id") + """ AS region
FROM (SELECT events.*, JSON_K(props) AS k FROM events) e
"""

TRANSFER_REQUESTS = """
SELECT o_orderkey AS seq, concat('R-', CAST(o_orderkey AS STRING)) AS request_id,
  concat('ds-', CAST(o_custkey AS STRING)) AS dataset_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'PII' WHEN '2' THEN 'HEALTH' WHEN '3' THEN 'FINANCIAL'
       WHEN '4' THEN 'BIOMETRIC' ELSE 'PUBLIC' END AS classification,
  CASE WHEN o_orderkey % 11 = 0 THEN 'HIPAA,SOX' WHEN o_orderkey % 13 = 0 THEN 'DPDP_2023,DPDP_2023'
       WHEN o_orderkey % 17 = 0 THEN 'OTHER' WHEN o_orderstatus = 'P' THEN 'DPDP_2023'
       WHEN o_orderstatus = 'F' THEN 'GDPR' ELSE 'DPDP_2023,GDPR' END AS laws_text,
  'IN-TG' AS source_region,
  CASE WHEN o_orderkey % 31 = 5 THEN NULL ELSE CASE o_orderkey % 9 WHEN 0 THEN 'IN-TG' WHEN 1 THEN 'IN-MH' WHEN 2 THEN 'IN' WHEN 3 THEN 'US' WHEN 4 THEN 'SG'
       WHEN 5 THEN 'EU-DE' WHEN 6 THEN 'UK' WHEN 7 THEN 'IN-GJ' ELSE 'DE' END END AS target_region,
  CASE o_custkey % 3 WHEN 0 THEN 'analytics' WHEN 1 THEN 'medical_treatment' ELSE 'research' END AS purpose,
  CASE WHEN o_orderkey % 23 = 3 THEN NULL ELSE IDIV(o_orderkey, 9) % 2 = 0 END AS has_consent,
  CASE WHEN o_orderkey % 29 = 4 THEN NULL ELSE CAST(IDIV(o_orderkey, 18) % 5 AS INT) END AS signature_count,
  PLUS_SECONDS(o_orderdate, o_orderkey % 86400) AS ts,
  SHA256(concat('decision-', CAST(o_orderkey AS STRING))) AS tx_id,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE concat('TX_', CAST(o_orderkey AS STRING)) END AS fabric_tx_id,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END AS is_erasable,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 20 AS INT) END AS field_count,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 10 END AS justified_field_count,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 6 <> 1 END AS encrypted_at_rest,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 8 <> 1 END AS encrypted_in_transit,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS clearance_level,
  CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE 2 END AS required_clearance,
  o_orderkey % 2 = 0 AS allow_auto_fix
FROM orders
"""

LINEAGE = """
SELECT r.*, CASE WHEN seq % 997 = 0 THEN SHA256(concat('tampered-', tx_id)) WHEN seq % 499 = 7 THEN NULL ELSE SHA256(concat_ws('|',
    tx_id, job_id, timestamp, inputs_text, hashes_text, output_dataset_id, output_hash, transformation_type,
    pipeline_id, pipeline_version, CAST(CAST(sigma_level AS DECIMAL(12,4)) AS STRING), classification, laws_text,
    owner_org, operator_msp, node_id, region, ipfs_cid)) END AS genome_hash
FROM (
  SELECT o_orderkey AS seq, concat('TX_', substr(SHA256(concat('lineage-', CAST(o_orderkey AS STRING))), 1, 24)) AS tx_id,
    concat('job-', CAST(o_orderkey AS STRING)) AS job_id,
    PLUS_SECONDS(o_orderdate, o_orderkey % 86400) AS ts,
    RFC3339(PLUS_SECONDS(o_orderdate, o_orderkey % 86400)) AS timestamp,
    CASE WHEN n = 0 THEN '' WHEN n % 5 = 0 THEN concat('ds-', CAST(IDIV(n, 2) AS STRING), ',ds-', CAST(n - 1 AS STRING))
         ELSE concat('ds-', CAST(IDIV(n, 2) AS STRING)) END AS inputs_text,
    CASE WHEN n = 0 THEN '' ELSE SHA256(concat('in-', CAST(n AS STRING))) END AS hashes_text,
    concat('ds-', CAST(n AS STRING)) AS output_dataset_id,
    SHA256(concat('out-', CAST(o_orderkey AS STRING))) AS output_hash,
    CASE o_orderkey % 5 WHEN 0 THEN 'SPARK' WHEN 1 THEN 'SQL' WHEN 2 THEN 'ML' WHEN 3 THEN 'FILTER' ELSE 'JOIN' END AS transformation_type,
    """ + _pipeline("o_custkey % 40") + """ AS pipeline_id,
    CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '1.0.0' END AS pipeline_version,
    CAST(round(CAST(1 AS DOUBLE) + CAST(o_orderkey * 37 % 50001 AS DOUBLE) / CAST(10000 AS DOUBLE), 4) AS DOUBLE) AS sigma_level,
    CASE o_orderkey % 4 WHEN 0 THEN 'PII' WHEN 1 THEN 'HEALTH' WHEN 2 THEN 'FINANCIAL' ELSE '' END AS classification,
    CASE o_orderstatus WHEN 'P' THEN 'GDPR,DPDP_2023' WHEN 'F' THEN 'DPDP_2023' ELSE 'HIPAA' END AS laws_text,
    'Tenant' AS owner_org, concat('Org', CAST(o_custkey % 3 AS STRING), 'MSP') AS operator_msp,
    concat('node-', CAST(o_custkey % 7 AS STRING)) AS node_id,
    """ + _REGION_6.format(n="o_custkey") + """ AS region, '' AS ipfs_cid
  FROM (SELECT orders.*, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE IDIV(o_orderkey, 3) END AS n FROM orders) o
) r
"""

_NODE = """concat(CASE n % 7 WHEN 0 THEN 'edge-IN-TG-' WHEN 1 THEN 'edge-IN-AP-' WHEN 2 THEN 'edge-IN-MH-'
  WHEN 3 THEN 'edge-IN-KA-' WHEN 4 THEN 'edge-EU-DE-' WHEN 5 THEN 'edge-US-VA-' ELSE 'hub-' END, lpad(CAST(n AS STRING), 2, '0'))"""

PUTS = """
SELECT doc_id AS seq, text AS payload, """ + _NODE + """ AS node_id,
  CAST(round(CAST(4 AS DOUBLE) + CAST(n_chars % 200 AS DOUBLE) / CAST(100 AS DOUBLE), 2) AS DOUBLE) AS sigma
FROM (SELECT documents.*, CAST(substr(source, 4) AS BIGINT) AS n FROM documents) d
"""

NODES = """
SELECT """ + _NODE + """ AS node_id,
  CASE n % 7 WHEN 0 THEN 'IN-TG' WHEN 1 THEN 'IN-AP' WHEN 2 THEN 'IN-MH' WHEN 3 THEN 'IN-KA' WHEN 4 THEN 'EU-DE'
    WHEN 5 THEN 'US-VA' ELSE 'IN' END AS region,
  CAST(20000 + n * 15000 AS BIGINT) AS capacity_bytes, CAST(n * 100 AS BIGINT) AS used_bytes,
  n % 9 <> 8 AS online, CASE WHEN n % 3 = 0 THEN 'core_cloud' ELSE 'edge' END AS node_type,
  CASE WHEN n % 4 = 0 THEN NULL ELSE CAST(n * 5 AS INT) END AS battery_pct, CAST(128 * (n % 5) AS INT) AS ram_mb
FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS n FROM documents) d
"""

ACCESSES = """
SELECT l_orderkey AS item, concat('part-', CAST(l_partkey AS STRING)) AS dataset_id,
  concat('user-', CAST(l_suppkey AS STRING)) AS user_id, l_shipdate AS ts,
  CASE l_returnflag WHEN 'A' THEN 'analytics' WHEN 'N' THEN 'analytics_and_research' ELSE 'marketing' END AS purpose
FROM lineitem
"""

NEEDS = """
SELECT o_orderkey AS seq, concat('need-', CAST(o_orderkey AS STRING)) AS need_id, """ + _NODE + """ AS node_id,
  CASE n % 7 WHEN 0 THEN 'IN-TG' WHEN 1 THEN 'IN-AP' WHEN 2 THEN 'IN-MH' WHEN 3 THEN 'IN-KA' WHEN 4 THEN 'EU-DE'
    WHEN 5 THEN 'US-VA' ELSE 'IN' END AS region, IDIV(o_orderkey * 2, 25) AS item
FROM (SELECT o_orderkey, o_custkey % 20 AS n FROM orders) o
"""

PAYLOADS = """
SELECT payload_id, dataset_name, payload, format, classification, laws_text, regions_text, purpose, tags_text, owner_id, ts
FROM (
  SELECT doc_id AS payload_id,
    CASE doc_id % 19 WHEN 0 THEN 'Bad Name' WHEN 1 THEN 'ab' ELSE concat('dataset_', CAST(doc_id AS STRING)) END AS dataset_name,
    CASE WHEN doc_id % 97 = 0 THEN concat(text, repeat(',,', CAST(n_chars AS INT))) WHEN doc_id % 89 = 0 THEN '' ELSE text END AS payload,
    CASE doc_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'parquet' WHEN 3 THEN 'avro' ELSE 'csv' END AS format,
    CASE doc_id % 3 WHEN 0 THEN 'PII' WHEN 1 THEN 'HEALTH' ELSE 'PUBLIC' END AS classification,
    CASE doc_id % 4 WHEN 0 THEN 'IN_DPDP_2023' WHEN 1 THEN 'EU_GDPR_2018' WHEN 2 THEN 'IN_DPDP_2023,US_HIPAA_1996' ELSE 'GLOBAL_OPEN' END AS laws_text,
    CASE doc_id % 13 WHEN 0 THEN 'IN,A-REGION-NAME-TOO-LONG' WHEN 1 THEN 'EU-DE' ELSE 'IN-TG,IN' END AS regions_text,
    CASE WHEN doc_id % 23 = 0 THEN 'x' ELSE 'analytics' END AS purpose,
    CASE WHEN doc_id % 29 = 0 THEN repeat('t,', 25) ELSE 'a,b' END AS tags_text,
    source AS owner_id, PLUS_SECONDS(NTZ('2024-01-01 00:00:00'), doc_id) AS ts
  FROM documents
  UNION ALL
  SELECT 1000000000 + page_id, concat('page_', CAST(page_id AS STRING)), html, 'html', 'PUBLIC', 'GLOBAL_OPEN', 'IN', 'archive', 'web',
    'crawler', PLUS_SECONDS(NTZ('2024-02-01 00:00:00'), page_id)
  FROM pages
) p
"""

DATASETS = """
SELECT c_custkey AS seq, concat('ds-', CAST(c_custkey AS STRING)) AS dataset_id, concat('owner-', CAST(c_custkey % 100 AS STRING)) AS owner_id,
  CASE c_custkey % 4 WHEN 0 THEN 'IN_DPDP_2023' WHEN 1 THEN 'EU_GDPR_2018' WHEN 2 THEN 'EU_GDPR_2018,IN_DPDP_2023' ELSE 'GLOBAL_OPEN' END AS laws_text,
  CASE WHEN c_custkey % 41 = 3 THEN NULL WHEN c_custkey % 3 = 0 THEN 'IN,IN-TG' WHEN c_custkey % 3 = 1 THEN 'DE,FR' ELSE 'IN' END AS allowed_text,
  CASE WHEN c_custkey % 43 = 2 THEN NULL WHEN c_custkey % 5 = 0 THEN 'CN,US' ELSE 'CN' END AS blocked_text,
  c_custkey % 4 IN (0, 2) AS requires_multisig, 3 AS multisig_count,
  CASE WHEN c_custkey % 37 = 1 THEN NULL WHEN c_custkey % 3 = 0 THEN 'analytics' WHEN c_custkey % 3 = 1 THEN 'medical' ELSE 'research' END AS consent_purpose,
  CASE WHEN c_custkey % 6 = 0 THEN NTZ('1998-06-01 00:00:00') WHEN c_custkey % 6 = 1 THEN NTZ('2030-01-01 00:00:00') ELSE NULL END AS consent_expires,
  CASE WHEN c_custkey % 8 = 0 THEN 12 ELSE 5 END AS n_tags
FROM customer WHERE c_custkey % 47 <> 5
"""

DATASET_USES = """
SELECT o_orderkey AS seq, concat('ds-', CAST(o_custkey AS STRING)) AS dataset_id,
  concat('owner-', CAST(o_orderkey % 100 AS STRING)) AS user_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'analytics_report' WHEN 1 THEN 'medical_treatment' WHEN 2 THEN 'research' ELSE 'marketing' END AS purpose,
  CASE o_orderkey % 7 WHEN 0 THEN 'IN' WHEN 1 THEN 'IN-TG' WHEN 2 THEN 'US' WHEN 3 THEN 'DE' WHEN 4 THEN 'CN' WHEN 5 THEN 'IN-MH' ELSE 'FR' END AS target_region,
  o_orderdate AS ts
FROM orders
"""

# Appended to every conversation turn so that all intents, schedules and scripts occur.
_PHRASES = (
    "Send daily sales reports for top 5 regions every morning at 6am",
    "alert me when daily revenue drops below 10 lakhs", "validate quality every 15 minutes",
    "make patient_records dpdp compliant", "ingest orders weekly", "sync hourly",
    "చివరి నెలలో అత్యధిక ఆదాయం ఏ ప్రాంతంలో", "पिछले महीने सर्वोच्च राजस्व किस क्षेत्र में",
    "show top regions by revenue last month", "which pipelines are below 4.2 sigma",
    "Create a kafka pipeline for fraud detection in mumbai", "build a postgres dataflow for customer churn in europe",
    "show risky flows", "which flows are healthy and best", "move data from crm to lake at 9 pm",
    "real-time streaming of iot sensor events", "generate csv pipeline for telecom billing in delhi sox",
    "add a pipeline with s3 payments for andhra hipaa", "நாள் அறிக்கை", "monthly privacy review of transactions",
    "set up api ingestion for patient health in telangana", "నాణ్యత నివేదిక కావాలి", "डेटा गुणवत्ता रिपोर्ट चाहिए",
    "make a pipeline", "at 12 am refresh the dashboard", "sales this month by product",
)
TEXTS = """
SELECT text_id, CAST(IDIV(text_id, 1000) % 17 AS BIGINT) AS user_no, concat(text, ' ', CASE pick
""" + "\n".join(f"  WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES[:-1])) + f"""
  ELSE '{_PHRASES[-1]}' END) AS text, text AS raw_text
FROM (SELECT conv_id * 1000 + turn AS text_id, text, (conv_id * 7 + turn * 3) % {len(_PHRASES)} AS pick FROM conversations) c
"""

RUNS = """
SELECT event_id AS seq, concat('RUN_', substr(SHA256(concat('run-', CAST(event_id AS STRING))), 1, 12)) AS run_id,
  """ + _pipeline("user_id % 60") + """ AS pipeline_id, ts,
  concat('TX_', substr(SHA256(concat('runtx-', CAST(event_id AS STRING))), 1, 12)) AS tx,
  CAST(1200 + k * 37 AS BIGINT) AS duration_ms,
  CASE WHEN k >= 90 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN k >= 90 THEN k % 6 ELSE 6 END AS failed_step
FROM (SELECT events.*, JSON_K(props) AS k FROM events) e
"""

REQUEST_LOG = """
SELECT page_id AS seq, CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method,
  concat(CASE page_id % 3 WHEN 0 THEN concat('/api/v1/dataset/', substr(SHA256(url), 1, 12)) WHEN 1 THEN concat('/runs/', CAST(page_id AS STRING)) ELSE '/pages' END,
    '/', CAST(length(url) AS STRING)) AS path,
  CASE WHEN page_id % 29 = 0 THEN 500 WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS status,
  CAST(page_id * 37 % 1200 AS DOUBLE) / CAST(100 AS DOUBLE) AS duration_s
FROM pages
"""

USERS = """
SELECT c_custkey AS seq, concat('user-', CAST(c_custkey AS STRING)) AS user_id,
  CASE c_custkey % 8 WHEN 0 THEN 'super_admin' WHEN 1 THEN 'tenant_admin' WHEN 2 THEN 'data_owner,analyst' WHEN 3 THEN 'data_engineer'
    WHEN 4 THEN 'analyst' WHEN 5 THEN 'auditor,analyst' WHEN 6 THEN 'service_account' ELSE 'unknown_role' END AS roles_text,
  CASE c_custkey % 5 WHEN 0 THEN 'audit:view' WHEN 1 THEN 'data:ingest' WHEN 2 THEN 'dataset:delete' WHEN 3 THEN 'report:generate' ELSE 'pipeline:manage' END AS wanted
FROM customer
"""

VIEWS = {
    "people": PEOPLE, "sales": SALES, "sales_region": SALES_REGION, "sales_day": SALES_DAY, "sales_part": SALES_PART,
    "sale_products": SALE_PRODUCTS, "measurements": MEASUREMENTS, "sla": SLA, "registry": REGISTRY,
    "audit_events": AUDIT_EVENTS, "transfer_requests": TRANSFER_REQUESTS, "lineage": LINEAGE, "puts": PUTS,
    "nodes": NODES, "accesses": ACCESSES, "needs": NEEDS, "payloads": PAYLOADS, "datasets": DATASETS,
    "dataset_uses": DATASET_USES, "texts": TEXTS, "runs": RUNS, "request_log": REQUEST_LOG, "users": USERS,
}

#: comma-joined text column -> array column the operators expect.
ARRAYS = {
    "laws_text": "jurisdictions", "inputs_text": "input_dataset_ids", "hashes_text": "input_hashes",
    "regions_text": "allowed_regions", "tags_text": "tags", "allowed_text": "allowed_regions",
    "blocked_text": "blocked_regions", "roles_text": "roles",
}


_SCHEMAS: dict[str, StructType] = {}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its schema is looked up once, so later reads start no footer job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One base table or one view over them, with list columns as arrays."""
    if name in BASE_TABLES:
        return base_table(spark, sf_dir, name)
    sql = VIEWS[name]
    for table in BASE_TABLES:
        if re.search(rf"\b(FROM|JOIN) {table}\b", sql):
            base_table(spark, sf_dir, table).createOrReplaceTempView(table)
    df = spark.sql(render(sql, "spark"))
    for text, array in ARRAYS.items():
        if text in df.columns:
            df = df.selectExpr("*", f"CASE WHEN {text} = '' THEN array() ELSE split({text}, ',') END AS {array}")
            df = df.drop(text)
    if name == "registry":
        df = df.withColumnRenamed("jurisdictions", "laws")
    return df


def with_views(sql: str) -> str:
    """DuckDB text: ``sql`` behind the views it mentions."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    ctes = [f"{name} AS ({VIEWS[name]})" for name in used]
    body = sql.strip()
    if not ctes:
        return render(body, "duckdb")
    if body.upper().startswith("WITH RECURSIVE "):
        return render("WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE "):], "duckdb")
    if body.upper().startswith("WITH "):
        return render("WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH "):], "duckdb")
    return render("WITH " + ",\n".join(ctes) + "\n" + body, "duckdb")
