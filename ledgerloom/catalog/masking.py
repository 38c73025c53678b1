"""Masking, stamping, validation and quality suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.base import Tables, big, joined, query
from ledgerloom.functions import hashing as H, masking as M, sigma as S
from ledgerloom.operators import masking as mask_ops, quality, validation
from ledgerloom.operators.quality import NotNull, Pattern, RowCount, Unique

_MASKED_SQL = """
SELECT person_id, region,
  CASE WHEN aadhaar IS NULL OR length(aadhaar) < 4 THEN NULL
       WHEN regexp_full_match(replace(replace(aadhaar, ' ', ''), '-', ''), '[0-9]{12}')
         THEN concat('XXXX-XXXX-', right(replace(replace(aadhaar, ' ', ''), '-', ''), 4))
       ELSE 'INVALID_AADHAAR' END AS aadhaar_masked,
  CASE WHEN phone IS NULL THEN NULL WHEN length(bare) < 8 THEN 'INVALID_PHONE'
       ELSE concat(repeat('X', length(bare) - 4), right(bare, 4)) END AS phone_masked,
  CASE WHEN email IS NULL OR strpos(email, '@') = 0 THEN NULL
       WHEN strpos(email, '@') <= 2 THEN concat('*@', substr(email, strpos(email, '@') + 1))
       ELSE concat(left(email, 1), '***@', substr(email, strpos(email, '@') + 1)) END AS email_masked,
  array_to_string(list_transform(list_filter(regexp_split_to_array(name, '\\s+'), lambda w: w <> ''),
    lambda w: upper(left(w, 1))), '. ') || '.' AS name_initials
FROM (SELECT *, replace(replace(replace(phone, '+', ''), '-', ''), ' ', '') AS bare FROM people)
"""


def masked_people(t: Tables):
    return mask_ops.mask_pii(t("people"))


@query("p1_mask_pii", _MASKED_SQL)
def p1(t):
    return masked_people(t).drop("balance")


@query("p2_stamp_run", """
SELECT person_id, 'people_daily' AS run_flow_id, 'r1' AS run_run_id, '2024-01-05T06:00:00Z' AS processed, 'IN-TG' AS run_region,
  CASE WHEN email IS NULL OR strpos(email, '@') = 0 THEN 0 ELSE 1 END AS has_email FROM people""")
def p2(t):
    stamped = mask_ops.stamp_run(masked_people(t), "people_daily", "r1", "IN-TG", "2024-01-05 06:00:00")
    return stamped.select(
        "person_id", "run_flow_id", "run_run_id", H.rfc3339(F.col("run_processed_at")).alias("processed"), "run_region",
        F.col("email_masked").isNotNull().cast("int").alias("has_email"),
    )


@query("x2_mask_numbers_in_text", """
SELECT doc_id, CAST(count(*) AS BIGINT) AS numbers, CAST(sum(CASE WHEN length(b) < 8 THEN 1 ELSE 0 END) AS BIGINT) AS invalid,
  max(CASE WHEN length(b) < 8 THEN 'INVALID_PHONE' ELSE concat(repeat('X', length(b) - 4), right(b, 4)) END) AS greatest_mask
FROM (SELECT doc_id, replace(replace(replace(m, '+', ''), '-', ''), ' ', '') AS b
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[+]?[0-9][0-9 -]{5,}[0-9]')) AS m FROM documents)) GROUP BY doc_id""")
def x2(t):
    found = t("documents").select("doc_id", F.explode(
        F.regexp_extract_all("text", F.lit("[+]?[0-9][0-9 -]{5,}[0-9]"), 0)).alias("m"))
    masked = found.withColumn("mask", M.mask_phone(F.col("m")))
    return masked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("numbers"), F.count_if(F.col("mask") == "INVALID_PHONE").alias("invalid"),
        F.max("mask").alias("greatest_mask"),
    )


@query("x3_mask_addresses_in_text", """
SELECT doc_id, m AS found_at, concat(CASE WHEN strpos(m, '@') <= 2 THEN '*' ELSE concat(left(m, 1), '***') END, '@',
  substr(m, strpos(m, '@') + 1)) AS email_masked
FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+')) AS m FROM documents)""")
def x3(t):
    found = t("documents").select("doc_id", F.explode(
        F.regexp_extract_all("text", F.lit("[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"), 0)).alias("found_at")).distinct()
    return found.withColumn("email_masked", M.mask_email(F.col("found_at")))


_SUITE_SQL = """
SELECT 'people_raw' AS dataset, total_rows, 9 AS checks_run, checks_passed,
  CASE WHEN checks_passed = 9 THEN 6.0 ELSE 2.0 END AS sigma_level, position, "check", passed, actual, expected
FROM (
  SELECT *, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) OVER () AS INT) AS checks_passed FROM (
    SELECT n AS total_rows, 0 AS position, 'row_count >= 1' AS "check", n >= 1 AS passed, concat(n, ' rows') AS actual, '>= 1' AS expected FROM s
    UNION ALL SELECT n, 1, 'not_null(aadhaar)', n1 * 100.0 / n <= 5, printf('%.2f%% nulls', n1 * 100.0 / n), '<5.0%' FROM s
    UNION ALL SELECT n, 2, 'not_null(phone)', n2 * 100.0 / n <= 5, printf('%.2f%% nulls', n2 * 100.0 / n), '<5.0%' FROM s
    UNION ALL SELECT n, 3, 'not_null(email)', n3 * 100.0 / n <= 5, printf('%.2f%% nulls', n3 * 100.0 / n), '<5.0%' FROM s
    UNION ALL SELECT n, 4, 'not_null(name)', n4 * 100.0 / n <= 1, printf('%.2f%% nulls', n4 * 100.0 / n), '<1.0%' FROM s
    UNION ALL SELECT n, 5, 'unique(person_id)', u = n, concat(u, '/', n, ' unique'), '100% unique' FROM s
    UNION ALL SELECT n, 6, 'unique(phone)', up = n, concat(up, '/', n, ' unique'), '100% unique' FROM s
    UNION ALL SELECT n, 7, 'pattern(email,^[^@]+@[^@]+$)', p * 100.0 / n >= 95, printf('%.1f%% match', p * 100.0 / n), '>=95.0%' FROM s
    UNION ALL SELECT n, 8, 'row_count >= 1 and <= 100000000', n BETWEEN 1 AND 100000000, concat(n, ' rows'), '>= 1 and <= 100000000' FROM s))
"""


@query("a6_run_suite", """
WITH s AS (SELECT count(*) AS n, count(*) - count(aadhaar) AS n1, count(*) - count(phone) AS n2, count(*) - count(email) AS n3,
  count(*) - count(name) AS n4, count(DISTINCT person_id) AS u,
  count(DISTINCT phone) + max(CASE WHEN phone IS NULL THEN 1 ELSE 0 END) AS up,
  count(*) FILTER (WHERE regexp_matches(email, '^[^@]+@[^@]+$')) AS p FROM people)
""" + _SUITE_SQL)
def a6(t):
    return quality.run_suite(t("people"), "people_raw", [
        RowCount(1), NotNull("aadhaar", 95.0), NotNull("phone", 95.0), NotNull("email", 95.0), NotNull("name"),
        Unique("person_id"), Unique("phone"), Pattern("email", "^[^@]+@[^@]+$"), RowCount(1, 100_000_000),
    ])


@query("a1_check_not_null", """
SELECT 'not_null(aadhaar)' AS "check", count(*) AS total_rows, (count(*) - count(aadhaar)) * 100.0 / count(*) <= 1 AS passed,
  printf('%.2f%% nulls', (count(*) - count(aadhaar)) * 100.0 / count(*)) AS actual FROM people""")
def a1(t):
    return quality.run_suite(t("people"), "people", [NotNull("aadhaar")]).select("check", "total_rows", "passed", "actual")


@query("a2_check_unique", """
SELECT 'unique(o_custkey)' AS "check", count(*) AS total_rows,
  count(DISTINCT o_custkey) + max(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END) = count(*) AS passed,
  concat(count(DISTINCT o_custkey) + max(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END), '/', count(*), ' unique') AS actual FROM orders""")
def a2(t):
    return quality.run_suite(t("orders"), "orders", [Unique("o_custkey")]).select("check", "total_rows", "passed", "actual")


@query("a3_check_pattern", """
SELECT 'pattern(text,[A-Za-z]+ing\\b)' AS "check", count(*) AS total_rows,
  count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]+ing\\b')) * 100.0 / count(*) >= 95 AS passed,
  printf('%.1f%% match', count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]+ing\\b')) * 100.0 / count(*)) AS actual FROM documents""")
def a3(t):
    suite = [Pattern("text", "[A-Za-z]+ing\\b")]
    return quality.run_suite(t("documents"), "documents", suite).select("check", "total_rows", "passed", "actual")


@query("a4_check_row_count", """
SELECT 'row_count >= 1 and <= 100000000' AS "check", count(*) AS total_rows, count(*) BETWEEN 1 AND 100000000 AS passed FROM lineitem""")
def a4(t):
    return quality.run_suite(t("lineitem"), "lineitem", [RowCount(1, 100_000_000)]).select("check", "total_rows", "passed")


@query("a5_check_columns_ordered", """
SELECT 'columns_ordered' AS "check", count(*) AS total_rows, false AS passed FROM customer""")
def a5(t):
    df = t("customer")
    check = quality.ColumnOrder(("id", "created_at", "updated_at"), tuple(df.columns))
    return quality.run_suite(df, "customer", [check]).select("check", "total_rows", "passed")


@query("c10_exit_report", """
WITH m AS (SELECT aadhaar_masked AS a, phone_masked AS p, email_masked AS e FROM (""" + _MASKED_SQL + """)),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(a, '^XXXX-XXXX-[0-9]{4}$')) AS na,
  count(*) FILTER (WHERE regexp_matches(p, '^X+[0-9]{4}$')) AS np, count(*) FILTER (WHERE regexp_matches(e, '^.+@.+\\..+$')) AS ne FROM m),
r AS (SELECT 0 AS position, n >= 1 AS passed, concat(n, ' rows') AS actual FROM s
  UNION ALL SELECT 1, na * 100.0 / n >= 99, printf('%.1f%% match', na * 100.0 / n) FROM s
  UNION ALL SELECT 2, np * 100.0 / n >= 99, printf('%.1f%% match', np * 100.0 / n) FROM s
  UNION ALL SELECT 3, ne * 100.0 / n >= 95, printf('%.1f%% match', ne * 100.0 / n) FROM s)
SELECT position, passed, actual, CASE WHEN bool_and(passed) OVER () THEN 6.0 ELSE 2.0 END AS sigma_level FROM r""")
def c10(t):
    masked = masked_people(t)
    return quality.run_suite(masked, "people_masked", quality.exit_suite(masked.columns)).select(
        "position", "passed", "actual", "sigma_level")


@query("p16_validate_ingest", """
SELECT payload_id, array_to_string(list_filter([
  CASE WHEN NOT (length(dataset_name) BETWEEN 3 AND 128 AND regexp_full_match(dataset_name, '[a-z0-9_]+')) THEN 'dataset_name' END,
  CASE WHEN NOT (length(payload) BETWEEN 1 AND 10000000) THEN 'payload' END,
  CASE WHEN format NOT IN ('csv', 'json', 'parquet', 'avro') THEN 'format' END,
  CASE WHEN laws_text = '' THEN 'jurisdictions' END,
  CASE WHEN regions_text = '' OR list_max(list_transform(NAMES(regions_text), lambda r: length(r))) > 16 THEN 'allowed_regions' END,
  CASE WHEN NOT (length(purpose) BETWEEN 3 AND 128) THEN 'purpose' END,
  CASE WHEN len(NAMES(tags_text)) > 20 THEN 'tags' END], lambda x: x IS NOT NULL), ',') AS failed_rules
FROM payloads""")
def p16(t):
    return validation.validate_ingest(t("payloads")).select("payload_id", joined("failed_rules").alias("failed_rules"))


@query("p17_validate_lineage", """
SELECT tx_id, CASE WHEN sigma_level < 1.0 OR sigma_level > 6.0 THEN 'sigma_level' ELSE '' END AS failed_rules FROM lineage
WHERE output_dataset_id <> '' AND length(output_hash) = 64""")
def p17(t):
    return validation.validate_lineage(t("lineage")).select("tx_id", joined("failed_rules").alias("failed_rules"))


@query("p18_validate_measurement", """
SELECT run_id, array_to_string(list_filter([CASE WHEN sigma_level - 1.5 < 1.0 THEN 'sigma_level' END,
  CASE WHEN completeness_pct + 1 > 100 THEN 'completeness_pct' END,
  CASE WHEN records_failed - 5 < 0 THEN 'records_failed' END], lambda x: x IS NOT NULL), ',') AS failed_rules FROM measurements""")
def p18(t):
    shifted = t("measurements").withColumns({
        "sigma_level": F.col("sigma_level") - 1.5, "completeness_pct": F.col("completeness_pct") + 1,
        "records_failed": F.col("records_failed") - 5,
    })
    return validation.validate_measurement(shifted, api=True).select("run_id", joined("failed_rules").alias("failed_rules"))


@query("p19_validate_sla", """
SELECT pipeline_id, array_to_string(list_filter([CASE WHEN NOT contains(customer_org, 'Customer') OR customer_org = 'Customer-2' THEN 'setter' END,
  CASE WHEN min_sigma - 0.25 < 4.5 THEN 'min_sigma' END], lambda x: x IS NOT NULL), ',') AS failed_rules FROM sla""")
def p19(t):
    terms = t("sla").withColumn("min_sigma", F.col("min_sigma") - 0.25)
    setter = F.when(F.col("customer_org") == "Customer-2", "Other").otherwise(F.col("customer_org"))
    return validation.validate_sla(terms, setter).select("pipeline_id", joined("failed_rules").alias("failed_rules"))


@query("p20_has_capacity", """
SELECT node_id, CASE WHEN battery_pct IS NOT NULL AND battery_pct < 20 THEN false WHEN ram_mb < 256 THEN false ELSE true END AS capacity FROM nodes""")
def p20(t):
    return t("nodes").select("node_id", validation.has_capacity(F.col("battery_pct"), F.col("ram_mb")).alias("capacity"))


@query("p11_align_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def p11(t):
    aligned, _ = mask_ops.align_columns(t("customer"), ["c_custkey", "gone", "c_name", "c_acctbal"])
    return aligned


@query("p12_drop_unjustified_columns", "SELECT s_suppkey, s_nationkey FROM supplier")
def p12(t):
    return mask_ops.drop_unjustified_columns(t("supplier"), ["s_suppkey", "s_nationkey"])


@query("x5_content_hash", "SELECT doc_id, sha256(text) AS content_hash, concat('Qm', left(sha256(sha256(text)), 44)) AS cid FROM documents")
def x5(t):
    body = H.sha256(F.col("text"))
    return t("documents").select("doc_id", body.alias("content_hash"), H.content_cid(body).alias("cid"))


@query("x7_dna_hash", """
SELECT dataset_id, content_hash, true AS integrity_ok, sha256(concat('{"classification": "', classification, '", "content_hash": "', content_hash,
  '", "created_at": ', CAST(epoch(ts) AS BIGINT), '.0, "creator_id": "', owner_id, '", "dataset_id": "', dataset_id, '", "fabric_tx_id": "TX_',
  left(sha256(concat('ingest|', content_hash)), 24), '", "ipfs_cid": "Qm', left(sha256(content_hash), 44), '", "jurisdictions": ["', replace(laws_text, ',', '", "'),
  '"], "parent_ids": [], "quality_sigma": ', CAST(sigma AS VARCHAR), ', "transformation": "raw_ingest"}')) AS genome_hash
FROM (SELECT p.*, sha256(payload) AS content_hash, concat('ds-', left(sha256(concat(dataset_name, '|', sha256(payload))), 12)) AS dataset_id,
    CAST(4 + (payload_id % 20000) / CAST(10000 AS DOUBLE) AS DOUBLE) AS sigma FROM payloads p)""")
def x7(t):
    from ledgerloom.operators.dna import dna_from_ingest, verify_dna

    scored = t("payloads").withColumn("sigma", 4 + F.col("payload_id") % 20000 / 10000)
    return verify_dna(dna_from_ingest(scored)).select("dataset_id", "content_hash", "genome_hash", "integrity_ok")


@query("x9_measurement_hash", """
SELECT run_id, sha256(concat_ws('|', pipeline_id, dataset_id, run_id, timestamp, CAST(CAST(sigma_level AS DECIMAL(12,4)) AS VARCHAR),
  CAST(records_processed AS VARCHAR), CAST(records_failed AS VARCHAR), node_id, region)) AS measurement_hash FROM measurements""")
def x9(t):
    return t("measurements").select("run_id", H.measurement_hash().alias("measurement_hash"))


@query("x10_tx_id", """
SELECT request_id, concat('TX_', left(sha256(concat('{"dataset_id": "', dataset_id, '", "jurisdictions": ["',
  replace(laws_text, ',', '", "'), '"], "region": ', coalesce('"' || target_region || '"', 'null'), '}')), 24)) AS tx FROM transfer_requests""")
def x10(t):
    members = {
        "region": H.json_string(F.col("target_region")), "dataset_id": H.json_string(F.col("dataset_id")),
        "jurisdictions": H.json_list(F.col("jurisdictions")),
    }
    return t("transfer_requests").select("request_id", H.tx_id(members).alias("tx"))


@query("x11_run_fingerprint", """
SELECT pipeline_id, count(*) AS runs, sha256(concat(pipeline_id, '|r1|', count(*))) AS fingerprint FROM runs GROUP BY pipeline_id""")
def x11(t):
    counted = t("runs").groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("runs"))
    return counted.withColumn("fingerprint", H.run_fingerprint(F.col("pipeline_id"), F.lit("r1"), F.col("runs")))


_INTS, _NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_ROW_TEXT = " || ".join(
    f"coalesce('{tag}' || CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '{tag}-')"
    for tag, text in [
        *[("i", f"CAST({c} AS VARCHAR)") for c in _INTS], *[("n", f"CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR)") for c in _NUMBERS],
        ("s", "l_returnflag"), ("s", "l_linestatus"), ("t", "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f')"),
    ]
)
_LANES = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {15 * k + 1}, 15) AS UBIGINT) AS DECIMAL(38,0))) AS VARCHAR)" for k in range(4))


@query("x11_table_digest", f"""
SELECT l_returnflag, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_LANES})) AS digest, count(*) AS n
FROM (SELECT l_returnflag, sha256({_ROW_TEXT}) AS h FROM lineitem) GROUP BY l_returnflag""")
def x11b(t):
    lines = t("lineitem")
    return lines.groupBy("l_returnflag").agg(H.table_digest(lines.schema).alias("digest"), F.count(F.lit(1)).alias("n"))


@query("x12_sign_verify", """
SELECT node_id, count(*) AS messages, CAST(count(*) FILTER (WHERE seq % 100 <> 0) AS BIGINT) AS verified,
  min(sha256(concat('{"need": "', need_id, '"}', sha256(node_id)))) AS least_signature FROM needs GROUP BY node_id""")
def x12(t):
    sent = t("needs").withColumns({
        "payload": H.json_object({"need": H.json_string(F.col("need_id"))}), "key": H.sha256(F.col("node_id"))
    }).withColumn("signature", H.sign(F.col("payload"), F.col("key")))
    forged = F.when(F.col("seq") % 100 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    checked = sent.withColumn("ok", H.verify(forged, F.col("key"), F.col("signature")))
    return checked.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if("ok").alias("verified"), F.min("signature").alias("least_signature"))


@query("x13_sigma_from_defects", """
SELECT run_id, CASE WHEN r >= 0.99999966 THEN 6.0 WHEN r >= 0.99999 THEN 5.5 WHEN r >= 0.99977 THEN 5.0 WHEN r >= 0.99865 THEN 4.5
  WHEN r >= 0.99379 THEN 4.0 WHEN r >= 0.97725 THEN 3.5 WHEN r >= 0.93319 THEN 3.0 ELSE 2.0 END AS sigma
FROM (SELECT run_id, CAST(1 AS DOUBLE) - CAST(records_failed AS DOUBLE) / records_processed AS r FROM measurements)""")
def x13(t):
    return t("measurements").select(
        "run_id", S.sigma_from_defects(F.col("records_failed"), F.col("records_processed")).alias("sigma"))


@query("x14_sigma_tables", """
SELECT run_id, CAST(CASE WHEN sigma_level >= 6 THEN 3.4 WHEN sigma_level >= 5.5 THEN 32 WHEN sigma_level >= 5 THEN 233
    WHEN sigma_level >= 4.5 THEN 1350 WHEN sigma_level >= 4 THEN 6210 WHEN sigma_level >= 3.5 THEN 22750
    WHEN sigma_level >= 3 THEN 66807 ELSE 308537 END AS DOUBLE) AS dpm,
  CAST(CASE round_even(sigma_level, 0) WHEN 6 THEN 3.4 WHEN 5 THEN 233 WHEN 4 THEN 6210 WHEN 3 THEN 66807 WHEN 2 THEN 308537
    WHEN 1 THEN 691462 ELSE 999999 END AS DOUBLE) AS dpm_rounded,
  CASE WHEN 5.5 - sigma_level >= 1.5 THEN 'CRITICAL' WHEN 5.5 - sigma_level >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN sigma_level >= 5.5 THEN 'good' WHEN sigma_level >= 4.5 THEN 'watch' ELSE 'bad' END AS band,
  CAST(CASE WHEN sigma_level >= 5 THEN 99.9 ELSE 97.0 END AS DOUBLE) AS completeness,
  CAST(CASE WHEN sigma_level >= 6 THEN 99.99 ELSE 99.0 END AS DOUBLE) AS accuracy FROM measurements""")
def x14(t):
    s = F.col("sigma_level")
    return t("measurements").select(
        "run_id", S.sigma_to_dpm(s).alias("dpm"), S.sigma_to_dpm_rounded(s).alias("dpm_rounded"),
        S.severity(5.5 - s).alias("severity"), S.sigma_band(s).alias("band"),
        S.completeness_default(s).alias("completeness"), S.accuracy_default(s).alias("accuracy"),
    )


_GAPS = "(octet_length(encode(payload)) - octet_length(encode(replace(payload, ',,', '')))) / 2"
_SIZE = "octet_length(encode(payload))"


@query("x18_payload_sigma_edge", f"""
SELECT payload_id, CASE WHEN b = 0 THEN 1.0 ELSE least(6.0, greatest(1.0, CAST(6 AS DOUBLE) - g / b * 10 - CASE WHEN b > 100 AND b < 10000000 THEN 0 ELSE 1 END)) END AS sigma
FROM (SELECT payload_id, {_SIZE} AS b, {_GAPS} AS g FROM payloads)""")
def x18(t):
    return t("payloads").select("payload_id", S.payload_sigma_edge(F.col("payload")).alias("sigma"))


@query("x19_payload_sigma_api", f"""
SELECT payload_id, CASE WHEN b = 0 THEN 1.0 ELSE least(6.0, greatest(1.0, CAST(6 AS DOUBLE) - CASE WHEN format = 'csv' THEN g / b * 20 ELSE 0 END
  - CASE WHEN b / l < 5 THEN 1.5 ELSE 0 END - CASE WHEN b / l > 5000 THEN 1 ELSE 0 END)) END AS sigma
FROM (SELECT payload_id, format, {_SIZE} AS b, {_GAPS} AS g, length(payload) - length(replace(payload, chr(10), '')) + 1 AS l FROM payloads)""")
def x19(t):
    return t("payloads").select("payload_id", S.payload_sigma_api(F.col("payload"), F.col("format")).alias("sigma"))


@query("c11_route_by_sigma", """
SELECT run_id, CASE WHEN s IS NULL THEN 'promote' WHEN s < 4.5 THEN 'quarantine' WHEN s < 5.5 THEN 'at_risk' ELSE 'promote' END AS route
FROM (SELECT run_id, CASE WHEN event_id % 20 = 0 THEN NULL ELSE sigma_level END AS s FROM measurements)""")
def c11(t):
    known = F.when(F.col("event_id") % 20 != 0, F.col("sigma_level"))
    return t("measurements").select("run_id", quality.route_by_sigma(known).alias("route"))


@query("c12_gate_payloads", f"""
SELECT payload_id, sha256(payload) AS content_hash, CASE WHEN b = 0 THEN false ELSE least(6.0, greatest(1.0, CAST(6 AS DOUBLE)
  - CASE WHEN format = 'csv' THEN g / b * 20 ELSE 0 END - CASE WHEN b / l < 5 THEN 1.5 ELSE 0 END - CASE WHEN b / l > 5000 THEN 1 ELSE 0 END)) >= 4.0 END AS accepted
FROM (SELECT payload_id, payload, format, {_SIZE} AS b, {_GAPS} AS g, length(payload) - length(replace(payload, chr(10), '')) + 1 AS l FROM payloads)""")
def c12(t):
    return quality.gate_payloads(t("payloads")).select("payload_id", "content_hash", "accepted")


@query("s5_payload_rows", """SELECT c_nationkey AS nation, c_custkey, c_name, c_acctbal, CASE WHEN c_nationkey % 3 = 0 THEN concat('says "', lower(c_mktsegment), '",', chr(10), 'and more') END AS note FROM customer""")
def s5(t):
    """A csv body for every nation, each with its own columns in its own order, read back."""
    from ledgerloom.sources.files import parse_payloads

    key, name, balance = F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')), F.col("c_acctbal").cast("string")
    note = F.concat(F.lit('"says ""'), F.lower("c_mktsegment"), F.lit('"",\nand more"'))
    layouts = [("c_custkey,note,c_name,c_acctbal", (key, note, name, balance)), ("c_acctbal,c_name,unknown,c_custkey", (balance, name, F.lit("x"), key)),
               ("c_name,c_custkey,c_acctbal", (name, key, balance))]
    kind = F.col("c_nationkey") % 3
    line, header = F, F
    for i, (names, cells) in enumerate(layouts):
        line, header = line.when(kind == i, F.concat_ws(",", *cells)), header.when(kind == i, F.lit(names))
    # bodies are written in parts of a hundred customers
    bodies = t("customer").select(F.col("c_nationkey").alias("nation"), F.expr("c_custkey div 100").alias("part"), header.alias("header"), line.alias("line"))
    bodies = bodies.groupBy("nation", "part", "header").agg(F.collect_list("line").alias("lines")).select(
        "nation", F.concat("header", F.lit("\n"), F.array_join("lines", "\r\n")).alias("payload"))
    return parse_payloads(bodies, "csv", "c_custkey bigint, c_name string, c_acctbal double, note string").drop("payload")
