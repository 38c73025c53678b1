"""The content catalogue, the registry, audit events, operations and sales templates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.catalog.governance import _FRAMEWORKS
from ledgerloom.catalog.base import EVENTS_AS_OF, SALES_AS_OF, Tables, big, joined, query
from ledgerloom.functions import hashing as H
from ledgerloom.functions.hashing import sha256
from ledgerloom.operators import audit, catalogue as K, operations as O, registry as reg, rules as R
from ledgerloom.plans import questions, templates
from ledgerloom.session import ensure_checkpoint_dir
from ledgerloom.sources import external
from ledgerloom.sources.pages import write_pages

_PARTICLES = """particles AS (SELECT content_hash, any_value(size_bytes) AS size_bytes, arg_min(sigma, seq) AS sigma,
    string_agg(node_id, ',' ORDER BY seq) AS homes, CAST(sum(puts) AS BIGINT) AS puts
  FROM (SELECT sha256(payload) AS content_hash, node_id, min(seq) AS seq, arg_min(sigma, seq) AS sigma, any_value(octet_length(encode(payload))) AS size_bytes, count(*) AS puts
        FROM puts GROUP BY 1, 2) GROUP BY content_hash)"""
_PREFERENCE = """CASE region WHEN 'IN-TG' THEN ['IN-TG','IN-AP','IN-MH','IN'] WHEN 'IN-MH' THEN ['IN-MH','IN-TG','IN-KA','IN'] WHEN 'IN-AP' THEN ['IN-AP','IN-TG','IN-KA','IN']
  WHEN 'IN-KA' THEN ['IN-KA','IN-TG','IN-MH','IN'] WHEN 'IN' THEN ['IN','IN-TG','IN-MH','IN-AP'] ELSE [region, 'IN'] END"""
_RESOLVED = _PARTICLES + f""",
asked AS (SELECT n.seq, n.need_id, n.node_id, n.region, coalesce(sha256(payload), concat('absent-', CAST(item AS VARCHAR))) AS content_hash FROM needs n LEFT JOIN puts p ON p.seq = item),
looked AS (SELECT a.*, size_bytes, homes, NAMES(homes) AS home_list, {_PREFERENCE} AS pref FROM asked a LEFT JOIN particles USING (content_hash)),
ranked AS (SELECT seq, arg_min(node, pos * 1000 + home_pos) AS hit FROM (
    SELECT seq, node, home_pos, wanted, pos FROM (SELECT seq, unnest(home_list) AS node, generate_subscripts(home_list, 1) AS home_pos FROM looked WHERE homes IS NOT NULL)
    JOIN (SELECT seq AS s2, unnest(pref) AS wanted, generate_subscripts(pref, 1) AS pos FROM looked) ON seq = s2 WHERE contains(node, wanted)) GROUP BY seq),
resolved AS (SELECT l.*, coalesce(hit, home_list[1]) AS nearest, CASE WHEN homes IS NULL THEN 'MISSING' WHEN contains(coalesce(hit, home_list[1]), region) THEN 'NEAR' ELSE 'MOVE' END AS status
  FROM looked l LEFT JOIN ranked USING (seq))"""


def held(t: Tables):
    """The puts, hashed once for all that a query builds from them."""
    return t.kept("held", lambda: K.hashed(t("puts")))


def particles(t: Tables):
    return t.kept("particles", lambda: K.dedup_content(held(t)))


def asked(t: Tables):
    items = held(t).select(F.col("seq").alias("item"), F.col("content_hash").alias("_hash"))
    return t("needs").join(items, "item", "left").withColumn(
        "content_hash", F.coalesce("_hash", F.concat(F.lit("absent-"), F.col("item").cast("string")))).drop("_hash")


@query("a19_dedup_content", f"WITH {_PARTICLES} SELECT content_hash, concat('Qm', left(sha256(content_hash), 44)) AS cid, size_bytes, sigma, homes, puts, 'floating' AS state FROM particles")
def a19(t):
    return particles(t).select("content_hash", "cid", "size_bytes", "sigma", joined("home_nodes").alias("homes"), "puts", "state")


@query("j7_nearest_replica", f"WITH {_RESOLVED} SELECT need_id, coalesce(nearest, '') AS nearest FROM resolved")
def j7(t):
    return K.resolve_needs(asked(t), particles(t)).select("need_id", F.coalesce("nearest", F.lit("")).alias("nearest"))


@query("j7_nearest_by_region", f"""WITH {_RESOLVED},
places AS (SELECT l.seq, l.pref, u.node, u.pos, n.region AS place FROM looked l, (SELECT seq AS s, unnest(home_list) AS node, generate_subscripts(home_list, 1) AS pos FROM looked WHERE homes IS NOT NULL) u
  LEFT JOIN nodes n ON n.node_id = u.node WHERE u.s = l.seq),
best AS (SELECT seq, arg_min(node, coalesce(nullif(coalesce(list_position(pref, place), 0), 0), 1000) * 100000 + pos) AS nearest FROM places GROUP BY seq)
SELECT need_id, coalesce(nearest, '') AS nearest FROM looked LEFT JOIN best USING (seq)""")
def j7b(t):
    known = particles(t).select("content_hash", "home_nodes")
    found = K.nearest_node_by_region(asked(t).join(known, "content_hash", "left"), t("nodes"), "home_nodes", "region")
    return found.select("need_id", F.coalesce("nearest", F.lit("")).alias("nearest"))


@query("j8_resolve_needs", f"WITH {_RESOLVED} SELECT need_id, content_hash, status, status <> 'MISSING' AS accessed FROM resolved")
def j8(t):
    return K.fetch(asked(t), particles(t)).select("need_id", "content_hash", "status", "accessed")


@query("j11_semi_anti", """SELECT 'known' AS side, count(*) AS needs, CAST(sum(seq) AS BIGINT) AS seq_sum FROM needs WHERE item IN (SELECT seq FROM puts)
UNION ALL SELECT 'unknown', count(*), CAST(coalesce(sum(seq), 0) AS BIGINT) FROM needs WHERE item NOT IN (SELECT seq FROM puts)""")
def j11(t):
    keys = t("puts").select(F.col("seq").alias("item"))
    needs = t("needs")

    def side(how, name):
        return needs.join(keys, "item", how).agg(F.count(F.lit(1)).alias("needs"), F.coalesce(F.sum("seq"), F.lit(0)).alias("seq_sum")).withColumn("side", F.lit(name))

    return side("left_semi", "known").unionByName(side("left_anti", "unknown"))


def moves(t: Tables):
    return K.resolve_needs(asked(t), particles(t)).filter("status = 'MOVE'")


_PLACED = _RESOLVED + """,
held AS (SELECT content_hash, unnest(NAMES(homes)) AS node_id FROM particles),
wanted AS (SELECT node_id, content_hash, min(seq) AS seq, min(size_bytes) AS size_bytes FROM resolved WHERE status = 'MOVE' GROUP BY 1, 2),
queue AS (SELECT w.*, capacity_bytes - used_bytes AS free, row_number() OVER (PARTITION BY w.node_id ORDER BY w.seq, w.content_hash) AS r
  FROM wanted w ANTI JOIN held h ON h.node_id = w.node_id AND h.content_hash = w.content_hash JOIN nodes n ON n.node_id = w.node_id),
plan AS (SELECT node_id, r, seq, content_hash, size_bytes, size_bytes <= free AS placed, free - CASE WHEN size_bytes <= free THEN size_bytes ELSE 0 END AS rest FROM queue WHERE r = 1
  UNION ALL SELECT q.node_id, q.r, q.seq, q.content_hash, q.size_bytes, q.size_bytes <= p.rest, p.rest - CASE WHEN q.size_bytes <= p.rest THEN q.size_bytes ELSE 0 END
  FROM plan p JOIN queue q ON q.node_id = p.node_id AND q.r = p.r + 1)"""


@query("g10_plan_placement", f"WITH RECURSIVE {_PLACED} SELECT node_id, seq, content_hash, size_bytes, placed FROM plan")
def g10(t):
    return K.plan_placement(moves(t), t("nodes"), particles(t))


@query("e5_catalogue_run", f"""WITH RECURSIVE {_PLACED} SELECT content_hash, from_node, node_id AS to_node, region AS to_region, p.size_bytes
FROM plan p JOIN (SELECT content_hash, NAMES(homes)[1] AS from_node FROM particles) USING (content_hash) JOIN nodes USING (node_id) WHERE placed""")
def e5(t):
    from ledgerloom.plans.jobs import catalogue_job

    out = catalogue_job(t("puts"), asked(t), t("nodes"))
    return out["moves"].select("content_hash", "from_node", "to_node", "to_region", "size_bytes")


@query("a20_access_stats", "SELECT dataset_id, RFC3339(max(ts)) AS last_accessed, count(*) AS access_count FROM accesses GROUP BY dataset_id")
def a20(t):
    return K.access_stats(t("accesses")).withColumn("last_accessed", H.rfc3339(F.col("last_accessed")))


_COLD = _PARTICLES + """,
stats AS (SELECT sha256(payload) AS content_hash, max(ts) AS last_accessed, count(*) AS access_count FROM accesses JOIN puts ON seq = item GROUP BY 1),
cold AS (SELECT content_hash, size_bytes, NAMES(homes) AS h FROM particles LEFT JOIN stats USING (content_hash)
  WHERE coalesce(last_accessed < NTZ('2000-01-01 00:00:00') - INTERVAL 30 DAY, true) AND contains(homes, ',') AND coalesce(access_count, 0) < 3)"""


def evictions(t: Tables):
    items = held(t).select(F.col("seq").alias("item"), "content_hash")
    stats = K.access_stats(t("accesses").join(items, "item"), "content_hash")
    return K.eviction_candidates(particles(t), stats, "2000-01-01 00:00:00")


@query("g11_eviction_candidates", f"WITH {_COLD} SELECT content_hash, size_bytes, h[len(h)] AS evict_node, array_to_string(h[1:len(h) - 1], ',') AS kept FROM cold")
def g11(t):
    return evictions(t).select("content_hash", "size_bytes", "evict_node", joined("kept_nodes").alias("kept"))


@query("g11_freed_space", f"WITH {_COLD} SELECT h[len(h)] AS node_id, CAST(sum(size_bytes) AS BIGINT) AS freed_bytes, count(*) AS copies FROM cold GROUP BY 1")
def g11b(t):
    return K.freed_space(evictions(t))


def _round(expr: str, places: int) -> str:
    return f"CAST(printf('%.{places}f', CAST({expr} AS DOUBLE)) AS DOUBLE)"


@query("a21_catalogue_status", f"""WITH {_RESOLVED}
SELECT (SELECT count(*) FROM particles) AS total_datasets, {_round('(SELECT CAST(sum(size_bytes) AS DOUBLE) FROM particles) / 1073741824', 4)} AS total_size_gb,
  (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM nodes WHERE online) AS online_nodes,
  {_round('(SELECT CAST(sum(CAST(sigma AS DECIMAL(18,4))) AS DOUBLE) / count(*) FROM particles)', 2)} AS avg_sigma,
  (SELECT count(*) FROM resolved WHERE status = 'MOVE') AS total_movements, (SELECT count(*) FROM needs) AS active_needs""")
def a21(t):
    return K.catalogue_status(particles(t), t("nodes"), moves(t), t("needs"))


_HOLDINGS = """h AS (SELECT node_id, sha256(payload) AS c, arg_min(sigma, seq) AS sigma FROM puts GROUP BY 1, 2),
per AS (SELECT node_id, region, node_type, online, count(c) AS items, coalesce(CAST(printf('%.2f', CAST(sum(CAST(sigma AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(c), 0)) AS DOUBLE), 0) AS avg_sigma
  FROM nodes LEFT JOIN h USING (node_id) GROUP BY ALL)"""


def node_rows(t: Tables):
    holdings = t("puts").groupBy("node_id", sha256(F.col("payload")).alias("content_hash")).agg(F.min_by("sigma", "seq").alias("sigma"))
    return K.node_status(t("nodes"), holdings)


@query("a22_node_status", f"WITH {_HOLDINGS} SELECT *, 0 AS heals_applied FROM per")
def a22(t):
    return node_rows(t)


@query("a21_network_status", f"""WITH {_HOLDINGS} SELECT CAST(sum(items) AS BIGINT) AS total_datasets, count(*) AS total_nodes, count(*) FILTER (WHERE online) AS online_nodes,
  {_round('CAST(sum(CAST(avg_sigma AS DECIMAL(18,4))) AS DOUBLE) / count(*)', 2)} AS avg_sigma FROM per""")
def a21b(t):
    return K.network_status(node_rows(t))


@query("p10_search_store", "SELECT sha256(payload) AS content_hash, sigma FROM puts WHERE contains(payload, 'license') OR contains(node_id, 'license')")
def p10(t):
    stored = t("puts").withColumn("content_hash", sha256(F.col("payload")))
    return K.search_store(stored, "license")


# ---- registry ---------------------------------------------------------------------------

_LAWS = "NAMES(laws_text)"


@query("p3_filter_registry", "SELECT id, name FROM registry WHERE lower(status) = 'healthy' AND list_contains(NAMES(upper(laws_text)), 'GDPR')")
def p3(t):
    return reg.filter_registry(t("registry"), "HEALTHY", "gdpr").select("id", "name")


@query("p4_filter_registry_exact", "SELECT id, name FROM registry WHERE status = 'healthy' AND region = 'IN-TG'")
def p4(t):
    return reg.filter_registry_exact(t("registry"), "healthy", "IN-TG").select("id", "name")


@query("p7_risky_flows", "SELECT id, status, sigma FROM registry WHERE status <> 'healthy' OR sigma < 5.0")
def p7(t):
    return reg.risky_flows(t("registry")).select("id", "status", "sigma")


@query("p8_law_flows", "SELECT id FROM registry WHERE list_contains(NAMES(upper(laws_text)), 'DPDP')")
def p8(t):
    return reg.law_flows(t("registry"), "DPDP").select("id")


@query("p8_law_events", "SELECT tx, dataset FROM audit_events WHERE law = 'GDPR' ORDER BY ts DESC, tx DESC LIMIT 5")
def p8b(t):
    return audit.law_events(t("audit_events"), "GDPR").select("tx", "dataset")


@query("p9_movements", "SELECT source AS from_node, target AS to_node, name AS dataset, region, laws_text AS law, tx FROM registry ORDER BY created_at, id LIMIT 12")
def p9(t):
    return reg.movements(t("registry"))


@query("g4_rank_flows", """SELECT 'sigma' AS ranked_by, id, sigma, runs, row_number() OVER (ORDER BY sigma DESC, id) AS rank FROM registry
UNION ALL SELECT 'runs', id, sigma, runs, row_number() OVER (ORDER BY runs DESC, id) FROM registry""")
def g4(t):
    flows = t("registry").select("id", "sigma", "runs")
    ranked = [reg.rank_flows(flows, by).select(F.lit(by).alias("ranked_by"), "id", "sigma", "runs", "rank") for by in ("sigma", "runs")]
    return ranked[0].unionByName(ranked[1])


@query("a14_overview", f"""SELECT count(*) AS flows, CAST(sum(runs) AS BIGINT) AS total_runs, {_round('CAST(sum(CAST(sigma AS DECIMAL(18,4))) AS DOUBLE) / count(*)', 2)} AS avg_sigma,
  {_round('CAST(sum(healing_rate) AS DOUBLE) / count(*)', 1)} AS heal_rate, count(*) FILTER (WHERE status <> 'healthy') AS warnings FROM registry""")
def a14(t):
    return reg.overview(t("registry"))


@query("j6_node_flow_counts", """SELECT node_id, region, CASE WHEN region = 'GLOBAL' THEN (SELECT count(*) FROM registry) ELSE (SELECT count(*) FROM registry r WHERE r.region = n.region) END AS flows
FROM (SELECT node_id, region FROM nodes UNION ALL SELECT 'audit-global', 'GLOBAL') n""")
def j6(t):
    nodes = t("nodes").select("node_id", "region")
    extra = t.spark.range(1).select(F.lit("audit-global").alias("node_id"), F.lit("GLOBAL").alias("region"))
    return reg.node_flow_counts(nodes.unionByName(extra), t("registry"))


@query("s7_insert_if_absent", """SELECT id, CAST(min(seq) AS BIGINT) AS seq FROM (SELECT concat('pl-', lpad(CAST(c_custkey % 500 AS VARCHAR), 3, '0')) AS id, c_custkey AS seq FROM customer) n
WHERE id NOT IN (SELECT id FROM registry) GROUP BY id""")
def s7(t):
    new = t("customer").select(F.concat(F.lit("pl-"), F.lpad((F.col("c_custkey") % 500).cast("string"), 3, "0")).alias("id"), F.col("c_custkey").alias("seq"))
    return reg.insert_if_absent(new, t("registry").select("id"), "id", "seq")


@query("s8_upsert_latest", """SELECT pipeline_id, arg_max(min_sigma, v) AS min_sigma, max(v) AS version FROM (
  SELECT pipeline_id, min_sigma, 0 AS v FROM sla UNION ALL SELECT pipeline_id, 5.75, event_id + 1 FROM measurements WHERE sigma_level > 5.9) GROUP BY 1""")
def s8(t):
    existing = t("sla").select("pipeline_id", "min_sigma", F.lit(0).cast("bigint").alias("version"))
    changes = t("measurements").filter("sigma_level > 5.9").select("pipeline_id", F.lit(5.75).alias("min_sigma"), (F.col("event_id") + 1).alias("version"))
    return reg.upsert_latest(changes, existing, "pipeline_id", "version")


@query("s9_increment_run_counts", """SELECT id, r.runs + coalesce(n, 0) AS runs, coalesce(last, '') AS last_run FROM registry r
LEFT JOIN (SELECT pipeline_id, count(*) AS n, RFC3339(max(ts)) AS last FROM runs GROUP BY 1) x ON id = pipeline_id""")
def s9(t):
    out = reg.increment_run_counts(t("registry"), t("runs"))
    return out.select("id", "runs", F.coalesce(H.rfc3339(F.col("last_run")), F.lit("")).alias("last_run"))


# ---- audit events -----------------------------------------------------------------------


@query("p5_filter_audit", "SELECT tx FROM audit_events WHERE action = 'BORDER' AND result = 'BLOCKED' AND contains(lower(dataset), 'patient')")
def p5(t):
    return audit.filter_audit(t("audit_events"), "border", "blocked", "PATIENT").select("tx")


@query("p6_dataset_audit_chain", """SELECT 'ds-12' AS dataset_id, RFC3339(ts) AS at, tx_id AS tx, 'ledger' AS source FROM lineage WHERE output_dataset_id = 'ds-12'
UNION ALL SELECT 'sales_1', RFC3339(ts), tx, 'events' FROM audit_events WHERE contains(lower(dataset), 'sales_1')""")
def p6(t):
    lineage, events = t("lineage"), t("audit_events")
    both = audit.dataset_audit_chain(lineage, events, "ds-12").unionByName(audit.dataset_audit_chain(lineage, events, "sales_1"))
    return both.select("dataset_id", H.rfc3339(F.col("ts")).alias("at"), "tx", "source")


@query("p14_report_rows", "SELECT left(RFC3339(ts), 20) AS ts, left(tx, 18) AS tx, left(action, 26) AS action, left(dataset, 28) AS dataset, left(result, 22) AS result FROM audit_events")
def p14(t):
    return audit.report_rows(t("audit_events"))


_STATS = """SELECT 'action' AS kind, action AS name, result FROM e UNION ALL SELECT 'result', result, result FROM e UNION ALL SELECT 'total', 'events', result FROM e"""


def _stats_sql(where: str) -> str:
    share = _round("count(*) FILTER (WHERE result = 'BLOCKED') * 100.0 / CAST(count(*) AS DOUBLE)", 1)
    return f"WITH e AS (SELECT * FROM audit_events {where}), k AS ({_STATS}) SELECT kind, name, count(*) AS events, {share} AS blocked_pct FROM k GROUP BY 1, 2"


@query("a15_audit_stats", _stats_sql("WHERE ts > NTZ('2024-01-19 12:00:00') AND ts <= NTZ('2024-01-20 12:00:00')"))
def a15(t):
    return audit.audit_stats(t("audit_events"), EVENTS_AS_OF)


@query("a15_audit_stats_all", _stats_sql(""))
def a15b(t):
    return audit.audit_stats(t("audit_events"), hours=None)


@query("a16_audit_report", """WITH n AS (SELECT * FROM audit_events ORDER BY ts DESC, tx DESC LIMIT 50)
SELECT count(*) AS total_events, string_agg(DISTINCT action, ',' ORDER BY action) AS actions, string_agg(DISTINCT law, ',' ORDER BY law) AS laws,
  string_agg(DISTINCT region, ',' ORDER BY region) AS regions FROM n""")
def a16(t):
    out = audit.audit_report(t("audit_events"))
    return out.select("total_events", *[joined(c).alias(c) for c in ("actions", "laws", "regions")])


@query("g5_recent", "SELECT tx, RFC3339(ts) AS at FROM audit_events ORDER BY ts DESC, tx DESC LIMIT 100")
def g5(t):
    return audit.recent(t("audit_events"), 100).select("tx", H.rfc3339(F.col("ts")).alias("at"))


@query("g5_recent_runs", "SELECT run_id, duration_ms FROM runs ORDER BY ts DESC, run_id DESC LIMIT 20")
def g5b(t):
    return audit.recent(t("runs"), 20, ("ts", "run_id")).select("run_id", "duration_ms")


@query("g6_page", "SELECT id FROM registry ORDER BY id LIMIT 5 OFFSET 5")
def g6(t):
    return audit.page(t("registry").select("id"), [F.col("id")], 2, 5)


@query("g6_page_info", "SELECT count(*) AS total, 2 AS page, 5 AS page_size, count(*) > 10 AS has_next FROM registry")
def g6b(t):
    return audit.page_info(t("registry"), 2, 5)


@query("g6_page_after", "SELECT run_id, timestamp FROM measurements WHERE (timestamp, run_id) > ('2024-01-10T00:00:00Z', 'run-5') ORDER BY timestamp, run_id LIMIT 50")
def g6c(t):
    return audit.page_after(t("measurements").select("timestamp", "run_id"), ["timestamp", "run_id"], ["2024-01-10T00:00:00Z", "run-5"]).select("run_id", "timestamp")


@query("g7_page_cursor", "SELECT tx FROM audit_events ORDER BY ts, tx LIMIT 50 OFFSET 100")
def g7(t):
    return audit.page_cursor(t("audit_events"), [F.col("ts"), F.col("tx")], "100").select("tx")


@query("g7_next_cursor", "SELECT count(*) AS total, CASE WHEN count(*) > 150 THEN '150' ELSE '' END AS next_cursor FROM audit_events")
def g7b(t):
    return audit.next_cursor(t("audit_events"), "100").withColumn("next_cursor", F.coalesce("next_cursor", F.lit("")))


def event_pages(t: Tables):
    """The events in order, written once."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/pages-{uuid.uuid4().hex}"
    return write_pages(t("audit_events").select("ts", "tx", "action", "dataset"), [F.col("ts"), F.col("tx")], folder)


_PLACED = "placed AS (SELECT tx, action, dataset, row_number() OVER (ORDER BY ts, tx) - 1 AS place, count(*) OVER () AS n FROM audit_events)"


@query("g6_indexed_page", f"WITH {_PLACED} SELECT tx, action, dataset FROM placed WHERE place >= n // 2 // 50 * 50 AND place < n // 2 // 50 * 50 + 50")
def g6d(t):
    index = event_pages(t)
    middle = index.page_info().first()["total"] // 2 // 50 + 1
    return index.page(middle, 50).select("tx", "action", "dataset")


@query("g7_indexed_cursor", f"WITH {_PLACED} SELECT tx, action, dataset FROM placed WHERE place >= n * 9 // 10 AND place < n * 9 // 10 + 100")
def g7c(t):
    index = event_pages(t)
    late = str(index.next_cursor().first()["total"] * 9 // 10)
    return index.page_cursor(late, 100).select("tx", "action", "dataset")


_BODY = """CASE WHEN length(run_id) % 2 = 0 AND pipeline_id LIKE '%7' THEN concat('{"pipeline_id": "', pipeline_id) WHEN pipeline_id LIKE '%3' THEN 'not a body'
  ELSE concat('{"run_id": "', run_id, '", "pipeline_id": "', pipeline_id, '"}') END"""


@query("s11_decode_bodies", f"""SELECT CASE WHEN body LIKE '%}}' THEN pipeline_id END AS pipeline_id, CASE WHEN body LIKE '%}}' THEN run_id END AS run_id,
  CASE WHEN body NOT LIKE '%}}' THEN body END AS unreadable FROM (SELECT *, {_BODY} AS body FROM measurements)""")
def s11(t):
    bodies = t("measurements").select(F.expr(_BODY).alias("value"))
    # A cut body gives the fields before the cut; only whole ones count here.
    decoded = external.decode(bodies, external.TOPICS["quality"])
    whole = F.col("unreadable").isNull()
    return decoded.select(F.when(whole, F.col("pipeline_id")).alias("pipeline_id"), F.when(whole, F.col("run_id")).alias("run_id"), "unreadable")


# ---- operations -------------------------------------------------------------------------


def failures(t: Tables):
    kinds = ("connection_timeout", "schema_mismatch", "quality_drop", "oom_error", "source_unavailable", "unknown_error_xyz")
    chain = F
    for i, kind in enumerate(kinds):
        chain = chain.when(F.col("failed_step") == i, F.lit(kind))
    from ledgerloom.catalog.views import load

    failed = load(t.spark, t.sf_dir, "runs").filter("status = 'failed'")
    return failed.select("run_id", "pipeline_id", chain.otherwise(F.lit("other")).alias("failure_type"))


_FAILURES = """f AS (SELECT run_id, pipeline_id, CASE failed_step WHEN 0 THEN 'connection_timeout' WHEN 1 THEN 'schema_mismatch' WHEN 2 THEN 'quality_drop' WHEN 3 THEN 'oom_error'
  WHEN 4 THEN 'source_unavailable' ELSE 'unknown_error_xyz' END AS failure_type FROM runs WHERE status = 'failed'),
c(kind, diagnosis, action) AS (VALUES ('connection_timeout', 'Source system connection timed out', 'Retry with exponential backoff (3 attempts, 30s max wait)'),
  ('schema_mismatch', 'Schema drift detected — new column added to source', 'Quarantine new data; alert owner; apply schema evolution'),
  ('quality_drop', 'Sigma level dropped below 4.5 threshold', 'Quarantine batch; trigger root-cause analysis; rollback'),
  ('oom_error', 'Spark executor out of memory', 'Reduce batch size by 50%; increase executor memory'),
  ('source_unavailable', 'Source system unavailable', 'Switch to backup source; cache last known good data'))"""


@query("j5_remedies", f"""WITH {_FAILURES} SELECT run_id, failure_type, kind IS NOT NULL AS success, coalesce(diagnosis, concat('Unknown error: ', failure_type)) AS diagnosis,
  coalesce(action, 'Escalate to human operator') AS action FROM f LEFT JOIN c ON kind = failure_type""")
def j5(t):
    return O.remedies(failures(t), O.remedy_catalogue(t.spark)).select("run_id", "failure_type", "success", "diagnosis", "action")


@query("j5_remedies_or_retry", f"""WITH {_FAILURES} SELECT run_id, failure_type, diagnosis, action FROM f JOIN c ON kind = CASE WHEN failure_type = 'unknown_error_xyz' THEN 'connection_timeout' ELSE failure_type END""")
def j5b(t):
    return O.remedies_or_retry(failures(t), O.remedy_catalogue(t.spark)).select("run_id", "failure_type", "diagnosis", "action")


_GRANTS = ",\n".join(f"('{role}', '{','.join(granted)}')" for role, granted in O.ROLE_PERMISSIONS.items())
_ENTITLED = f"""roles(role, granted) AS (VALUES {_GRANTS}),
entitled AS (SELECT DISTINCT user_id, permission FROM (SELECT user_id, unnest(NAMES(roles_text)) AS r FROM users) JOIN (SELECT role, unnest(NAMES(granted)) AS permission FROM roles) ON r = role)"""


@query("j9_entitlements", f"WITH {_ENTITLED} SELECT user_id, string_agg(permission, ',' ORDER BY permission) AS permissions FROM entitled GROUP BY user_id")
def j9(t):
    return O.permission_sets(t("users"), O.role_permissions(t.spark)).withColumn("permissions", joined("permissions"))


@query("j9_allowed_requests", f"WITH {_ENTITLED} SELECT u.user_id, wanted AS permission FROM users u WHERE EXISTS (SELECT 1 FROM entitled e WHERE e.user_id = u.user_id AND e.permission = wanted)")
def j9b(t):
    wanted = t("users").select("user_id", F.col("wanted").alias("permission"))
    return O.allowed_requests(wanted, t("users"), O.role_permissions(t.spark))


@query("j9_denied_requests", f"WITH {_ENTITLED} SELECT u.user_id, wanted AS permission FROM users u WHERE NOT EXISTS (SELECT 1 FROM entitled e WHERE e.user_id = u.user_id AND e.permission = wanted)")
def j9c(t):
    wanted = t("users").select("user_id", F.col("wanted").alias("permission"))
    return O.denied_requests(wanted, t("users"), O.role_permissions(t.spark))


@query("u2_role_sets", """SELECT user_id, list_contains(NAMES(roles_text), 'analyst') OR list_contains(NAMES(roles_text), 'super_admin') AS may_analyse,
  array_to_string(list_sort(list_distinct(list_concat(NAMES(roles_text), ['analyst']))), ',') AS with_analyst,
  CASE WHEN list_contains(NAMES(roles_text), 'analyst') THEN 'analyst' ELSE '' END AS kept FROM users""")
def u2(t):
    analyst = F.array(F.lit("analyst"))
    return t("users").select(
        "user_id", O.has_role(F.col("roles"), "analyst").alias("may_analyse"),
        joined(F.array_sort(F.array_union("roles", analyst))).alias("with_analyst"), joined(F.array_intersect("roles", analyst)).alias("kept"))


@query("a23_ops_status", f"""WITH {_FAILURES}, l AS (SELECT pipeline_id, arg_max(sigma_level, concat(CAST(ts AS VARCHAR), run_id)) AS s FROM measurements GROUP BY 1)
SELECT (SELECT count(*) FROM registry) AS active_flows, (SELECT count(*) FROM texts) AS intents_processed, (SELECT count(*) FROM f) AS heals_applied,
  printf('%.0f%%', (SELECT count(*) FROM f WHERE failure_type <> 'unknown_error_xyz') / CAST(greatest((SELECT count(*) FROM f), 1) AS DOUBLE) * 100) AS heal_success_rate,
  {_round('(SELECT CAST(sum(CAST(s AS DECIMAL(18,4))) AS DOUBLE) / count(*) FROM l)', 2)} AS avg_sigma""")
def a23(t):
    from ledgerloom.operators.ordered import latest_per_key

    latest = latest_per_key(t("measurements").select("pipeline_id", "ts", "run_id", "sigma_level"), ["pipeline_id"], ["ts", "run_id"])
    healed = O.remedies(failures(t), O.remedy_catalogue(t.spark))
    return O.ops_status(t("registry"), t("texts"), healed, latest)


@query("a24_health_score", """
WITH c AS (SELECT (SELECT count(*) > 0 FROM registry) AS ok UNION ALL SELECT (SELECT count(*) > 0 FROM audit_events) UNION ALL SELECT (SELECT count(*) > 0 FROM lineage)
  UNION ALL SELECT (SELECT count(*) > 0 FROM registry WHERE sigma < 0))
SELECT CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS passed, count(*) AS total FROM c""")
def a24(t):
    tables = {name: t(name) for name in ("registry", "audit_events", "lineage")}
    checks = O.table_checks(tables | {"below_zero": t("registry").filter("sigma < 0")})
    return O.health_score(checks).select(big("passed").alias("passed"), big("total").alias("total"))


@query("a25_run_kpis", """SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'completed') AS completed, arg_max(tx, concat(CAST(ts AS VARCHAR), run_id)) AS latest_tx,
  CAST(floor(CAST(sum(duration_ms) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS avg_duration_ms FROM runs""")
def a25(t):
    return O.run_kpis(t("runs"))


@query("a26_run_step_stats", """SELECT step, count(*) AS entries, count(*) FILTER (WHERE failed_step <> i) AS completed FROM runs,
  (VALUES (0, 'queued'), (1, 'source_connect'), (2, 'quality_scan'), (3, 'compliance_guard'), (4, 'target_write'), (5, 'audit_commit')) s(i, step) GROUP BY step""")
def a26(t):
    return O.run_step_stats(t("runs"))


_PATH = "regexp_replace(regexp_replace(path, '/[a-f0-9-]{8,}', '/{id}', 'g'), '/[0-9]+', '/{id}', 'g')"


@query("a28_request_counts", f"SELECT method, {_PATH} AS path, CAST(status AS BIGINT) AS status, count(*) AS requests FROM request_log GROUP BY ALL")
def a28(t):
    return O.request_counts(t("request_log")).withColumn("status", big("status"))


@query("a28_request_latency", f"""SELECT method, path, le, count(*) FILTER (WHERE duration_s <= bound) AS requests FROM (SELECT method, {_PATH} AS path, duration_s FROM request_log),
  (VALUES ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0), ('10.0', 10.0), ('+Inf', 1e18)) b(le, bound)
GROUP BY method, path, le""")
def a28b(t):
    return O.request_latency(t("request_log"))


_A29_FLOWS = ("seq", "id", "name", "tx", "region", "classification", "owner", "source", "target")


@query("a29_full_report", f"""WITH {_FRAMEWORKS},
o AS (SELECT count(*) AS flows, CAST(sum(runs) AS BIGINT) AS total_runs, {_round('CAST(sum(CAST(sigma AS DECIMAL(18,4))) AS DOUBLE) / count(*)', 2)} AS avg_sigma,
  {_round('CAST(sum(healing_rate) AS DOUBLE) / count(*)', 1)} AS heal_rate, count(*) FILTER (WHERE status <> 'healthy') AS warnings FROM registry)
SELECT 'overview' AS section, concat('{{"flows":', flows, ',"total_runs":', total_runs, ',"avg_sigma":', avg_sigma, ',"heal_rate":', heal_rate, ',"warnings":', warnings, '}}') AS document FROM o
UNION ALL SELECT 'flows', concat('{{"seq":', seq, ',"id":"', id, '","name":"', name, '","tx":"', tx, '","region":"', region, '","classification":"', classification, '","owner":"', owner,
  '","source":"', source, '","target":"', target, '"}}') FROM registry
UNION ALL (SELECT 'audit', concat('{{"tx":"', tx, '","action":"', action, '","dataset":"', dataset, '","result":"', result, '"}}') FROM audit_events ORDER BY ts DESC, tx DESC LIMIT 20)
UNION ALL SELECT 'compliance', concat('{{"law":"', law, '","rules":', rules, ',"violations":', violations, ',"auto_fixes":', auto_fixes, ',"status":"', status, '"}}') FROM summary""")
def a29(t):
    from ledgerloom.catalog.governance import a17

    events = audit.recent(t("audit_events"), 20).select("tx", "action", "dataset", "result")
    return O.full_report(reg.overview(t("registry")), t("registry").select(*_A29_FLOWS), events, a17(t))


@query("e2_ingest_run", """
SELECT content_hash, records, expectations, region FROM (
  SELECT sha256(payload) AS content_hash, CASE WHEN format = 'csv' THEN length(payload) - length(replace(payload, chr(10), '')) + 1 ELSE 1 END AS records, 12 AS expectations,
    NAMES(regions_text)[1] AS region, octet_length(encode(payload)) AS b, length(payload) - length(replace(payload, chr(10), '')) + 1 AS l,
    (octet_length(encode(payload)) - octet_length(encode(replace(payload, ',,', '')))) / 2 AS g, format FROM payloads
  WHERE length(dataset_name) >= 3 AND regexp_full_match(dataset_name, '[a-z0-9_]+') AND length(payload) >= 1 AND format IN ('csv', 'json', 'parquet', 'avro')
    AND NOT contains(regions_text, 'TOO-LONG') AND length(purpose) >= 3 AND length(tags_text) <= 40)
WHERE least(6.0, greatest(1.0, CAST(6 AS DOUBLE) - CASE WHEN format = 'csv' THEN g / b * 20 ELSE 0 END - CASE WHEN b / l < 5 THEN 1.5 ELSE 0 END - CASE WHEN b / l > 5000 THEN 1 ELSE 0 END)) >= 4.0""")
def e2(t):
    from ledgerloom.plans.jobs import ingest_job

    out = ingest_job(t("payloads"))
    return out["measurements"].select(
        "content_hash", big("records_processed").alias("records"), big("expectations_passed").alias("expectations"), "region")


_E2 = """marked AS (SELECT *, sha256(payload) AS content_hash, concat('ds-', left(sha256(concat(dataset_name, '|', sha256(payload))), 12)) AS dataset_id,
    octet_length(encode(payload)) AS b, length(payload) - length(replace(payload, chr(10), '')) + 1 AS l, (octet_length(encode(payload)) - octet_length(encode(replace(payload, ',,', '')))) / 2 AS g,
    length(dataset_name) >= 3 AND regexp_full_match(dataset_name, '[a-z0-9_]+') AND length(payload) >= 1 AND format IN ('csv', 'json', 'parquet', 'avro')
      AND NOT contains(regions_text, 'TOO-LONG') AND length(purpose) >= 3 AND length(tags_text) <= 40 AS valid FROM payloads),
scored AS (SELECT *, CASE WHEN b = 0 THEN 1.0 ELSE least(6.0, greatest(1.0, CAST(6 AS DOUBLE) - CASE WHEN format = 'csv' THEN g / b * 20 ELSE 0 END - CASE WHEN b / l < 5 THEN 1.5 ELSE 0 END
    - CASE WHEN b / l > 5000 THEN 1 ELSE 0 END)) END AS sigma FROM marked),
lined AS (SELECT *, concat('TX_', left(sha256(concat('ingest|', content_hash)), 24)) AS tx_id, concat('ingest-', dataset_id) AS job_id, RFC3339(ts) AS timestamp,
    NAMES(regions_text)[1] AS region, concat('Qm', left(sha256(content_hash), 44)) AS ipfs_cid FROM scored WHERE valid AND sigma >= 4.0)"""


@query("e2_ingest_outcomes", f"WITH {_E2} SELECT payload_id, content_hash, CASE WHEN NOT valid THEN 'invalid' WHEN sigma >= 4.0 THEN 'accepted' ELSE 'quarantined' END AS outcome FROM scored")
def e2b(t):
    from ledgerloom.plans.jobs import ingest_job

    out = ingest_job(t("payloads"))
    kept = t("payloads").select("payload_id", sha256(F.col("payload")).alias("content_hash"))
    refused = out["invalid"].select("payload_id", F.lit("invalid").alias("outcome")).unionByName(
        out["quarantined"].select("payload_id", F.lit("quarantined").alias("outcome")))
    return kept.join(refused, "payload_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("accepted")))


@query("e2_ingest_lineage", f"""WITH {_E2} SELECT tx_id, job_id, timestamp, dataset_id AS output_dataset_id, content_hash AS output_hash, 'manual-ingest' AS pipeline_id, sigma AS sigma_level, classification,
  laws_text AS jurisdictions, region, ipfs_cid, sha256(concat_ws('|', tx_id, job_id, timestamp, '', '', dataset_id, content_hash, 'INGEST', 'manual-ingest', '', CAST(CAST(sigma AS DECIMAL(12,4)) AS VARCHAR),
  classification, laws_text, '', '', '', region, ipfs_cid)) AS genome_hash FROM lined""")
def e2c(t):
    from ledgerloom.plans.jobs import ingest_job

    return ingest_job(t("payloads"))["lineage"].select(
        "tx_id", "job_id", "timestamp", "output_dataset_id", "output_hash", "pipeline_id", "sigma_level", "classification",
        joined("jurisdictions").alias("jurisdictions"), "region", "ipfs_cid", "genome_hash")


@query("e2_ingest_measurements", f"""WITH {_E2} SELECT dataset_id, concat('run-', left(sha256(concat_ws('|', tx_id, dataset_id, strftime(ts, '%Y-%m-%d %H:%M:%S'))), 8)) AS run_id,
  concat('M-manual-ingest-', left(tx_id, 12)) AS measurement_id, sigma AS sigma_level, timestamp, CASE WHEN format = 'csv' THEN l ELSE 1 END AS records_processed, 0 AS records_failed, region, tx_id FROM lined""")
def e2d(t):
    from ledgerloom.plans.jobs import ingest_job

    return ingest_job(t("payloads"))["measurements"].select(
        "dataset_id", "run_id", "measurement_id", "sigma_level", "timestamp", "records_processed", "records_failed", "region", "tx_id")


# ---- sales templates --------------------------------------------------------------------

_LAST_MONTH = "sale_date >= DATE '1998-06-01' AND sale_date < DATE '1998-07-01'"


@query("q1_top_regions", f"SELECT region, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM sales WHERE {_LAST_MONTH} GROUP BY region ORDER BY 2 DESC, 1 LIMIT 100")
def q1(t):
    return templates.top_regions(t("sales_region"), SALES_AS_OF)


@query("q1_top_regions_this_month", "SELECT region, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM sales WHERE sale_date >= DATE '1998-07-01' GROUP BY region ORDER BY 2 DESC, 1 LIMIT 3")
def q1b(t):
    return templates.top_regions(t("sales_region"), SALES_AS_OF, "this month", 3)


_MEAN = "CAST(sum(CAST(sigma_level AS DECIMAL(18,4))) AS DOUBLE) / count(*)"


@query("q2_flows_below", f"SELECT pipeline_id, {_MEAN} AS avg_sigma, count(*) AS runs FROM measurements GROUP BY 1 HAVING {_MEAN} < 5.4 ORDER BY 2, 1 LIMIT 100")
def q2(t):
    return templates.flows_below(t("measurements"), 5.4)


@query("q3_daily_revenue", "SELECT CAST(sale_date AS VARCHAR) AS day, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE sale_date >= DATE '1998-06-15' GROUP BY 1 ORDER BY 1 DESC LIMIT 100")
def q3(t):
    return templates.daily_revenue(t("sales_day"), SALES_AS_OF).withColumn("day", F.col("day").cast("string"))


@query("q4_scan", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 100")
def q4(t):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    return templates.scan(t("lineitem").select(*columns), columns)


@query("q5_region_sales_last_month", f"SELECT region, CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(*) AS orders FROM sales WHERE {_LAST_MONTH} GROUP BY region ORDER BY 2 DESC, 1 LIMIT 20")
def q5(t):
    return templates.region_sales_last_month(t("sales_region"), SALES_AS_OF)


@query("q6_top_products", "SELECT product_id, product_name, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10")
def q6(t):
    return templates.top_products(t("sales_part"), t("sale_products"))


@query("q7_quality_rollup", f"SELECT pipeline_id, {_MEAN} AS avg_sigma, count(*) AS runs, CAST(sum(records_failed) AS BIGINT) AS total_defects FROM measurements GROUP BY 1")
def q7(t):
    return templates.quality_rollup(t("measurements"))


@query("q8_top5_regions_30_days", "SELECT region, CAST(sum(revenue) AS DOUBLE) AS total FROM sales WHERE sale_date >= DATE '1998-06-15' GROUP BY region ORDER BY 2 DESC, 1 LIMIT 5")
def q8(t):
    return templates.top_regions_30_days(t("sales_region"), SALES_AS_OF)


@query("q9_region_sales_since_last_month", "SELECT region, CAST(sum(revenue) AS DOUBLE) AS total FROM sales WHERE sale_date >= DATE '1998-06-01' GROUP BY region")
def q9(t):
    return templates.region_sales_since_last_month(t("sales_region"), SALES_AS_OF)


@query("q10_answers", f"""
SELECT 'highest revenue by region last month' AS question, region AS name, CAST(sum(revenue) AS DOUBLE) AS value, CAST(NULL AS BIGINT) AS n FROM sales WHERE {_LAST_MONTH} GROUP BY region
UNION ALL SELECT 'top regions', region, CAST(sum(revenue) AS DOUBLE), NULL FROM sales WHERE sale_date >= DATE '1998-07-01' GROUP BY region
UNION ALL SELECT 'flows with quality below 5.4', pipeline_id, {_MEAN}, count(*) FROM measurements GROUP BY pipeline_id HAVING {_MEAN} < 5.4
UNION ALL (SELECT 'daily sales', CAST(sale_date AS VARCHAR), CAST(sum(revenue) AS DOUBLE), NULL FROM sales WHERE sale_date >= DATE '1998-06-15' GROUP BY sale_date ORDER BY sale_date DESC LIMIT 100)
UNION ALL (SELECT 'anything else', CAST(order_id AS VARCHAR), CAST(revenue AS DOUBLE), product_id FROM sales ORDER BY order_id, product_id, revenue LIMIT 100)""")
def q10b(t):
    """One question for each of the five branches; every answer in the same columns."""
    shapes = {
        "highest revenue by region last month": ("region", "total_revenue", None), "top regions": ("region", "total_revenue", None),
        "flows with quality below 5.4": ("pipeline_id", "avg_sigma", "runs"), "daily sales": ("day", "revenue", None), "anything else": ("order_id", "revenue", "product_id"),
    }
    answers = None
    for question, (name, value, n) in shapes.items():
        sold = t("sales").select("region", "sale_date", "order_id", "product_id", "revenue")
        _, out = questions.answer(question, sold, t("measurements"), SALES_AS_OF, ["order_id", "product_id", "revenue"])
        row = out.select(
            F.lit(question).alias("question"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"),
            (F.col(n) if n else F.lit(None)).cast("bigint").alias("n"),
        )
        answers = row if answers is None else answers.unionByName(row)
    return answers


@query("q10_answer", f"SELECT region, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM sales WHERE {_LAST_MONTH} GROUP BY region ORDER BY 2 DESC, 1 LIMIT 100")
def q10(t):
    question = "పైప్‌లైన్ చివరి నెలలో అత్యధిక ఆదాయం by region"
    _, out = questions.answer(question, t("sales"), t("measurements"), SALES_AS_OF, ["order_id", "product_id"])
    return out


_Q14 = {
    "what needs attention": "general_dashboard_query", "which flows are at risk?": "risk_pipeline_search", "dpdp status": "dpdp_compliance_query", "gdpr status": "gdpr_compliance_query",
    "audit of transactions": "audit_chain_query", "best sigma": "quality_score_query", "what was executed": "pipeline_run_query",
}
_Q14_FLOWS = {
    "what needs attention": "true", "which flows are at risk?": "status <> 'healthy' OR sigma < 5.0", "dpdp status": "list_contains(list_transform(NAMES(laws_text), lambda x: upper(x)), 'DPDP')",
    "gdpr status": "list_contains(list_transform(NAMES(laws_text), lambda x: upper(x)), 'GDPR')", "best sigma": "true", "what was executed": "true",
}
_Q14_EVENTS = {"dpdp status": "law = 'DPDP'", "gdpr status": "law = 'GDPR'"}
_Q14_SQL = " UNION ALL ".join(
    [f"SELECT '{q}' AS question, '{_Q14[q]}' AS route, 'flow' AS kind, id AS item FROM registry WHERE {where}" for q, where in _Q14_FLOWS.items()]
    + [f"(SELECT '{q}', '{route}', 'event', tx FROM audit_events WHERE {_Q14_EVENTS.get(q, 'true')} ORDER BY ts DESC, tx DESC LIMIT {10 if route == 'audit_chain_query' else 5})"
       for q, route in _Q14.items()]
)


@query("q14_ask_all", _Q14_SQL)
def q14b(t):
    """One question a route: its flows and its events."""
    out = None
    for question in _Q14:
        route, flows, events = questions.ask(question, t("registry"), t("audit_events"))
        parts = [events.select(F.lit("event").alias("kind"), F.col("tx").alias("item"))]
        if flows is not None:
            parts.append(flows.select(F.lit("flow").alias("kind"), F.col("id").alias("item")))
        for part in parts:
            rows = part.select(F.lit(question).alias("question"), F.lit(route).alias("route"), "kind", "item")
            out = rows if out is None else out.unionByName(rows)
    return out


@query("q14_ask", "SELECT id, status FROM registry WHERE status <> 'healthy' OR sigma < 5.0")
def q14(t):
    _, flows, _ = questions.ask("which flows are at risk?", t("registry"), t("audit_events"))
    return flows.select("id", "status")
