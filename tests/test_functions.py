"""Hand-computed results of the column functions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import hashing as H, masking as M, sigma as S, text as T


def one(spark, value, function, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize("value,expected", [
    (None, None), ("", None), ("123", None), ("1 3", None), ("1234", "INVALID_AADHAAR"), ("123456789012", "XXXX-XXXX-9012"),
    ("1234-5678-9012", "XXXX-XXXX-9012"), ("1234 5678 9012", "XXXX-XXXX-9012"), ("12345678901x", "INVALID_AADHAAR"),
    ("12345678901\n", "INVALID_AADHAAR"), ("1234567890123", "INVALID_AADHAAR"),
])
def test_aadhaar(spark, value, expected):
    assert one(spark, value, M.mask_aadhaar) == expected


@pytest.mark.parametrize("value,expected", [
    (None, None), ("", "INVALID_PHONE"), ("+91-12", "INVALID_PHONE"), ("12345678", "XXXX5678"), ("+91 98765-43210", "XXXXXXXX3210"),
    ("not-a-number", "XXXXXXmber"),
])
def test_phone(spark, value, expected):
    assert one(spark, value, M.mask_phone) == expected


@pytest.mark.parametrize("value,expected", [
    (None, None), ("plain", None), ("ravi@apollo.com", "r***@apollo.com"), ("x@y.z", "*@y.z"), ("@y.z", "*@y.z"), ("a.b@c@d", "a***@c@d"),
])
def test_email(spark, value, expected):
    assert one(spark, value, M.mask_email) == expected


@pytest.mark.parametrize("value,expected", [
    (None, None), ("", "."), ("   ", "."), ("Ravi Kumar Sharma", "R. K. S."), ("  ravi\tkumar ", "R. K."), ("élodie x", "É. X."),
])
def test_name(spark, value, expected):
    assert one(spark, value, M.mask_name) == expected


def test_masking_twice_reveals_nothing(spark):
    df = spark.createDataFrame([("123456789012",)], "v string").select(M.mask_aadhaar(M.mask_aadhaar(F.col("v"))))
    assert df.first()[0] == "INVALID_AADHAAR"


@pytest.mark.parametrize("rate,expected", [
    (1.0, 6.0), (0.999991, 5.5), (0.9998, 5.0), (0.9987, 4.5), (0.994, 4.0), (0.98, 3.5), (0.94, 3.0), (0.5, 2.0), (None, 0.0),
])
def test_sigma_ladder(spark, rate, expected):
    assert one(spark, rate, S.sigma_from_pass_rate, "double") == expected


@pytest.mark.parametrize("sigma,expected", [(4.5, 6210.0), (5.5, 3.4), (5.2, 233.0), (2.5, 308537.0), (3.5, 6210.0), (0.4, 999999.0)])
def test_rounded_defects(spark, sigma, expected):
    assert one(spark, sigma, S.sigma_to_dpm_rounded, "double") == expected


@pytest.mark.parametrize("payload,edge,api", [
    ("", 1.0, 1.0), ("," * 20, 1.0, 1.0), ("a,b\n1,2", 5.0, 4.5), ("name,age,city\n" * 10, 6.0, 6.0), (",,,", 6 - 10 / 3 - 1, 1.0),
])
def test_payload_sigma(spark, payload, edge, api):
    assert one(spark, payload, S.payload_sigma_edge) == pytest.approx(max(1.0, edge))
    found = one(spark, payload, lambda v: S.payload_sigma_api(v, F.lit("csv")))
    assert found == pytest.approx(api)


def test_broken_utf8_costs_points(spark):
    df = spark.createDataFrame([(b"\xff\xfe" + b"a" * 200,)], "v binary").select(F.col("v").cast("string").alias("v"))
    assert df.select(S.payload_sigma_edge(F.col("v"))).first()[0] == 4.0
    assert df.select(S.payload_sigma_api(F.col("v"), F.lit("json"))).first()[0] == 3.5
    assert df.select(S.payload_sigma_api(F.col("v"), F.lit("parquet"))).first()[0] == 6.0


@pytest.mark.parametrize("text", [
    "plain", 'quote " and \\ slash', "line\nfeed\ttab\rret\b\f\x01\x7f", "é ₹ తెలుగు", "😀 beyond", "", "a]b[c",
])
def test_json_string_equals_python(spark, text):
    assert one(spark, text, H.json_string) == json.dumps(text)


@pytest.mark.parametrize("number", [1704067200.0, 5.5, 0.25, 1704067200.123, 100000000.5, 3.0])
def test_json_float_equals_python(spark, number):
    assert one(spark, number, H.json_float, "double") == json.dumps(number)


def test_tx_id_equals_python(spark):
    record = {"b": "x", "a": ["p", "q"]}
    expected = "TX_" + hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()[:24]
    built = H.tx_id({"b": H.json_string(F.lit("x")), "a": H.json_list(F.array(F.lit("p"), F.lit("q")))})
    assert spark.range(1).select(built).first()[0] == expected


def test_rounding_equals_python(spark):
    import random

    from ledgerloom.functions.numbers import exact_sum, fixed, rounded

    rng = random.Random(5)
    numbers = [4.835, 5.315, 5.125, -56.25, 0.15, 2.675, 1.005, 0.0, 99.995, -0.04, 5.0, 1e9 + 0.125, 0.5, 1.5, 2.5]
    numbers += [rng.randrange(10 ** 6) / 10 ** rng.randrange(1, 6) for _ in range(3000)] + [rng.uniform(0, 100) for _ in range(500)]
    df = spark.createDataFrame([(n,) for n in numbers], "n double")
    got = df.select("n", *[f(F.col("n"), p).alias(f"{f.__name__}{p}") for f in (rounded, fixed) for p in (0, 1, 2, 4)]).collect()
    for row in got:
        for places in (0, 1, 2, 4):
            assert row[f"rounded{places}"] == round(row.n, places), (row.n, places)
            assert row[f"fixed{places}"] == f"{row.n:.{places}f}", (row.n, places)
    tenth = spark.createDataFrame([(0.1,)] * 10, "n double").repartition(4)
    assert tenth.select(exact_sum(F.col("n"))).first()[0] == 1.0


def test_dna_hash_equals_python(spark):
    record = {
        "dataset_id": "d1", "creator_id": "alice", "created_at": 1704067200.5, "classification": "PII",
        "jurisdictions": ["IN_DPDP_2023"], "parent_ids": [], "transformation": "raw", "quality_sigma": 5.5,
        "content_hash": "c", "ipfs_cid": "Qm", "fabric_tx_id": "TX_1",
    }
    expected = hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()
    schema = "dataset_id string, creator_id string, created_at double, classification string, jurisdictions array<string>, " \
             "parent_ids array<string>, transformation string, quality_sigma double, content_hash string, ipfs_cid string, fabric_tx_id string"
    df = spark.createDataFrame([tuple(record.values())], schema)
    assert df.select(H.dna_hash()).first()[0] == expected
    changed = df.withColumn("creator_id", F.lit("mallory"))
    assert changed.select(H.dna_hash()).first()[0] != expected


def test_lineage_hash_keeps_nulls_in_place(spark):
    names = list(H.LINEAGE_HASH_FIELDS)
    row = {n: n for n in names} | {"input_dataset_ids": ["a", "b"], "input_hashes": [], "jurisdictions": ["GDPR"], "sigma_level": 5.25, "ipfs_cid": None}
    schema = ", ".join(f"{n} {'array<string>' if n in H.ARRAY_FIELDS else 'double' if n == 'sigma_level' else 'string'}" for n in names)
    parts = [("a,b" if n == "input_dataset_ids" else "" if n in ("input_hashes", "ipfs_cid") else "GDPR" if n == "jurisdictions"
              else "5.2500" if n == "sigma_level" else n) for n in names]
    expected = hashlib.sha256("|".join(parts).encode()).hexdigest()
    assert spark.createDataFrame([tuple(row[n] for n in names)], schema).select(H.lineage_hash()).first()[0] == expected


def test_signature(spark):
    df = spark.createDataFrame([("{}", "k")], "p string, k string")
    signed = df.withColumn("s", H.sign(F.col("p"), F.col("k")))
    assert signed.select(H.verify(F.col("p"), F.col("k"), F.col("s"))).first()[0]
    assert not signed.select(H.verify(F.lit("{!}"), F.col("k"), F.col("s"))).first()[0]


@pytest.mark.parametrize("text,expected", [
    ("Send daily report at 6am", "0 6 * * *"), ("at 9 pm", "0 21 * * *"), ("at 12 am", "0 0 * * *"), ("at 12 pm", "0 12 * * *"),
    ("check every 15 minutes", "*/15 * * * *"), ("every 005 minute", "*/5 * * * *"), ("format 3 tables", "0 3 * * *"), ("hourly sync", "0 * * * *"),
    ("each week", "0 6 * * MON"), ("monthly", "0 6 1 * *"), ("real-time feed", "@continuous"), ("streaming", "@continuous"),
    ("nothing", "0 6 * * *"), ("birthday", "0 6 * * *"), ("midweek hourly", "0 * * * *"),
])
def test_schedule(spark, text, expected):
    assert one(spark, text, T.extract_schedule) == expected


@pytest.mark.parametrize("text,expected", [
    ("Send daily sales reports for top 5 regions", "REPORT"), ("alert me", "ALERT"), ("when revenue drops", "ALERT"),
    ("when revenue\ndrops", "PIPELINE"), ("whenever it drops", "PIPELINE"), ("validate this", "QUALITY"), ("gdpr please", "COMPLIANCE"),
    ("édaily report_x", "PIPELINE"), ("move a to b", "PIPELINE"), ("reports", "PIPELINE"),
])
def test_intent(spark, text, expected):
    assert one(spark, text, T.classify_intent) == expected


@pytest.mark.parametrize("text,expected", [
    ("Alert me when revenue drops", "alert"), ("my life", "alert"), ("నివేదిక కావాలి", "report"), ("trend of x", "insight"), ("hello", "pipeline"),
])
def test_intent_keywords(spark, text, expected):
    assert one(spark, text, T.classify_intent_keywords) == expected


@pytest.mark.parametrize("text,language", [("అమ్మకాలు sales", "te"), ("बिक्री", "hi"), ("அ", "ta"), ("sales é", "en"), ("बिक्री అ", "te")])
def test_language(spark, text, language):
    assert one(spark, text, T.detect_language) == language


def test_translation(spark):
    def en(v):
        return T.translate_phrases(v, T.detect_language(v))

    assert one(spark, "చివరి నెలలో అత్యధిక ఆదాయం", en) == "last month highest revenue"
    assert one(spark, "पिछले महीने शीर्ष राजस्व", en) == "last month top revenue"
    assert one(spark, "పైప్‌లైన్", en) == "pipeline"
    assert one(spark, "அ sales", en) == "அ sales"


@pytest.mark.parametrize("text,route", [
    ("any risky flows", "risk_pipeline_search"), ("museum", "gdpr_compliance_query"), ("india privacy", "dpdp_compliance_query"),
    ("show tx", "audit_chain_query"), ("best ones", "quality_score_query"), ("last run", "pipeline_run_query"), ("hello", "general_dashboard_query"),
])
def test_route(spark, text, route):
    assert one(spark, text, T.route_question) == route


def test_flow_spec(spark):
    df = spark.createDataFrame([("create a kafka pipeline for customer churn in the eu ",)], "v string")
    row = df.select(*[c.alias(n) for n, c in T.flow_spec(F.col("v")).items()]).first()
    assert tuple(row) == ("kafka", "GDPR", "EU-DE", "fabric_node_frankfurt", "customer_churn")
    assert one(spark, "build me a stream", T.is_create_request) is True
    assert one(spark, "show my pipeline", T.is_create_request) is False


def test_identifier_and_path(spark):
    assert one(spark, "Sales-Table_1", T.safe_identifier) == "alesable_1"
    assert one(spark, "/api/v1/dataset/deadbeef-01/runs/42", T.normalize_path) == "/api/v1/dataset/{id}/runs/{id}"
    assert one(spark, "quality below 4.2 sigma", T.sigma_threshold) == 4.2
    assert one(spark, "quality", T.sigma_threshold) == 4.5
