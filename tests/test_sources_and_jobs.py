"""Files, ledgers, external options and the end-to-end jobs on disk."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.jobs import MaskingJob, catalogue_job, ingest_job, mask_job
from ledgerloom.sources import external, files, ledger, pages


@pytest.fixture
def people_csv(tables, tmp_path):
    path = str(tmp_path / "raw")
    tables("people").coalesce(1).write.option("header", True).csv(path)
    return path


def job(path, tmp_path, **more):
    return MaskingJob(path, str(tmp_path / "out"), "people_daily", "r1", "2024-01-05 06:00:00", **more)


def test_raw_csv_is_text(spark, people_csv):
    df = files.read_raw_csv(spark, people_csv)
    assert {f.dataType.simpleString() for f in df.schema} == {"string"} and df.count() == 150


def test_mask_job(spark, people_csv, tmp_path):
    done = mask_job(spark, job(people_csv, tmp_path))
    assert (done.status, done.exit_code) == ("COMPLETED", 0)
    out = spark.read.parquet(done.record["output_path"])
    assert out.count() == done.record["input_rows"] == done.record["output_rows"] == 150
    assert not {"aadhaar", "phone", "email", "name"} & set(out.columns)
    assert os.path.isdir(os.path.join(done.record["output_path"], "run_region=IN-TG"))
    side = os.path.join(done.record["output_path"], "_LINEAGE.json")
    text = "".join(open(os.path.join(side, f)).read() for f in os.listdir(side) if f.startswith("part-"))
    assert json.loads(text)["fabric_tx_id"] == done.record["fabric_tx_id"]
    again = mask_job(spark, job(people_csv, tmp_path))
    assert again.record == done.record and spark.read.parquet(again.record["output_path"]).count() == 150
    assert done.route == "quarantine" and done.record["exit_sigma"] == 2.0  # reported, not enforced


def test_output_layouts(spark, tables, people_csv, tmp_path):
    done = mask_job(spark, job(people_csv, tmp_path, output_files=2))
    assert spark.read.parquet(done.record["output_path"]).count() == 150
    path = files.write_curated(tables("people"), str(tmp_path / "many"), "r2", region_column="region", rebalance=True)
    assert spark.read.parquet(path).filter("region = 'US'").count() == tables("people").filter("region = 'US'").count() > 0


def test_mask_job_quarantines(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.range(20).select(F.lit(None).cast("string").alias("email"), F.col("id").cast("string").alias("x")).write.option("header", True).csv(path)
    done = mask_job(spark, job(path, tmp_path))
    assert (done.status, done.exit_code) == ("QUARANTINED", 2)
    assert spark.read.parquet(done.record["output_path"]).count() == 20
    assert done.record["fabric_tx_id"].startswith("TX_")


def test_mask_job_skips_without_input(spark, tmp_path):
    assert mask_job(spark, job(str(tmp_path / "missing"), tmp_path)).status == "SKIPPED"
    os.makedirs(tmp_path / "empty")
    assert files.preflight_input(spark, str(tmp_path / "empty")) == "skip"


def test_payload_formats(spark):
    df = spark.createDataFrame([(1, "a,b\n1,x\n2,y\n"), (2, "a,b\r\n3,z")], "k int, payload string")
    rows = files.parse_payloads(df, "csv", "a int, b string").select("k", "a", "b").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, "x"), (1, 2, "y"), (2, 3, "z")]
    js = spark.createDataFrame([('{"a": 1}',), ("broken",)], "payload string")
    assert [r.a for r in files.parse_payloads(js, "json", "a int").collect()] == [1, None]
    with pytest.raises(ValueError):
        files.parse_payloads(js, "avro", "a int")


def test_files_by_format(spark, tmp_path):
    df = spark.range(3).selectExpr("id", "CAST(id AS STRING) AS name")
    df.write.json(str(tmp_path / "j"))
    df.write.parquet(str(tmp_path / "p"))
    assert files.read_files(spark, "json", str(tmp_path / "j"), "id long, name string").count() == 3
    assert files.read_files(spark, "parquet", str(tmp_path / "p")).count() == 3
    with pytest.raises(ValueError):
        files.read_files(spark, "xml", str(tmp_path / "p"))


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.range(50).selectExpr("concat('k', id % 10) AS key", "id AS n", "concat('t', id) AS tx")
    ledger.append_ledger(rows, path, "key", 4)
    ledger.append_ledger(rows.limit(5).withColumn("key", F.lit("k3")), path, "key", 4)
    found = ledger.read_key(spark, path, "key", "k3", 4)
    assert found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan
    once = str(tmp_path / "once")
    for _ in range(2):
        ledger.append_new(rows, once, "tx", "n", 4)
    assert ledger.read_ledger(spark, once).count() == 50


def test_unreadable_records(spark, tmp_path):
    lines = ['{"pipeline_id": "p", "sigma_level": 5.0}', '{"pipeline_id": broken']
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(str(tmp_path / "m"))
    assert [r.pipeline_id for r in ledger.read_records(spark, str(tmp_path / "m"), "measurements").collect()] == ["p"]
    with pytest.raises(Exception, match="MALFORMED"):
        ledger.read_records(spark, str(tmp_path / "m"), "lineage").collect()


def test_external_options(spark):
    options = external.jdbc_options("jdbc:postgresql://db/x", "registry", "id", (0, 100), 4)
    assert options["numPartitions"] == "4" and options["dbtable"] == "registry"
    assert external.kafka_options("b:9092", "lineage")["subscribe"] == "lineage"
    raw = spark.createDataFrame([('{"pipeline_id": "p", "sigma_level": 5.5}',), ("nonsense",)], "value string")
    rows = external.decode(raw, external.TOPICS["quality"]).collect()
    assert (rows[0].pipeline_id, rows[0].sigma_level) == ("p", 5.5) and rows[1].pipeline_id is None


def test_unreadable_bodies_are_told_apart(spark):
    bodies = [
        '{"pipeline_id": "p", "sigma_level": 5.5, "more": 1}', "nonsense", None, "", "{}", '{"pipeline_id": "q", "sigma_level": "high"}',
        '[{"pipeline_id": "r"}]', "null", ' {"pipeline_id": null}', '{"pipeline_id": "cut',
    ]
    raw = spark.createDataFrame([(None if b is None else b.encode(),) for b in bodies], "value binary")
    decoded = external.decode(raw, external.TOPICS["quality"])
    assert [r.unreadable for r in decoded.collect()] == [
        None, "nonsense", "", "", None, bodies[5], bodies[6], "null", None, bodies[9],
    ]
    assert [r.pipeline_id for r in external.readable(decoded).collect()] == ["p", None, None]
    assert external.unreadable(decoded).count() == 7 and "unreadable" not in external.readable(decoded).columns


def files_read(df):
    return {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}


def test_page_index(spark, tmp_path):
    rows = [(None if i % 50 == 0 else i * 7919 % 1000 // 3, i) for i in range(1000)]  # ties and null keys
    df = spark.createDataFrame(rows, "k int, id int")
    order = [F.col("k").desc(), F.col("id")]
    index = pages.write_pages(df, order, str(tmp_path / "index"), ranges=8)
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    for offset, limit in ((0, 10), (0, 0), (120, 3), (95, 300), (990, 50), (999, 1), (1000, 5), (4000, 5), (0, 2000)):
        assert [tuple(r) for r in index.rows_at(offset, limit).collect()] == want[offset : offset + limit]
    assert [tuple(r) for r in index.page(20, 50).collect()] == want[950:] and index.page(21, 50).count() == 0
    assert tuple(index.page_info(19, 50).first()) == (1000, 19, 50, True) and not index.page_info(20, 50).first().has_next
    assert [tuple(r) for r in index.page_cursor("x", 2).collect()] == want[:2]
    assert index.next_cursor("990", 5).first().next_cursor == "995" and index.next_cursor("995", 5).first().next_cursor is None
    assert len(files_read(index.rows_at(0, 1000))) == 8
    for held in index.ranges().collect():
        inside = index.rows_at(held.before + 1, held.rows - 2)
        assert files_read(inside) == {f"_range={held._range}"}  # a page inside one range reads that range alone
        assert "Exchange hashpartitioning" not in inside._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        index.rows_at(-1, 5)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        pages.write_pages(df, order, str(tmp_path / "index"))


def test_page_index_of_an_empty_table(spark, tmp_path):
    index = pages.write_pages(spark.createDataFrame([], "k int, id int"), [F.col("k")], str(tmp_path / "index"))
    assert index.page(1, 5).columns == ["k", "id"] and index.page(1, 5).count() == 0
    assert tuple(index.page_info().first()) == (0, 1, 50, False) and index.next_cursor().first().next_cursor is None


def test_ingest_job_partitions_its_input(tables):
    payloads = tables("payloads")
    out = ingest_job(payloads)
    assert out["invalid"].count() + out["quarantined"].count() + out["measurements"].count() == payloads.count()
    assert out["datasets"].count() == out["lineage"].count() == out["measurements"].count()
    assert out["datasets"].filter("length(genome_hash) <> 64").count() == 0


def test_catalogue_job(tables):
    from ledgerloom.catalog.estate import asked

    out = catalogue_job(tables("puts"), asked(tables), tables("nodes"))
    status = out["status"].first()
    assert status.total_datasets == out["particles"].count() and status.total_movements == out["moves"].count()


def test_records_do_not_depend_on_the_columns_asked_for(spark, tmp_path):
    lines = ['{"pipeline_id": "p", "sigma_level": 5.0}', '{"pipeline_id": "q", "sigma_level": broken}']
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(str(tmp_path / "m"))
    found = ledger.read_records(spark, str(tmp_path / "m"), "measurements")
    assert found.count() == found.select("pipeline_id").count() == len(found.collect()) == 1
    with pytest.raises(Exception, match="MALFORMED"):
        ledger.read_records(spark, str(tmp_path / "m"), "lineage").count()


def test_period_reaches_the_scan(spark, tmp_path):
    from ledgerloom.operators.lineage import period

    rows = spark.range(100).selectExpr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) AS ts", "id AS tx_id")
    rows.selectExpr("*", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS timestamp").write.parquet(str(tmp_path / "t"))
    found = period(spark.read.parquet(str(tmp_path / "t")), "2024-01-01T05:00:00Z", "2024-01-01T07:00:00Z")
    assert sorted(r.tx_id for r in found.collect()) == [5, 6, 7]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 2024-01-01 05:00:00)" in plan and "< 2024-01-01 07:00:01)" in plan


def test_ingest_defaults(spark):
    from ledgerloom.operators.validation import validate_ingest

    row = spark.sql(
        "SELECT 'abc' AS dataset_name, 'a,b' AS payload, CAST(NULL AS STRING) AS format, array('GDPR') AS jurisdictions, array('EU') AS allowed_regions, "
        "'care' AS purpose, CAST(NULL AS ARRAY<STRING>) AS tags"
    )
    assert validate_ingest(row).first().failed_rules == []


@pytest.fixture
def ledgers(spark, tmp_path):
    from ledgerloom.sources.commits import Ledgers

    return Ledgers(spark, str(tmp_path / "ledgers"), buckets=4)


def test_mask_job_logs_its_run_once(spark, people_csv, tmp_path, ledgers):
    from ledgerloom.operators.lineage import verify_integrity

    for _ in range(2):
        done = mask_job(spark, job(people_csv, tmp_path), ledgers)
    line = ledgers.read("lineage").collect()
    assert [(r.tx_id, r.output_dataset_id, r.output_hash, r.timestamp) for r in line] == [
        (done.record["fabric_tx_id"], "people_daily_curated_r1", done.record["content_hash"], "2024-01-05T06:00:00Z")]
    assert [(r.verified, r.records) for r in verify_integrity(ledgers.read("lineage")).collect()] == [(True, 1)]
    measured = ledgers.read("measurements").collect()
    assert [(m.records_processed, m.sigma_level, len(m.measurement_hash)) for m in measured] == [(150, 2.0, 64)]
    assert ledgers.read("audit_events").first().action == "SPARK_PII_MASKING"
    assert {r.dataset for r in ledgers.read("check_results").collect()} == {"people_daily_raw", "people_daily_masked"}
    path = str(tmp_path / "bad")
    spark.range(20).select(F.lit(None).cast("string").alias("email"), F.col("id").cast("string").alias("x")).write.option("header", True).csv(path)
    bad = MaskingJob(path, str(tmp_path / "out"), "bad_daily", "r1", "2024-01-05 06:00:00")
    assert mask_job(spark, bad, ledgers).status == "QUARANTINED"
    assert sorted(r.result for r in ledgers.read("audit_events").collect()) == ["OK", "QUARANTINED"]
    assert {r.verified for r in verify_integrity(ledgers.read("lineage")).collect()} == {True}


def test_ingest_job_commits_full_records(spark, tables, ledgers, monkeypatch):
    from ledgerloom.operators.dna import verify_dna
    from ledgerloom.operators.lineage import verify_integrity
    from ledgerloom.sources.commits import Ledgers

    payloads = tables("payloads")
    plain = ingest_job(payloads)
    stage, staged = Ledgers._stage, []

    def dies(self, name, rows, key):
        if len(staged) == 2:
            raise RuntimeError("killed")
        staged.append(name)
        return stage(self, name, rows, key)

    monkeypatch.setattr(Ledgers, "_stage", dies)
    with pytest.raises(RuntimeError, match="killed"):
        ingest_job(payloads, ledgers=ledgers)
    monkeypatch.undo()
    assert not ledgers.has("lineage")
    for _ in range(2):
        out = ingest_job(payloads, ledgers=ledgers)
    for name, entity in (("lineage", "lineage"), ("measurements", "measurements"), ("datasets", "dataset_dna")):
        columns = [c for c in ledgers.read(entity).columns]
        stored = sorted(map(str, ledgers.read(entity).collect()))
        from ledgerloom.schemas import conform
        assert stored == sorted(map(str, conform(plain[name], entity).select(*columns).collect())) and len(stored) > 50
    line = ledgers.read("lineage")
    assert verify_integrity(line).filter("NOT verified").count() == 0
    assert line.filter("tx_id = '' OR timestamp = '' OR length(output_hash) <> 64 OR input_hashes IS NULL").count() == 0
    assert line.join(ledgers.read("dataset_dna"), F.col("tx_id") == F.col("fabric_tx_id")).count() >= line.count()
    assert out["datasets"].count() == verify_dna(out["datasets"]).filter("integrity_ok").count()
    assert ledgers.read("ingest_refused").count() + ledgers.read("ingest_quarantined").count() + line.count() == payloads.count()
    assert "payload" not in ledgers.read("ingest_refused").columns


def test_ingest_takes_flow_and_node_of_the_payload(spark, tables):
    some = tables("payloads").withColumns({"pipeline_id": F.when(F.col("payload_id") % 2 == 0, "pl-9").otherwise(""), "node_id": F.lit("edge-1")})
    rows = ingest_job(some)["lineage"].collect()
    assert {r.pipeline_id for r in rows} == {"pl-9", "manual-ingest"} and {r.node_id for r in rows} == {"edge-1"}


def test_compliance_job_commits_violations(tables, ledgers):
    from ledgerloom.plans.jobs import compliance_job

    requests = tables("transfer_requests")
    for _ in range(2):
        report, made = compliance_job(requests, ledgers=ledgers)
    assert ledgers.read("decisions").count() == requests.count()
    assert ledgers.read("violations").count() == made.agg(F.sum(F.size("violations"))).first()[0] > 100
    assert ledgers.read("compliance_reports").drop("batch").exceptAll(report).count() == 0
    assert ledgers.read("violations").filter("law IS NULL OR description IS NULL OR dataset_id IS NULL").count() == 0


def test_quality_job_logs_each_transaction_once(spark, tables, ledgers):
    from ledgerloom.operators import sla as SL
    from ledgerloom.plans.jobs import quality_job

    rows = tables("measurements").withColumns({"expectations_run": F.lit(12), "expectations_passed": F.lit(12)})
    early, late = rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1 OR event_id < 100")
    span = ("2024-01-01T00:00:00Z", "2024-12-31T00:00:00Z")
    quality_job(early, tables("sla"), span, ledgers=ledgers)
    out = quality_job(late, tables("sla"), span, 5, ledgers=ledgers)
    assert ledgers.read("measurements").count() == rows.count()
    whole = quality_job(rows, tables("sla"), span, 5)
    assert sorted(map(str, out["trend"].collect())) == sorted(map(str, whole["trend"].collect()))
    assert sorted(map(str, out["certificates"].collect())) == sorted(map(str, whole["certificates"].collect()))
    assert ledgers.read("sla_alerts").count() == SL.sla_breaches(rows, tables("sla")).count() > 0
    again = quality_job(late, tables("sla"), span, 5, ledgers=ledgers)
    assert again["measurements"].count() == 0 and ledgers.read("measurements").count() == rows.count()


def test_catalogue_run_keeps_state(spark, tables, ledgers):
    """A plain model of the catalogue, run by run: puts, needs in order with capacity, then eviction."""
    from ledgerloom.operators import catalogue as K
    from ledgerloom.plans.jobs import catalogue_run
    from ledgerloom.sources.commits import Conflict

    nodes = spark.createDataFrame(
        [("edge-IN-TG-0", "IN-TG", 100, 0, "edge", True), ("edge-US-VA-1", "US-VA", 35, 5, "edge", True), ("hub-2", "IN", 20, 0, "core", True)],
        "node_id string, region string, capacity_bytes bigint, used_bytes bigint, node_type string, online boolean")

    def puts(rows):
        return spark.createDataFrame(rows, "seq bigint, payload string, node_id string, sigma double")

    def needs(rows):
        df = spark.createDataFrame(rows, "seq bigint, node_id string, region string, payload string")
        return df.select(F.concat(F.lit("n"), "seq").alias("need_id"), "seq", "node_id", "region", F.sha2("payload", 256).alias("content_hash"))

    a, b, c = "a" * 10, "b" * 20, "c" * 15
    first = puts([(1, a, "edge-IN-TG-0", 5.0), (2, b, "edge-IN-TG-0", 5.0), (3, c, "hub-2", 4.0)])
    asked = needs([(1, "edge-US-VA-1", "US-VA", a), (2, "edge-US-VA-1", "US-VA", b), (3, "edge-US-VA-1", "US-VA", c), (4, "edge-IN-TG-0", "IN-TG", a), (5, "hub-2", "IN", "nothing")])
    out = catalogue_run(ledgers, "r1", first, asked, nodes, "2024-01-01 00:00:00", cold_days=30)
    homes = lambda: {r.size_bytes: (list(r.home_nodes), r.state) for r in ledgers.read("particles").collect()}
    used = lambda: {r.node_id: r.used_bytes for r in ledgers.read("nodes").collect()}
    # a (10) and b (20) fit the 30 bytes left, c does not; the copies moved are cold at once and few asked for them: evicted again but for a, which
    # was near once
    assert out["plan"].filter("placed").count() == 2 and ledgers.read("movements").count() == 2
    assert homes() == {10: (["edge-IN-TG-0", "edge-US-VA-1"], "replicated"), 20: (["edge-IN-TG-0"], "replicated"), 15: (["hub-2"], "floating")}
    assert used() == {"edge-IN-TG-0": 0, "edge-US-VA-1": 15, "hub-2": 0}
    assert [r.size_bytes for r in ledgers.read("evictions").collect()] == [20]
    # the same batch again changes nothing
    version = ledgers.snapshot().version
    catalogue_run(ledgers, "r1", first, asked, nodes, "2024-01-01 00:00:00")
    assert ledgers.snapshot().version == version
    # next run: b was evicted, so it moves again and stays as it is asked for; c fits into what is left now
    many = needs([(i, "edge-US-VA-1", "US-VA", a) for i in range(10, 14)])
    out = catalogue_run(ledgers, "r2", puts([(9, c, "edge-IN-TG-0", 4.5)]), many.unionByName(asked), nodes, "2024-01-02 00:00:00")
    assert ledgers.read("accesses").filter("access_count >= 5").count() == 1
    assert homes()[15][0][:2] == ["hub-2", "edge-IN-TG-0"] or homes()[15][0] == ["hub-2"]
    state = ledgers.read("particles").collect()
    moved = {r.content_hash: r for r in ledgers.read("movements").filter("batch = 'r2'").collect()}
    assert sum(r.size_bytes for r in ledgers.read("movements").collect()) - sum(r.size_bytes for r in ledgers.read("evictions").collect() if r.evict_node == "edge-US-VA-1") == used()["edge-US-VA-1"] - 5
    status = K.catalogue_status(ledgers.read("particles"), ledgers.read("nodes"), ledgers.read("movements"), asked).first()
    assert (status.total_datasets, status.total_movements) == (3, 2 + len(moved)) and len(state) == 3
    # needs that are met move nothing
    met = needs([(20, "edge-US-VA-1", "US-VA", a)])
    before = ledgers.read("movements").count()
    catalogue_run(ledgers, "r3", first.limit(0), met, nodes, "2024-01-03 00:00:00")
    assert ledgers.read("movements").count() == before
    with pytest.raises(Conflict):
        ledgers.commit("stale", {"particles": (ledgers.read("particles", 0), "content_hash")}, replace=("particles",), based_on=0)


def test_nearest_by_region_keeps_every_row(spark):
    from ledgerloom.operators.catalogue import nearest_node_by_region

    nodes = spark.createDataFrame([("n1", "IN-TG"), ("n2", "US"), ("n3", "IN")], "node_id string, region string")
    rows = [(1, ["n2", "n1"], "IN-TG"), (1, ["n2", "n1"], "IN-TG"), (2, ["n2"], "EU"), (3, [], "IN"), (4, None, "IN"), (5, ["n3", "n1"], None), (6, ["gone", "n3"], "IN-KA")]
    found = nearest_node_by_region(spark.createDataFrame(rows, "k int, homes array<string>, region string"), nodes, "homes", "region").collect()
    assert sorted((r.k, r.nearest or "") for r in found) == [(1, "n1"), (1, "n1"), (2, "n2"), (3, ""), (4, ""), (5, "n3"), (6, "n3")]


def test_profiles_leave_violation_records(tables):
    from ledgerloom.operators import compliance as C, rules as R

    for profile in (C.decide_simulation, C.decide_fallback):
        made = profile(tables("transfer_requests"))
        assert made.filter(F.size("violations") != F.size("violated_rules")).count() == 0
        summary = {r.law: r.violations for r in C.framework_summary(R.rule_catalogue(made.sparkSession), made).collect()}
        exploded = {r.law: r["count"] for r in made.select(F.inline("violations")).groupBy("law").count().collect()}
        assert {k: v for k, v in summary.items() if v} == exploded and len(exploded) == 2


def test_csv_payloads_by_their_own_header(spark):
    import csv
    import io
    import random

    draw = random.Random(2)
    cells = ["", "x", "a,b", 'say "hi"', "two\nlines", "cr\r\nlf", " padded ", '"', ",", "é\u00fc", "1,5", '""', "long " * 5000]
    want, bodies = [], []
    for k in range(40):
        names = draw.sample(["a", "b", "c", "other"], draw.randrange(1, 5))
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=draw.choice(["\n", "\r\n"]))
        writer.writerow(names)
        for n in range(draw.randrange(5)):
            row = {name: str(n) if name == "a" else draw.choice(cells) for name in names}
            if list(row.values()) == [""]:
                row[names[0]] = "x"  # a record of one empty field is an empty line
            writer.writerow(row.values())
            if draw.random() < 0.2:
                out.write("\n")
            want.append((k, int(row["a"]) if "a" in row else None, row.get("b") or None, row.get("c") or None))
        bodies.append((k, ("\ufeff" if k == 3 else "") + out.getvalue().rstrip("\r\n" if k % 2 else "")))
    bodies += [(100, None), (101, ""), (102, "a,b"), (103, 'a,b\n1,"never closed\n2,x'), (104, "b,a,b\nfirst,7,second\nshort"), (105, "a,b\nnot a number,y\n3")]
    want += [(103, 1, "never closed\n2,x", None), (104, 7, "first", None), (104, None, "short", None), (105, None, "y", None), (105, 3, None, None)]
    df = spark.createDataFrame(bodies, "k int, payload string")
    found = files.parse_payloads(df, "csv", "a int, b string, c string").select("k", "a", "b", "c").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
