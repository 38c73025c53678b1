"""The registry of data flows: filters, rankings, totals, creation, run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.hashing import sha256
from ledgerloom.functions.numbers import exact_mean, rounded
from ledgerloom.functions.text import flow_spec, is_create_request
from ledgerloom.operators.ordered import latest_per_key, numbered, running_sum
from ledgerloom.session import cut_lineage


def _has_law(law: str) -> Column:
    return F.exists("laws", lambda x: F.upper(x) == law.upper())


def filter_registry(registry: DataFrame, status: str | None = None, law: str | None = None) -> DataFrame:
    """Status and law compare without regard to case."""
    if status:
        registry = registry.filter(F.lower("status") == status.lower())
    return registry.filter(_has_law(law)) if law else registry


def filter_registry_exact(registry: DataFrame, status: str | None = None, region: str | None = None) -> DataFrame:
    if status:
        registry = registry.filter(F.col("status") == status)
    return registry.filter(F.col("region") == region) if region else registry


def risky_flows(registry: DataFrame) -> DataFrame:
    return registry.filter((F.col("status") != "healthy") | (F.col("sigma") < 5.0))


def law_flows(registry: DataFrame, law: str) -> DataFrame:
    return registry.filter(_has_law(law))


def movements(registry: DataFrame, n: int = 12) -> DataFrame:
    """Source to target edges of the oldest ``n`` flows."""
    return registry.orderBy("created_at", "id").limit(n).select(
        F.col("source").alias("from_node"), F.col("target").alias("to_node"), F.col("name").alias("dataset"), "region",
        F.array_join("laws", ",").alias("law"), "tx",
    )


def rank_flows(registry: DataFrame, by: str = "sigma") -> DataFrame:
    """All flows from best to worst by ``sigma`` or ``runs``, with their ``rank`` from 1; equal ones by id."""
    return numbered(registry, [], [F.desc(by), F.col("id")], "rank").orderBy("rank")


def overview(registry: DataFrame) -> DataFrame:
    def mean(column: str, places: int) -> Column:
        return F.coalesce(rounded(exact_mean(F.col(column)), places), F.lit(0.0))

    return registry.agg(
        F.count(F.lit(1)).alias("flows"), F.coalesce(F.sum("runs"), F.lit(0)).alias("total_runs"),
        mean("sigma", 2).alias("avg_sigma"), mean("healing_rate", 1).alias("heal_rate"),
        F.count_if(F.col("status") != "healthy").alias("warnings"),
    )


def node_flow_counts(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Flows per node by region; a node of region ``GLOBAL`` counts them all."""
    counts = registry.groupBy("region").agg(F.count(F.lit(1)).alias("flows"))
    everything = counts.agg(F.sum("flows").alias("flows")).select(F.lit("GLOBAL").alias("region"), "flows")
    regional = counts.filter(F.col("region") != "GLOBAL").unionByName(everything)
    joined = nodes.join(regional, "region", "left")
    return joined.withColumn("flows", F.coalesce("flows", F.lit(0)))


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key is not taken; the first by ``order`` wins among equals."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")
    return first.join(existing.select(key), key, "left_anti")


def upsert_latest(changes: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """The table after replacing by key; the highest ``order`` wins."""
    return latest_per_key(existing.unionByName(changes), [key], [order])


def increment_run_counts(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Add executed runs to each flow's counter and move its last run forward."""
    executed = runs.groupBy(F.col("pipeline_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_new"), F.max("ts").alias("last_run")
    )
    joined = registry.join(executed, "id", "left")
    return joined.withColumn("runs", F.col("runs") + F.coalesce("_new", F.lit(0))).drop("_new")


def unique_names(requests: DataFrame, taken: DataFrame, base: str, seq: str) -> DataFrame:
    """Give each request its base name, or the base with the next free number from 2 on.

    Requests for one base are served in ``seq`` order. The r-th request gets the r-th free
    number: r plus the taken numbers that have fewer than r free ones below. Both counts go over
    ranges of the rows, so a single popular base is spread over many tasks. The requests,
    slim by now, are written once because the sums read them several times.
    """
    requests = cut_lineage(requests)
    ordered = numbered(requests, [base], [F.col(seq)], "_rank")
    whole = taken.select(F.col("name").alias("_base"), F.lit(1).cast("bigint").alias("_number"))
    suffix = "^(.+)_([1-9][0-9]*)$"
    cut = taken.select(
        F.regexp_extract("name", suffix, 1).alias("_base"),
        F.regexp_extract("name", suffix, 2).try_cast("bigint").alias("_number"),
    ).filter("_number >= 2")
    used = whole.unionByName(cut).distinct().withColumnRenamed("_base", base)
    used = used.join(requests.select(base).distinct(), base, "left_semi")
    used = numbered(used, [base], [F.col("_number")], "_nth")
    marks = used.select(
        base, (F.col("_number") - F.col("_nth")).alias("_at"), F.lit(0).alias("_turn"),
        F.lit(1).cast("bigint").alias("_taken"),
    )
    # A taken number with f free ones below comes before every request of rank above f.
    asks = ordered.withColumnRenamed("_rank", "_at").withColumns({
        "_at": F.col("_at") - 1, "_turn": F.lit(1), "_taken": F.lit(0).cast("bigint"),
    })
    merged = marks.unionByName(asks, allowMissingColumns=True)
    summed = running_sum(
        merged, [base], [F.col("_at"), F.col("_turn"), F.col(seq)], F.col("_taken"), "_skipped"
    )
    number = F.col("_at") + 1 + F.col("_skipped")
    name = F.when(number == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), number.cast("string")))
    return summed.filter("_turn = 1").withColumn("name", name).select(*requests.columns, "name")


def flow_id(number: Column) -> Column:
    """``pl-`` and at least three digits."""
    text = number.cast("string")
    return F.concat(F.lit("pl-"), F.when(number < 1000, F.lpad(text, 3, "0")).otherwise(text))


def _numbered_ids(rows: DataFrame, registry: DataFrame, seq: str) -> DataFrame:
    existing = registry.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = numbered(rows, [], [F.col(seq)], "_nth")
    return placed.withColumn("id", flow_id(F.col("_nth") + existing)).drop("_nth")


def build_flows(requests: DataFrame, registry: DataFrame, text: str = "text", seq: str = "text_id") -> DataFrame:
    """Registry rows for the creation requests among the texts."""
    wanted = requests.filter(is_create_request(F.col(text)))
    spec = flow_spec(F.col(text))
    asked = wanted.select(F.col(seq).alias("seq"), *[column.alias(name) for name, column in spec.items()])
    asked = asked.withColumn("base", F.concat_ws("_", "domain", "source", F.lit("pipeline")))
    named = cut_lineage(unique_names(asked, registry.select("name"), "base", "seq"))
    return _numbered_ids(named, registry, "seq").select(
        "seq", "id", "name", F.lit(5.1).alias("sigma"), F.lit("healthy").alias("status"),
        F.array("law").alias("laws"), F.concat(F.lit("TX_"), F.left(sha256(F.concat_ws("|", "id", "name")), F.lit(12))).alias("tx"),
        "region", F.lit(0).cast("bigint").alias("runs"), F.lit("AI_INTENT").alias("classification"),
        F.lit("intent_builder").alias("owner"), "source", "target", "domain",
    )


def build_audit(requests: DataFrame, built: DataFrame, text: str = "text", seq: str = "text_id") -> DataFrame:
    """Two audit rows per flow built, one per refused request."""
    made = built.select("seq", "region", F.explode(F.array(
        F.struct(F.lit("INTENT_BUILD_PIPELINE").alias("action"), F.col("name").alias("dataset"),
                 F.lit("intent-builder").alias("actor")),
        F.struct(F.lit("AI_QUERY").alias("action"), F.lit("intent_pipeline_builder").alias("dataset"),
                 F.lit("query-assistant").alias("actor")),
    )).alias("e"), F.get("laws", F.lit(0)).alias("law")).select(
        "seq", "e.*", F.lit("OK").alias("result"), "law", "region"
    )
    refused = requests.filter(~is_create_request(F.col(text))).select(
        F.col(seq).alias("seq"), F.lit("INTENT_REJECTED").alias("action"), F.lit("non_creation_query").alias("dataset"),
        F.lit("intent-builder").alias("actor"), F.lit("USE_ASK_QUERY").alias("result"), F.lit("NA").alias("law"),
        F.lit("GLOBAL").alias("region"),
    )
    return made.unionByName(refused)


# What a creation form leaves open.
FORM_DEFAULTS = {
    "source": "manual", "target": "fabric_node_default", "region": "IN-TG", "law": "DPDP", "owner": "dashboard_user",
}


def create_flows(rows: DataFrame, registry: DataFrame, seq: str = "seq") -> DataFrame:
    """Registry rows from filled-in forms; forms without a name are dropped."""
    named = rows.withColumn("name", F.trim("name")).filter(F.coalesce(F.col("name"), F.lit("")) != "")
    filled = {
        field: F.coalesce(F.nullif(F.trim(F.col(field)), F.lit("")), F.lit(default))
        for field, default in FORM_DEFAULTS.items()
    }
    filled["law"] = F.upper(filled["law"])
    out = _numbered_ids(named.withColumns(filled), registry, seq)
    return out.select(
        F.col(seq).alias("seq"), "id", "name", F.lit(5.0).alias("sigma"), F.lit("healthy").alias("status"),
        F.array("law").alias("laws"), "region", F.lit(0).cast("bigint").alias("runs"), F.lit("CUSTOM").alias("classification"),
        "owner", "source", "target",
    )
