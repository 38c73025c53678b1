"""Questions in plain language: one at a time, or a whole column of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import audit, registry as reg
from ledgerloom.plans import templates


def classify_batch(texts: DataFrame, column: str = "text") -> DataFrame:
    """Everything the text functions say about each text, in one projection."""
    said = F.col(column)

    def told(language: Column, english: Column, planner: Column, lowered: Column) -> Column:
        values = {
            "language": language, "translated": english, "intent": T.classify_intent(english),
            "planner_intent": T.classify_intent_keywords(planner), "schedule": T.extract_schedule(english),
            "simple_schedule": T.extract_schedule_simple(said), "template": T.sql_template(english),
            "threshold": T.sigma_threshold(english), "route": T.route_question(said), "creates": T.is_create_request(said),
            **{f"spec_{name}": value for name, value in T.lowered_flow_spec(lowered).items()},
        }
        return F.struct(*[value.alias(name) for name, value in values.items()])

    # language and both translations are worked out once a text, whoever reads them
    found = T.bound(T.detect_language(said), lambda language: T.bound(T.translate_phrases(said, language), lambda english: T.bound(
        T.translate_for_planner(said, language), lambda planner: T.bound(F.lower(said), lambda lowered: told(language, english, planner, lowered)))))
    return texts.withColumn("_told", found).select(*texts.columns, "_told.*")


def planned_flows(texts: DataFrame, column: str = "text", seq: str = "text_id") -> DataFrame:
    """What the planner deploys per text: reports get a schedule and a sigma target, others only a type."""
    language = T.detect_language(F.col(column))
    kind = T.classify_intent_keywords(T.translate_for_planner(F.col(column), language))
    # The planner builds insight requests as plain data flows.
    built = F.when(kind == "insight", "pipeline").otherwise(kind)
    report = F.col("type") == "report"
    return texts.select(F.col(seq), built.alias("type")).select(
        seq, "type",
        F.concat(F.lit("auto-"), "type", F.lit("-"), F.left(F.sha2(F.col(seq).cast("string"), 256), F.lit(6))).alias("flow_id"),
        F.when(report, "0 6 * * *").alias("schedule"), F.when(report, 5.2).alias("estimated_sigma"),
        F.lit("DEPLOYED").alias("status"),
    )


def _facts(spark: SparkSession, question: str, *columns) -> tuple:
    """Evaluate text functions on a single question."""
    return tuple(spark.range(1).select(F.lit(question).alias("q")).select(*columns).first())


def answer(
    question: str, table: DataFrame, measurements: DataFrame, as_of: str, order: list[str],
    language: str = "auto", limit: int = 100,
) -> tuple[str, DataFrame]:
    """Pick the template a question asks for and build it over the table."""
    said = F.col("q")
    tongue = T.detect_language(said) if language == "auto" else F.lit(language)
    english = T.translate_phrases(said, tongue)
    name, threshold = _facts(table.sparkSession, question, T.sql_template(english), T.sigma_threshold(english))
    if name == "top_regions_last_month":
        return name, templates.top_regions(table, as_of, "last month", limit)
    if name == "top_regions_this_month":
        return name, templates.top_regions(table, as_of, "this month", limit)
    if name == "flows_below_sigma":
        return name, templates.flows_below(measurements, threshold, limit)
    if name == "daily_revenue":
        return name, templates.daily_revenue(table, as_of, 30, limit)
    return "scan", templates.scan(table, order, limit)


def ask(question: str, registry: DataFrame, events: DataFrame, newest: int | None = None) -> tuple[str, DataFrame | None, DataFrame]:
    """Route a question; returns the route, matching flows (none for audit questions) and events.

    Events are filtered first, then the newest are shown. With ``newest`` only so many of the
    newest events are looked at, as the dashboard does with 20.
    """
    (route,) = _facts(registry.sparkSession, question, T.route_question(F.col("q")))
    seen = events if newest is None else audit.recent(events, newest)
    flows, shown = registry, audit.recent(seen, 5)
    if route == "risk_pipeline_search":
        flows = reg.risky_flows(registry)
    elif route == "dpdp_compliance_query":
        flows, shown = reg.law_flows(registry, "DPDP"), audit.law_events(seen, "DPDP")
    elif route == "gdpr_compliance_query":
        flows, shown = reg.law_flows(registry, "GDPR"), audit.law_events(seen, "GDPR")
    elif route == "audit_chain_query":
        flows, shown = None, audit.recent(seen, 10)
    elif route == "quality_score_query":
        flows = reg.rank_flows(registry, "sigma")
    elif route == "pipeline_run_query":
        flows = reg.rank_flows(registry, "runs")
    return route, flows, shown
