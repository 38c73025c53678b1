"""Questions in plain language: language, translation, intent, schedule, routing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# Phrase translations, applied in this order.
PHRASES = {
    "te": (
        ("చివరి నెలలో", "last month"),
        ("అమ్మకాలు", "sales"),
        ("అత్యధిక", "highest"),
        ("ఆదాయం", "revenue"),
        ("ఏ ప్రాంతంలో", "in which region"),
        ("నాణ్యత", "quality"),
        ("నివేదిక", "report"),
        ("పైప్‌లైన్", "pipeline"),
        ("ఈ వారం", "this week"),
        ("ప్రాంతం వారీగా", "by region"),
        ("ఎగువ", "top"),
        ("క్రింది", "below"),
    ),
    "hi": (
        ("पिछले महीने", "last month"),
        ("बिक्री", "sales"),
        ("सर्वोच्च", "highest"),
        ("राजस्व", "revenue"),
        ("किस क्षेत्र में", "in which region"),
        ("गुणवत्ता", "quality"),
        ("रिपोर्ट", "report"),
        ("इस सप्ताह", "this week"),
        ("क्षेत्र के अनुसार", "by region"),
        ("शीर्ष", "top"),
    ),
}
# The planner's own phrases; it applies all of them to any non-English text.
PLANNER_PHRASES = (
    ("చివరి నెలలో అమ్మకాలు", "sales last month"),
    ("అత్యధిక ఆదాయం", "highest revenue"),
    ("డేటా నాణ్యత", "data quality"),
    ("నివేదిక కావాలి", "need report"),
    ("पिछले महीने की बिक्री", "sales last month"),
    ("सर्वोच्च राजस्व", "highest revenue"),
    ("डेटा गुणवत्ता", "data quality"),
    ("रिपोर्ट चाहिए", "need report"),
)
# The short phrase list of the plain API.
API_PHRASES = {
    "te": (("చివరి నెలలో అమ్మకాలు", "sales last month"), ("అత్యధిక ఆదాయం", "highest revenue")),
    "hi": (("पिछले महीने की बिक्री", "sales last month"),),
}

# Letters of a word, and per intent words of which each match holds one, and whole-word patterns; first match wins.
WORD = "[\\p{L}\\p{N}_]"


def whole_word(pattern: str) -> str:
    return f"(?<!{WORD})(?:{pattern})(?!{WORD})"


INTENT_PATTERNS = (
    ("REPORT", ("report", "dashboard", "show me", "daily", "weekly"), (whole_word("report|dashboard|show me|daily|weekly"),)),
    ("ALERT", ("alert", "notify", "when"), (
        whole_word("alert|notify"),
        whole_word("when") + "[^\\n]+" + whole_word("drops?|exceeds?|above|below"),
    )),
    ("QUALITY", ("quality", "clean", "validate", "sigma"), (whole_word("quality|clean|validate|sigma"),)),
    ("COMPLIANCE", ("dpdp", "gdpr", "compliant", "audit"), (whole_word("dpdp|gdpr|compliant|audit"),)),
    ("PIPELINE", ("ingest", "sync", "load", "move"), (
        whole_word("ingest|sync|load"),
        whole_word("move") + "[^\\n]+" + whole_word("to"),
    )),
)
# Keywords per planner intent, matched anywhere in the text, first match wins.
INTENT_KEYWORDS = (
    ("report", ("report", "dashboard", "show me", "నివేదిక", "रिपोर्ट")),
    ("alert", ("alert", "notify", "when", "if", "హెచ్చరిక", "सूचित")),
    ("pipeline", ("move", "transfer", "ingest", "sync", "తరలించు")),
    ("quality", ("quality", "clean", "validate", "నాణ్యత", "गुणवत्ता")),
    ("compliance", ("compliant", "dpdp", "gdpr", "audit", "అనుగుణత")),
    ("insight", ("pattern", "trend", "analyse", "insight", "అంతర్దృష్టి")),
)
# Named schedules with words of which each match holds one, first match wins.
NAMED_SCHEDULES = (
    (("day", "daily"), whole_word("day") + "|daily", "0 6 * * *"),
    (("hour",), whole_word("hour") + "|hourly", "0 * * * *"),
    (("week",), whole_word("week") + "|weekly", "0 6 * * MON"),
    (("month",), whole_word("month") + "|monthly", "0 6 1 * *"),
    (("real", "streaming"), whole_word("real[- ]?time") + "|streaming", "@continuous"),
)
# Keywords that route a question, first match wins.
QUESTION_ROUTES = (
    ("risk_pipeline_search", ("risk", "risky", "warning", "failed", "issue", "problem")),
    ("dpdp_compliance_query", ("dpdp", "india", "privacy")),
    ("gdpr_compliance_query", ("gdpr", "europe", "eu")),
    ("audit_chain_query", ("audit", "transaction", "tx", "fabric")),
    ("quality_score_query", ("best", "sigma", "quality", "healthy")),
    ("pipeline_run_query", ("run", "executed", "last run")),
)
DEFAULT_ROUTE = "general_dashboard_query"
# Words a creation request must contain, one of each list.
CREATE_WORDS = ("create", "build", "generate", "make", "add", "setup", "set up", "configure")
FLOW_WORDS = ("pipeline", "dataflow", "data flow", "stream", "ingestion")
# What a creation request asks for, first match wins.
SOURCE_WORDS = (
    ("kafka", ("kafka",)), ("postgres", ("postgres",)), ("s3", ("s3",)),
    ("csv", ("csv",)), ("api", ("api",)),
)
LAW_WORDS = (("GDPR", ("gdpr", "europe", "eu ")), ("HIPAA", ("hipaa",)), ("SOX", ("sox",)))
PLACE_WORDS = (
    ("IN-MH", "fabric_node_mumbai", ("mumbai", "maharashtra")),
    ("IN-TG", "fabric_node_hyderabad", ("hyderabad", "telangana")),
    ("IN-AP", "fabric_node_ap", ("andhra", "ap ")),
    ("IN-DL", "fabric_node_delhi", ("delhi",)),
    ("EU-DE", "fabric_node_frankfurt", ("europe", "germany", "eu ")),
)
DEFAULT_PLACE = ("IN-TG", "fabric_node_hyderabad")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def detect_language(text: Column) -> Column:
    return (
        F.when(text.rlike("[\\u0c00-\\u0c7f]"), "te")
        .when(text.rlike("[\\u0900-\\u097f]"), "hi")
        .when(text.rlike("[\\u0b80-\\u0bff]"), "ta")
        .otherwise("en")
    )


def _replace_all(text: Column, phrases) -> Column:
    for native, english in phrases:
        text = F.replace(text, F.lit(native), F.lit(english))
    return text


def translate_phrases(text: Column, language: Column, phrases=PHRASES) -> Column:
    """Languages without a phrase list, English among them, pass through unchanged."""
    chain = F
    for code, entries in phrases.items():
        chain = chain.when(language == code, _replace_all(text, entries))
    return chain.otherwise(text)


def translate_for_planner(text: Column, language: Column) -> Column:
    return F.when(language == "en", text).otherwise(_replace_all(text, PLANNER_PHRASES))


def safe_identifier(text: Column) -> Column:
    """Drops every character outside ``a-z0-9_``, upper-case letters included."""
    return F.regexp_replace(text, "[^a-z0-9_]", "")


def contains_any(text: Column, words) -> Column:
    """Does any of the words occur; bytes are compared, which is much cheaper than a pattern."""
    return reduce(lambda a, b: a | b, [text.contains(word) for word in words])


def _first_keyword(text: Column, table, default: str) -> Column:
    chain = F
    for result, words in table:
        chain = chain.when(contains_any(text, words), F.lit(result))
    return chain.otherwise(F.lit(default))


def classify_intent(text: Column) -> Column:
    def classified(lowered: Column) -> Column:
        chain = F
        for intent, words, patterns in INTENT_PATTERNS:
            chain = chain.when(contains_any(lowered, words) & lowered.rlike("|".join(patterns)), F.lit(intent))
        return chain.otherwise(F.lit("PIPELINE"))

    return bound(F.lower(text), classified)


def classify_intent_keywords(text: Column) -> Column:
    """Keywords also match inside longer words (``if`` in ``life``)."""
    return bound(F.lower(text), lambda lowered: _first_keyword(lowered, INTENT_KEYWORDS, "pipeline"))


def extract_schedule(text: Column) -> Column:
    """Cron text. ``at <hour>`` is searched anywhere, so ``format 3`` counts as hour 3."""
    return bound(F.lower(text), _schedule)


def _schedule(lowered: Column) -> Column:
    at_hour = "at ([0-9]{1,2})\\s*(am|pm)?"
    hour = F.regexp_extract(lowered, at_hour, 1).try_cast("int")
    half = F.regexp_extract(lowered, at_hour, 2)
    clock = (
        F.when((half == "pm") & (hour < 12), hour + 12)
        .when((half == "am") & (hour == 12), F.lit(0))
        .otherwise(hour)
    )
    minutes = F.regexp_extract(lowered, "every ([0-9]+) minutes?", 1)
    step = F.regexp_replace(minutes, "^0+(?=[0-9])", "")
    chain = F.when(hour.isNotNull(), F.concat(F.lit("0 "), clock.cast("string"), F.lit(" * * *")))
    chain = chain.when(minutes != "", F.concat(F.lit("*/"), step, F.lit(" * * * *")))
    for words, pattern, cron in NAMED_SCHEDULES:
        chain = chain.when(contains_any(lowered, words) & lowered.rlike(pattern), F.lit(cron))
    return chain.otherwise(F.lit("0 6 * * *"))


def extract_schedule_simple(text: Column) -> Column:
    return bound(F.lower(text), lambda lowered: (
        F.when(contains_any(lowered, ("6am", "6 am", "daily", "every day")), "0 6 * * *")
        .when(lowered.contains("hourly"), "0 * * * *")
        .otherwise("@continuous")
    ))


def route_question(text: Column) -> Column:
    """Keywords also match inside longer words (``eu`` in ``museum``)."""
    return bound(F.lower(text), lambda lowered: _first_keyword(lowered, QUESTION_ROUTES, DEFAULT_ROUTE))


def is_create_request(text: Column) -> Column:
    return bound(F.lower(text), lambda lowered: contains_any(lowered, CREATE_WORDS) & contains_any(lowered, FLOW_WORDS))


def _domain(lowered: Column) -> Column:
    def has(*words):
        return contains_any(lowered, words)

    return (
        F.when(has("fraud"), "fraud")
        .when(has("payment"), "payments")
        .when(has("customer") & has("churn"), "customer_churn")
        .when(has("customer"), "customer_profile")
        .when(has("churn"), "customer_churn")
        .when(has("iot", "sensor"), "iot_sensors")
        .when(has("health", "patient"), "patient_records")
        .when(has("billing"), "billing")
        .when(has("telecom"), "telecom")
        .otherwise("custom")
    )


def flow_spec(text: Column) -> dict[str, Column]:
    """Source, law, region, target and domain a creation request asks for."""
    return lowered_flow_spec(F.lower(text))


def lowered_flow_spec(lowered: Column) -> dict[str, Column]:
    region, target = F, F
    for code, node, words in PLACE_WORDS:
        hit = contains_any(lowered, words)
        region = region.when(hit, F.lit(code))
        target = target.when(hit, F.lit(node))
    return {
        "source": _first_keyword(lowered, SOURCE_WORDS, "manual"),
        "law": _first_keyword(lowered, LAW_WORDS, "DPDP"),
        "region": region.otherwise(F.lit(DEFAULT_PLACE[0])),
        "target": target.otherwise(F.lit(DEFAULT_PLACE[1])),
        "domain": _domain(lowered),
    }


def sql_template(translated: Column) -> Column:
    """Which analytic template answers an English question."""
    lowered = F.lower(translated)
    ranked = contains_any(lowered, ("top", "highest")) & lowered.contains("region")
    return (
        F.when(ranked & lowered.contains("last month"), "top_regions_last_month")
        .when(ranked, "top_regions_this_month")
        .when(contains_any(lowered, ("sigma", "quality")), "flows_below_sigma")
        .when(contains_any(lowered, ("sales", "revenue")), "daily_revenue")
        .otherwise("scan")
    )


def sigma_threshold(translated: Column) -> Column:
    """First number in the text, ``4.5`` when there is none."""
    number = F.regexp_extract(translated, "([0-9]\\.?[0-9]*)", 1)
    return F.coalesce(F.nullif(number, F.lit("")).try_cast("double"), F.lit(4.5))


def normalize_path(path: Column) -> Column:
    """Collapse identifiers in a request path, long hex runs first, then digits."""
    return F.regexp_replace(F.regexp_replace(path, "/[a-f0-9-]{8,}", "/{id}"), "/[0-9]+", "/{id}")
