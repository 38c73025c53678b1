"""Fixtures of the tests of training-data operators; the test modules import them."""

import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(autouse=True, scope="session")
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


#: Extra columns under names the operators use inside.
CLASHING = {c: "string" for c in ("id", "digest", "row", "node", "fp", "key", "who", "spans", "words", "line", "n", "kind", "anchor", "content", "ids")}


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text) pairs, with clashing extra columns when asked."""

    def build(pairs, clashing=False, lang="en"):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in pairs]
        if clashing:
            schema += "".join(f", {c} {k}" for c, k in CLASHING.items())
            rows = [r + ("x",) * len(CLASHING) for r in rows]
        return spark.createDataFrame(rows, schema)

    return build
