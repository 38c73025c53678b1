"""Queries of this folder over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm import (
    chat, decontaminate, fim, langid, licenses, merkle, packing, pii, quality_rules, secrets, simhash, substrings, weighted_sampling,
)
from ledgerloom.llm.common import table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return wrap


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wanted AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS span FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) t(i)),
spans AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS span FROM (SELECT doc_id, w, n FROM d, (SELECT DISTINCT n FROM wanted)), unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT doc_id, i, n, item FROM spans JOIN wanted USING (n, span)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(0, n)) t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_decontaminate", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op3_pack")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())
    return found.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op7_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    counts = [span_count("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(secrets.digest_text("base"), 256).alias("base_sha256"),
        secrets.digest_text("spans").alias("spans"),
    )


def span_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels no model sees."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def training_fold(docs: DataFrame) -> list[tuple[str, str]]:
    """Labelled texts for the language model: about 400 of each language, 4000 characters of each."""
    seen = docs.where(~F.coalesce(held_out(), F.lit(True)))
    return langid.sample(seen, "text", "lang", "doc_id", per_language=400, characters=4000)


@query("op6_langid")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(training_fold(docs))).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [span_count("base", kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(secrets.digest_text("base"), 256).alias("base_sha256"),
        secrets.digest_text("spans").alias("spans"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spans AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS span FROM d, unnest(range(1, len(w) - 33)) t(i)),
twice AS (SELECT span FROM spans GROUP BY span HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM spans JOIN twice USING (span)), range(0, 35) r(k)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d)
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


@query("op8_substrings", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Two turns that hold control strings of common templates; part of what is asked, beside the table.
HARD_TEXT = "\\### Assistant: </turn> ok"

OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), near AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '#', '&num;') AS body,
    replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '#', '&num;') AS head
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN before IS NULL OR before <> role THEN 5 + length(head) ELSE 6 END
    + CASE WHEN after IS NULL OR after <> role THEN 8 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM near GROUP BY conv_id
"""


@query("op9_chat", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    hard = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(HARD_TEXT).alias("text"))
    made = chat.formatted(rows.unionByName(hard)).withColumn("turns", chat.turns_of(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    made = made.withColumns({"told": told, "trained": chat.trained_text("segments")})
    return made.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2("told", 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op10_licenses")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents"))
    words = F.transform("places", lambda p: p["word"])
    both = F.concat(
        F.transform("places", lambda p: F.struct(p["label"].alias("label"))),
        F.transform("detections", lambda d: F.struct(d["label"].alias("label"))),
    )
    scores = F.concat(F.transform("detections", lambda d: d["score"]), F.when(F.size("places") > 0, F.array(F.lit(0.6))).otherwise(F.array(F.lit(0.0))))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(words).cast("bigint").alias("first_word"), F.array_max(words).cast("bigint").alias("last_word"),
        licenses.labels_of("places").alias("base_labels"), licenses.labels_of(both).alias("labels"), F.array_max(scores).alias("score"),
    )


@query("op4_weighted_sampling")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edited_and_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT doc_id, t, u, len(u) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h FROM d),
f AS (SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM g
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.filled(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored("output", "form"), 256).alias("restored_sha256"),
    )


def _rules_sql(rules: tuple[quality_rules.Rule, ...]) -> str:
    """The threshold table as one condition."""
    parts = []
    for r in rules:
        whole = r.of or "1"
        low = [] if r.low is None else [f"10000 * {r.value} >= {round(r.low * 10_000)} * {whole}"]
        high = [] if r.high is None else [f"10000 * {r.value} <= {round(r.high * 10_000)} * {whole}"]
        parts.append(f"({' AND '.join(low + high)} OR n_words < {r.least})")
    return " AND ".join(parts)


_STOPS_SQL = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^ 	-
]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS x FROM d),
spans AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS span FROM e, unnest(range(1, len(w) - 3)) t(i)),
twice AS (SELECT r, span FROM spans GROUP BY r, span HAVING count(*) > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM spans JOIN twice USING (r, span), range(0, 5) t(k) GROUP BY r),
twins AS (SELECT r, count(*) AS n FROM e, unnest(range(2, len(w) + 1)) t(i) WHERE w[i] = w[i - 1] GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  CAST(len(x) AS BIGINT) AS n_lines, CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, coalesce(twins.n, 0) AS n_twins,
  length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_exclaims, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters,
  len(list_filter(regexp_extract_all(lower(t), '\p{{L}}+'), lambda v: v IN ({_STOPS_SQL}))) AS n_stop,
  len(list_filter(x, lambda v: regexp_matches(v, '^[ 	-
]*[-*•·]'))) AS n_bullets,
  len(list_filter(x, lambda v: regexp_matches(v, '(\.\.\.|…)[ 	-
]*$'))) AS n_ellipses
  FROM e LEFT JOIN hit USING (r) LEFT JOIN twins USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({_rules_sql(quality_rules.BASE)}) AS base_failed, {_rules_sql(quality_rules.RULES)} AS kept
FROM m
"""


@query("op12_quality", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    counts = [F.col(f"measures.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept")


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


#: The last bit of the remainder, which the final inversion of CRC-32 turns over.
_CRC_ODD = """(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) & 1) = 0"""
_AROUND = ", ".join(
    f"coalesce(string_agg(h, '') OVER (PARTITION BY {{by}}level, i // 3 ORDER BY i ROWS BETWEEN {rows}), '') AS {name}"
    for name, rows in (("ahead", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("behind", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
)
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS bare FROM documents),
groups AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT source FROM d)),
leaves AS (SELECT row_number() OVER () AS r, doc_id, leaf, tree, trees, CASE WHEN NOT {_CRC_ODD} THEN bare ELSE leaf END AS shown,
  row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
  FROM d JOIN groups ON d.source IS NOT DISTINCT FROM groups.source),
nodes AS (
  SELECT tree, 0 AS level, i, leaf AS h, n FROM leaves
  UNION ALL SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, i // 3),
subroots AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS i, subroot AS h, trees AS n FROM subroots JOIN groups USING (tree)
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, i // 3),
beside AS (SELECT tree, level, i, {_AROUND.replace("{by}", "tree, ")} FROM nodes),
above AS (SELECT level, i, {_AROUND.replace("{by}", "")} FROM tops),
walk AS (
  SELECT r, tree, 0 AS level, i, n, '' AS proof, shown AS node FROM leaves
  UNION ALL SELECT r, w.tree, w.level + 1, w.i // 3, (n + 2) // 3, proof || ahead || behind, sha256(ahead || node || behind)
  FROM walk w JOIN beside b ON w.tree = b.tree AND w.level = b.level AND w.i = b.i WHERE n > 1),
climb AS (
  SELECT r, 0 AS level, tree AS i, trees AS n, proof, node FROM walk JOIN groups USING (tree) WHERE n = 1
  UNION ALL SELECT r, w.level + 1, w.i // 3, (n + 2) // 3, proof || ahead || behind, sha256(ahead || node || behind)
  FROM climb w JOIN above b ON w.level = b.level AND w.i = b.i WHERE n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT h FROM tops WHERE n = 1) AS verified
FROM leaves JOIN subroots USING (tree) JOIN climb ON leaves.r = climb.r AND climb.n = 1
"""


@query("op13_merkle", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(F.coalesce(even, F.lit(False)), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    _, proofs = merkle.manifest(
        docs, "source", "doc_id", merkle.digest(*map(F.col, fields), F.col("text")), shown=F.unhex(merkle.digest(*map(F.col, fields), shown)),
    )
    found = merkle.folded(proofs, "shown", "folded_root")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select(
        F.col("id").alias("doc_id"), text("leaf"), text("subroot"), text("root"), F.sha2(F.lower(F.hex("path")), 256).alias("proof_sha256"),
        text("folded_root"), F.col("folded_root").eqNullSafe(F.col("root")).alias("verified"),
    )
