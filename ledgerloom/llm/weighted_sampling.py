"""Document fingerprints by consistent weighted sampling, in Spark expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerloom.llm.common import id_and_text
from ledgerloom.session import cut_lineage

#: Samples of a fingerprint: LANES are columns of one aggregation, ROUNDS its rows for each term.
LANES, ROUNDS = 8, 8
SAMPLES = LANES * ROUNDS
#: Hexadecimal digits of a sample.
DIGITS = 4

_WORDS = r"[\x20\x09-\x0D]+"


def _uniform(bits: Column, shift: int) -> Column:
    """Sixteen bits as a number between 0 and 1, without the ends."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF)) + 0.5) / 65536.0


def _sample(log_weights: list[Column], term: Column, number: Column) -> list[Column]:
    """Rank and name of a term in one sample as one whole number, for each of its weights: the least wins.

    ``r`` and ``c`` are gamma(2, 1) variables and ``beta`` is uniform, all drawn by hashing the term
    and the sample's number. With ``t = floor(ln w / r + beta)`` the rank is
    ``ln a = ln c - r (t - beta + 1)``; the name mixes the hash of the term with ``t``. Equal terms of
    two texts have equal names and ranks unless ``t`` tells their weights apart, so the chance of
    a common least name is the generalised Jaccard similarity of the weights. The draws are shared by all
    weights; a null weight gives null.
    """
    h = F.xxhash64(term, number)
    beta = (F.xxhash64(h).bitwiseAND(F.lit(0xFFFFFF)) + 0.5) / 16777216.0
    r = -F.ln(_uniform(h, 0) * _uniform(h, 16))
    log_c = F.ln(-F.ln(_uniform(h, 32) * _uniform(h, 48)))
    name = h.bitwiseXOR(F.shiftrightunsigned(h, 21)).bitwiseXOR(F.shiftrightunsigned(h, 43))
    out = []
    for log_weight in log_weights:
        t = F.floor(log_weight / r + beta)
        rank = F.floor((log_c - r * (t - beta + 1.0) + 100.0) * 16777216.0)
        out.append(F.shiftleft(rank, 32).bitwiseOR(name.bitwiseXOR(t).bitwiseAND(F.lit((1 << (4 * DIGITS)) - 1))))
    return out


def _signed(counts: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """``(*keys, *names)`` from ``counts`` ``(*keys, term, ...)``: for each fingerprint the column with its counts, none where zero."""
    logs = [F.when(F.col(n) > 0, F.ln(F.col(n).cast("double"))).alias(f"w{k}") for k, n in enumerate(names.values())]
    counts = counts.select(*keys, "term", *logs)
    weights = [f"w{k}" for k in range(len(names))]
    spread = counts.select(*keys, "term", *weights, F.explode(F.array(*[F.lit(i * LANES) for i in range(ROUNDS)])).alias("round"))
    least = []
    for lane in range(LANES):
        for k, sample in enumerate(_sample([F.col(w) for w in weights], F.col("term"), F.col("round") + lane)):
            least.append(F.min(sample).alias(f"s{k}_{lane}"))
    sampled = spread.groupBy(*keys, "round").agg(*least)
    low = (1 << (4 * DIGITS)) - 1

    def part(k: int) -> Column:
        return F.lower(F.concat(*[F.lpad(F.hex(F.col(f"s{k}_{i}").bitwiseAND(F.lit(low))), DIGITS, "0") for i in range(LANES)])).alias(f"p{k}")

    parts = sampled.select(*keys, F.struct("round", *[part(k) for k in range(len(names))]).alias("p"))
    joined = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("parts"))
    return joined.select(*keys, *[F.array_join(F.col("parts")[f"p{k}"], "").alias(name) for k, name in enumerate(names)])


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``(*keys, fingerprint)`` of every text with a word; ``keys`` tell the texts apart.

    A text is weighted terms: its words, as white space separates them, and their counts.
    If ``texts`` lies partitioned by some of ``keys``, nothing is shuffled.
    """
    terms = texts.select(*keys, F.explode(F.split(text_col, _WORDS)).alias("word")).where("word != ''")
    counts = terms.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.count("*").alias("n"))
    return _signed(counts, keys, {"fingerprint": "n"})


def paired_fingerprints(texts: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """``(*keys, fingerprint, edited_fingerprint)`` of two texts a row; a term of both is drawn once for both."""
    sides = F.array(F.struct(F.lit(0).alias("kind"), F.col(first).alias("body")), F.struct(F.lit(1).alias("kind"), F.col(second).alias("body")))
    terms = texts.select(*keys, F.inline(sides)).select(*keys, "kind", F.explode(F.split("body", _WORDS)).alias("word")).where("word != ''")
    counts = terms.groupBy(*keys, F.xxhash64("word").alias("term")).agg(
        F.count_if(F.col("kind") == 0).alias("n0"), F.count_if(F.col("kind") == 1).alias("n1")
    )
    return _signed(counts, keys, {"fingerprint": "n0", "edited_fingerprint": "n1"})


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of samples two fingerprints have in common; fingerprints of no words agree with each other alone."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    same = [(F.substring(a, i * DIGITS + 1, DIGITS) == F.substring(b, i * DIGITS + 1, DIGITS)).cast("int") for i in range(SAMPLES)]
    total = same[0]
    for x in same[1:]:
        total = total + x
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(total / float(SAMPLES))


def following(keys: DataFrame) -> DataFrame:
    """``(*columns of keys, next_who, next_digest)``: the next of distinct ``(id, who, digest)`` in descending id.

    Rows are dealt out by ranges of their order; inside a range the next row is a window away,
    at its end it is the first of the next range, at the very end the first of all. Only the
    first rows of the ranges, one a partition, meet in one task.
    """
    order = [F.desc_nulls_last("id"), F.col("digest"), F.col("who")]
    placed = cut_lineage(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = W.partitionBy("part").orderBy(*order)
    here = placed.withColumns({
        "after": F.lead(F.struct("who", "digest")).over(within), "nth": F.row_number().over(within),
    })
    firsts = here.where("nth = 1").select("part", F.struct("who", "digest").alias("head"))
    ahead = firsts.select("part", F.lead("head").over(W.orderBy("part")).alias("over"), F.first("head").over(W.orderBy("part")).alias("top"))
    found = here.where("after is not null").select(*keys.columns, "after")
    ends = here.where("after is null").join(ahead, "part").select(*keys.columns, F.coalesce("over", "top").alias("after"))
    both = found.unionByName(ends)
    return both.select(*keys.columns, F.col("after")["who"].alias("next_who"), F.col("after")["digest"].alias("next_digest"))


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next text.

    Returns ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``. The
    next document is the next by descending id, nulls last, ties by a hash of the text; after the
    last comes the first. In the edited text the last third of the characters, rounded down, gives
    way to as many of the next text's first, or all it has. Null texts are empty; texts without
    words have an empty fingerprint, alike to each other only. Wholly equal rows count as one in
    the order and are each returned.
    """
    rows = id_and_text(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.select(F.xxhash64("id").alias("who"), F.xxhash64("text").alias("digest"), "id", "text")
    key = ["who", "digest"]
    slim = texts.select("id", *key, F.length("text").alias("n_chars")).distinct()
    pairs = cut_lineage(following(slim)).select(*key, "n_chars", "next_who", "next_digest")

    # the first of equal rows has none before it; both joins below ask for the same columns of
    # the texts, so Spark deals them out once
    marked = texts.withColumn("lone", F.lag(F.lit(1)).over(W.partitionBy(*key).orderBy("id")).isNull())
    once = marked.where("lone").select(F.col("who").alias("next_who"), F.col("digest").alias("next_digest"), F.col("text").alias("next_text"))
    heads = pairs.join(once, ["next_who", "next_digest"]).select(
        *key, "n_chars", "next_who", "next_digest", F.expr("left(next_text, n_chars div 3)").alias("head")
    )
    whole = marked.join(heads, key)
    edited = F.expr("concat(left(text, n_chars - n_chars div 3), head)")
    whole = whole.select(*key, "id", "lone", "n_chars", "next_who", "next_digest", "text", edited.alias("edited"))
    prints = paired_fingerprints(whole.where("lone"), key, "text", "edited")
    mine = whole.select(*key, "id", "n_chars", "next_who", "next_digest", F.sha2("edited", 256).alias("edited_sha256"))
    mine = cut_lineage(mine.join(prints, key, "left").na.fill("", ["fingerprint", "edited_fingerprint"]))
    following_prints = mine.groupBy("who", "digest").agg(F.first("fingerprint").alias("next_fingerprint")).select(
        F.col("who").alias("next_who"), F.col("digest").alias("next_digest"), "next_fingerprint"
    )
    return mine.join(following_prints, ["next_who", "next_digest"]).select(
        "id", F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
