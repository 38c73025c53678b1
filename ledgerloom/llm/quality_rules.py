"""Quality of whole texts by a table of thresholds, compiled into one projection of Spark expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import id_and_text

#: What parts words, and the same characters one by one.
BETWEEN, SPACES = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window that is looked for a second time.
WINDOW = 5

#: Frequent short words of five languages.
STOP_WORDS = tuple(
    "the of and to in a is that it for was on are as with be this by from or at not have "
    "der die das und ist ein eine den dem von zu mit nicht sich auf für im es auch als "
    "le la les un une et est que qui dans pour pas en du des sur il elle au ce "
    "el los las uno y es por con no se lo su para al del como más pero "
    "che di il non per una si sono della con".split()
)


@dataclass(frozen=True)
class Rule:
    """``low <= value / of <= high`` (``value`` alone without ``of``); texts with fewer than ``least`` words pass."""

    name: str
    value: str
    of: str | None = None
    low: float | None = None
    high: float | None = None
    least: int = 0


#: The two rules whose failure is a fact of the text's repetition and length.
BASE = (Rule("too_short", "n_words", low=10), Rule("repeated_windows", "n_repeat_words", "n_words", high=0.2))
RULES = (
    *BASE,
    Rule("too_long", "n_words", high=1_000_000),
    Rule("word_length", "word_chars", "n_words", low=2, high=15),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("shouting", "n_upper", "n_letters", high=0.5),
    Rule("exclamations", "n_exclaims", "n_words", high=0.3),
    Rule("letters", "n_letters", "word_chars", low=0.5),
    Rule("stuttering", "n_twins", "n_words", high=0.3),
    Rule("stop_words", "n_stop", "n_words", low=0.02, least=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.3),
    Rule("bullets", "n_bullets", "n_lines", high=0.9, least=50),
    Rule("ellipses", "n_ellipses", "n_lines", high=0.3),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also when lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(value: Column) -> Column:
    return value.cast("bigint")


def _times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _left(text: Column, dropped: str) -> Column:
    return F.length(F.regexp_replace(text, dropped, ""))


def _repeated(words: Column) -> Column:
    """Words inside windows whose words stand twice or more in the text.

    Windows compare by 64-bit hashes. Only a text with equal ones is sorted: neighbours with
    equal hashes are repeats, and each covers the words up to the next.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(ordered, lambda s: _let(F.array_sort(F.transform(
            F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))),
            lambda x: x["i"],
        )), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
        )))

    counted = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) >= WINDOW, counted).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """Struct of all counts of one text that rules may name."""
    words = F.filter(F.split(text, BETWEEN), lambda w: w != "")
    stops = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(*STOP_WORDS))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def counted(w: Column, x: Column) -> Column:
        starts = F.filter(x, lambda v: F.substring(F.btrim(v, F.lit(SPACES)), 1, 1).isin("-", "*", "•", "·"))
        ends = F.filter(x, lambda v: F.btrim(v, F.lit(SPACES)).endswith("...") | F.btrim(v, F.lit(SPACES)).endswith("…"))
        values = {
            "n_words": F.size(w), "word_chars": _left(text, BETWEEN), "n_symbols": _times(text, SYMBOLS),
            "n_lines": F.size(x), "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)), "n_repeat_words": _repeated(w),
            "n_twins": F.size(F.filter(w, lambda v, i: (i > 0) & F.coalesce(v == F.get(w, i - 1), F.lit(False)))),
            "n_exclaims": _times(text, "[!?]"), "n_upper": _times(text, r"\p{Lu}"), "n_letters": _left(text, r"[^\p{L}]+"),
            "n_stop": F.size(stops), "n_bullets": F.size(starts), "n_ellipses": F.size(ends),
        }
        return F.struct(*[_count(v).alias(k) for k, v in values.items()])

    return _let(F.struct(words.alias("w"), lines.alias("x")), lambda t: counted(t["w"], t["x"]))


def passes(rule: Rule, value: Callable[[str], Column]) -> Column:
    """Whether a text keeps a rule; nothing of nothing passes, whole numbers decide."""
    whole = value(rule.of) if rule.of else F.lit(1)
    kept = F.lit(True)
    for bound, sign in ((rule.low, 1), (rule.high, -1)):
        if bound is not None:
            kept = kept & (sign * (10_000 * value(rule.value) - F.lit(round(bound * 10_000)).cast("bigint") * whole) >= 0)
    return kept | (value("n_words") < rule.least)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE) -> DataFrame:
    """Per row of ``docs``: ``(id, measures, failed, base_failed, kept)``.

    ``failed`` lists the names of broken rules in table order, ``kept`` means none is; ``base_failed`` that one of
    ``base`` is. One projection over whole texts, no shuffle, no Python. Words are what white space
    parts; a line counts if it has a word. Null texts are empty: no words, so ``too_short``. Repeated rows are judged
    one by one; an empty table gives no rows. A text is judged in its own row, with about 100 bytes a word.
    """
    rows = id_and_text(docs, id_col, text_col).select("id", measures(F.coalesce("text", F.lit(""))).alias("measures"))
    value = lambda name: F.col(f"measures.{name}")
    failed = F.array_compact(F.array(*[F.when(~passes(r, value), F.lit(r.name)) for r in rules]))
    fails = F.lit(False)
    for rule in base:
        fails = fails | ~passes(rule, value)
    kept = ~fails
    for rule in rules:
        kept = kept & passes(rule, value)
    return rows.select("id", "measures", failed.alias("failed"), fails.alias("base_failed"), kept.alias("kept"))
