"""License notices: phrases that must be found, and ordered signature rules over whole texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import bound
from ledgerloom.llm.common import id_and_text

#: Phrases and labels of the base.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, strings of which one is in every match, and the name as it reads in words of letters and digits.
NAMES = (
    ("gpl-1.0", "general public license|gpl", r"(?:gnu )?(?:general public license|gpl)(?: ?version| ?v)? ?1(?: 0)?"),
    ("gpl-2.0", "general public license|gpl", r"(?:gnu )?(?:general public license|gpl)(?: ?version| ?v)? ?2(?: 0)?"),
    ("gpl-3.0", "general public license|gpl", r"(?:gnu )?(?:general public license|gpl)(?: ?version| ?v)? ?3(?: 0)?"),
    ("gpl", "general public license", r"(?:gnu )?general public license"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-2.0", "gpl", r"gpl(?: ?version| ?v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"gpl(?: ?version| ?v)? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lesser|library", r"(?:gnu )?(?:lesser|library) general public license(?: ?version| ?v)? ?2 1"),
    ("lgpl-3.0", "lesser|library", r"(?:gnu )?(?:lesser|library) general public license(?: ?version| ?v)? ?3(?: 0)?"),
    ("lgpl", "lesser|library", r"(?:gnu )?(?:lesser|library) general public license"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: ?version| ?v)? ?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: ?version| ?v)? ?3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: ?v?2(?: 0)?)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: ?version| ?v)? ?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public license"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: ?version| ?v)? ?3(?: 0)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("gfdl", "documentation", r"gnu free documentation license(?: version 1 [123])?"),
    ("apache-1.1", "apache", r"apache (?:software )?license version 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: ?version| ?v)? ?2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)? license"),
    ("mit", "mit", r"mit license"),
    ("mit", "mit", r"mit x11 license"),
    ("mit-0", "mit", r"mit no attribution(?: license)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd license|bsd 2 clause(?: license)?)"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified|revised) bsd license|bsd 3 clause(?: license)?)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd license|bsd 4 clause(?: license)?)"),
    ("bsd", "bsd", r"bsd license"),
    ("0bsd", "zero clause bsd|0bsd", r"(?:zero clause bsd|0bsd)(?: license)?"),
    ("isc", "isc", r"isc license"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: ?version| ?v)? ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: ?version| ?v)? ?2 0"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: ?version| ?v)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: ?version| ?v)? ?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("edl-1.0", "eclipse", r"eclipse distribution license(?: v ?1 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 0)?"),
    ("cddl", "distribution", r"common development and distribution license(?: version 1 [01])?"),
    ("cpl-1.0", "common", r"common public license(?: version 1 0)?"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: v(?:ersion)? ?1 2)?"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? 2 0"),
    ("artistic", "artistic", r"artistic license"),
    ("bsl-1.0", "boost", r"boost software license(?: version 1 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("unlicense", "unlicense", r"the unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2.0", "python", r"python (?:software foundation )?license(?: version 2)?"),
    ("php-3.01", "php", r"php license(?: version 3 01)?"),
    ("ruby", "ruby", r"ruby license"),
    ("openssl", "openssl", r"openssl license"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("ofl-1.1", "sil", r"sil open font license(?: version)?(?: 1 1)?"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database license(?: v?1 0)?"),
    ("odc-by", "commons", r"open data commons attribution license"),
    ("pddl", "commons", r"public domain dedication and license"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc0-1.0", "creative", r"creative commons zero(?: v?1 0)?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("proprietary", "reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("public-domain", "domain", r"(?:in|into|to) the public domain"),
)

_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_WITHIN = r"(?: [^ ]+){0,200}?"
_ADVERTISED, _ENDORSED = " all advertising materials mentioning features", " (?:neither the name|may not be used to endorse)"
_HEADER = "general public license as published by the free software foundation (?:either )?version"
#: Label, string in every match and wording of license bodies and headers that need not name the license.
BODIES = (
    ("mit", "permission is hereby granted", _MIT + _WITHIN + " subject to the following conditions"),
    ("mit-0", "permission is hereby granted", _MIT + f"(?!{_WITHIN} subject to the following conditions )"),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", "with or without fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "with or without fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided )"),
    ("bsd-4-clause", "binary forms", _BSD + _WITHIN + _ADVERTISED),
    ("bsd-3-clause", "binary forms", _BSD + f"(?!{_WITHIN}{_ADVERTISED} )" + _WITHIN + _ENDORSED),
    ("bsd-2-clause", "binary forms", _BSD + f"(?!{_WITHIN}(?:{_ADVERTISED}|{_ENDORSED}) )"),
    ("gpl-1.0", "general public license as published", f"gnu {_HEADER} 1"),
    ("gpl-2.0", "general public license as published", f"gnu {_HEADER} 2"),
    ("gpl-3.0", "general public license as published", f"gnu {_HEADER} 3"),
    ("lgpl-2.1", "general public license as published", f"gnu lesser {_HEADER} 2 1"),
    ("lgpl-3.0", "general public license as published", f"gnu lesser {_HEADER} 3"),
    ("agpl-3.0", "general public license as published", f"gnu affero {_HEADER} 3"),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "authors be held liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
)
BODY_PRIORITY, BODY_SCORE = 35, 0.95

#: What may stand before a name, its priority and the score of a rule; the bare name comes last.
NOTICES = (
    (r"spdx license identifier (?:the )?", 40, 1.0),
    (r"(?:is |are |be )?(?:dual )?licen[cs]ed (?:to you )?under (?:the )?(?:terms of )?(?:the )?", 30, 0.95),
    (r"(?:released|distributed|published|available|provided|made available) under (?:the )?(?:terms of )?(?:the )?", 30, 0.9),
    (r"(?:subject to|governed by|covered by|under) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", 20, 0.8),
    ("", 10, 0.6),
)
#: Notices that name no license of their own; the others go before each name.
UNNOTICED = ("proprietary", "public-domain")

#: A text without any of these holds neither a base phrase nor a rule's name; each is looked for once a text.
GATES = (
    "licen", "cc", "gpl", "bsd", "apache", "attribution", "reserved", "confidential", "public", "wtfpl", "creative", "cddl",
    "hereby", "redistribution", "authors",
)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


def rules() -> list[Rule]:
    """Every notice before every name, in order, then license bodies and headers."""
    return [
        Rule(label, keyword, f"(?<= ){lead}{name}(?= )", priority, score)
        for lead, priority, score in NOTICES
        for label, keyword, name in NAMES
        if not (lead and label in UNNOTICED)
    ] + [Rule(label, keyword, f"(?<= ){body}(?= )", BODY_PRIORITY, BODY_SCORE) for label, keyword, body in BODIES]


def _places(words: str, phrase: str) -> Column:
    """Numbers of the words at which a phrase begins."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == part)
        return F.coalesce(found, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(label).alias("label"), i.alias("word")))


def _signature_table() -> Column:
    fields = lambda i, r: F.struct(
        F.lit(i).alias("number"), F.lit(r.label).alias("label"), F.lit(r.keyword.split("|")[0]).alias("keyword"), F.lit(r.keyword.split("|")[-1]).alias("other"),
        F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"),
    )
    return F.array(*[fields(i, r) for i, r in enumerate(rules())])


def _walked(items: Column, start: Column, state: str, out: str, step: Callable[[Column, Column], Column], told: Callable[[Column, Column], Column]) -> Column:
    """The arrays ``told(state, item)`` of all items in order, joined; ``step`` carries the state past an item.

    An array grows only by being copied, so items are walked in blocks of their square root: first for the state at the
    head of each block, then each block from there. n items copy about n to the power 1.5 values instead of its square.
    """

    def block_of(items: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(items))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(items) - 1, width), lambda i: F.slice(items, i + 1, width))

    def over(blocks: Column) -> Column:
        heads = F.aggregate(
            blocks, F.struct(start.alias("state"), F.array().cast(f"array<{state}>").alias("heads")),
            lambda acc, block: F.struct(
                F.aggregate(block, acc["state"], step).alias("state"), F.concat(acc["heads"], F.array(acc["state"])).alias("heads"),
            ),
        )["heads"]
        return F.flatten(F.zip_with(blocks, heads, lambda block, head: F.aggregate(
            block, F.struct(head.alias("state"), F.array().cast(f"array<{out}>").alias("told")),
            lambda acc, item: F.struct(step(acc["state"], item).alias("state"), F.concat(acc["told"], told(acc["state"], item)).alias("told")),
        )["told"]))

    none = F.array().cast(f"array<{out}>")
    return bound(items, lambda items: F.when(F.size(items) == 0, none).otherwise(bound(block_of(items), over)))


def _matches(text: str, rule: Column) -> Column:
    """``(start, end)`` of all matches of a rule: lengths of matches and of what lies between."""
    between = F.split(F.col(text), rule["pattern"], F.lit(-1))
    spans = bound(F.regexp_extract_all(F.col(text), rule["pattern"], F.lit(0)), lambda found: F.zip_with(
        found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(F.length(m).alias("m"), F.length(b).alias("b"))))
    return _walked(
        spans, F.lit(0), "int", "struct<start:int,end:int>", lambda at, s: at + s["b"] + s["m"],
        lambda at, s: F.array(F.struct((at + s["b"]).alias("start"), (at + s["b"] + s["m"]).alias("end"))),
    )


def _undominated(found: Column) -> Column:
    """Detections that no stronger one contains, by place, as ``(label, start, end, score)``.

    By start, then longest, then priority, then rule, whatever contains a detection and beats it stands before it. So a
    detection goes if one before it has its priority or more and ends no earlier: the state is the furthest end so far of
    each priority and those above.
    """
    levels = sorted({rule.priority for rule in rules()})
    ordered = F.transform(F.array_sort(F.transform(found, lambda d: F.struct(
        d["start"].alias("start"), (-d["end"]).alias("to"), (-d["priority"]).alias("rank"), d["number"].alias("number"), d["label"].alias("label"), d["score"].alias("score"),
    ))), lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), (-d["to"]).alias("end"), d["score"].alias("score"), (-d["rank"]).alias("priority")))

    def step(ends: Column, d: Column) -> Column:
        return F.struct(*[
            F.greatest(ends[f"from_{p}"], F.when(d["priority"] >= p, d["end"]).otherwise(F.lit(0))).alias(f"from_{p}") for p in levels
        ])

    def told(ends: Column, d: Column) -> Column:
        beaten = F.lit(False)
        for p in levels:
            beaten = beaten | ((d["priority"] == p) & (ends[f"from_{p}"] >= d["end"]))
        slim = F.struct(*[d[name].alias(name) for name in ("label", "start", "end", "score")])
        return F.when(beaten, F.array().cast("array<struct<label:string,start:int,end:int,score:double>>")).otherwise(F.array(slim))

    start = F.struct(*[F.lit(0).alias(f"from_{p}") for p in levels])
    state = "struct<" + ",".join(f"from_{p}:int" for p in levels) + ">"
    return _walked(ordered, start, state, "struct<label:string,start:int,end:int,score:double>", step, told)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``(id, n_words, places, detections)``.

    Words are runs of ASCII letters and digits and of what lies beyond ASCII, A-Z as small
    letters. ``places`` are ``(label, word)`` of every base phrase, by phrase, then word.
    ``detections`` are ``(label, start, end, score)`` of signature rules in the text of words
    joined by spaces, by place. A rule is tried where one of its keywords occurs, in a word or across words; a detection goes when another
    contains it that has the higher priority, or the same and more characters, or the same span
    and an earlier rule. Null and empty texts have no words; repeated rows stay; no shuffle; an
    empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    # Letters beyond ASCII may change case here as well; none of them becomes a letter of a phrase or rule.
    rows = rows.select("id", "text", F.lower("text").alias("low"))
    gate = F.lit(False)
    for key in GATES:
        gate = gate | F.contains("low", F.lit(key))
    rows = rows.select("id", "low", F.regexp_count("text", F.lit(_WORD)).cast("bigint").alias("n_words"), gate.alias("gate"))
    line = F.concat(F.lit(" "), F.btrim(F.regexp_replace("low", _BETWEEN, " "), F.lit(" ")), F.lit(" "))
    rows = rows.select("id", "n_words", "gate", F.when(F.col("gate"), line).alias("line"))
    words = F.when(F.col("gate"), F.split(F.btrim("line", F.lit(" ")), " "))
    rows = rows.select("id", "line", "n_words", "gate", words.alias("words"))

    places = F.flatten(F.array(*[
        F.when(F.contains("line", F.lit(f" {phrase} ")), _labelled(_places("words", phrase), label))
        .otherwise(F.array().cast("array<struct<label:string,word:int>>"))
        for phrase, label in PHRASES
    ]))
    keyed = F.filter("signatures", lambda r: F.contains("line", r["keyword"]) | F.contains("line", r["other"]))
    found = F.flatten(F.transform(keyed, lambda r: F.transform(
        _matches("line", r),
        lambda m: F.struct(
            r["number"].alias("number"), r["label"].alias("label"), r["priority"].alias("priority"), r["score"].alias("score"),
            m["start"].alias("start"), m["end"].alias("end"),
        ),
    )))
    none = "array<struct<number:int,label:string,priority:int,score:double,start:int,end:int>>"
    rows = rows.withColumn("signatures", _signature_table())
    rows = rows.select("id", "n_words", places.alias("places"), F.when(F.col("gate"), found).otherwise(F.array().cast(none)).alias("found"))

    return rows.select("id", "n_words", "places", _undominated(F.col("found")).alias("detections"))


def labels_of(array: str | Column) -> Column:
    """Distinct labels, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(array, lambda x: x["label"]))), ",")
