"""Fill-in-middle, quality rules and Merkle manifests against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fim, langid, merkle, packing, quality_rules
from ledgerloom.llm.common import tokenizer_path
from llm_fixtures import documents, workers_find_the_package  # noqa: F401


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, size, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{chr(97 + draw.randrange(26))}{draw.randrange(vocabulary)}" for _ in range(size))


@pytest.fixture(scope="module")
def odd():
    """Null, empty and very long texts, marks, repeated rows, null ids."""
    pairs = [(i, prose(i, 1 + 7 * i)) for i in range(60)]
    pairs += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "<P> stands here"), (105, "almost <S <M ><P"), (106, "ends <"), (107, "Ünï ÇÖDE 😀 ß\r\n\x00x")]
    pairs += [(108, " " * 300_000), (109, "a" * 2_000_000), (110, prose(7, 60_000)), (103, "one"), (103, "another one"), (None, "no id"), (None, None), (-5, "minus five")]
    return pairs


# ---- fill in middle ----------------------------------------------------------------------


def plain_fim(key, text, marks=fim.MARKS):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in marks) or h3 % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    p, s, m = marks
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return key, n, form, len(prefix), len(middle), out


def test_fill_in_middle(spark, documents, odd):  # noqa: F811
    found = fim.filled(documents(odd, clashing=True)).withColumn("back", fim.restored("output", "form"))
    rows = found.collect()
    assert collections.Counter(tuple(r)[:6] for r in rows) == collections.Counter(plain_fim(i, t) for i, t in odd)
    assert collections.Counter((r.id, r.back) for r in rows) == collections.Counter((i, t or "") for i, t in odd)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fim.filled(documents([])).count() == 0


def test_fill_in_middle_parameters(spark, documents):  # noqa: F811
    pairs = [(i, f"line {i}\nnext {i}\n\nlast") for i in range(40)]
    lines = fim.filled(documents(pairs), unit=r"[^\n]*\n|[^\n]+", plain_from=100, spm_below=100, marks=("{pre}", "[suf]", "(mid)"))
    rows = lines.withColumn("back", fim.restored("output", "form", ("{pre}", "[suf]", "(mid)"))).collect()
    assert {(r.id, r.back) for r in rows} == set(pairs) and {(r.n, r.form) for r in rows} == {(4, "spm")}
    assert all(t[: r.prefix_chars] in ("", t) or t[r.prefix_chars - 1] == "\n" for r, t in ((r, dict(pairs)[r.id]) for r in rows))
    with pytest.raises(ValueError):
        fim.filled(documents(pairs), marks=("<P>", "<P>", "<M>"))
    with pytest.raises(Exception, match="does not cover"):
        fim.filled(documents([(1, "a1")]), unit="[a-z]").collect()


# ---- quality rules -----------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall("[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_twins": sum(a == b for a, b in zip(w, w[1:])),
        "n_exclaims": text.count("!") + text.count("?"), "n_upper": sum(c.isupper() for c in text), "n_letters": sum(c.isalpha() for c in text),
        "n_stop": sum(v in quality_rules.STOP_WORDS for v in re.findall(r"[^\W\d_]+", text.lower())),
        "n_bullets": sum(x.strip()[0] in "-*•·" for x in lines), "n_ellipses": sum(x.strip().endswith(("...", "…")) for x in lines),
    }


def plain_pass(rule, m):
    whole = m[rule.of] if rule.of else 1
    kept = (rule.low is None or m[rule.value] >= rule.low * whole) and (rule.high is None or m[rule.value] <= rule.high * whole)
    return kept or m["n_words"] < rule.least


def test_quality_measures_and_rules(spark, documents, odd):  # noqa: F811
    line = prose(1, 12)
    hard = odd + [
        (200, "\n".join([line] * 40)), (201, "a " * 3000), (202, " ".join(f"{w} {w}" for w in prose(5, 300).split())),
        (203, f"{line}\n{line} \n{line}\n\n \n- {line}\n* x...\ny…"), (204, prose(9, 200) + " " + " ".join(prose(9, 200).split()[50:57])),
        (205, " | ".join(prose(6, 80).split())), (206, prose(6, 80).upper() + "!!! ??"), (207, "the of und le " * 20 + prose(8, 400)),
    ]
    rows = quality_rules.judged(documents(hard, clashing=True)).collect()
    want = [(i, plain_quality(t)) for i, t in hard]
    key = lambda i, m: (str(i), tuple(m[k] for k in sorted(m)))
    assert sorted(key(r.id, r.measures.asDict()) for r in rows) == sorted(key(i, m) for i, m in want)
    for r in rows:
        m = r.measures.asDict()
        broken = [x.name for x in quality_rules.RULES if not plain_pass(x, m)]
        assert r.failed == broken and r.kept == (not broken)
        assert r.base_failed == (m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"])
    assert quality_rules.judged(documents([])).count() == 0
    assert {x for r in rows for x in r.failed} >= {"too_short", "repeated_windows", "symbols", "shouting", "stop_words", "repeated_lines", "stuttering", "letters"}


def test_quality_is_one_native_projection(spark, documents):  # noqa: F811
    plan = quality_rules.judged(documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas|Join|Aggregate", plan)


def test_quality_keeps_labelled_documents(spark):
    """Hand labels of the given documents: 1 is clean. Short and repeating clean texts fail by the base rules."""
    from conftest import SF_DIR

    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.judged(docs).join(labels, F.col("id") == labels.doc_id).where("NOT base_failed OR quality = 0")
    rates = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert rates[1] > 0.97 and rates.get(0, 0) < 0.1


# ---- Merkle manifests ---------------------------------------------------------------------


def plain_tree(digests):
    """Levels of a tree over hex digests."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def plain_proof(levels, rank):
    out = []
    for nodes in levels[:-1]:
        first = rank // 3 * 3
        out += [h for i, h in enumerate(nodes[first : first + 3], first) if i != rank]
        rank //= 3
    return out


def plain_manifest(rows):
    """``rows`` of (id, group, leaf): multiset of (id, group, leaf, subroot, root, proof)."""
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    groups = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted((r for r in rows if r[1] == g), key=order) for g in groups}
    trees = {g: plain_tree([r[2] for r in members[g]]) for g in groups}
    top = plain_tree([trees[g][-1][0] for g in groups])
    return collections.Counter(
        (r[0], g, r[2], trees[g][-1][0], top[-1][0], "".join(plain_proof(trees[g], rank) + plain_proof(top, k)))
        for k, g in enumerate(groups) for rank, r in enumerate(members[g])
    )


@pytest.mark.parametrize("n", [*range(1, 30), 80, 81, 82, 243, 500])
def test_log_places(n):
    """The closed form gives the place at which a postorder walk writes each node."""
    levels = plain_tree([sha(str(i)) for i in range(n)])
    log = [h.hex() for h in merkle.append_log((bytes.fromhex(h) for h in levels[0]), len(levels) - 1)]
    assert len(log) == sum(map(len, levels)) == int(merkle.size(n, len(levels) - 1))
    for level, nodes in enumerate(levels):
        at = merkle.place(np.full(len(nodes), level), np.arange(len(nodes)), n, len(levels) - 1)
        assert [log[p] for p in at] == nodes
    found = merkle.siblings(np.arange(n), n, len(levels) - 1)
    assert [[log[p] for p in row if p >= 0] for row in found.tolist()] == [plain_proof(levels, i) for i in range(n)]
    root, used = merkle.fold(bytes.fromhex(levels[0][n // 2]), n // 2, n, [bytes.fromhex(h) for h in plain_proof(levels, n // 2)])
    assert root.hex() == levels[-1][0] and used == len(plain_proof(levels, n // 2))


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest(spark, levels):
    """A group with most rows, groups of one, null group and ids, repeated rows and ids, clashing columns."""
    draw = random.Random(4)
    rows = [(i, "hot", f"text {i}\nmore", "x") for i in range(300)]
    rows += [(1000 + i, f"g{i}", f"other {i}", "x") for i in range(12)] + [(2000 + i, None, None, None) for i in range(5)]
    rows += [(None, "hot", "no id", "x"), (7, "hot", "second seven", "x"), (7, "hot", "text 7\nmore", "x"), (7, "hot", "text 7\nmore", "x"), (9, "", "", ""), (10, "é", "ü", "x"), (11, "Z", "z" * 100_000, "x")]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id bigint, source string, text string, lang string, `group` string, leaf string").repartition(6)
    hashed = merkle.digest(F.col("doc_id"), F.col("source"), F.col("text"))
    plain = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:3]))
    log, proofs = merkle.manifest(docs, "source", "doc_id", hashed, levels=levels, shown=F.unhex(F.when(F.col("doc_id") == 20, F.sha2(F.lit("forged"), 256)).otherwise(hashed)))
    found = merkle.folded(proofs, "shown").collect()
    got = collections.Counter((r.id, r.group, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.path.hex()) for r in found)
    assert got == plain_manifest([(r[0], r[1], plain(r)) for r in rows])
    assert {r.id for r in found if r.folded != r.root} == {20}
    parts = log.collect()
    assert sum(len(p.nodes) for p in parts if p.tier == 0 and p.tree >= 0) >= 32 * len(rows) and max(len(p.nodes) for p in parts) <= 32 * (3 ** (levels + 1) // 2)
    assert max(p.tier for p in parts) == {1: 5, 2: 2, 8: 0}[levels]


def test_manifest_of_little(spark):
    one = spark.createDataFrame([(5, None, "t")], "doc_id bigint, source string, text string")
    leaf = merkle.digest(F.col("doc_id"), F.col("source"), F.col("text"))
    _, proofs = merkle.manifest(one, "source", "doc_id", leaf)
    row = merkle.folded(proofs, "leaf").first()
    assert row.leaf.hex() == row.subroot.hex() == row.root.hex() == row.folded.hex() == sha("1:5-1:t") and row.path == b""
    _, proofs = merkle.manifest(one.limit(0), "source", "doc_id", leaf)
    assert merkle.folded(proofs, "leaf").count() == 0


# ---- long runs and missing labels ------------------------------------------------------------


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_000_000 + "x", "a" * 2_000_000, "x" + " \t" * 400_000 + "y", " " * 49_999 + "end"])
def test_packing_of_long_runs(documents, text):  # noqa: F811
    pieces = sorted(packing.packed(documents([(1, text), (2, "short")]), tokenizer_path()).collect(), key=lambda r: (r.id, r.start))
    ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces if r.id == 1), "<u4").tolist()
    from tokenizers import Tokenizer

    assert ids == [*Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, 1]


def test_unlabelled_corpus_is_kept(documents):  # noqa: F811
    docs = documents([(1, "some words"), (2, "1 2 3"), (3, None), (4, ""), (5, "ein Satz"), (5, "ein Satz")], lang=None)
    chain = langid.train(langid.sample(docs, "text", "lang", "doc_id", 400, 4000))
    assert sorted(r.doc_id for r in langid.keep_known(docs, chain).collect()) == [1, 5, 5]
    assert {r.lang_pred for r in langid.predict(docs, chain).collect()} == {"und"}
    assert langid.keep_known(documents([]), chain).count() == 0
