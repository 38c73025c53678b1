"""Passages that stand in more than one place, found by suffix automata of shards of candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import Words, gram_hashes, id_and_text, last_minimum, saved, shingle_bytes, span_hashes, text_slices
from ledgerloom.session import cut_lineage

#: Words of the grams that choose a window's anchor.
GRAM = 6
#: Different regions of one anchor up to which they share an automaton.
SHARD = 2048

_KEY = "who bigint, digest bigint"


class SuffixAutomaton:
    """Suffix automaton of several strings, with the number of places where each state's strings end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]

    def add(self, string: list, times: int) -> None:
        """Adds a string that occurs ``times`` times."""
        last = 0
        for symbol in string:
            last = self._extend(last, symbol)
            self.ends[last] += times

    def _extend(self, last: int, symbol) -> int:
        step, link, length = self.next, self.link, self.length
        have = step[last].get(symbol)
        if have is not None:
            return have if length[have] == length[last] + 1 else self._clone(last, have, symbol)
        new = self._state({}, length[last] + 1)
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = step[at][symbol]
            link[new] = to if length[to] == length[at] + 1 else self._clone(at, to, symbol)
        else:
            link[new] = 0
        return new

    def _clone(self, at: int, to: int, symbol) -> int:
        step, link = self.next, self.link
        copy = self._state(dict(step[to]), self.length[at] + 1)
        link[copy], link[to] = link[to], copy
        while at >= 0 and step[at].get(symbol) == to:
            step[at][symbol] = copy
            at = link[at]
        return copy

    def _state(self, steps: dict, length: int) -> int:
        self.next.append(steps)
        self.link.append(-1)
        self.length.append(length)
        self.ends.append(0)
        return len(self.link) - 1

    def count(self) -> None:
        """Passes the ends of every state on to the states of its suffixes."""
        for at in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[at] > 0:
                self.ends[self.link[at]] += self.ends[at]

    def repeated(self, string: list, span: int) -> list[int]:
        """Starts of the runs of ``span`` symbols of ``string`` that end in two places or more.

        The matching statistic, cut at ``span``, moves along the string: a step forward, then
        up the suffix links while a suffix of ``span`` symbols is still there.
        """
        step, link, length, ends = self.next, self.link, self.length, self.ends
        at, have, found = 0, 0, []
        for i, symbol in enumerate(string):
            while at and symbol not in step[at]:
                at = link[at]
                have = length[at]
            if symbol in step[at]:
                at, have = step[at][symbol], have + 1
            while have >= span and length[link[at]] >= span:
                at = link[at]
            have = min(have, span)
            if have >= span and ends[at] > 1:
                found.append(i - span + 1)
        return found


def regions_of(words: Words, span: int) -> tuple[np.ndarray, ...]:
    """``(text, first, windows, anchor, content)`` of each region of some texts.

    Every window of ``span`` words chooses as anchor the last of the least gram hashes in it, so
    equal windows choose equal anchors at the same place. Windows next to each other with one
    anchor make a region; ``content`` is a hash of its words.
    """
    text = words.text_of()
    grams = gram_hashes(words.hashes, GRAM)
    at = last_minimum(grams, span - GRAM + 1)
    starts = np.flatnonzero(text[: len(at)] == text[span - 1 : span - 1 + len(at)])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    anchor = at[starts]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    s1, s2 = starts[first], starts[last]
    content = span_hashes(words.hashes, s1, s2 + span)
    owner = text[s1]
    return owner, s1 - words.bounds[owner], s2 - s1 + 1, grams[anchor[first]].view(np.int64), content.view(np.int64)


def _regions(texts: DataFrame, span: int) -> DataFrame:
    names = ["who", "digest", "first", "windows", "anchor", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, part in text_slices(batch, "text"):
                owner, first, windows, anchor, content = regions_of(Words(part, shingle_bytes(), lower=False), span)
                own = [batch.column(c).slice(at, to - at).take(pa.array(owner)) for c in names[:2]]
                rest = [pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(anchor), pa.array(content)]
                yield pa.RecordBatch.from_arrays(own + rest, names)

    return texts.select("who", "digest", "text").mapInArrow(run, f"{_KEY}, first int, windows int, anchor bigint, content bigint")


def _contents(wanted: DataFrame, span: int) -> DataFrame:
    """The regions that each text is to show, as they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, part in text_slices(batch, "text"):
                words, out = Words(part, shingle_bytes(), lower=False, hashed=False), []
                for i, shown in enumerate(batch.column("shown").slice(at, to - at).to_pylist()):
                    for x in shown:
                        s = words.bounds[i] + x["first"]
                        passage = words.raw[words.starts[s] : words.ends[s + x["windows"] + span - 2]]
                        out.append((x["anchor"], x["content"], x["n"], passage.tobytes()))
                cols = list(zip(*out)) or [()] * 4
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["anchor", "content", "n", "passage"])

    return wanted.select("id", "text", "shown").mapInArrow(run, "anchor bigint, content bigint, n bigint, passage binary")


def _windows(wanted: DataFrame, span: int) -> DataFrame:
    """Every window, with a hash of its words, of the regions that each text is to show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, part in text_slices(batch, "text"):
                words = Words(part, shingle_bytes(), lower=False)
                for i, shown in enumerate(batch.column("shown").slice(at, to - at).to_pylist()):
                    first = np.concatenate([np.arange(x["first"], x["first"] + x["windows"]) for x in shown])
                    s = first + words.bounds[i]
                    key = [batch.column(c).slice(at + i, 1).take(pa.array(np.zeros(len(s), np.int64))) for c in ("who", "digest")]
                    content = span_hashes(words.hashes, s, s + span).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*key, pa.array(first.astype(np.int32)), pa.array(content)], ["who", "digest", "first", "content"])

    return wanted.select("id", "who", "digest", "text", "shown").mapInArrow(run, f"{_KEY}, first int, content bigint")


def _judged(contents: DataFrame, span: int) -> DataFrame:
    """``(content, spans)``: word ranges of each region that repeated windows cover.

    Regions of an anchor come one after the other; they make an automaton and then run through it.
    """
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def judge(group: dict[int, tuple[int, bytes]]) -> list[tuple[int, list[dict]]]:
        automaton, strings = SuffixAutomaton(), {}
        for content, (n, passage) in group.items():
            strings[content] = passage.split()
            automaton.add(strings[content], n)
        automaton.count()
        found = []
        for content, string in strings.items():
            spans: list[dict] = []
            for s in automaton.repeated(string, span):
                if spans and s <= spans[-1]["b"]:
                    spans[-1]["b"] = s + span
                else:
                    spans.append({"a": s, "b": s + span})
            if spans:
                found.append((content, spans))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchor = {}, None
        for batch in batches:
            out = []
            for a, content, n, passage in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "n", "passage"))):
                if a != anchor:
                    out += judge(group)
                    group, anchor = {}, a
                group[content] = (n, passage)
            yield _batch(out)
        yield _batch(judge(group))

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out], spans_type)], ["content", "spans"])

    ordered = contents.repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, "content bigint, spans array<struct<a:int,b:int>>")


def repeated_spans(texts: DataFrame, span: int) -> DataFrame:
    """``(who, digest, spans)`` for texts ``(who, digest, id, text)`` with a window that stands elsewhere too.

    Texts are dealt out by their key once: every join with them asks for the same columns, so
    Spark reuses the exchange.
    """
    regions = _regions(texts, span)
    # a table of its own, so that the join can split an anchor that very many regions share
    busy = saved(regions.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    members = saved(regions.join(busy, "anchor"))

    place = F.struct("who", "digest", "first", "windows")
    kinds = members.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(place).alias("p"))
    hot = cut_lineage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > SHARD).select("anchor"))
    shown = kinds.join(hot, "anchor", "left_anti").select("p.*", "anchor", "content", "n")
    shown = shown.groupBy("who", "digest").agg(F.collect_list(F.struct("first", "windows", "anchor", "content", "n")).alias("shown"))
    judged = _judged(_contents(texts.join(shown, ["who", "digest"]), span), span)
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")))
    found = members.join(judged, "content").select("who", "digest", F.inline(moved).alias("a", "b"))

    # An anchor with very many different regions would make a large automaton. Its windows are
    # told apart by their own contents instead: a shard for each, and its count of places.
    if not hot.isEmpty():
        all_shown = members.join(hot, "anchor", "left_semi").groupBy("who", "digest").agg(F.collect_set(F.struct("first", "windows")).alias("shown"))
        windows = _windows(texts.join(all_shown, ["who", "digest"]), span)
        twice = windows.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
        hit = windows.join(twice, "content").select("who", "digest", F.col("first").alias("a"), (F.col("first") + span).alias("b"))
        found = found.unionByName(hit)
    return found.groupBy("who", "digest").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 35) -> DataFrame:
    """Per row of ``docs``: ``(id, n_words, n_removed, kept_sha256)``.

    Words are what white space separates. A word goes if a window of ``span`` words that stands in
    two places, in one text or several, covers it; ``kept_sha256`` is the digest of the other
    words joined by one space. Null and empty texts have no words; texts shorter than a window
    stay whole; repeated rows count as places of their own and each is returned.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select(F.xxhash64("id").alias("who"), F.xxhash64("text").alias("digest"), "id", F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(rows, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for text, spans_ in zip(batch.column("text").cast(pa.binary()), batch.column("spans")):
                words, gone = text.as_py().split(), spans_.as_py()
                n_words.append(len(words))
                if gone:
                    keep, at = [], 0
                    for s in sorted(gone, key=lambda s: s["a"]):
                        keep += words[at : s["a"]]
                        at = max(at, s["b"])
                    words = keep + words[at:]
                n_removed.append(n_words[-1] - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            cols = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "n_removed", "kept_sha256"])

    joined = rows.join(spans, ["who", "digest"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
