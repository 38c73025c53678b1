"""Benchmark passages in documents, found by winnowed word grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.llm.common import (
    Words, gram_hashes, id_and_text, last_minimum, letter_bytes, small, text_slices, with_row,
)
from ledgerloom.session import cut_lineage

#: Words of a gram; with a run of ``span - GRAM + 1`` grams per minimum, every shared span of
#: ``span`` words holds a gram that both texts keep.
GRAM = 5
#: 2**SIEVE_BITS bits say which hashes items may have: 1 MB whatever the number of items.
SIEVE_BITS = 23

_MARK = "array<struct<pos:bigint,size:int,hash:bigint,before:array<bigint>,after:array<bigint>>>"


def grams_of(words: np.ndarray, span: int, short: list[int], dense: bool = False) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(size, positions, hashes)`` of the kept grams of one text.

    Grams of ``GRAM`` words are winnowed for windows of ``span`` words. Items shorter than that
    are one gram of their own length; documents keep every gram of the lengths in ``short``.
    """
    found = []
    if dense and 0 < len(words) < span:
        return [(len(words), np.zeros(1, np.int64), gram_hashes(words, len(words)))]
    grams = gram_hashes(words, GRAM)
    at = last_minimum(grams, span - GRAM + 1)
    if len(at):
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        found.append((GRAM, at, grams[at]))
    if not dense:
        for size in short:
            hashes = gram_hashes(words, size)
            if len(hashes):
                found.append((size, np.arange(len(hashes)), hashes))
    return found


def _marks(texts: DataFrame, span: int, short: list[int], sieve: bytes | None) -> DataFrame:
    """Per row ``(id, n_words, marks)``; with a sieve only grams that some item may have."""
    kind = texts.schema["id"].dataType.simpleString()
    reach = span - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sieve is None else np.unpackbits(np.frombuffer(sieve, np.uint8), bitorder="little")
        for batch in batches:
            for at, to, part in text_slices(batch, "text"):
                words = Words(part, letter_bytes(), lower=True)
                counts, rows = np.diff(words.bounds), []
                for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                    own, marks = words.hashes[a:b], []
                    for size, pos, hashes in grams_of(own, span, short, dense=sieve is None):
                        if bits is not None:
                            keep = bits[_slot(hashes, size)] > 0
                            pos, hashes = pos[keep], hashes[keep]
                        signed = own.view(np.int64)
                        for p, h in zip(pos.tolist(), hashes.view(np.int64).tolist()):
                            full = size == GRAM and len(own) >= span
                            before = signed[max(0, p - reach) : p][::-1].tolist() if full else []
                            after = signed[p + size : p + size + reach].tolist() if full else []
                            marks.append({"pos": p, "size": size, "hash": h, "before": before, "after": after})
                    rows.append(marks)
                marks = pa.array(rows, _MARK_TYPE)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, to - at), pa.array(counts.astype(np.int64)), marks], ["id", "n_words", "marks"]
                )

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, n_words bigint, marks {_MARK}")


_MARK_TYPE = pa.list_(pa.struct([
    ("pos", pa.int64()), ("size", pa.int32()), ("hash", pa.int64()),
    ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64())),
]))


def _slot(hashes: np.ndarray, size: int) -> np.ndarray:
    return ((hashes >> np.uint64(64 - SIEVE_BITS)) ^ np.uint64(size)).astype(np.int64)


def _sieve(item_marks: DataFrame) -> bytes:
    """Which slots hashes of items fall in, gathered as 2**(SIEVE_BITS - 6) words of 64 bits at most."""
    slot = F.shiftrightunsigned("m.hash", 64 - SIEVE_BITS).bitwiseXOR(F.col("m.size").cast("bigint"))
    one = item_marks.select(F.explode("marks").alias("m")).select(slot.alias("slot"))
    words = one.groupBy(F.shiftright("slot", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("slot") % 64).cast("int"))).alias("b")
    )
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    for row in words.toLocalIterator():
        out[row.w] = row.b
    return out.tobytes()


def keep_clean(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", span: int = 10,
) -> DataFrame:
    """Rows of ``docs``, all columns, that ``contaminated`` finds clean.

    Null and empty texts have no words and stay; of rows with one id each is judged by its own text; repeated
    rows stay or go together. Without items all rows stay; an empty table stays empty.
    """
    key = F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("digest"))
    found = contaminated(docs.select(key.alias("key"), docs[text_col].alias("text")), items, "key", "text", item_col, item_text_col, span)
    hit = cut_lineage(found.where("contaminated").select(F.col("id.id").alias("_id"), F.col("id.digest").alias("_digest")).distinct())
    same = docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_digest"))
    return docs.join(small(hit), same, "left_anti")


def _matching(a: str, b: str, reach: int):
    """How many leading elements of two arrays are equal."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(reach)), F.lit(0),
        lambda have, i: F.when((have == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(have),
    )


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", span: int = 10,
) -> DataFrame:
    """Per row of ``docs``: ``(row, id, n_words, n_hit, item_ids, contaminated)``.

    A window is ``span`` consecutive words of an item, or the whole of an item with fewer words
    but not none. A word of a document is hit if an occurrence of a window covers it; ``item_ids``
    are the ids, as sorted strings, of items with an occurring window. Null or empty texts have
    no words and hit nothing; null item ids hit but are not listed. Repeated rows and items count
    once each. Tables may be empty; other columns are not looked at.
    """
    if span <= GRAM:
        raise ValueError(f"a window needs more than {GRAM} words")
    reach = span - GRAM
    item_marks = cut_lineage(_marks(id_and_text(items, item_col, item_text_col), span, [], None))
    sizes = item_marks.where(f"n_words between 1 and {span - 1}").select("n_words").distinct()
    short = sorted(r.n_words for r in sizes.collect())  # fewer than span values
    rows = with_row(_marks(id_and_text(docs, id_col, text_col), span, short, _sieve(item_marks)))

    hits = rows.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    whole = F.col("n_words") < span
    wanted = item_marks.select(F.col("id").cast("string").alias("item"), whole.alias("whole"), F.explode("marks").alias("m")).select(
        "item", "whole", F.col("m.size").alias("size"), F.col("m.hash").alias("hash"),
        F.col("m.before").alias("t_before"), F.col("m.after").alias("t_after"),
    ).distinct()
    left = F.when(F.col("whole"), 0).otherwise(_matching("before", "t_before", reach))
    right = F.when(F.col("whole"), 0).otherwise(_matching("after", "t_after", reach))
    met = hits.join(wanted, ["size", "hash"]).withColumns({"l": left, "r": right})
    met = met.where(F.col("whole") | (F.col("l") + F.col("size") + F.col("r") >= span))
    spans = met.select("row", "item", (F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("size") + F.col("r")).alias("b"))
    spans = cut_lineage(spans.distinct())

    # words covered by spans of a document: each span adds what reaches beyond all before it
    order = W.partitionBy("row").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    reached = F.coalesce(F.max("b").over(order), F.lit(0))
    covered = spans.select("row", "a", "b").distinct().withColumn("new", F.greatest(F.lit(0), F.col("b") - F.greatest("a", reached)))
    n_hit = covered.groupBy("row").agg(F.sum("new").alias("n_hit"))
    listed = spans.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    found = n_hit.join(listed, "row")
    return rows.select("row", "id", "n_words").join(found, "row", "left").select(
        "row", "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
