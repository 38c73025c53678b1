"""Fill-in-middle: texts cut at unit borders into prefix, middle and suffix, and put in another order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import id_and_text, text_slices

#: A run of ASCII letters, or one other character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: What stands before prefix, suffix and middle in the output.
MARKS = ("<P>", "<S>", "<M>")


class Cutter:
    """Cuts one text after another; which units and which form follow from the id alone.

    One full match of ``(unit)*`` keeps the end of every repetition, so ``ends(1)`` gives the number of
    units and both cuts. The repetition is possessive: nothing is kept for going back. A text needs
    about 100 bytes a unit while it is matched.
    """

    def __init__(self, unit: str = UNIT, seed: str = "1", plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = MARKS):
        if any(not m or m[0] in other[1:] for m in marks for other in marks) or len(set(marks)) < 3:
            raise ValueError("marks differ, and their first characters stand nowhere else in them")
        self.units = regex.compile(f"((?>{unit}))*+")
        self.seed, self.plain_from, self.spm_below, self.marks = seed, plain_from, spm_below, marks

    def draws(self, key: str) -> list[int]:
        """Four numbers below 2**32 from the seed and the id."""
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).digest()
        return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]

    def __call__(self, key: str, text: str) -> tuple[int, str, int | None, int | None, str]:
        """``(n, form, prefix_chars, middle_chars, output)``."""
        match = self.units.fullmatch(text)
        if match is None:
            raise ValueError(f"the unit pattern does not cover the text of {key or 'a row without id'}")
        ends = match.ends(1)
        n = len(ends)
        one, two, three, four = self.draws(key)
        if not text or three % 100 >= self.plain_from or any(m in text for m in self.marks):
            return n, "plain", None, None, text
        first, second = sorted((one % (n + 1), two % (n + 1)))
        a, b = (ends[i - 1] if i else 0 for i in (first, second))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        p, s, m = self.marks
        if four % 100 < self.spm_below:
            return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def filled(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, seed: str = "1",
    plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """Per row of ``docs``: ``(id, n, form, prefix_chars, middle_chars, output)``.

    ``n`` counts the units of the whole text, lengths are code points. The form is ``plain`` (the text
    as it is, lengths null) for an empty text, one that holds a mark, or by the id's third draw at
    ``plain_from`` of 100 or more; otherwise ``spm`` by the fourth draw below ``spm_below`` of 100, else ``psm``.
    Null texts are empty; a null id counts as empty text in the draws; rows with equal ids are cut
    by the same draws, each over its own text; repeated rows stay; an empty table gives no rows. Any
    length of text is one row in one task. No shuffle.
    """
    Cutter(unit, seed, plain_from, spm_below, marks)
    rows = id_and_text(docs, id_col, text_col).withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("")))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(unit, seed, plain_from, spm_below, marks)
        for batch in batches:
            ids, keys = batch.column("id"), batch.column("key")
            for at, to, part in text_slices(batch, "text"):
                made = [cut(key, text) for key, text in zip(keys.slice(at, to - at).to_pylist(), part.to_pylist())]
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(values, t) for values, t in zip(zip(*made), types)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), *columns], names)

    return rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made of; pieces hold no mark, so marks part them."""
    between = "|".join(re.escape(m) for m in marks)
    parts = F.split(F.col(output), between, -1)
    ordered = (
        F.when(F.col(form) == "psm", F.struct(F.lit(1).alias("a"), F.lit(3).alias("b"), F.lit(2).alias("c")))
        .when(F.col(form) == "spm", F.struct(F.lit(2).alias("a"), F.lit(3).alias("b"), F.lit(1).alias("c")))
    )
    joined = F.transform(F.array(F.struct(parts.alias("p"), ordered.alias("o"))), lambda x: F.concat(*[F.get(x["p"], x["o"][k]) for k in "abc"]))
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(F.get(joined, F.lit(0)))
