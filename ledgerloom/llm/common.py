"""Helpers shared by the operators of this folder: columns, checkpoints, words as arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.session import cut_lineage, ensure_checkpoint_dir

#: Bytes of words that are hashed at once, and of texts that are turned into words at once.
SLICE_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_TABLES: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies; it is installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, under its own names, so others cannot clash."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_row(df: DataFrame, name: str = "row") -> DataFrame:
    """Checkpoints ``df`` and numbers its rows; the numbers stay the same on every later read."""
    return cut_lineage(df).withColumn(name, F.monotonically_increasing_id())


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, whose rows have a few fixed-size values and are counted here, as a broadcast side if ``rows`` or fewer."""
    return F.broadcast(df) if df.count() <= rows else df


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """Runs of rows whose texts have about ``limit`` bytes together; one long text makes a run alone."""
    texts = batch.column(column)
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + limit, "right")) - 1)
        yield at, to, texts.slice(at, to - at)
        at = to


class Words:
    """Words of consecutive texts as arrays: hash of each word, and which words each text has."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray, lower: bool, hashed: bool = True, prepare=None):
        n = len(texts)
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        raw = raw if prepare is None else prepare(raw)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = is_word[raw]
        begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        full = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        begin[first], end[last] = inside[1:-1][first], inside[1:-1][last]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.offsets = offsets
        #: word numbers at which each text begins, and the end of the last one
        self.bounds = np.searchsorted(self.starts, offsets)
        self.raw, self.lower = raw, lower
        self.hashes = self._hash() if hashed else None

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + SLICE_BYTES)))
            base = self.starts[at]
            values = self.raw[base : self.ends[to - 1]]
            if self.lower:
                values = _lowered()[values]
            out[at:to] = span_hashes(values.astype(np.uint64) + np.uint64(1), self.starts[at:to] - base, self.ends[at:to] - base)
            at = to
        return out

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values``, equal for equal contents wherever they stand."""
    power, inverse = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words; ``len(words) - size + 1`` of them."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size))
        for i in range(size):
            out = out * _MULTIPLIER + words[i : i + n]
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a multiplicative hash: spreads every bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def last_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the last minimum in every run of ``width`` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        size = len(best) - step
        right = best[step:] <= best[:size]
        best, at, have = np.where(right, best[step:], best[:size]), np.where(right, at[step:], at[:size]), have + step
    return at[:n]


def shingle_bytes() -> np.ndarray:
    """Word bytes where words are what white space separates."""
    if "shingle" not in _TABLES:
        _TABLES["shingle"] = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
    return _TABLES["shingle"]


def letter_bytes() -> np.ndarray:
    """Word bytes where words are ASCII letters and digits and everything beyond ASCII."""
    if "letter" not in _TABLES:
        i = np.arange(256)
        _TABLES["letter"] = (i >= 0x80) | ((i >= 0x30) & (i <= 0x39)) | ((i >= 0x61) & (i <= 0x7A)) | ((i >= 0x41) & (i <= 0x5A))
    return _TABLES["letter"]


def _lowered() -> np.ndarray:
    if "lower" not in _TABLES:
        i = np.arange(256, dtype=np.uint8)
        i[0x41:0x5B] += 0x20
        _TABLES["lower"] = i
    return _TABLES["lower"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_TABLES.get("power", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        odd = int(_MULTIPLIER)
        with np.errstate(over="ignore"):
            for name, x in (("power", odd), ("inverse", pow(odd, -1, 1 << 64))):
                steps = np.full(size, np.uint64(x))
                steps[0] = 1
                _TABLES[name] = np.cumprod(steps)
    return _TABLES["power"], _TABLES["inverse"]
