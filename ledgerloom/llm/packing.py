"""Packing token sequences: every piece goes to the fill level that keeps open windows few."""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerloom.llm.common import id_and_text, text_slices

_STATE: dict[str, tuple] = {}
#: The rank encoder's pattern cannot go back over much more white space than this in one run.
_LONG_BLANK = 50_000


class Encoder:
    """Ids of whole texts by a byte-level BPE vocabulary.

    ``path`` is a ``tokenizers`` file; the same vocabulary as ranks lies beside it with the suffix
    ``.tiktoken`` and gives the same ids four times as fast. Texts that contain a special token
    are encoded by the ``tokenizers`` file, which knows those, and so are texts with very long runs of
    white space, which the rank encoder fails on.
    """

    def __init__(self, path: str):
        if path not in _STATE:
            _STATE[path] = self._load(path)
        self.plain, self.whole, self.special = _STATE[path]
        self.blank = re.compile(rf"\s{{{_LONG_BLANK}}}")

    @staticmethod
    def _load(path: str) -> tuple:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = Tokenizer.from_file(path)
        return plain.encode_ordinary, whole, [x.content for x in whole.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        whole = any(x in text for x in self.special) or (len(text) >= _LONG_BLANK and self.blank.search(text))
        ids = self.whole.encode(text, add_special_tokens=False).ids if whole else self.plain(text)
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


class LevelPacker:
    """Sum-of-squares packing of one task's pieces into windows of ``size`` tokens.

    ``counts[h]`` is the number of open windows filled to ``h``. A piece goes where the sum of
    the squared counts of partly filled windows comes out smallest, a new window (level 0)
    included; the fuller level wins a tie. Windows of a level are taken last in, first out.
    """

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.levels: dict[int, list[list]] = {}
        self.open = 0

    def place(self, piece: tuple) -> list[tuple] | None:
        """Puts a piece ``(..., ids)`` in a window; returns the window's pieces once it is full."""
        n, size, counts = len(piece[-1]) // 4, self.size, self.counts
        levels = np.flatnonzero(counts[: size - n + 1])
        levels = levels[levels > 0]
        to = levels + n
        gain = np.where(to < size, 2 * counts[to] + 1, 0) - 2 * counts[levels] + 1
        fresh = 2 * counts[n] + 1 if n < size else 0
        if len(levels) and gain.min() <= fresh:
            at = int(levels[np.flatnonzero(gain == gain.min())[-1]])
            window = self.levels[at].pop()
            counts[at] -= 1
            self.open -= 1
        else:
            at, window = 0, []
        window.append(piece)
        if at + n == size:
            return window
        self.levels.setdefault(at + n, []).append(window)
        counts[at + n] += 1
        self.open += 1
        return None

    def drain(self) -> Iterator[list[tuple]]:
        """Closes all windows: the emptiest are cut to fill the fullest; the last is cut at powers of two."""
        rest = [w for level in sorted(self.levels, reverse=True) for w in self.levels[level]]
        self.levels, self.open = {}, 0
        self.counts[:] = 0
        loose: list[tuple] = []
        low, high = 0, len(rest)
        while low < high:
            window = rest[low]
            low += 1
            room = self.size - sum(len(p[-1]) // 4 for p in window)
            while room:
                if not loose:
                    if low == high:
                        break
                    high -= 1
                    loose = rest[high]
                piece = loose.pop()
                n = len(piece[-1]) // 4
                if n > room:
                    head, piece = cut(piece, room)
                    loose.append(piece)
                    piece, n = head, room
                window.append(piece)
                room -= n
            if not room:
                yield window
            else:
                loose = window
        yield from by_powers(loose, self.size)


def cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
    """The first ``at`` ids of ``(row, start, ids)`` and the rest."""
    row, start, ids = piece
    return (row, start, ids[: 4 * at]), (row, start + at, ids[4 * at :])


def by_powers(pieces: list[tuple], size: int) -> Iterator[list[tuple]]:
    """Pieces as sequences whose lengths are the powers of two of their total; none needs padding."""
    total = sum(len(p[-1]) // 4 for p in pieces)
    pieces = list(reversed(pieces))
    while total:
        want = min(size, 1 << (total.bit_length() - 1))
        total -= want
        out = []
        while want:
            piece = pieces.pop()
            if len(piece[-1]) // 4 > want:
                piece, rest = cut(piece, want)
                pieces.append(rest)
            out.append(piece)
            want -= len(piece[-1]) // 4
        yield out


def packed(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    size: int = 2048, end_id: int = 1, open_windows: int = 1024,
) -> DataFrame:
    """Per piece ``(id, start, length, ids, doc_tokens, sequence_id, offset)``.

    Every document becomes the ids of its whole text and ``end_id``. Full windows are cut off
    first; what is left goes through ``LevelPacker``. A task packs the rows it reads and needs no
    shuffle; it holds ``open_windows`` open windows at most, then cuts them into full ones, as it
    does at its end, so no sequence is padded: all have ``size`` ids or a power of two. Null
    texts are empty and become ``end_id`` alone; repeated rows are packed one by one; an empty
    table gives no rows. Sequence ids hold the task's partition in their upper bits.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    schema = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer), LevelPacker(size)
        sequence = TaskContext.get().partitionId() << 36
        out: list[tuple] = []

        def emit(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for (row, total), start, ids in window:
                out.append((row, start, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(names)
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("id").type
            for at, to, part in text_slices(batch, "text"):
                for row, ids in zip(batch.column("id").slice(at, to - at).to_pylist(), map(encoder, part.to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    full = total // size * size
                    for start in range(0, full, size):
                        emit([((row, total), start, ids[4 * start : 4 * (start + size)])])
                    if full < total:
                        window = packer.place(((row, total), full, ids[4 * full :]))
                        if window is not None:
                            emit(window)
                        if packer.open > open_windows:
                            for window in packer.drain():
                                emit(window)
                yield flush()
        for window in packer.drain():
            emit(window)
            if len(out) > 1000:
                yield flush()
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)
