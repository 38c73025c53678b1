"""Secrets in texts: fixed patterns, and character Markov models of random strings and identifiers."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import id_and_text, text_slices

#: Fixed patterns and least lengths; letters of ASSIGN stand for either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

#: Runs of these characters are candidates of the models.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Words of letters alone: pieces of longer tokens are no ordinary words.
_PLAIN_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]+(?![A-Za-z0-9+/_=-])")
_TOKEN_BYTES = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))
_KEYS = (b"passw", b"secret", b"token", b"api")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Fewest characters of a random part, and how much higher its mean ratio is to be without a digit.
SHORTEST, LETTERS_MORE = 16, 0.6
#: Ordinary words that every sample of identifiers holds, so that small tables are judged like large ones.
COMMON_WORDS = tuple(
    """about account after against amount another because before between business change children company could country
    customer development different during every family first following government group however important information
    interest knowledge language little market member money number other people place problem program public question
    report school service should social state system their there things think through under university water where
    which without world would young
    aber alles andere arbeit beispiel bereits besonders deutsch durch eigentlich entwicklung erste frage geschichte
    gesellschaft gewesen heute immer jahre jetzt kinder leben machen menschen nicht schon seine sprache stadt unter
    verschieden viele wieder wirtschaft wissenschaft zeit zwischen
    alors aussi autre avant avoir beaucoup chaque comme compte contre depuis deux encore enfant entre exemple faire
    femme gouvernement homme jamais jour lequel leur monde notre nouveau parce pays pendant personne peut place
    plusieurs pour premier quelque question rien sans service temps toujours travail ville
    ahora algunos antes aunque cada ciudad como contra cuando cuenta desde desarrollo donde durante ejemplo entonces
    equipo estado gobierno grupo hacer hasta historia hombre lugar manera mayor mejor mientras momento mucho mujer
    mundo nuestro nuevo otros palabra parte persona poder primero problema pueblo servicio siempre sobre tiempo todos
    trabajo vida""".split()
)
_CODE = {c: i + 1 for i, c in enumerate(_SYMBOLS)}
_KINDS = np.array([0] + [1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 for c in _SYMBOLS])


class MarkovPair:
    """Log-likelihood ratio of a second-order model of random strings over one of identifiers."""

    def __init__(self, random_strings: Iterable[str], identifiers: Iterable[str], smoothing: float = 0.1):
        self.ratio = (self._fit(random_strings, smoothing) - self._fit(identifiers, smoothing)).astype(np.float32)

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.array([0, 0, *(_CODE[c] for c in text)])

    def _fit(self, samples: Iterable[str], smoothing: float) -> np.ndarray:
        n = len(_SYMBOLS) + 1
        three = np.zeros((n, n, n))
        for text in samples:
            c = self._codes(text)
            np.add.at(three, (c[:-2], c[1:-1], c[2:]), 1)
        two, one = three.sum(0), three.sum((0, 1)) + 1
        # what the context says of the class, lower, upper, digit or sign, is known from few words
        kinds = np.eye(_KINDS.max() + 1)[_KINDS]
        inside = one / (kinds @ (kinds.T @ one))
        change = np.einsum("abc,ai,bj,ck->ijk", three, kinds, kinds, kinds, optimize=True) + 1
        change = change / change.sum(-1, keepdims=True)
        prior = change[_KINDS[:, None, None], _KINDS[None, :, None], _KINDS[None, None, :]] * inside
        two = (two[None] + 8 * smoothing * n * prior) / (two.sum(-1, keepdims=True)[None] + 8 * smoothing * n)
        return np.log((three + smoothing * n * two) / (three.sum(-1, keepdims=True) + smoothing * n))

    def ratios(self, text: str) -> np.ndarray:
        """The ratio of each character after the two before it."""
        c = self._codes(text)
        return self.ratio[c[:-2], c[1:-1], c[2:]]

    def score(self, text: str) -> float:
        return float(self.ratios(text).sum())


def train(words: Iterable[str], seed: int = 7, size: int = 4000) -> MarkovPair:
    """Models of labelled samples: identifiers made of ``words`` and ``COMMON_WORDS``, and strings drawn with ``seed``.

    Words as long as a candidate are left out, as they may be secrets. There are three identifiers for each
    word, up to ``size`` of them: the same few words over and over would make the model too sure of them.
    """
    draw = random.Random(seed)
    words = sorted({w for w in words if 2 <= len(w) < SHORTEST and _PLAIN_WORD.fullmatch(w)} | set(COMMON_WORDS))
    identifiers = [form for w in words for form in (w.lower(), w.capitalize(), w.upper())]
    for _ in range(min(size, 3 * len(words))):
        parts = draw.choices(words, k=draw.randint(2, 4))
        style = draw.randrange(4)
        if style == 0:
            text = "_".join(p.lower() for p in parts)
        elif style == 1:
            text = parts[0].lower() + "".join(p.capitalize() for p in parts[1:])
        elif style == 2:
            text = "-".join(parts) + (str(draw.randint(0, 99)) if draw.random() < 0.3 else "")
        else:
            text = "".join(parts).upper() if draw.random() < 0.5 else "/".join(parts)
        identifiers.append(text)
    identifiers += [c * n for c in "-=_+/" for n in (16, 24, 40, 80)]
    identifiers += [f"{y}-{m:02}-{d:02}" for y in range(1990, 2030, 3) for m in (1, 6, 12) for d in (1, 15, 28)]
    identifiers += ["".join(draw.choices("0123456789", k=draw.randint(4, 24))) for _ in range(size // 2)]  # numbers
    letters, digits = _SYMBOLS[:52], _SYMBOLS[52:62]
    alphabets = ("0123456789abcdef", letters[26:] + "234567", letters + digits, letters + digits + "+/", letters + digits + "_-")
    strings = ["".join(draw.choices(draw.choice(alphabets), k=draw.randint(16, 48))) for _ in range(size)]
    return MarkovPair(strings, identifiers)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=_order)


def random_spans(text: str, models: MarkovPair, least: float, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Parts of token runs that look random to the models and lie outside all base spans."""
    found = []
    for m in TOKEN.finditer(text):
        at, covers = m.start(), [(s, e) for _, s, e in base if s < m.end() and m.start() < e]
        for s, e in [*sorted(covers), (m.end(), m.end())]:
            if s > at:
                found += _random_parts(text, at, s, models, least)
            at = max(at, e)
    return [("random", s, e) for s, e in found]


def _random_parts(text: str, start: int, end: int, models: MarkovPair, least: float) -> list[tuple[int, int]]:
    """The whole of a run if its mean ratio is high enough, otherwise its best parts of ``SHORTEST`` characters or more.

    A part has the largest sum of ratios above the least one, so one is found whenever any part of that
    length reaches the least mean; what lies before and after it is looked at in the same way.
    """
    piece = text[start:end]
    core = piece.strip("-=_/+")
    if len(core) < SHORTEST:
        return []
    start += piece.index(core)
    ratios = models.ratios(core)
    found, todo = [], [(0, len(core))]
    while todo:
        s, e = todo.pop()
        if e - s < SHORTEST:
            continue
        part = _best_part(ratios[s:e], least, whole=e - s == len(core))
        if part is None:
            continue
        rest, (s, e) = (s, e), _grown(core, s, e, part)
        todo += [(rest[0], s), (e, rest[1])]
        if not any(c.isdigit() for c in core[s:e]):  # letters alone: words of languages the sample may lack
            part = _best_part(ratios[s:e], least + LETTERS_MORE, whole=True)
            if part is None:
                continue
            s, e = _grown(core, s, e, part)
        kept = core[s:e].strip("-=_/+")
        if len(kept) >= SHORTEST:
            s += core[s:e].index(kept)
            found.append((start + s, start + s + len(kept)))
    return sorted(found)


def _grown(core: str, start: int, end: int, part: tuple[int, int]) -> tuple[int, int]:
    """A part of ``core[start:end]`` with the letters and digits that adjoin it there."""
    s, e = start + part[0], start + part[1]
    while s > start and core[s - 1].isalnum():
        s -= 1
    while e < end and core[e].isalnum():
        e += 1
    return s, e


def _best_part(ratios: np.ndarray, least: float, whole: bool) -> tuple[int, int] | None:
    """Where the sum over ``SHORTEST`` or more of what ratios exceed ``least`` by is largest, if not negative."""
    sums = np.concatenate([[0.0], np.cumsum(ratios - least, dtype=np.float64)])
    if whole and sums[-1] >= 0:
        return 0, len(ratios)
    lowest = np.minimum.accumulate(sums[: len(sums) - SHORTEST])
    over = sums[SHORTEST:] - lowest
    end = int(over.argmax())
    if over[end] < 0:
        return None
    return int(sums[: end + 1].argmin()), end + SHORTEST


def _order(span: tuple[str, int, int]) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def candidates(part: pa.Array) -> np.ndarray:
    """Which texts of a slice can have any span: a key word, or a run of 16 token characters."""
    offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
    data = part.buffers()[2]
    raw = bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data is not None else b""
    offsets = offsets - offsets[0]
    run = _TOKEN_BYTES[np.frombuffer(raw, np.uint8)]
    edges = np.diff(np.concatenate([[False], run, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    at = [ends[ends - starts >= 16] - 1]
    lowered = raw.translate(_LOWER)
    for key in _KEYS:
        found, i = [], lowered.find(key)
        while i >= 0:
            found.append(i)
            i = lowered.find(key, i + 1)
        at.append(np.array(found, np.int64))
    hit = np.zeros(len(part), bool)
    for positions in at:
        hit[np.searchsorted(offsets, positions, "right") - 1] = True
    # a run that began in one text may end in another: its first bytes count too
    long = ends - starts >= 16
    for s, e in zip(starts[long].tolist(), ends[long].tolist()):
        hit[np.searchsorted(offsets, s, "right") - 1 : np.searchsorted(offsets, e - 1, "right")] = True
    return hit


def sample_words(docs: DataFrame, text_col: str, rows: int) -> list[str]:
    """Words of a bounded sample: about ``rows`` different texts chosen by hash, 2000 characters of each."""
    texts = id_and_text(docs, text_col, text_col).where(F.col("text").isNotNull())
    share = min(1 << 30, rows * (1 << 30) // max(1, texts.count()) + 1)
    taken = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share).select(F.substring("text", 1, 2000).alias("t"))
    return sorted({w for r in taken.distinct().limit(2 * rows).collect() for w in _PLAIN_WORD.findall(r.t)})


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_rows: int = 500, least: float = 0.6) -> DataFrame:
    """Per row of ``docs``: ``(id, base, spans)``.

    ``base`` and ``spans`` are arrays of ``(kind, start, end)`` in code points, by start, then
    kind. Base spans come from the fixed patterns; the models add spans of kind ``random`` for what
    of token runs lies outside base spans and has a log-likelihood ratio of ``least`` or more a
    character, ``LETTERS_MORE`` above it where it has no digit: the whole run or its best parts. Identifiers of the
    training sample are made from words of ``training_rows`` texts; everything else looks at
    whole texts. Null texts are empty; repeated rows stay; an empty table gives no rows.
    """
    models = train(sample_words(docs, text_col, training_rows))
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    span = "array<struct<kind:string,start:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, part in text_slices(batch, "text"):
                base, spans = spans_of(part, models, least)
                columns = [batch.column("id").slice(at, to - at), pa.array(_dicts(base), spans_type), pa.array(_dicts(spans), spans_type)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "base", "spans"])

    return rows.mapInArrow(run, f"id {kind}, base {span}, spans {span}")


def redact(
    docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", training_rows: int = 500, least: float = 0.6
) -> DataFrame:
    """Rows of ``docs``, all columns, with the spans that ``find`` finds replaced by ``[secret]``.

    ``length_col``, if there is one, is set to the new length where a text changes. Null texts stay null,
    repeated rows stay, texts of any length are read whole; an empty table stays empty.
    """
    models = train(sample_words(docs, text_col, training_rows))
    place = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.column(place).cast(pa.string())], ["text"])
            for at, to, part in text_slices(plain, "text"):
                rows, (_, spans) = batch.slice(at, to - at), spans_of(part, models, least)
                if any(spans):
                    columns = list(rows.columns)
                    texts = [redacted(t, s) if s else t for t, s in zip(columns[place].to_pylist(), spans)]
                    columns[place] = pa.array(texts, columns[place].type)
                    if length is not None:
                        sizes = [len(t) if s else n for t, s, n in zip(texts, spans, columns[length].to_pylist())]
                        columns[length] = pa.array(sizes, columns[length].type)
                    rows = pa.RecordBatch.from_arrays(columns, schema=rows.schema)
                yield rows

    return docs.mapInArrow(run, docs.schema)


def spans_of(part: pa.Array, models: MarkovPair, least: float) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Base spans and all spans of each text of a slice."""
    base, spans = [[] for _ in range(len(part))], [[] for _ in range(len(part))]
    for i in np.flatnonzero(candidates(part)).tolist():
        text = part[i].as_py()
        base[i] = base_spans(text)
        spans[i] = sorted(base[i] + random_spans(text, models, least, base[i]), key=_order)
    return base, spans


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, or union of overlapping spans, replaced by ``[secret]``."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _dicts(rows: list[list[tuple[str, int, int]]]) -> list[list[dict]]:
    return [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in rows]


def digest_text(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
