"""Personal data: fixed patterns, and a semi-Markov conditional random field over token segments."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import id_and_text, text_slices
from ledgerloom.llm.secrets import sample_words

KINDS = ("email", "ip", "card", "phone", "id")
#: Tokens an entity may have.
LONGEST = 5
#: Rows of the weight table; features are hashed into it.
SLOTS = 1 << 14

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a run of digits that fails at its first digit fails at all others, so only first digits are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]")
_SHAPE = re.compile(r"[0-9]+|[^\W\d_]+|\s+")
_EDGES = "\"'`<>[]{}.,;:!?*=|&%$#~_"

Span = tuple[str, int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: what stands before each ``@``, if a domain follows; linear on any text."""
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            after = domain.end()
        at = text.find("@", max(at + 1, after))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start; matches that fail their test are dropped."""
    found = [("email", s, e) for s, e in emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = digits_of(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


class SemiMarkov:
    """Scores every segment of up to ``LONGEST`` tokens as a whole; other tokens stand alone as none."""

    def __init__(self):
        self.weights = np.zeros((SLOTS, len(KINDS) + 1))

    def lattice(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
        """``(first, last, features)`` of the segments of a window, single tokens first."""
        triggers = [bool(_TRIGGER.search(text, s, e)) for s, e in tokens]
        out = []
        for i in range(len(tokens)):
            for j in range(i, min(len(tokens), i + LONGEST)):
                if j == i or (triggers[i] and triggers[j]):
                    s, e = trimmed(text, tokens[i][0], tokens[j][1])
                    before = text[tokens[i - 1][0] : tokens[i - 1][1]] if i else ""
                    out.append((i, j, features(text[s:e], before, j - i + 1)))
        return out

    def scores(self, lattice: list) -> np.ndarray:
        flat = np.concatenate([f for _, _, f in lattice])
        firsts = np.cumsum([0] + [len(f) for _, _, f in lattice[:-1]])
        s = np.add.reduceat(self.weights[flat], firsts)
        s[[i != j for i, j, _ in lattice], -1] = -np.inf  # none has one token
        return s

    def best(self, lattice: list, n: int) -> list[tuple[int, int, int]]:
        """Segments ``(first, last, kind)`` of the best cut, by dynamic programming over ends."""
        s = self.scores(lattice)
        kinds, tops = s.argmax(1).tolist(), s.max(1).tolist()
        value, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        for (i, j, _), kind, top in sorted(zip(lattice, kinds, tops), key=lambda x: (x[0][0], x[0][1])):
            if value[i] + top > value[j + 1]:
                value[j + 1], back[j + 1] = value[i] + top, (i, j, kind)
        out = []
        while n:
            out.append(back[n])
            n = back[n][0]
        return out[::-1]

    def step(self, lattice: list, n: int, truth: set[tuple[int, int, int]], rate: float, squares: np.ndarray) -> None:
        """One gradient step: observed less expected features of all segments of one window."""
        s = self.scores(lattice)
        total = np.logaddexp.reduce(s, 1)
        order = sorted(range(len(lattice)), key=lambda k: (lattice[k][0], lattice[k][1]))
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0
        for k in order:
            i, j, _ = lattice[k]
            ahead[j + 1] = np.logaddexp(ahead[j + 1], ahead[i] + total[k])
        for k in sorted(order, key=lambda k: (-lattice[k][1], -lattice[k][0])):
            i, j, _ = lattice[k]
            behind[i] = np.logaddexp(behind[i], behind[j + 1] + total[k])
        for k, (i, j, f) in enumerate(lattice):
            grad = -np.exp(np.clip(s[k] + ahead[i] + behind[j + 1] - ahead[n], -60, 0))
            for kind in range(len(KINDS) + 1):
                if (i, j, kind) in truth:
                    grad[kind] += 1
            grad[~np.isfinite(grad)] = 0
            squares[f] += grad**2
            self.weights[f] += rate * grad / np.sqrt(squares[f])


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """A span without punctuation at its edges; brackets stay where they have their partner."""
    while s < e and (text[s] in _EDGES or text[s] == ")" or text[s] == "(" and ")" not in text[s:e]):
        s += 1
    while s < e and (text[e - 1] in _EDGES or text[e - 1] == "(" or text[e - 1] == ")" and "(" not in text[s:e]):
        e -= 1
    return s, e


def features(span: str, before: str, tokens: int) -> list[int]:
    """Hashed features of a whole candidate segment."""
    digits = digits_of(span)
    shape = _SHAPE.sub(lambda m: f"d{min(len(m[0]), 20)}" if m[0][0].isdigit() else "_" if m[0][0].isspace() else "a", span)[:40]
    names = [
        "bias", f"tokens {tokens}", f"shape {shape}", f"digits {min(len(digits), 20)}", f"coarse {re.sub('[0-9]+', '', shape)[:20]}",
        f"first {span[:1] if span[:1] in '+(@$' else 'd' if span[:1].isdigit() else 'x'}",
        f"cue {before.lower().strip(_EDGES + '()')[:12]}",
    ]
    if "@" in span:
        found = emails(span)
        names.append(f"email {len(found)} {bool(found) and found[0] == (0, len(span))}")
    if len(digits) >= 13 and re.fullmatch(r"[0-9 -]+", span):
        names.append(f"luhn {luhn(digits)} {13 <= len(digits) <= 19}")
    if span.count(".") == 3 and re.fullmatch(r"[0-9.]+", span):
        names.append(f"octets {all(0 < len(p) <= 3 and int(p) <= 255 for p in span.split('.'))}")
    if re.fullmatch(r"\+?[0-9().\s-]+", span):
        names.append(f"number {'+' in span} {'(' in span} {9 <= len(digits) <= 15} {sum(map(len, re.findall('[^0-9]+', span))) > 0}")
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens around those with a digit or ``@``; no entity can reach from one into another."""
    found: list[tuple[int, int]] = []  # the window so far; it ends with the last trigger
    since: list[tuple[int, int]] = []  # tokens since then, LONGEST at most
    for m in _TOKEN.finditer(text):
        since = (since + [m.span()])[-LONGEST:]
        if _TRIGGER.search(text, *m.span()):
            if found and len(since) == LONGEST:
                yield found
                found = []
            found = found + since if found else since[-2:]
            since = []
    if found:
        yield found


def method_spans(text: str, model: SemiMarkov, base: list[Span]) -> list[Span]:
    """Entities of the best cuts that lie outside all base spans."""
    out = []
    for tokens in windows(text):
        for i, j, kind in model.best(model.lattice(text, tokens), len(tokens)):
            if kind < len(KINDS):
                s, e = trimmed(text, tokens[i][0], tokens[j][1])
                if s < e and not any(a < e and s < b for _, a, b in base):
                    out.append((KINDS[kind], s, e))
    return out


def examples(words: list[str], seed: int, size: int) -> Iterator[tuple[str, list[Span]]]:
    """Labelled sentences: sampled words with entities and look-alikes put in between."""
    draw = random.Random(seed)
    words = words or ["the", "word"]
    number = lambda n: "".join(draw.choices("0123456789", k=n))

    def card() -> str:
        lead = draw.choice("345") + number(draw.choice([11, 13, 14, 14, 14, 17]))
        digits = next(lead + c for c in "0123456789" if luhn(lead + c))
        sep = draw.choice(["", "", " ", "-"])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if sep else digits

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return draw.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{draw.randint(20, 99)} {number(2)} {number(4)} {number(4)}", f"+1{a}{b}{c}", f"+1-{a}-{b}-{c}"])

    def email() -> str:
        name = draw.choice(words).lower() + draw.choice(["", ".", "_", "+"]) + draw.choice([number(2), draw.choice(words).lower()])
        return name + "@" + draw.choice(words).lower() + draw.choice([".com", ".org", ".co.uk", number(1) + ".example.com"])

    makers = {
        "email": email, "card": card, "phone": phone, "ip": lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4)),
        "id": lambda: f"{number(3)}-{number(2)}-{number(4)}",
    }
    others = [
        lambda: str(draw.randint(1, 99)), lambda: str(draw.randint(1900, 2030)), lambda: f"{draw.randint(0, 99)}.{draw.randint(0, 99)}",
        lambda: f"{draw.randint(1, 9)}.0", lambda: f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}",
        lambda: f"{draw.randint(0, 23)}:{draw.randint(0, 59):02}", lambda: f"${draw.randint(1, 999)},{number(3)}.{number(2)}",
        lambda: number(draw.choice([3, 4, 5, 6, 8])), lambda: "".join(draw.choices("0123456789abcdef", k=draw.choice([18, 24, 40]))),
        lambda: "password=" + "".join(draw.choices("0123456789abcdef", k=18)), lambda: f"token = \"{''.join(draw.choices('0123456789abcdef', k=40))}\"",
        lambda: "AKIA" + "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), lambda: f"{draw.randint(256, 999)}.{number(1)}.{number(2)}.{number(3)}",
        lambda: f"{draw.randint(1, 9)}.{draw.randint(0, 9)}.{draw.randint(0, 9)}", lambda: f"{draw.randint(1, 100)}%", lambda: "@" + draw.choice(words).lower(),
        lambda: f"{draw.choice(words)}{draw.randint(1, 99)}", lambda: number(16), lambda: number(draw.choice([9, 10, 11, 12])),
    ]
    for _ in range(size):
        text, spans = "", []
        for _ in range(draw.randint(1, 4)):
            text += " ".join(draw.choices(words, k=draw.randint(0, 6))) + " "
            if draw.random() < 0.55:
                kind = draw.choice(KINDS)
                made = makers[kind]()
                open_, close = draw.choice([("", ""), ("", ""), ("", "."), ("", ","), ("<", ">"), ('"', '"')])
                spans.append((kind, len(text) + len(open_), len(text) + len(open_) + len(made)))
                text += open_ + made + close + " "
            else:
                text += draw.choice(others)() + draw.choice(["", "", ".", ","]) + " "
        yield text, spans


def train(words: list[str], seed: int = 5, size: int = 700, rounds: int = 3, rate: float = 0.4) -> SemiMarkov:
    """Fits the field by stochastic gradient on generated labelled sentences."""
    model, cases = SemiMarkov(), []
    for text, spans in examples(words, seed, size):
        for tokens in windows(text):
            truth, taken = set(), set()
            for kind, s, e in spans:
                inside = [k for k, (a, b) in enumerate(tokens) if a < e and s < b]
                if inside:
                    truth.add((inside[0], inside[-1], KINDS.index(kind)))
                    taken.update(inside)
            truth.update((k, k, len(KINDS)) for k in range(len(tokens)) if k not in taken)
            cases.append((model.lattice(text, tokens), len(tokens), truth))
    squares = np.full_like(model.weights, 1e-2)
    for _ in range(rounds):
        for lattice, n, truth in cases:
            model.step(lattice, n, truth, rate, squares)
    return model


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_rows: int = 300) -> DataFrame:
    """Per row of ``docs``: ``(id, base, spans)``, arrays of ``(kind, start, end)`` in code points.

    Both are ordered by kind as in ``KINDS``, then start. Base spans come from the fixed patterns;
    the field adds entities outside them. Words of its training sentences come from
    ``training_rows`` texts; everything else looks at whole texts. Texts without a digit or ``@``
    have no span; null texts are empty; repeated rows stay; an empty table gives no rows.
    """
    model = train(sample_words(docs, text_col, training_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, part in text_slices(batch, "text"):
                base, spans = [[] for _ in range(at, to)], [[] for _ in range(at, to)]
                for i in candidates(part).tolist():
                    text = part[i].as_py()
                    base[i] = base_spans(text)
                    spans[i] = sorted(base[i] + method_spans(text, shared.value, base[i]), key=_order)
                columns = [batch.column("id").slice(at, to - at)]
                columns += [pa.array([[dict(zip(("kind", "start", "end"), x)) for x in row] for row in rows_], spans_type) for rows_ in (base, spans)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "base", "spans"])

    return rows.mapInArrow(run, f"id {kind}, base {span}, spans {span}")


def candidates(part: pa.Array) -> np.ndarray:
    """Numbers of the texts of a slice that hold a digit or ``@``."""
    offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
    if part.buffers()[2] is None:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    at = np.flatnonzero((raw == 0x40) | ((raw >= 0x30) & (raw <= 0x39)))
    return np.unique(np.searchsorted(offsets - offsets[0], at, "right") - 1)


def _order(span: Span) -> tuple:
    return KINDS.index(span[0]), span[1], span[2]
