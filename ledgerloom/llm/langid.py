"""Languages of words and documents by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import Words, id_and_text, mix, text_slices

UNKNOWN = "und"
#: Rows of the weight tables, by kind of feature.
TABLES = {"gram": 1 << 15, "prefix": 1 << 15, "suffix": 1 << 15, "lexicon": 1 << 17}
#: Words of a block; blocks of all texts go through the chain side by side.
BLOCK = 32

_LETTERS = np.array([(0x41 <= b <= 0x5A) or (0x61 <= b <= 0x7A) or b >= 0x80 for b in range(256)])


def _lowered(raw: np.ndarray) -> np.ndarray:
    """ASCII capitals and those of the two-byte Latin-1 range as small letters."""
    out = raw.copy()
    out[(raw >= 0x41) & (raw <= 0x5A)] += 0x20
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    out[after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 0x20
    return out


class Features:
    """Slots of the features of every word of some texts."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, _LETTERS, lower=False, prepare=_lowered)
        self.bounds, n = words.bounds, len(words.starts)
        lengths = words.ends - words.starts
        #: where the grams of each word begin among all grams; a word has one for each byte
        self.firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        self.word = np.repeat(np.arange(n), lengths)
        at = np.arange(len(self.word)) - self.firsts[self.word] + words.starts[self.word] if n else np.zeros(0, np.int64)
        raw = np.concatenate([[32], words.raw, [32]]).astype(np.uint64)
        before, here, after = raw[at], raw[at + 1], raw[at + 2]
        if n:
            before[self.firsts] = 32
            after[self.firsts + lengths - 1] = 32
        slots = {"gram": (before << np.uint64(16)) | (here << np.uint64(8)) | after, "lexicon": words.hashes}
        slots["prefix"], slots["suffix"] = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for i in range(4):
            has = lengths > i
            slots["prefix"][has] = (slots["prefix"][has] << np.uint64(8)) | raw[words.starts[has] + i + 1]
            slots["suffix"][has] = (slots["suffix"][has] << np.uint64(8)) | raw[words.ends[has] - i]
        self.slots = {k: (mix(v) & np.uint64(TABLES[k] - 1)).astype(np.int64) for k, v in slots.items()}

    def scores(self, weights: dict[str, np.ndarray]) -> np.ndarray:
        """Score of each label for each word."""
        if not len(self.firsts):
            return np.zeros((0, weights["gram"].shape[1]))
        grams = np.add.reduceat(weights["gram"][self.slots["gram"]], self.firsts)
        return grams + sum(weights[k][self.slots[k]] for k in ("prefix", "suffix", "lexicon"))


class Chain:
    """The trained field: labels, weight tables, transition and start scores."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.weights = {k: np.zeros((size, n), np.float32) for k, size in TABLES.items()}
        self.step, self.start = np.zeros((n, n)), np.zeros(n)

    def marginals(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of each label for each word, by forward-backward over each text.

        Texts are cut into blocks. The product of transition matrices of every block comes
        first, then the messages pass from block to block, then inside all blocks at once; so
        a long text takes as many sequential steps as it has blocks.
        """
        k, counts = len(self.labels), np.diff(bounds)
        texts = np.flatnonzero(counts)
        if not len(texts):
            return np.zeros((0, k))
        step = np.exp(self.step - self.step.max())
        start = np.exp(self.start - self.start.max())
        blocks = -(-counts[texts] // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        text_of_word = np.repeat(np.arange(len(texts)), counts[texts])
        place = np.arange(len(scores)) - bounds[texts][text_of_word] + bounds[0] + first[text_of_word] * BLOCK
        emit = np.ones((blocks.sum() * BLOCK, k))
        emit[place] = np.exp(scores - scores.max(1, keepdims=True))
        real = np.zeros(len(emit), bool)
        real[place] = True
        emit, real = emit.reshape(-1, BLOCK, k), real.reshape(-1, BLOCK)
        begins = np.zeros(len(emit), bool)
        begins[first] = True

        product = np.where(begins[:, None, None], start[None, None, :], step[None]) * emit[:, 0, None, :]
        for s in range(1, BLOCK):
            on = real[:, s]
            if not on.any():
                break
            product[on] = (product[on].reshape(-1, k) @ step).reshape(-1, k, k) * emit[on, s, None, :]
            if s % 8 == 0:
                product /= product.max((1, 2), keepdims=True)
        product /= product.max((1, 2), keepdims=True)

        enter, leave = np.empty((len(emit), k)), np.empty((len(emit), k))
        for j in range(blocks.max()):
            has = blocks > j
            at = first[has] + j
            if j == 0:
                enter[at] = 1 / k
            else:
                enter[at] = _scaled(np.einsum("nk,nkl->nl", enter[at - 1], product[at - 1]))
        last = first + blocks - 1
        for j in range(blocks.max()):
            has = blocks > j
            at = last[has] - j
            if j == 0:
                leave[at] = 1 / k
            else:
                leave[at] = _scaled(np.einsum("nkl,nl->nk", product[at + 1], leave[at + 1]))

        ahead = np.empty_like(emit)
        now = enter
        for s in range(BLOCK):
            move = now @ step
            if s == 0:
                move[begins] = start * now[begins].sum(1, keepdims=True)
            now = np.where(real[:, s, None], _scaled(move * emit[:, s]), now)
            ahead[:, s] = now
        now = leave
        out = np.empty_like(emit)
        for s in range(BLOCK - 1, -1, -1):
            out[:, s] = _scaled(ahead[:, s] * now)
            now = np.where(real[:, s, None], _scaled((emit[:, s] * now) @ step.T), now)
        return out.reshape(-1, k)[place]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-300)


def train(samples: list[tuple[str, str]], seed: int = 11, length: int = 48, batch: int = 192, steps: int = 240, rate: float = 0.25) -> Chain:
    """Fits the field to labelled texts, cut into pieces and joined to code-switched sequences.

    Every sequence has ``length`` words: pieces of one to three texts one after the other, each
    word with the label of its text. The gradient of the conditional likelihood is the observed
    less the expected counts, from forward-backward over each batch.
    """
    draw = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in samples})
    chain = Chain(labels)
    if len(labels) < 2:
        return chain
    feats = Features(pa.array([t for t, _ in samples], pa.string()))
    counts = np.diff(feats.bounds)
    code = np.array([labels.index(lang) for _, lang in samples])
    groups = [np.flatnonzero((code == i) & (counts >= 8)) for i in range(len(labels))]
    groups = [g if len(g) else np.flatnonzero(code == i) for i, g in enumerate(groups)]
    lengths = np.diff(np.append(feats.firsts, len(feats.word)))
    squares: dict[str, np.ndarray] = {k: np.full_like(w, 1e-3) for k, w in chain.weights.items()}
    squares |= {"step": np.full_like(chain.step, 1e-3), "start": np.full_like(chain.start, 1e-3)}
    for _ in range(steps):
        chosen, truth = [], []
        for _ in range(batch):
            parts = draw.choice([1, 1, 2, 3])
            left = length
            for p in range(parts):
                lang = draw.integers(len(labels))
                if not len(groups[lang]):
                    continue
                text = draw.choice(groups[lang])
                want = min(left if p == parts - 1 else draw.integers(3, length // 2), left)
                n = counts[text]
                at = draw.integers(0, max(1, n - want + 1))
                got = min(n, want)
                chosen.append(np.arange(at, at + got) + feats.bounds[text])
                truth.append(np.full(got, lang))
                left -= got
            if left:  # short texts: fill with any words of the first group
                lang = int(truth[-1][-1]) if truth and len(truth[-1]) else 0
                pool = groups[lang]
                while left:
                    text = draw.choice(pool)
                    got = min(left, counts[text]) or 1
                    chosen.append(np.arange(got) + feats.bounds[text])
                    truth.append(np.full(got, lang))
                    left -= got
        words, y = np.concatenate(chosen), np.concatenate(truth)
        n = len(words)
        grams = np.repeat(feats.firsts[words] - np.concatenate([[0], np.cumsum(lengths[words])[:-1]]), lengths[words]) + np.arange(lengths[words].sum())
        owner = np.repeat(np.arange(n), lengths[words])
        own = {k: feats.slots[k][words] for k in ("prefix", "suffix", "lexicon")} | {"gram": feats.slots["gram"][grams]}
        scores = sum(chain.weights[k][own[k]] for k in ("prefix", "suffix", "lexicon"))
        scores = scores + np.add.reduceat(chain.weights["gram"][own["gram"]], np.concatenate([[0], np.cumsum(lengths[words])[:-1]]))
        bounds = np.arange(0, n + 1, length)
        p = chain.marginals(scores, bounds)
        error = np.eye(len(labels))[y] - p
        for k, slot in own.items():
            by = error[owner] if k == "gram" else error
            used, back = np.unique(slot, return_inverse=True)
            grad = np.stack([np.bincount(back, by[:, j], len(used)) for j in range(len(labels))], 1) / np.sqrt(n) - 1e-3 * chain.weights[k][used]
            squares[k][used] += grad**2
            chain.weights[k][used] += rate * grad / np.sqrt(squares[k][used])
        pairs = np.zeros_like(chain.step)
        inner = np.ones(n, bool)
        inner[bounds[:-1]] = False
        np.add.at(pairs, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
        expected = _pair_counts(chain, scores, bounds)
        firsts = np.zeros(len(labels))
        np.add.at(firsts, y[bounds[:-1]], 1)
        for name, grad in (("step", (pairs - expected) / n), ("start", (firsts - p[bounds[:-1]].sum(0)) / n)):
            squares[name] += grad**2
            setattr(chain, name, getattr(chain, name) + 0.1 * grad / np.sqrt(squares[name]))
    return chain


def _pair_counts(chain: Chain, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Expected transitions over sequences of one length."""
    t = int(bounds[1] - bounds[0])
    emit = np.exp(scores - scores.max(1, keepdims=True)).reshape(-1, t, len(chain.labels))
    step, start = np.exp(chain.step - chain.step.max()), np.exp(chain.start - chain.start.max())
    ahead = np.empty_like(emit)
    ahead[:, 0] = _scaled(start * emit[:, 0])
    for s in range(1, t):
        ahead[:, s] = _scaled((ahead[:, s - 1] @ step) * emit[:, s])
    back, out = np.ones((len(emit), len(chain.labels))), np.zeros_like(chain.step)
    for s in range(t - 1, 0, -1):
        right = emit[:, s] * back
        joint = ahead[:, s - 1][:, :, None] * step[None] * right[:, None, :]
        out += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back = _scaled(right @ step.T)
    return out


def sample(docs: DataFrame, text_col: str, lang_col: str, key_col: str, per_language: int, characters: int) -> list[tuple[str, str]]:
    """About ``per_language`` labelled texts of each language, ``characters`` of each, chosen by a hash of the key."""
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].alias("lang"), docs[key_col].alias("key"))
    rows = rows.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30))
    wanted = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 30, per_language * (1 << 30) // n + 1))])
    taken = rows.where(place < F.get(F.map_values(F.map_filter(wanted, lambda k, _: k == F.col("lang"))), 0))
    taken = taken.select("key", "lang", F.substring("text", 1, characters).alias("text")).limit(2 * per_language * len(counts) + 100)
    found = sorted((str(r.key), r.text, r.lang) for r in taken.collect())
    return [(text, lang) for _, text, lang in found]


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` per row.

    Each word gets label probabilities from the whole text by forward-backward; ``score`` is the
    mean probability of the predicted language over all words, ties go to the first label.
    Texts that are null or have no letter are ``und`` with score 0; so is everything if nothing
    was learned. Repeated rows stay.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, part in text_slices(batch, "text"):
                langs, scores = predict_texts(part, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, to - at), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    ["id", "lang_pred", "score"],
                )

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, chain: Chain, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language: not ``und``, score ``least`` or more.

    If nothing was learned, for want of labelled texts, no text can be told from another: all with a letter stay.
    Null texts and texts without a letter go; repeated rows stay or go together; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.column(place).cast(pa.string())], ["text"])
            for at, to, part in text_slices(plain, "text"):
                if shared.value.labels:
                    langs, scores = predict_texts(part, shared.value)
                    keep = (np.array(langs, object) != UNKNOWN) & (scores >= least)
                else:
                    keep = np.array([any(c.isalpha() for c in text or "") for text in part.to_pylist()], bool)
                yield batch.slice(at, to - at).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def predict_texts(texts: pa.Array, chain: Chain) -> tuple[list[str], np.ndarray]:
    feats = Features(texts)
    n, counts = len(texts), np.diff(feats.bounds)
    out, scores = np.full(n, UNKNOWN, object), np.zeros(n)
    if not chain.labels:
        return out.tolist(), scores
    p = chain.marginals(feats.scores(chain.weights), feats.bounds)
    sums = np.concatenate([np.zeros((1, len(chain.labels))), np.cumsum(p, 0)])
    mean = (sums[feats.bounds[1:]] - sums[feats.bounds[:-1]]) / np.maximum(counts, 1)[:, None]
    best = mean.argmax(1)
    plain = counts > 0
    for i in np.flatnonzero(plain).tolist():  # words of bytes beyond ASCII alone need not hold a letter
        plain[i] = any(c.isalpha() for c in texts[i].as_py())
    out[plain] = np.array(chain.labels, object)[best[plain]]
    scores[plain] = np.clip(mean[plain, best[plain]], 0, 1)
    return out.tolist(), scores
