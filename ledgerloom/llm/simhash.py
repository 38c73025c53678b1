"""Near duplicates: by SimHash with blocks that close pairs must share, and by exact similarity of shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import id_and_text, mix
from ledgerloom.llm.components import components
from ledgerloom.session import cut_lineage

BITS = 64
#: Least hashes of a signature: sets that agree in one whole band are compared.
BANDS, ROWS = 32, 4
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_UPPER = bytes(range(0x41, 0x5B))
_LOWER_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())
_CHUNK = 1 << 16


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of the lower-cased word shingles of one text; no words: zero."""
    words = text.translate(_LOWER_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = len(words) - size + 1
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, count, _CHUNK):
        to = min(count, at + _CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, to - at)
        set_in += _set_bits(hashes)
    return _majority(set_in, count)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, digest, fp)`` per row; ``digest`` is a hash of the text, null texts have fingerprint 0."""
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = [fingerprint(x.as_py() or b"", size) for x in texts]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), fp], ["id", "digest", "fp"])

    rows = rows.select("id", F.xxhash64("text").alias("digest"), "text")
    return rows.mapInArrow(run, f"id {kind}, digest bigint, fp bigint")


def close_links(points: DataFrame, distance: int = 3, blocks: int = 6, kept: int = 3, cell: int = 2048) -> DataFrame:
    """``(a, b)``: links between nodes that join whatever is close.

    ``points`` has ``node`` and its fingerprint ``fp``. Close are ``distance`` bits or fewer.
    A fingerprint is split into ``blocks`` parts; every choice of ``kept`` parts is a key. Pairs that
    differ in at most ``blocks - kept`` parts share a key, so with ``distance`` no more than that no
    close pair is missed. A key with more than ``cell`` nodes is cut into parts of about that size
    by hash, and every pair of parts is compared in a task of its own. Within such a cell the
    links form a spanning forest: a node is linked when it is first reached, so links never exceed
    the rows. Cells may give the same link.
    """
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = [_key(i, chosen, cuts) for i, chosen in enumerate(combinations(range(blocks), kept))]
    keyed = points.select("node", F.explode(F.array(*keys)).alias("key"))
    busy = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = busy.select("key", F.ceil(F.col("n") / cell).cast("int").alias("parts"))
    cells = _paired(keyed.join(parts, "key")).join(points, "node")
    by = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, bits in _runs(batches, by, ["fp"]):
            a, b = spanning_links(bits[:, 0], distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a bigint, b bigint")


def _key(number: int, chosen: tuple[int, ...], cuts: list[int]) -> Column:
    """The bits of the chosen parts side by side, below the number of the choice."""
    key, at = F.lit(0).cast("bigint"), 0
    for part in chosen:
        size = cuts[part + 1] - cuts[part]
        bits = F.shiftrightunsigned("fp", cuts[part]).bitwiseAND(F.lit((1 << size) - 1))
        key, at = key.bitwiseOR(F.shiftleft(bits, at)), at + size
    return key.bitwiseOR(F.lit(number << at))


def spanning_links(bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links of a forest that joins what chains of close pairs join."""
    return forest(len(bits), lambda x, rows: np.bitwise_count(bits[rows] ^ bits[x]) <= distance)


def _runs(batches: Iterator[pa.RecordBatch], by: list[str], bits: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and fingerprints of each cell; cells come in order, and one may go on in the next batch."""
    rest, rest_key = [], None

    def whole() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([n for n, _ in rest]), np.concatenate([x for _, x in rest])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in bits], 1)
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *new.tolist(), len(nodes)]
        for s, e in zip(edges, edges[1:]):
            key = tuple(c[s] for c in cols)
            if key != rest_key:
                if sum(len(n) for n, _ in rest) > 1:
                    yield whole()
                rest, rest_key = [], key
            rest.append((nodes[s:e].copy(), values[s:e]))
    if sum(len(n) for n, _ in rest) > 1:
        yield whole()


def clusters(points: DataFrame, **how) -> DataFrame:
    """``(node, root)`` for every node; equal roots: reachable over close links."""
    found = components(close_links(points, **how), "a", "b")
    return points.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def print_points(prints: DataFrame) -> DataFrame:
    """Every fingerprint as a node of its own."""
    return prints.select(F.col("fp").alias("node"), "fp").distinct()


def print_groups(prints: DataFrame, distance: int) -> DataFrame:
    """``(fp, root)`` for every fingerprint ``fp`` of ``prints``; equal roots: reachable over close links."""
    found = clusters(print_points(prints), distance=distance, blocks=2 * distance, kept=distance)
    return cut_lineage(found).withColumnRenamed("node", "fp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the smallest
    id reachable. Null and empty texts have fingerprint zero and link like any other. A null id
    is never the smallest unless all ids of its component are null; then ``component_id`` is
    null. Repeated rows stay. Other columns are not looked at; an empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, size))
    roots = print_groups(prints, distance)
    firsts = prints.groupBy("fp").agg(F.min("id").alias("id")).join(roots, "fp")
    smallest = firsts.groupBy("root").agg(F.min("id").alias("component_id"))
    by_print = roots.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(set_in: np.ndarray, count: int) -> int:
    return int.from_bytes(np.packbits(2 * set_in > count, bitorder="little").tobytes(), "little")


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted different hashes of the lower-cased word shingles; fewer words than ``size`` are one shingle."""
    words = text.translate(_LOWER_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    count = max(1, len(words) - size + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(count)), np.uint64, count))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of a set under each of ``BANDS`` times ``ROWS`` hash functions; an empty set: all ones."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), _CHUNK // 32):
        np.minimum(least, mix(hashes[at : at + _CHUNK // 32, None] ^ _SEEDS).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A hash of each band of a signature."""
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, digest, fp, node, n, keys, s0 ... )``: fingerprint, a hash and the size of the shingle set, its bands, a byte of every least hash."""
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    names = [f"s{i}" for i in range(BANDS * ROWS // 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            fp, node, n = np.zeros(count, np.uint64), np.zeros(count, np.uint64), np.zeros(count, np.int64)
            keys, low = np.zeros((count, BANDS), np.uint64), np.zeros((count, BANDS * ROWS), np.uint8)
            for i, x in enumerate(batch.column("text").cast(pa.binary())):
                text = x.as_py() or b""
                hashes = shingles(text, size)
                least = least_hashes(hashes)
                fp[i] = fingerprint(text)
                node[i], n[i], keys[i], low[i] = xxhash.xxh64_intdigest(hashes.tobytes(), 42), len(hashes), band_keys(least), least.astype(np.uint8)
            words = low.view(np.int64)
            listed = pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * BANDS, pa.array(keys.view(np.int64).ravel()))
            columns = [pa.array(fp.view(np.int64)), pa.array(node.view(np.int64)), pa.array(n), listed, *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *columns], ["id", "digest", "fp", "node", "n", "keys", *names])

    rows = rows.select("id", F.xxhash64("text").alias("digest"), "text")
    return rows.mapInArrow(run, f"id {kind}, digest bigint, fp bigint, node bigint, n bigint, keys array<bigint>, " + ", ".join(f"{n} bigint" for n in names))


def least_agreement(similarity: float, deviations: float = 5.5) -> int:
    """Bytes of a signature that sets of a similarity have in common at least, with some deviations of room."""
    total = BANDS * ROWS
    return math.floor(total * similarity - deviations * math.sqrt(total * similarity * (1 - similarity)))


def forest(count: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest over rows 0 ... that joins what chains of near rows join; ``near(x, rows)`` tells which are near."""
    left, a, b = np.arange(count), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = near(x, left)
            if hit.any():
                a.append(np.full(hit.sum(), x))
                b.append(left[hit])
                front.extend(left[hit])
                left = left[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def agreeing(words: np.ndarray, least: int):
    """``near`` of ``forest``: signatures that have ``least`` bytes or more in common."""
    low = np.ascontiguousarray(words).view(np.uint8)
    return lambda x, rows: (low[rows] == low[x]).sum(1) >= least


def similar(sets: list[np.ndarray], words: np.ndarray, least: int, similarity: float):
    """``near`` of ``forest``: agreeing signatures whose sets have the exact Jaccard similarity or more."""
    agree, sizes = agreeing(words, least), np.array([len(x) for x in sets])

    def near(x: int, rows: np.ndarray) -> np.ndarray:
        hit = agree(x, rows) & (np.minimum(sizes[rows], sizes[x]) >= similarity * np.maximum(sizes[rows], sizes[x]))
        for i in np.flatnonzero(hit).tolist():
            other = sets[rows[i]]
            common = len(np.intersect1d(sets[x], other, assume_unique=True))
            hit[i] = bool(common) and common / (len(sets[x]) + len(other) - common) >= similarity
        return hit

    return near


def band_links(points: DataFrame, least: int, cell: int = 2048) -> DataFrame:
    """``(a, b)``: forests of agreeing signatures within each band; cells as in ``close_links``."""
    lanes = [c for c in points.columns if c not in ("node", "n", "keys")]
    by = ["key", "i", "j"]
    keyed = points.select("node", F.explode("keys").alias("key"))
    busy = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = busy.select("key", F.ceil(F.col("n") / cell).cast("int").alias("parts"))
    cells = _paired(keyed.join(parts, "key")).join(points.select("node", *lanes), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, bits in _runs(batches, by, lanes):
            a, b = forest(len(nodes), agreeing(bits, least))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a bigint, b bigint")


def _paired(placed: DataFrame) -> DataFrame:
    """Rows with ``node`` and ``parts``, once for each pair ``(i, j)`` that the part of the row is in."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "parts")


def exact_links(texts: DataFrame, least: int, similarity: float, size: int, cell: int = 2048, weight: int = 1 << 21) -> DataFrame:
    """``(a, b)``: within each ``root``, forests of the pairs whose shingle sets have the similarity, counted exactly.

    ``texts`` has ``node, n, root, text`` and the signature. A group of more than ``cell`` rows or ``weight``
    shingles is cut into parts, and every pair of parts is compared in a task of its own.
    """
    lanes = [c for c in texts.columns if c not in ("node", "n", "root", "text")]
    by = ["root", "i", "j"]
    groups = texts.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    parts = groups.select("root", F.ceil(F.greatest(F.col("rows") / cell, F.col("all") / weight)).cast("int").alias("parts"))
    cells = _paired(texts.join(parts, "root")).select(*by, "node", "text", *lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches, by):
            nodes = rows.column("node").to_numpy()
            words = np.stack([rows.column(c).to_numpy() for c in lanes], 1)
            sets = [shingles(x.as_py() or b"", size) for x in rows.column("text").cast(pa.binary())]
            a, b = forest(len(nodes), similar(sets, words, least, similarity))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a bigint, b bigint")


def print_links(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """``(a, b)``: a star over the nodes whose fingerprints have one root; a node may have several fingerprints.

    ``roots`` has ``(node, root)`` of the fingerprints that are close to others.
    """
    found = roots.select(F.col("node").alias("fp"), "root")
    placed = prints.select("node", "fp").distinct().join(found, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("node").alias("b"))
    return placed.join(least, "root").where("node != b").select(F.col("node").alias("a"), "b")


def _cells(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each cell; cells come in order, and one may go on in the next batch."""
    rest, rest_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        for s, e in zip(edges, edges[1:]):
            key = tuple(c[s] for c in cols)
            if key != rest_key:
                if rest:
                    yield pa.Table.from_batches(rest)
                rest, rest_key = [], key
            rest.append(batch.slice(s, e - s))
    if rest:
        yield pa.Table.from_batches(rest)


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8,
    distance: int | None = None,
) -> DataFrame:
    """Rows of ``docs``, all columns, with one row left of each group of near duplicates.

    Texts are near duplicates where the sets of their lower-cased ``size``-word shingles have a Jaccard
    similarity of ``similarity`` or more, counted on the sets themselves; groups are chains of such pairs.
    With a ``distance`` texts whose fingerprints differ in that many bits or fewer are near duplicates too,
    as in ``near_duplicates``, and chains run over both kinds of pairs.
    Pairs are looked for among sets that share one of ``BANDS`` bands of ``ROWS`` least hashes and have
    ``least_agreement`` of all; a pair at similarity 0.8 fails that with a chance below one in a million.
    The row with the smallest id stays, nulls last, ties by a hash of the text; of wholly equal rows
    any one. Null and empty texts form one group. An empty table stays empty.
    """
    prints = cut_lineage(signatures(docs, id_col, text_col, size))
    points = prints.drop("id", "digest", "fp").dropDuplicates(["node"])
    least = least_agreement(similarity)
    # both kinds of links are kept before they meet, so that the shuffles of one can go while the other runs
    found = cut_lineage(band_links(points, least)).withColumn("of", F.lit("sets"))
    if distance is not None:
        close = cut_lineage(close_links(print_points(prints), distance=distance, blocks=2 * distance, kept=distance))
        found = found.unionByName(close.withColumn("of", F.lit("prints")))
    roots = cut_lineage(components(found, "a", "b", "of"))
    loose = roots.where("of = 'sets'").drop("of")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    # keys without nulls, so that the rows of one key lie together for what follows the join
    named = docs.withColumns({"_who": F.xxhash64(docs[id_col]), "_digest": F.xxhash64(docs[text_col].cast("string"))})
    lanes = [c for c in points.columns if c not in ("node", "n", "keys")]
    shown = prints.join(loose, "node").groupBy("node", "root").agg(
        F.min(F.struct(F.xxhash64("id").alias("w"), F.col("digest").alias("d"))).alias("o"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in lanes]
    )
    shown = shown.select("node", "root", "n", *lanes, F.col("o.w").alias("_who"), F.col("o.d").alias("_digest"))
    texts = named.select("_who", "_digest", F.col(text_col).cast("string").alias("text")).join(shown, ["_who", "_digest"])
    texts = cut_lineage(texts.drop("_who", "_digest").dropDuplicates(["node"]))
    links = exact_links(texts, least, similarity, size)
    if distance is not None:
        links = links.unionByName(print_links(prints, roots.where("of = 'prints'")))
    joined = components(links, "a", "b")
    nodes = prints.groupBy("node").agg(F.min(order).alias("o")).join(joined, "node", "left")
    first = nodes.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("o").alias("o"))
    keep = cut_lineage(first.select(F.xxhash64("o.id").alias("_who"), F.col("o.digest").alias("_digest")))
    return named.join(keep, ["_who", "_digest"]).dropDuplicates(["_who", "_digest"]).select(*docs.columns)


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
