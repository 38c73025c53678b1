"""Content-addressed catalogue: copies, nearest replica, placement, eviction, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.hashing import content_cid, sha256
from ledgerloom.functions.numbers import exact_mean, exact_sum, rounded
from ledgerloom.operators.ordered import RANGE, ROW, deal, sum_so_far
from ledgerloom.session import cut_lineage

# Where to look for a copy, nearest first.
REGION_PREFERENCE = {
    "IN-TG": ["IN-TG", "IN-AP", "IN-MH", "IN"],
    "IN-MH": ["IN-MH", "IN-TG", "IN-KA", "IN"],
    "IN-AP": ["IN-AP", "IN-TG", "IN-KA", "IN"],
    "IN-KA": ["IN-KA", "IN-TG", "IN-MH", "IN"],
    "IN": ["IN", "IN-TG", "IN-MH", "IN-AP"],
}
GIB = 1024 ** 3


def register_nodes(nodes: DataFrame) -> DataFrame:
    """Catalogue rows of new nodes: nothing stored yet, online."""
    return nodes.select(
        "node_id", "region", "node_type", (F.col("capacity_gb") * GIB).cast("bigint").alias("capacity_bytes"),
        F.lit(0).cast("bigint").alias("used_bytes"), F.lit(True).alias("online"),
    )


def hashed(puts: DataFrame) -> DataFrame:
    """Puts with hash and size in place of their payload: all that the catalogue looks at."""
    return puts.select(
        sha256(F.col("payload")).alias("content_hash"), F.octet_length("payload").cast("bigint").alias("size_bytes"),
        "node_id", "seq", "sigma",
    )


def dedup_content(puts: DataFrame) -> DataFrame:
    """One particle per content with the nodes that hold it, in order of arrival.

    ``puts`` may have been ``hashed`` before. Payloads are reduced to hash and size before
    anything moves, and copies are counted per node first, so a content put a billion times
    reaches its group as one row per node.
    """
    slim = puts if "content_hash" in puts.columns else hashed(puts)
    per_node = slim.groupBy("content_hash", "node_id").agg(
        F.min("seq").alias("seq"), F.min_by("sigma", "seq").alias("sigma"), F.min("size_bytes").alias("size_bytes"),
        F.count(F.lit(1)).alias("puts"),
    )
    arrivals = F.array_sort(F.collect_list(F.struct("seq", "node_id")))
    return per_node.groupBy("content_hash").agg(
        F.min("size_bytes").alias("size_bytes"), F.min_by("sigma", "seq").alias("sigma"),
        F.transform(arrivals, lambda a: a["node_id"]).alias("home_nodes"),
        F.sum("puts").alias("puts"), F.min("seq").alias("first_seq"),
    ).withColumns({"cid": content_cid(F.col("content_hash")), "state": F.lit("floating")})


def merge_particles(held: DataFrame | None, arrived: DataFrame) -> DataFrame:
    """The catalogue after new particles: known content keeps its place and gains the nodes that put it again."""
    columns = ["content_hash", "cid", "size_bytes", "state", "home_nodes", "sigma", "puts"]
    if held is None:
        return arrived.select(*columns)
    old = held.select(F.col("content_hash"), *[F.col(c).alias(f"_{c}") for c in columns[1:]])
    joined = arrived.select(*columns).join(old, "content_hash", "full_outer")
    none = F.array().cast("array<string>")
    merged = {c: F.coalesce(f"_{c}", c) for c in ("cid", "size_bytes", "state", "sigma")} | {
        "home_nodes": F.array_distinct(F.concat(F.coalesce("_home_nodes", none), F.coalesce("home_nodes", none))),
        "puts": F.coalesce("_puts", F.lit(0)) + F.coalesce("puts", F.lit(0)),
    }
    return joined.select("content_hash", *[merged[c].alias(c) for c in columns[1:]])


def apply_moves(particles: DataFrame, plan: DataFrame) -> DataFrame:
    """Particles with the nodes that placed moves brought them to, in need order after those they had."""
    arrivals = F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda a: a["node_id"])
    moved = plan.filter("placed").groupBy("content_hash").agg(arrivals.alias("_new"))
    joined = particles.join(moved, "content_hash", "left")
    return joined.withColumns({
        "home_nodes": F.when(F.col("_new").isNull(), F.col("home_nodes")).otherwise(F.array_distinct(F.concat("home_nodes", "_new"))),
        "state": F.when(F.col("_new").isNull(), F.col("state")).otherwise("replicated"),
    }).drop("_new")


def apply_evictions(particles: DataFrame, evictions: DataFrame) -> DataFrame:
    """Particles without the copies that were evicted."""
    kept = evictions.select("content_hash", F.col("kept_nodes").alias("_kept"))
    return particles.join(kept, "content_hash", "left").withColumn("home_nodes", F.coalesce("_kept", "home_nodes")).drop("_kept")


def apply_space(nodes: DataFrame, plan: DataFrame, evictions: DataFrame) -> DataFrame:
    """Nodes with the bytes that placed moves took and evictions gave back; never below zero."""
    taken = plan.filter("placed").groupBy("node_id").agg(F.sum("size_bytes").alias("_taken"))
    freed = freed_space(evictions).select("node_id", F.col("freed_bytes").alias("_freed"))
    joined = nodes.join(taken, "node_id", "left").join(freed, "node_id", "left")
    zero = F.lit(0).cast("bigint")
    used = F.greatest(F.col("used_bytes") + F.coalesce("_taken", zero) - F.coalesce("_freed", zero), zero)
    return joined.withColumn("used_bytes", used).drop("_taken", "_freed")


def add_accesses(stats: DataFrame | None, more: DataFrame) -> DataFrame:
    """Access counts and last accesses per content after more of them."""
    both = more if stats is None else stats.unionByName(more)
    return both.groupBy("content_hash").agg(F.max("last_accessed").alias("last_accessed"), F.sum("access_count").alias("access_count"))


def _preference(region: Column) -> Column:
    chain = F
    for code, order in REGION_PREFERENCE.items():
        chain = chain.when(region == code, F.array(*map(F.lit, order)))
    return chain.otherwise(F.array(region, F.lit("IN")))


def nearest_node(home_nodes: Column, region: Column) -> Column:
    """First preferred region that occurs in a node id, else the first node, else null."""
    hits = F.transform(
        _preference(region),
        lambda wanted: F.get(F.filter(home_nodes, lambda node: node.contains(wanted)), F.lit(0)),
    )
    return F.coalesce(F.get(F.array_compact(hits), F.lit(0)), F.get(home_nodes, F.lit(0)))


def nearest_node_by_region(df: DataFrame, nodes: DataFrame, home_nodes: str, region: str) -> DataFrame:
    """Variant that matches the region a node is registered with instead of its name."""
    # only lists and regions move, each pair of them once; rows keep their number
    pairs = df.select(F.col(home_nodes).alias("_homes"), F.col(region).alias("_region")).distinct()
    places = nodes.select(F.col("node_id").alias("_node"), F.col("region").alias("_place"))
    exploded = pairs.select("_homes", "_region", F.posexplode("_homes").alias("_pos", "_node")).join(places, "_node", "left")
    rank = F.array_position(_preference(F.col("_region")), F.col("_place"))
    score = F.struct(F.when(rank > 0, rank).otherwise(F.lit(1000)), F.col("_pos"))
    best = exploded.groupBy("_homes", "_region").agg(F.min_by("_node", score).alias("nearest"))
    same = df[home_nodes].eqNullSafe(best["_homes"]) & df[region].eqNullSafe(best["_region"])
    return df.join(best, same, "left").drop("_homes", "_region")


def resolve_needs(needs: DataFrame, particles: DataFrame) -> DataFrame:
    """Per need: MISSING from the catalogue, NEAR already (an access), or to MOVE."""
    known = particles.select("content_hash", "size_bytes", "home_nodes")
    joined = needs.join(known, "content_hash", "left")
    nearest = F.when(F.col("home_nodes").isNotNull(), nearest_node(F.col("home_nodes"), F.col("region")))
    return joined.withColumn("nearest", nearest).withColumn(
        "status",
        F.when(F.col("home_nodes").isNull(), "MISSING")
        .when(F.coalesce(F.col("nearest").contains(F.col("region")), F.lit(False)), "NEAR")
        .otherwise("MOVE"),
    )


def fetch(needs: DataFrame, particles: DataFrame) -> DataFrame:
    """Point lookups by content: every hit counts as an access, far hits also move."""
    found = resolve_needs(needs, particles)
    return found.withColumn("accessed", F.col("status") != "MISSING")


def access_stats(accesses: DataFrame, key: str = "dataset_id") -> DataFrame:
    return accesses.groupBy(key).agg(F.max("ts").alias("last_accessed"), F.count(F.lit(1)).alias("access_count"))


def eviction_candidates(particles: DataFrame, stats: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Cold, rarely used content with several copies loses the copy that came last."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    joined = particles.join(stats, "content_hash", "left").withColumn(
        "access_count", F.coalesce("access_count", F.lit(0))
    )
    cold = F.coalesce(F.col("last_accessed") < cutoff, F.lit(True))
    return joined.filter(cold & (F.size("home_nodes") > 1) & (F.col("access_count") < 3)).select(
        "content_hash", "size_bytes", F.element_at("home_nodes", -1).alias("evict_node"),
        F.slice("home_nodes", F.lit(1), F.size("home_nodes") - 1).alias("kept_nodes"),
    )


def freed_space(evictions: DataFrame) -> DataFrame:
    return evictions.groupBy(F.col("evict_node").alias("node_id")).agg(
        F.sum("size_bytes").alias("freed_bytes"), F.count(F.lit(1)).alias("copies")
    )


def plan_placement(moves: DataFrame, nodes: DataFrame, particles: DataFrame) -> DataFrame:
    """Which moves fit: per node, in need order, each is placed if the space left allows.

    An item that does not fit is passed over, a later smaller one may still fit. A round takes every node
    past the point where its free space falls below a power of two, so there are at most as many rounds as
    bits in the largest free space, whatever the number of items. With ``T <= free < 2 T``, items below
    ``T`` always fit, and the first larger one that fits, or the small one that takes the space below ``T``,
    ends the round: before it all small items are placed and all others refused. The small
    ones' running total decides which item that is; it goes over ranges of the rows, so
    a node with most of the needs is spread over many tasks. Nodes are independent of each other. A node that
    already holds a copy is not charged again; a move without a known size is refused.
    """
    keys = ["node_id", "content_hash"]
    held = particles.select("content_hash", F.explode("home_nodes").alias("node_id"))
    wanted = moves.groupBy(*keys).agg(F.min("seq").alias("seq"), F.min("size_bytes").alias("size_bytes"))
    wanted = wanted.join(held, keys, "left_anti")
    space = nodes.select("node_id", (F.col("capacity_bytes") - F.col("used_bytes")).alias("free"))
    todo = wanted.join(space, "node_id", "left").withColumn("free", F.coalesce("free", F.lit(0)))
    columns = ["node_id", "seq", "content_hash", "size_bytes"]
    todo = deal(todo.select(*columns, "free"), ["node_id"], [F.col("seq"), F.col("content_hash")])
    free, size = F.col("free"), F.col("size_bytes")
    settled: list[DataFrame] = []
    while True:
        # the largest power of two that is not above the free space
        floor = F.expr("shiftleft(1L, length(bin(greatest(free, 1L))) - 1)")
        fits, small = size <= free, size < floor
        summed = sum_so_far(todo, ["node_id"], F.when(fits & small, size).otherwise(0), "total")
        ends = F.when(small, free - F.col("total") < floor).otherwise(size <= free - F.col("total"))
        # rows of a node that end its round: the first of them and what it leaves
        last = summed.filter(fits & ends).groupBy("node_id").agg(F.min_by(
            F.struct(F.col(ROW).alias("row"), (free - F.col("total") - F.when(small, 0).otherwise(size)).alias("left")), ROW).alias("_last"))
        judged = summed.join(last, "node_id", "left").withColumn(
            "placed",
            F.when(F.coalesce(~fits, F.lit(True)), False)
            .when(F.col("_last").isNull() | (F.col(ROW) < F.col("_last.row")), small)
            .when(F.col(ROW) == F.col("_last.row"), True),
        )
        judged = cut_lineage(judged.select(*columns, RANGE, ROW, F.coalesce("_last.left", "free").alias("free"), "placed"))
        settled.append(judged.filter(F.col("placed").isNotNull()).select(*columns, "placed"))
        todo = judged.filter(F.col("placed").isNull()).drop("placed")
        if todo.isEmpty():
            break
    plan = settled[0]
    for part in settled[1:]:
        plan = plan.unionByName(part)
    return plan


def move_records(plan: DataFrame, particles: DataFrame, nodes: DataFrame) -> DataFrame:
    """A log row per placed move, from the content's first node."""
    source = particles.select("content_hash", "cid", F.get("home_nodes", F.lit(0)).alias("from_node"))
    place = nodes.select("node_id", F.col("region").alias("to_region"))
    return plan.filter("placed").join(source, "content_hash").join(place, "node_id", "left").select(
        F.left(sha256(F.concat_ws("|", "content_hash", "node_id")), F.lit(8)).alias("move_id"),
        "content_hash", "cid", "from_node", F.col("node_id").alias("to_node"), "to_region", "size_bytes",
        F.lit("data_gravity").alias("reason"),
    )


def catalogue_status(particles: DataFrame, nodes: DataFrame, moves: DataFrame, needs: DataFrame) -> DataFrame:
    """One row of totals. Each table is counted on its own; the counts meet in a last small sum."""
    total_sigma = exact_sum(F.col("sigma"))
    parts = [
        particles.agg(
            F.count(F.lit(1)).alias("total_datasets"), F.sum("size_bytes").alias("_bytes"), total_sigma.alias("_sigma")),
        nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if("online").alias("online_nodes")),
        moves.agg(F.count(F.lit(1)).alias("total_movements")),
        needs.agg(F.count(F.lit(1)).alias("active_needs")),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    one = union.agg(*[F.max(c).alias(c) for c in union.columns])
    return one.select(
        "total_datasets", rounded(F.coalesce("_bytes", F.lit(0)) / GIB, 4).alias("total_size_gb"),
        "total_nodes", "online_nodes",
        rounded(F.coalesce("_sigma", F.lit(0.0)) / F.greatest("total_datasets", F.lit(1)), 2).alias("avg_sigma"),
        "total_movements", "active_needs",
    )


def node_status(nodes: DataFrame, holdings: DataFrame, heals: DataFrame | None = None) -> DataFrame:
    """Items and mean sigma per node, nodes without items included.

    ``holdings`` has one row per node and content. Every node is a peer of all others.
    """
    items = holdings.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("items"),
        exact_mean(F.col("sigma")).alias("_mean"),
    )
    out = nodes.join(items, "node_id", "left")
    if heals is not None:
        applied = heals.groupBy("node_id").agg(F.count(F.lit(1)).alias("heals_applied"))
        out = out.join(applied, "node_id", "left")
    else:
        out = out.withColumn("heals_applied", F.lit(0))
    return out.select(
        "node_id", "region", "node_type", "online", F.coalesce("items", F.lit(0)).alias("items"),
        F.coalesce(rounded(F.col("_mean"), 2), F.lit(0.0)).alias("avg_sigma"),
        F.coalesce("heals_applied", F.lit(0)).alias("heals_applied"),
    )


def network_status(per_node: DataFrame) -> DataFrame:
    """Totals over node rows: items, nodes online, mean of the nodes' sigma."""
    mean = exact_mean(F.col("avg_sigma"))
    return per_node.agg(
        F.sum("items").alias("total_datasets"), F.count(F.lit(1)).alias("total_nodes"),
        F.count_if("online").alias("online_nodes"), rounded(mean, 2).alias("avg_sigma"),
    )


def search_store(df: DataFrame, text: str, hash_column: str = "content_hash") -> DataFrame:
    """Hash and sigma of stored records that contain the text anywhere."""
    return df.filter(F.to_json(F.struct("*")).contains(text)).select(hash_column, "sigma")
