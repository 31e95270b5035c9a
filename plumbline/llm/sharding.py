"""Sharding by balanced label propagation.

Linked documents start in shards by hash. In turns, the nodes of one phase look at their neighbours' shards
(a join and a partial aggregation) and propose to move to the one that holds most of their links; a shard
accepts proposals in a fixed order while its quota lasts. Each round is written to the shared folder, which
cuts the lineage. A shard that holds more linked documents than its quota then gives up those beyond it, in the
order of their groups. These and the documents without links come last: from large to small tiers they level the
shards, each tier cut into intervals of a prefix sum, and LAST documents at the very end, one by one.

Groups of equal texts are linked as a star: every member to a node of size 0 for the group, so links are as
many as documents. A group too large for one shard fills its quota and stays spread with the rest. Prefix sums run over
BUCKETS parts of a shard or tier, whose offsets (BUCKETS rows at most) are all that meets in one task.

Cases: a null text counts as an empty one (size 1); a very long text may be a shard's greater part and is placed
before smaller ones; repeated rows are members of one group, each with its own slot; an empty table gives no rows;
ties between shards are broken by a hash of node and shard, which favours none; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_before, small, stored

SHARDS = 16
ROUNDS = 6
#: Times the even size that a shard may hold of linked documents while they move.
SLACK = 1.25
BUCKETS = 4096
#: Documents without links are dealt in tiers: over 1/8 of a shard, over 1/32, and so on.
TIERS, TIER_STEP = 6, 4
#: Documents without links, or given up, that are placed at the very end, one by one on the driver, each in the least
#: full shard: they even out what the tiers' whole documents leave.
LAST = 2_000


def _level(loads: list[float], amount: float) -> list[float]:
    """How much each shard gets of `amount` so that the least loaded become as level as possible."""
    order = sorted(range(len(loads)), key=lambda s: (loads[s], s))
    total, level = 0.0, 0.0
    for k, s in enumerate(order, 1):
        total += loads[s]
        level = (amount + total) / k
        if k == len(order) or level <= loads[order[k]]:
            break
    return [max(0.0, level - x) for x in loads]


def _by_interval(at: Column, shares: list[float]) -> Column:
    """The shard whose interval of a prefix sum holds `at`; shards without a share get no interval."""
    out, end = None, 0.0
    last = max((s for s, x in enumerate(shares) if x > 0), default=0)
    for s, x in enumerate(shares):
        end += x
        if x > 0 and s != last:
            out = F.when(at < end, s) if out is None else out.when(at < end, s)
    return (F.lit(last) if out is None else out.otherwise(last)).cast("int")


def _sums(df: DataFrame, shards: int) -> list[float]:
    got = {r[0]: float(r[1] or 0) for r in df.groupBy("shard").agg(F.sum("size")).collect()}  # one row for each shard
    return [got.get(s, 0.0) for s in range(shards)]


def propagate(nodes: DataFrame, links: DataFrame, cap: float, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes (node, size, phase 0 or 1) and links (a, b, w, phase of a; both directions, between phases) to (node,
    size, shard).

    Nodes of one phase move at a time, so that neighbours don't swap places. No shard takes moves beyond `cap`. Where
    nodes of phase 0 are hubs of many, their own votes are summed before the exchange, and their few shards go to the
    tasks that hold their neighbours.
    """
    labels = stored(nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")), "shard-start")
    idle = 0
    for k in range(rounds):
        now = labels.filter(F.col("phase") != k % 2).select(F.col("node").alias("b"), F.col("shard").alias("at"))
        votes = links.filter(F.col("phase") == k % 2).join(small(now), "b").groupBy("a", "at").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.max(F.struct(F.col("w"), F.xxhash64("a", "at").alias("h"), F.col("at").alias("s"))).alias("x"), F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("all"))
        moves = (
            labels.filter(F.col("phase") == k % 2)
            .join(best, F.col("node") == F.col("a"))
            .withColumn("to", F.col("x.s"))
            .filter((F.col("to") != F.col("shard")) & (F.col("x.w") > F.coalesce(F.element_at("all", F.col("shard")), F.lit(0))))
            .select("node", "size", "to", F.pmod(F.xxhash64("node", F.lit(k)), F.lit(BUCKETS)).cast("int").alias("_bucket"))
        )
        loads = _sums(labels, shards)
        room = F.element_at(F.array(*[F.lit(max(0.0, cap - x)) for x in loads]), F.col("to") + 1)
        moves = stored(moves.filter(F.col("size") <= room), "shard-moves")  # what can't fit must not keep others out
        ordered = running_before(moves, ["to"], "_bucket", ["node"], "size", "before")
        taken = ordered.filter((F.col("before") + F.col("size") <= room) | (F.col("size") == 0)).select(F.col("node").alias("_n"), "to")
        taken = stored(taken, "shard-taken")
        if not taken.limit(1).count():
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        moved = labels.join(small(taken), F.col("node") == F.col("_n"), "left").withColumn("shard", F.coalesce("to", "shard")).drop("_n", "to")
        labels = stored(moved, "shard-round")
    return labels.select("node", "size", "shard")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text) to doc_id, size, text_crc32, law, shard, slot, grown_shard, with equal texts linked."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("fp"),
    )
    # a stored row keeps its number, which tells repeated rows apart
    slim = stored(slim.withColumn("uid", F.monotonically_increasing_id()), "shard-docs")
    groups = slim.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("fp").alias("_fp"), F.xxhash64("fp", F.lit("group")).alias("hub"))
    groups = small(stored(groups, "shard-groups"))
    rows = stored(slim.join(groups, F.col("fp") == F.col("_fp"), "left").drop("fp", "_fp"), "shard-rows")
    cap = (rows.agg(F.sum("size")).first()[0] or 0) / shards

    linked = rows.filter(F.col("hub").isNotNull())
    name = lambda c, kind: F.struct(F.lit(kind).alias("k"), F.col(c).alias("i"))
    members = linked.select(name("uid", 1).alias("node"), "size", F.lit(1).alias("phase"))
    hubs = linked.select(name("hub", 0).alias("node")).distinct().select("node", F.lit(0).cast("long").alias("size"), F.lit(0).alias("phase"))
    star = linked.select(name("uid", 1).alias("a"), name("hub", 0).alias("b"), "size").select("a", "b", F.col("size").alias("w"))
    links = star.withColumn("phase", F.lit(1)).unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", F.lit(0).alias("phase")))
    placed = propagate(members.unionByName(hubs), links, SLACK * cap, shards).filter("node.k = 1").select(F.col("node.i").alias("_uid"), "shard")
    # parts of a shard go by group first and by document then, so that few groups are cut where the quota ends
    part = F.pmod(F.xxhash64("hub"), F.lit(64)) * 64 + F.pmod(F.xxhash64("uid"), F.lit(64))
    ordered = running_before(linked.join(placed, F.col("uid") == F.col("_uid")).withColumn("_bucket", part.cast("int")), ["shard"], "_bucket", ["uid"], "size", "before")
    settled = stored(ordered.withColumn("stays", F.col("before") + F.col("size") <= cap).drop("before", "_bucket", "_uid"), "shard-settled")
    loads = _sums(settled.filter("stays").select("shard", "size"), shards)

    names = ["doc_id", "size", "text_crc32", "uid"]
    single = rows.filter(F.col("hub").isNull()).select(*names).unionByName(settled.filter(~F.col("stays")).select(*names))
    single = stored(single, "shard-free")
    last = [(r["size"], r["uid"]) for r in single.select("uid", "size").orderBy(F.xxhash64("uid"), "uid").limit(LAST).collect()]
    spark = docs.sparkSession
    kept = F.broadcast(spark.createDataFrame([(u,) for _, u in last], "_uid long"))  # LAST rows
    rest = single.join(kept, F.col("uid") == F.col("_uid"), "left_anti")
    tier = F.lit(TIERS - 1)
    for k in range(TIERS - 2, -1, -1):
        tier = F.when(F.col("size") > cap / 8 / TIER_STEP**k, k).otherwise(tier)
    rest = rest.withColumns({"tier": tier, "_bucket": F.pmod(F.xxhash64("uid"), F.lit(BUCKETS)).cast("int")})
    rest = stored(running_before(rest, ["tier"], "_bucket", ["uid"], "size", "before").drop("_bucket"), "shard-single")
    amounts = {r[0]: float(r[1]) for r in rest.groupBy("tier").agg(F.sum("size")).collect()}
    middle, choice = F.col("before") + F.col("size") / 2, F.lit(0)
    for k in sorted(amounts):
        here = _by_interval(middle, _level(loads, amounts[k]))
        more = _sums(rest.filter(F.col("tier") == k).withColumn("shard", here), shards)
        loads = [a + b for a, b in zip(loads, more, strict=True)]
        choice = F.when(F.col("tier") == k, here).otherwise(choice)
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    ends = []
    for size, uid in sorted(last, reverse=True):
        load, s = heapq.heappop(heap)
        ends.append((uid, s))
        heapq.heappush(heap, (load + size, s))
    ends = F.broadcast(spark.createDataFrame(ends, "_uid long, shard int"))  # LAST rows
    both = rest.withColumn("shard", choice.cast("int")).select(*names, "shard").unionByName(settled.filter("stays").select(*names, "shard"))
    both = both.unionByName(single.join(ends, F.col("uid") == F.col("_uid")).select(*names, "shard"))
    both = both.withColumns({"_bucket": F.pmod(F.xxhash64("uid", F.lit("slot")), F.lit(BUCKETS)).cast("int"), "_one": F.lit(1)})
    both = running_before(stored(both, "shard-all"), ["shard"], "_bucket", ["uid"], "_one", "slot")
    return both.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
