"""Sharding by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import key_bucket, running_total_before, stored
from wayline.operators.skew import salted_join

#: The member that stands for the large groups in a bucket; other members are digests.
SEED = ""


def difference(parts: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Combines partial partitions (each a list of k sums) into one by largest differencing.

    The two with the largest spread are joined, the fullest part of one with the emptiest of the other, until one is
    left. Returns for each input the final part of each of its parts, and the final sums (fullest first).
    """
    k = len(parts[0])
    sums: list[list[int]] = []
    kids: list[tuple[int, int] | None] = []
    orders: list[list[int]] = []
    heap: list[tuple[int, int]] = []

    def add(values: list[int], kid: tuple[int, int] | None) -> None:
        order = sorted(range(k), key=lambda i: -values[i])
        sums.append([values[i] for i in order])
        orders.append(order)
        kids.append(kid)
        heapq.heappush(heap, (values[order[-1]] - values[order[0]], len(sums) - 1))

    for p in parts:
        add(p, None)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        add([x + y for x, y in zip(sums[a], reversed(sums[b]))], (a, b))
    place: dict[int, list[int]] = {len(sums) - 1: list(range(k))}
    for node in range(len(sums) - 1, -1, -1):
        final, kid = place[node], kids[node]
        of = [0] * k  # the final part of each sum as it stood before it was sorted
        for rank, i in enumerate(orders[node]):
            of[i] = final[rank]
        if kid:
            place[kid[0]], place[kid[1]] = of, of[::-1]
            del place[node]
        else:
            place[node] = of
    return [place[i] for i in range(len(parts))], sums[-1]


def _differenced(parts: DataFrame, shards: int) -> DataFrame:
    """(bucket, member, part, bytes, final): rows (bucket, member, part, bytes) with the part that differencing the members of
    their bucket gives them; bytes are the sums of each part of each member. Where a member is SEED, its parts keep their numbers."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        sums: dict = {}
        for member, part, size in zip(frame["member"], frame["part"], frame["bytes"]):
            sums.setdefault(member, [0] * shards)[part] += int(size)
        members = sorted(sums, key=lambda m: (-max(sums[m]), m))
        where, _ = difference([sums[m] for m in members])
        final = {m: w for m, w in zip(members, where)}
        number = {f: i for i, f in enumerate(final.get(SEED, range(shards)))}
        return frame[["bucket", "member", "part", "bytes"]].assign(final=[number[final[m][p]] for m, p in zip(frame["member"], frame["part"])])

    return parts.groupBy("bucket").applyInPandas(one, "bucket long, member string, part int, bytes long, final int")


def _balanced(groups: DataFrame, shards: int, groups_per_task: int, sums_per_task: int) -> DataFrame:
    """(group_key, part): groups (group_key, bytes) in `shards` parts of nearly equal bytes.

    Groups of over a bucket's share of a part are few (under `shards` for each bucket) and go first, by the same way.
    What they leave uneven is filled up: they seed as many buckets as hold twice the bytes that are missing, each with
    a like piece of their sums, and the small groups there are differenced against it. Those buckets and the large
    groups are one partial partition; the other buckets are flat ones of their own. Levels of tasks difference about `sums_per_task` of them.
    """
    counted = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total")).first()
    buckets = max(1, math.ceil(counted["n"] / groups_per_task))
    if buckets == 1:
        whole = groups.select(F.lit(0).cast("long").alias("bucket"), F.col("group_key").alias("member"), F.lit(0).alias("part"), "bytes")
        return _differenced(whole, shards).select(F.col("member").alias("group_key"), F.col("final").alias("part"))
    limit = counted["total"] / (shards * buckets)
    large, small = groups.where(F.col("bytes") > limit), groups.where(F.col("bytes") <= limit)
    first = stored(_balanced(stored(large, "large"), shards, groups_per_task, sums_per_task).join(large, "group_key"), "large-parts")
    taken = {r["part"]: r["bytes"] for r in first.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect()}  # a number for each shard
    sums_of_large = [taken.get(i, 0) for i in range(shards)]
    missing, rest = sum(max(sums_of_large) - n for n in sums_of_large), counted["total"] - sum(sums_of_large)
    seeded = min(buckets, math.ceil(2 * missing * buckets / rest) + 1) if rest and taken else 0
    dealt = small.select(F.pmod(F.xxhash64("group_key"), F.lit(buckets)).alias("bucket"), F.col("group_key").alias("member"), F.lit(0).alias("part"), "bytes")
    piece = lambda n: F.expr(f"{n} * (id + 1) div {max(seeded, 1)} - {n} * id div {max(seeded, 1)}")
    seeds = groups.sparkSession.range(seeded).select(F.col("id").alias("bucket"), F.lit(SEED).alias("member"), F.posexplode(F.array(*[piece(n) for n in sums_of_large])).alias("part", "bytes"))
    found = _differenced(dealt.unionByName(seeds), shards).where(F.col("member") != SEED)
    node = F.when(F.col("bucket") < seeded, F.lit(0).cast("long")).otherwise(F.col("bucket"))
    members = found.select(F.col("member").alias("group_key"), node.alias("node"), F.col("final").alias("part"), "bytes")
    placed = stored(members.unionByName(first.select("group_key", F.lit(0).cast("long").alias("node"), "part", "bytes")), "parts")
    sums = placed.groupBy("node", "part").agg(F.sum("bytes").alias("bytes"))
    while buckets > 1:
        above = math.ceil(buckets / sums_per_task)
        members = sums.select((F.col("node") % above).alias("bucket"), F.col("node").cast("string").alias("member"), "part", "bytes")
        moved = stored(_differenced(members, shards), "moves")
        step = moved.select(F.col("member").cast("long").alias("node"), "part", F.col("bucket").alias("_up"), "final")
        # A table of 8 rows for each 65,536 groups; joined, not broadcast, since it grows with the input.
        placed = placed.join(step, ["node", "part"]).select("group_key", F.col("_up").alias("node"), F.col("final").alias("part"), "bytes")
        sums, buckets = moved.groupBy(F.col("bucket").alias("node"), F.col("final").alias("part")).agg(F.sum("bytes").alias("bytes")), above
    return placed.select("group_key", "part")


def shard_by_bytes(docs: DataFrame, shards: int = 8, groups_per_task: int = 65_536, sums_per_task: int = 4096) -> DataFrame:
    """Puts whole groups of equal texts into `shards` shards of nearly equal bytes.

    Every task differences the groups of one hash bucket (about `groups_per_task`) to a partial partition of `shards`
    sums. Tasks of the next level difference about `sums_per_task` of these, and so on until one is left, whose parts
    are the shards. Groups too large for a bucket go first, and buckets fill up what they leave uneven. Only digests and sizes are shuffled, no texts, and nothing goes through the driver.

    Returns one row per row of `docs`: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (place in its shard,
    gapless from 0, in hash order of the ids).

    Defined cases: a null text counts as the empty one (size 1, CRC 0) and is in its group; rows that repeat are rows
    of their own in one group; a null doc_id is hashed by its text; groups of equal size are taken in the order of
    their digests, so reruns agree; a group larger than a shard's share makes its shard larger, since groups are
    indivisible; extra columns are ignored; an empty table gives no rows.
    """
    groups_per_task = max(groups_per_task, 2 * shards)  # so that fewer than half of the groups are large
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("group_key"),
        F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.when(F.col("doc_id").isNull(), F.md5(text)))).alias("order_key"),
    )
    rows = stored(rows, "sizes")  # what is left of the texts, which are read once
    total = rows.count()
    groups = stored(rows.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    placed = _balanced(groups.select("group_key", "bytes"), shards, groups_per_task, sums_per_task)
    shard_of = placed.withColumnRenamed("part", "shard").join(groups.select("group_key", "rows"), "group_key")
    found = salted_join(rows, shard_of, ["group_key"], "rows", total, F.col("order_key"))
    keyed = found.withColumn("order_bucket", key_bucket("order_key", total)).withColumn("one", F.lit(1).cast("long"))
    return running_total_before(keyed, ["shard"], "order_bucket", ["order_key", "group_key"], "one", "slot").select(
        "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")
    )
