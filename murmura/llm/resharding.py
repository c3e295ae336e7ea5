"""Minimum-cost-flow resharding.

Rows lie in old shards, cut into small blocks by a hash of their text.  From
the old shards' bytes and the new shards' capacities a minimum-cost flow says
how many bytes go from where to where (staying costs nothing, moving costs one
per byte), whole blocks carry them out, and only shards that gain or lose
blocks are rewritten.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.scratch import bounded_broadcast, materialize

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
OLD_SHARDS = 32
NEW_SHARDS = 40
#: Blocks of an old shard; the driver sees one row of each, whatever the input.
BLOCKS = 512


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes sent from each old to each new shard, moving the fewest.

    Successive shortest paths on old -> new shards: cost 0 where the numbers
    agree, 1 elsewhere.  Capacities must hold all supplies.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold the old ones")
    s, t, nodes = n + m, n + m + 1, n + m + 2
    to, left, cost, out = [], [], [], [[] for _ in range(nodes)]

    def arc(a: int, b: int, most: int, price: int) -> None:
        for x, y, z, p in ((a, b, most, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            left.append(z)
            cost.append(p)

    for i, v in enumerate(supply):
        arc(s, i, v, 0)
    for j, v in enumerate(capacity):
        arc(n + j, t, v, 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, supply[i], int(i != j))
    height = [0] * nodes
    while True:
        dist, via = [None] * nodes, [-1] * nodes
        dist[s], heap = 0, [(0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                y = to[e]
                if left[e] and (dist[y] is None or d + cost[e] + height[x] - height[y] < dist[y]):
                    dist[y], via[y] = d + cost[e] + height[x] - height[y], e
                    heapq.heappush(heap, (dist[y], y))
        if dist[t] is None:
            break
        far = max(d for d in dist if d is not None)
        height = [h + (far if d is None else d) for h, d in zip(height, dist, strict=True)]
        push, x = None, t
        while x != s:
            push = left[via[x]] if push is None else min(push, left[via[x]])
            x = to[via[x] ^ 1]
        x = t
        while x != s:
            left[via[x]] -= push
            left[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    sent = ((i, j, left[first + 2 * (i * m + j) + 1]) for i in range(n) for j in range(m))
    return {(i, j): v for i, j, v in sent if v}


def capacities(total: int, shards: int) -> list[int]:
    """Near-equal capacities that add up to the total."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def place_blocks(blocks: list[tuple[int, int, int]], flow: dict[tuple[int, int], int], capacity: list[int]) -> dict[int, int]:
    """New shard of each block ``(block, old shard, bytes)``, following the flow.

    Largest blocks choose first, each the wish of its old shard with the most
    bytes still to carry; a block too large for all of them goes where most room
    is left.  A last pass moves single blocks from the fullest to the emptiest
    shards while that evens them out.
    """
    wish, fill, shard = dict(flow), [0] * len(capacity), {}
    by_old: dict[int, list[int]] = {}
    for i, j in flow:
        by_old.setdefault(i, []).append(j)
    for b, i, size in sorted(blocks, key=lambda x: (-x[2], x[0])):
        j = max(by_old.get(i, range(len(capacity))), key=lambda j: (wish.get((i, j), 0), capacity[j] - fill[j], -j))
        if wish.get((i, j), 0) < size:
            room = max(range(len(capacity)), key=lambda j: (capacity[j] - fill[j], -j))
            if fill[j] + size > capacity[j] and capacity[room] - fill[room] > capacity[j] - fill[j]:
                j = room
        wish[i, j] = wish.get((i, j), 0) - size
        fill[j] += size
        shard[b] = j
    held: list[list[tuple[int, int]]] = [[] for _ in capacity]
    for b, _, size in blocks:
        held[shard[b]].append((size, b))
    for _ in range(4 * len(capacity)):
        hi, lo = max(range(len(fill)), key=lambda j: (fill[j] - capacity[j], -j)), min(range(len(fill)), key=lambda j: (fill[j] - capacity[j], j))
        gap = (fill[hi] - capacity[hi]) - (fill[lo] - capacity[lo])
        fits = [x for x in held[hi] if 0 < x[0] < gap]
        if not fits:
            break
        size, b = min(fits, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[hi].remove((size, b))
        held[lo].append((size, b))
        fill[hi] -= size
        fill[lo] += size
        shard[b] = lo
    return shard


def reshard(docs: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, blocks: int = BLOCKS, old: Column | None = None, whole: bool = False) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, old_shard, block, shard, slot.

    ``old`` names the rows' present shard (0 to old_shards - 1); by default a
    hash of the text, so equal texts lie together.  A block is a hash range of
    an old shard; equal texts with more bytes than half a new shard's hundredth
    are dealt over several blocks by their ids, and rows that share the id as
    well by a number of their own.  Slots run from 0 in each shard, by block,
    text checksum and id.  With ``whole`` each row also carries its columns, as
    ``doc``.  Null text counts as empty, null ids sort first, repeated rows get
    slots of their own, an empty table gives an empty result, and other columns
    are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    rows = docs.select(
        "doc_id", row_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_h"),
        (F.pmod(F.xxhash64(text, F.lit(1)), F.lit(old_shards)) if old is None else old).cast("int").alias("old_shard"),
        F.monotonically_increasing_id().alias("_row"), *own,
    )
    rows = materialize(rows, "reshard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    piece = max(1, total // (new_shards * 200))
    # fewer than new_shards * 200 texts, or texts of one id, can have more bytes than a piece
    hot = materialize(rows.groupBy("_h").agg(F.sum("size").alias("_bytes")).where(F.col("_bytes") > piece), "reshard-hot")
    hot, _ = bounded_broadcast(hot.select("_h", F.least(F.ceil(F.col("_bytes") / piece), F.lit(blocks)).alias("_pieces")), new_shards * 200)
    rows = rows.join(hot, "_h", "left")
    again = rows.where("_pieces is not null").groupBy("_h", F.col("doc_id").alias("_id")).agg(F.sum("size").alias("_bytes")).where(F.col("_bytes") > piece)
    again, _ = bounded_broadcast(materialize(again.select(F.col("_h").alias("_h2"), "_id", F.lit(True).alias("_again")), "reshard-again"), new_shards * 200)
    rows = rows.join(again, (F.col("_h") == F.col("_h2")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", F.when(F.col("_again"), F.col("_row")).otherwise(0)), F.col("_pieces")), F.lit(0))
    block = F.pmod(F.xxhash64("_h", part), F.lit(blocks)) + F.col("old_shard") * blocks
    carried = ["doc"] if whole else []
    rows = materialize(rows.select("doc_id", "size", "text_crc32", "old_shard", block.cast("int").alias("block"), *carried), "reshard-blocks")
    found = [tuple(r) for r in rows.groupBy("block", "old_shard").agg(F.sum("size"), F.count("*")).orderBy("block").collect()]
    supply = [0] * old_shards
    for _, i, size, _ in found:
        supply[i] += size
    capacity = capacities(total, new_shards)
    shard = place_blocks([x[:3] for x in found], min_cost_flow(supply, capacity), capacity)
    start, plan = [0] * new_shards, []
    for b, _, _, n in found:
        plan.append((b, shard[b], start[shard[b]]))
        start[shard[b]] += n
    plan_type = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("_start", T.LongType())])
    placed = rows.join(F.broadcast(spark.createDataFrame(plan, plan_type)), "block")
    inside = Window.partitionBy("block").orderBy("text_crc32", "doc_id", "size")
    slot = F.row_number().over(inside).cast("long") - 1 + F.col("_start")
    return placed.select("doc_id", "size", "text_crc32", "old_shard", "block", "shard", slot.alias("slot"), *carried)


def affected(placed: DataFrame) -> list[int]:
    """Shards (at most old plus new ones) whose files must be written again."""
    moved = placed.where("old_shard != shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    return sorted(r[0] for r in moved.collect())


def rewrite(docs: DataFrame, path: str, old_shards: int, new_shards: int, blocks: int = BLOCKS, old: str = "shard") -> list[int]:
    """Reshards the table of ``shard=N`` folders below ``path``, which ``docs`` reads; returns the affected shards.

    The column ``old`` names each row's present shard.  Only shards that gain or
    lose blocks are written again, other folders stay as they are; a shard that
    is left empty loses its folder.  Rows carry their own place from end to end,
    so ids may be null or repeated, and no row is lost or doubled.  Files hold
    all other columns of ``docs``, whatever their names.
    """
    spark = docs.sparkSession
    placed = materialize(reshard(docs, old_shards, new_shards, blocks, F.col(f"`{old}`"), whole=True), "reshard-files")
    changed = affected(placed)
    if not changed:
        return changed
    keep = [F.col(f"doc.`{c}`") for c in docs.columns if c != old]
    out = placed.where(F.col("shard").isin(changed)).repartition("shard", F.floor(F.col("slot") / 1_000_000))
    out.select(*keep, F.col("shard").alias(old)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(old).parquet(path)
    filled = {r[0] for r in placed.select("shard").distinct().collect()}  # one row for each shard
    jvm = spark.sparkContext._jvm
    for s in set(changed) - filled:
        gone = jvm.org.apache.hadoop.fs.Path(f"{path}/{old}={s}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return changed
