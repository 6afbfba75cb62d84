"""Sharding by Karmarkar-Karp differencing: near-equal bytes for indivisible groups.

Documents of equal text form a group that stays together. Groups are dealt into blocks of
bounded size; each block is differenced in a task of its own: the two partial partitions
of largest spread are combined, the heaviest shard of one with the lightest of the other,
until one is left. The blocks' partial partitions are again partial partitions, so the
same step combines ``fan_in`` of them at a time, level by level, until one remains. Only
loads of shards move up; the groups' own rows stay where they are, and the levels'
permutations are joined back to them. No task and no driver ever holds all groups.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise, utf8_bytes

SHARDS = 24


def difference(partitions: list[tuple[list[int], list]]) -> tuple[list[int], list]:
    """Combine partial partitions, each a list of loads and a list of members per shard
    (any nested pairs), into one whose loads are in descending order."""
    heap = []
    for n, (loads, members) in enumerate(partitions):
        order = sorted(range(len(loads)), key=lambda i: -loads[i])
        heap.append((min(loads) - max(loads), n, [loads[i] for i in order], [members[i] for i in order]))
    heapq.heapify(heap)
    n = len(partitions)
    while len(heap) > 1:
        _, _, a, ma = heapq.heappop(heap)
        _, _, b, mb = heapq.heappop(heap)
        both = sorted(((x + y, i) for i, (x, y) in enumerate(zip(a, reversed(b)))), key=lambda v: -v[0])
        mb = mb[::-1]
        loads = [v for v, _ in both]
        members = [ma[i] if mb[i] is None else mb[i] if ma[i] is None else (ma[i], mb[i]) for _, i in both]
        heapq.heappush(heap, (loads[-1] - loads[0], n, loads, members))
        n += 1
    return heap[0][2], heap[0][3]


def leaves(tree) -> list:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        elif x is not None:
            out.append(x)
    return out


def _block(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gkey"], ascending=[False, True]).reset_index(drop=True)
        none = [None] * (shards - 1)
        zeros = [0] * (shards - 1)
        _, members = difference([([int(b), *zeros], [i, *none]) for i, b in enumerate(pdf["bytes"])])
        place = np.zeros(len(pdf), dtype="int32")
        for p, tree in enumerate(members):
            place[leaves(tree)] = p
        return pd.DataFrame({"gkey": pdf["gkey"], "bytes": pdf["bytes"], "node": pdf["node"], "place": place})

    return run


def _merge(shards: int):
    """One row per node and place in; the place in the parent node out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, up = [], pdf["parent"].iloc[0]
        for node, g in pdf.sort_values(["node", "place"]).groupby("node"):
            loads = np.zeros(shards, dtype="int64")
            loads[g["place"].to_numpy()] = g["bytes"].to_numpy()
            parts.append((loads.tolist(), [(node, p) for p in range(shards)]))
        # a tuple is a pair of subtrees to leaves(): wrap the labels
        wrapped = [(loads, [_Label(m) for m in members]) for loads, members in parts]
        total, members = difference(wrapped)
        rows = [(up, *leaf.at, p, total[p]) for p, tree in enumerate(members) for leaf in leaves(tree)]
        return pd.DataFrame(rows, columns=["parent", "node", "place", "new_place", "new_bytes"])

    return run


class _Label:
    def __init__(self, at):
        self.at = at


def shard_groups(groups: DataFrame, shards: int = SHARDS, block_rows: int = 20_000, fan_in: int = 512) -> DataFrame:
    """Rows (gkey, bytes), one per group, with the group's shard: columns gkey, shard. Groups of
    equal bytes go by their key, so reruns agree; a key that comes twice, or a null one, is a
    caller's mistake; a group longer than a shard's share has that shard to itself; no rows,
    no rows."""
    groups = materialise(groups, "groups")
    n = groups.count()
    nodes = max(1, -(-n // block_rows))
    placed = groups.withColumn("node", F.pmod(F.xxhash64("gkey"), F.lit(nodes)))
    placed = placed.groupBy("node").applyInPandas(_block(shards), "gkey binary, bytes long, node long, place int")
    placed = materialise(placed, "placed")
    loads = placed.groupBy("node", "place").agg(F.sum("bytes").alias("bytes"))
    maps = None
    while nodes > 1:
        step = loads.withColumn("parent", F.floor(F.col("node") / fan_in))
        step = materialise(step.groupBy("parent").applyInPandas(_merge(shards), "parent long, node long, place int, new_place int, new_bytes long"), "step")
        level = step.select("node", "place", "parent", "new_place")
        if maps is None:
            maps = level.select("node", "place", F.col("parent").alias("top"), F.col("new_place").alias("shard"))
        else:
            level = level.select(F.col("node").alias("top"), F.col("place").alias("shard"), "parent", "new_place")
            maps = maps.join(level, ["top", "shard"]).select("node", "place", F.col("parent").alias("top"), F.col("new_place").alias("shard"))
        loads = step.groupBy("parent", "new_place").agg(F.max("new_bytes").alias("bytes")).select(F.col("parent").alias("node"), F.col("new_place").alias("place"), "bytes")
        nodes = -(-nodes // fan_in)
    if maps is None:
        return placed.select("gkey", F.col("place").alias("shard"))
    return placed.join(maps, ["node", "place"]).select("gkey", "shard")


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", slot_cells: int = 256) -> DataFrame:
    """One row per document: key, size, text_crc32, law ('bytes'), shard, slot (gapless
    from 0 in its shard), grown_shard (null).

    Size is the text's UTF-8 bytes plus 8; a null text counts as the empty one and joins
    its group. Rows that repeat get slots of their own, also those of a null key. Very long
    texts count whole. Only key and text are read of docs. An empty table gives no rows."""
    rows = docs.select(
        F.col(f"`{key}`").alias(key),
        (utf8_bytes(text) + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("gkey"),
    )
    shared = shard_groups(rows.groupBy("gkey").agg(F.sum("size").alias("bytes")), shards)
    rows = materialise(rows.join(shared, "gkey").withColumn("__cell", F.pmod(F.xxhash64(key, "gkey"), F.lit(slot_cells)).cast("int")), "shards")
    # at most shards x slot_cells rows, whatever the input
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "__cell").count().select("shard", "__cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy(key, "gkey"))
    return rows.join(F.broadcast(starts), ["shard", "__cell"]).select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__start") + within - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op9_shard_kk(spark, sf_dir) -> DataFrame:
    return shard(documents(spark, sf_dir))
