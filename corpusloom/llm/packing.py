"""Filling containers of several permitted capacities with items of varying length, almost without room left.

Items are spread over packing blocks of about ITEMS by a hash of their id; a block packs on its own, so no task grows
with the collection. Within a block the largest items go first (best fit): into the open container that they leave least
room in, else into a new one of the capacity that is expected to stay least empty for its size, given how much smaller
stock is left. At last every container is downsized to the smallest capacity that holds its content. An item is split
only if it exceeds the largest capacity.
"""

from __future__ import annotations

import bisect


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

ITEMS = 20_000


def expected_share_empty(size: int, capacity: int, smallest: int, left: int) -> float:
    """Room expected to stay empty in a new container for `size`, as a share of its capacity."""
    gap = capacity - size
    empty = gap if gap < smallest else max(min(gap, smallest / 2), gap - left)
    return empty / capacity


def pack(sizes: np.ndarray, capacities: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(container of every item, capacity of every container); every size is between 1 and the largest capacity."""
    order = np.argsort(-sizes, kind="stable")
    suffix = np.concatenate([np.cumsum(sizes[order][::-1])[::-1], [0]])
    smallest = int(sizes.min()) if len(sizes) else 0
    open_by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted rooms in which open containers exist
    home, filled, caps = np.zeros(len(sizes), np.int64), [], []
    for n, i in enumerate(order):
        s = int(sizes[i])
        at = bisect.bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            c = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room], rooms[at]
            filled[c] += s
        else:
            fit = [x for x in capacities if x >= s]
            cap = min(fit, key=lambda x: (round(expected_share_empty(s, x, smallest, int(suffix[n + 1])), 9), -x))
            c, room = len(caps), cap
            caps.append(cap)
            filled.append(s)
        home[i] = c
        room -= s
        if room >= smallest:
            if room not in open_by_room:
                bisect.insort(rooms, room)
                open_by_room[room] = []
            open_by_room[room].append(c)
    final = np.array([capacities[bisect.bisect_left(capacities, f)] for f in filled], np.int64)  # downsizing
    return home, final


def pieces(sized: DataFrame, largest: int, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, tokens): an item over `largest` becomes full pieces and a rest; items without size drop out."""
    cuts = F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.lit(largest)).cast("int"))
    return sized.where("tokens > 0").select(id_col, "tokens", F.explode(cuts).alias("piece")).select(id_col, "piece", (F.col("piece") * F.lit(largest).cast("bigint")).alias("start"), F.least(F.lit(largest).cast("bigint"), F.col("tokens") - F.col("piece") * F.lit(largest)).alias("tokens"))


def containers(sized: DataFrame, capacities: list[int], id_col: str = "doc_id", items: int = ITEMS) -> DataFrame:
    """(block, container, capacity, id, piece, start, tokens) for items (id, tokens); ids are unique.

    Items without size (null or 0) need no container and give no row. Without capacities or items there is no row.
    """
    capacities = sorted({int(c) for c in capacities if c and c > 0})
    kind = sized.schema[id_col].dataType.simpleString()
    schema = f"block int, container int, capacity int, `{id_col}` {kind}, piece int, start bigint, tokens bigint"
    if not capacities:
        return sized.sparkSession.createDataFrame([], schema)
    total = sized.count()
    blocks = max(1, -(-total // items))
    split = pieces(sized, capacities[-1], id_col).withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int"))

    def fill(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values([id_col, "piece"])  # the same result whatever the order of arrival
        home, caps = pack(b["tokens"].to_numpy(), capacities)
        return b.assign(container=home.astype("int32"), capacity=caps[home].astype("int32"))[["block", "container", "capacity", id_col, "piece", "start", "tokens"]]

    return split.groupBy("block").applyInPandas(fill, schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """(capacity, containers, items, tokens, room, room_share) by capacity."""
    each = packed.groupBy("block", "container", "capacity").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    total = each.groupBy("capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    room = F.col("capacity").cast("bigint") * F.col("containers") - F.col("tokens")
    return total.select("capacity", "containers", "items", "tokens", room.alias("room"), (room / (F.col("capacity") * F.col("containers"))).alias("room_share"))


