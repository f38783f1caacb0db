"""Consistent-hash ring with virtual nodes and bounded loads.

DataFrame functions only. The ring has a fixed number of cells; documents fall on cells by the hash of
their id. Only the cells' totals (at most ``CELLS`` rows) reach the driver, which walks the ring once:
what overflows a full shard continues clockwise. The plan it makes is joined back by broadcast, and a
document's rank within its cell picks its place in the plan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: cells of the ring. Bounds what the driver sees, whatever the number of documents.
CELLS = 1 << 16


def ring_owners(shards: int, virtual_nodes: int) -> list[int]:
    """The shard that owns each cell: that of the next virtual node clockwise (the cell itself included)."""
    at: dict[int, tuple[str, int]] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.sha256(f"shard {shard} node {node}".encode()).hexdigest()
            cell = int(digest[:8], 16) % CELLS
            at[cell] = min(at.get(cell, (digest, shard)), (digest, shard))
    owners, owner = [0] * CELLS, at[min(at)][1]
    for cell in range(CELLS - 1, -1, -1):
        owner = at[cell][1] if cell in at else owner
        owners[cell] = owner
    return owners


def plan_ring(loads: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where each cell's rows go.

    Pass 1 fills each cell's own shard. Pass 2 lets what is left walk clockwise from its cell to the next
    virtual nodes whose shards still have room; capacities add up to the load at least, so all are placed.
    """
    room, used, plan = list(capacity), [0] * len(capacity), []
    left: list[tuple[int, int, int]] = []

    def take(cell: int, first: int, n: int, shard: int) -> int:
        got = min(n, room[shard])
        if got:
            plan.append((cell, first, first + got, shard, used[shard]))
            room[shard] -= got
            used[shard] += got
        return got

    for cell in sorted(loads):
        got = take(cell, 0, loads[cell], owners[cell])
        if got < loads[cell]:
            left.append((cell, got, loads[cell]))
    for cell, first, end in left:
        at = cell
        while first < end:
            if not any(room):
                raise ValueError("capacities are smaller than the load")
            while not room[owners[at % CELLS]] and at < cell + CELLS:
                at += 1
            shard = owners[at % CELLS] if room[owners[at % CELLS]] else room.index(max(room))
            first += take(cell, first, end - first, shard)
    return plan


def assign(docs: DataFrame, shards: int = 8, virtual_nodes: int = 128, load_factor: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, cell, shard, slot, home) for each row; no text is shuffled.

    A row's place on the ring is the hash of its doc_id; ``home`` is the shard owning that place. A shard takes
    at most its even share of the rows times ``load_factor`` (1: counts differ by one at most); rows that find
    it full go on clockwise. ``slot`` counts from 0 within a shard, without gaps. ``size`` is the text's UTF-8
    bytes plus 1.

    Null text: size 1, checksum 0. Null doc_id: the text's hash gives the place. Repeated rows share a cell and
    each gets a slot of its own. Other columns are left out; an empty table gives no rows.
    """
    if shards < 1 or load_factor < 1:
        raise ValueError("shards and load_factor are at least 1")
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text")).alias("key"))
    rows = rows.withColumn("cell", F.pmod(F.col("key"), F.lit(CELLS)).cast("int"))
    counts = rows.select("cell").groupBy("cell").count()
    loads = {r["cell"]: r["count"] for r in counts.collect()}  # at most CELLS rows
    total = sum(loads.values())
    owners = ring_owners(shards, virtual_nodes)
    even = [total // shards + (s < total % shards) for s in range(shards)]
    capacity = even if load_factor == 1 else [max(e, int(total * load_factor / shards)) for e in even]
    plan = plan_ring(loads, owners, capacity)
    table = spark.createDataFrame(plan, "cell int, first long, end long, shard int, slot0 long")
    owner_table = spark.createDataFrame([(c, owners[c]) for c in sorted(loads)], "cell int, home int")
    order = Window.partitionBy("cell").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    placed = ranked.join(F.broadcast(table), (ranked["cell"] == table["cell"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))).drop(table["cell"])
    return (placed.join(F.broadcast(owner_table), "cell")
            .select("doc_id", "size", "text_crc32", "cell", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), "home"))
