"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's key hashes to one of SLOTS slots and stays there for good.  The bytes of
each slot are summed, and a map from slots to shards deals the slots out so that
shards come near equal bytes.  Rebalancing edits the map under a new version: only
the slots it moves change shard.  The map has SLOTS rows whatever the corpus, so the
driver edits it.  Versions are stored in a folder and only ever added to; a run takes
the latest one and adds another where shards were added or removed, or bytes have
become uneven.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.stores import shared_dir

SLOTS = 4096
#: Rows of a slot that are numbered in one task, about: larger slots are numbered in parts, by a hash of the row.
PART_ROWS = 100_000
#: How far the fullest shard may be over the mean before slots move.
UNEVEN = 1.05


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_sizes(counted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot of (virtual_slot, b, n): at most as many rows as slots reach the driver."""
    return {r.virtual_slot: (r.b, r.n) for r in counted.groupBy("virtual_slot").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()}


def first_map(sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots from the largest to the smallest, each to the shard with the fewest bytes so far."""
    heap = [(0, k) for k in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, (0, 0))[0], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, (0, 0))[0], shard))
    return out


def grown_map(current: list[int], sizes: dict[int, tuple[int, int]], shards: int) -> list[int]:
    """The next version, with one more shard: slots move into it only, from the fullest shards, until it has its share."""
    out, load = list(current), [0] * (shards + 1)
    of: dict[int, list[tuple[int, int]]] = {k: [] for k in range(shards)}
    for slot, shard in enumerate(current):
        load[shard] += sizes.get(slot, (0, 0))[0]
        of[shard].append((sizes.get(slot, (0, 0))[0], slot))
    for slots in of.values():
        slots.sort()
    share = sum(load) / (shards + 1)
    while True:
        shard = max(range(shards), key=lambda k: (load[k] if of[k] else -1, -k))
        if not of[shard] or load[shard] <= share:
            return out
        size, slot = of[shard].pop()
        if load[shards] + size <= share or load[shards] + size - share < share - load[shards]:
            out[slot] = shards
            load[shard] -= size
            load[shards] += size


def edited_map(current: list[int], sizes: dict[int, tuple[int, int]], shards: int) -> list[int]:
    """The map for this many shards: slots of removed shards are dealt out, added shards fill up, and while a shard is more than UNEVEN of the mean, slots move from the fullest to the emptiest. No other slots move."""
    out = list(current)
    for k in range(max(current) + 1, shards):
        out = grown_map(out, sizes, k)
    weight = lambda slot: sizes.get(slot, (0, 0))[0]
    load, of = [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        if shard < shards:
            load[shard] += weight(slot)
            of[shard].append(slot)
    for slot in sorted((s for s, k in enumerate(out) if k >= shards), key=lambda s: (-weight(s), s)):
        shard = min(range(shards), key=lambda k: (load[k], len(of[k]), k))
        out[slot] = shard
        load[shard] += weight(slot)
        of[shard].append(slot)
    while shards > 1 and max(load) > UNEVEN * sum(load) / shards:
        full, empty = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        # the largest slot that leaves both at or under half of what they differ by, else the smallest that helps at all
        fits = [s for s in of[full] if 0 < weight(s) < load[full] - load[empty]]
        if not fits:
            break
        half = (load[full] - load[empty]) / 2
        slot = max((s for s in fits if weight(s) <= half), key=lambda s: (weight(s), -s), default=None)
        slot = min(fits, key=lambda s: (weight(s), s)) if slot is None else slot
        of[full].remove(slot)
        of[empty].append(slot)
        out[slot] = empty
        load[full] -= weight(slot)
        load[empty] += weight(slot)
    return out


def map_rows(spark, versions: list[list[int]], first: int = 1) -> DataFrame:
    """The stored form of the map: version, slot, shard."""
    return spark.createDataFrame([(v, s, k) for v, m in enumerate(versions, first) for s, k in enumerate(m)], "version int, slot int, shard int")


def map_folder(spark: SparkSession, name: str, source: str) -> str:
    """Where the shared folder holds the map of a table of this source."""
    return f"{shared_dir(spark)}/slot-map-{name}-{hashlib.sha256(source.encode()).hexdigest()[:16]}"


def stored_map(spark: SparkSession, folder: str, slots: int = SLOTS) -> tuple[int, list[int] | None]:
    """The number of the latest whole version in the folder and its map; (0, None) if there is none."""
    try:
        rows = spark.read.schema("version int, slot int, shard int").parquet(f"{folder}/*")
        whole = rows.groupBy("version").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("d")).filter("n = d and n = top + 1").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0, None
    if whole is None:
        return 0, None
    found = {r.slot: r.shard for r in rows.filter(F.col("version") == whole).collect()}
    if len(found) != slots:
        raise ValueError(f"the stored map has {len(found)} slots, not {slots}: slots are fixed")
    return whole, [found[s] for s in range(slots)]


def current_map(spark: SparkSession, folder: str, sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """The latest stored map, edited for these sizes and shards; what is new is stored as the next version. Without bytes nothing is stored."""
    version, before = stored_map(spark, folder, slots)
    now = first_map(sizes, shards, slots) if before is None else edited_map(before, sizes, shards)
    if now != before and sizes:
        map_rows(spark, [now], version + 1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/v{version + 1}")
    return now


ADDED = ("size", "text_crc32", "virtual_slot", "shard", "slot", "next_shard")


def sharded(rows: DataFrame, keys: list[str], text_col: str = "text", shards: int = 24, slots: int = SLOTS, folder: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Every row with size, text_crc32, virtual_slot, shard, slot (its place in the shard, from 0, without gaps) and next_shard (with one more shard).

    With a folder the map stored there is taken, and edited under a new version where it has to be; without one it is made anew.
    The law is `bytes`: sums of size are near equal.  A null text has no bytes; a null
    key hashes like any value.  Rows of one key share a slot, so a key that holds more
    than a shard's part of the bytes cannot be split: give further key columns then.
    Places follow the virtual slot, then a hash of (keys, size, crc) that cuts large
    slots into parts of about part_rows, then keys, size and crc; rows equal in these
    may swap places.
    Columns of rows that have the names of added ones are replaced.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    held = [c for c in rows.columns if c not in ADDED]
    # names of our own within: the caller's may be any
    base = rows.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(held)),
        *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        slot_of(*(F.col(f"`{c}`") for c in keys), slots=slots).alias("virtual_slot"),
    )
    order = [*(f"k{i}" for i in range(len(keys))), "size", "crc"]
    most = base.groupBy("virtual_slot").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = most // part_rows + 1
    base = base.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counted = base.groupBy("virtual_slot", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    sizes = slot_sizes(counted)
    first = first_map(sizes, shards, slots) if folder is None else current_map(rows.sparkSession, folder, sizes, shards, slots)
    second = grown_map(first, sizes, shards)
    before, ahead = [0] * slots, [0] * shards
    for slot, shard in enumerate(first):
        before[slot] = ahead[shard]
        ahead[shard] += sizes.get(slot, (0, 0))[1]
    # a row for each slot
    plan = rows.sparkSession.createDataFrame(list(zip(range(slots), first, second, before)), "virtual_slot int, shard int, next_shard int, ahead long")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("virtual_slot", "part", earlier.alias("start"))
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy(*order)) - 1
    placed = base.withColumn("place", place).join(F.broadcast(plan), "virtual_slot")
    if parts > 1:
        placed = placed.join(starts, ["virtual_slot", "part"])
    else:
        placed = placed.withColumn("start", F.lit(0).cast("long"))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(held)]
    slot = (F.col("ahead") + F.col("start") + F.col("place")).cast("long").alias("slot")
    return placed.select(*kept, "size", F.col("crc").alias("text_crc32"), "virtual_slot", "shard", slot, "next_shard")
