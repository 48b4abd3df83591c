"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard sits on the ring several times; the stretch before each of its
places is an arc.  A row belongs to the arc its key falls in and goes to the
arc's shard while that has room; rows of a full shard go on clockwise.  The
loads are bounded by the even share, so shard sizes differ by one row at most.

The key is the text, so equal texts lie together on the ring and are only
parted when their shard is full.  The driver gets one number per arc; rows are
placed by their rank in their arc, which no single task has to count.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ranked, stored

SHARDS = 24
PLACES = 64
# The ring's resolution.
POINTS = 1 << 16


def ring(shards: int, places: int = PLACES) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes, clockwise; a taken point goes to the lowest shard."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for place in range(places):
            digest = hashlib.md5(f"{shard}/{place}".encode()).digest()
            taken.setdefault(int.from_bytes(digest[:8], "big") % POINTS, shard)
    return sorted(taken.items())


def place_arcs(loads: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): who takes which rows of each arc.

    Arcs first fill their own shard, then offer what is left to the shard one
    place further, and so on around the ring.
    """
    total = sum(loads)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, done, out = [0] * shards, [0] * len(loads), []
    left = [i for i, n in enumerate(loads) if n]
    for step in range(len(owners)):
        for i in left:
            shard = owners[(i + step) % len(owners)]
            n = min(loads[i] - done[i], room[shard] - used[shard])
            if n > 0:
                out.append((i, done[i], done[i] + n, shard, used[shard]))
                done[i] += n
                used[shard] += n
        left = [i for i in left if done[i] < loads[i]]
        if not left:
            break
    return out


def shard_rows(docs: DataFrame, shards: int = SHARDS, places: int = PLACES) -> DataFrame:
    """Put every row into a shard.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law
    ("rows": shard sizes differ by one at most), shard, slot (0, 1, .. in its
    shard) and grown_shard (null under this law).

    Defined cases: a null text counts as empty; rows with null or repeated
    doc_id are rows like any other; an empty table gives an empty result.
    Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    point = F.pmod(F.xxhash64(text), F.lit(POINTS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), point.alias("point"))

    nodes = ring(shards, places)
    arc_of, arc = [], 0
    for p in range(POINTS):
        if arc < len(nodes) and p > nodes[arc][0]:
            arc += 1
        arc_of.append((p, arc % len(nodes)))
    # One row per point of the ring.
    arcs = spark.createDataFrame(arc_of, "point int, arc int")
    rows = stored(rows.join(F.broadcast(arcs), "point").drop("point"), "ring")

    counted = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    loads = [counted.get(i, 0) for i in range(len(nodes))]
    placed = place_arcs(loads, [s for _, s in nodes], shards)
    spans = spark.createDataFrame(placed, "arc int, first long, end long, shard int, base long")

    order = [F.col("text_crc32"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    numbered = ranked(rows, "arc", order, F.xxhash64("doc_id"), sum(loads))
    # At most a few rows per arc.
    joined = numbered.alias("r").join(F.broadcast(spans).alias("s"), (F.col("r.arc") == F.col("s.arc")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return joined.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
