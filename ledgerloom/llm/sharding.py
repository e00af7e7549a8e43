"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `VIRTUAL` points on a ring of 64-bit hashes; a key belongs to
the next point clockwise. A shard takes no more rows than its bound; keys that
find it full continue clockwise to the next shard with room. The bounds add up
to the number of rows (slack 0), so counts are at most one apart: law `rows`.

All keys between two neighbouring points share one walk around the ring. So the
walk is decided on the counts of the ring's arcs (shards x VIRTUAL of them,
whatever the data), once, and each row finds its shard from its rank in its
arc. Ranks come from blocks (arc, salt) of bounded number, counted first: no
task sorts an arc whole, and text never moves.

Cases: a null text counts one byte and the checksum 0; null ids are keys like
others; repeated rows are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import documents, table

SHARDS, VIRTUAL = 16, 64
#: Blocks that an arc's keys are dealt to for ranking; shards x VIRTUAL x SALTS counts reach the driver.
SALTS = 32
SEED = 29


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """The points (position, shard), clockwise; a shard's points don't depend on how many shards there are."""
    points = []
    for shard in range(shards):
        for node in range(virtual):
            digest = hashlib.sha256(f"{SEED}:{shard}:{node}".encode()).digest()
            points.append((int.from_bytes(digest[:8], "big", signed=True), shard))
    return sorted(points)


def bounds(rows: int, shards: int) -> list[int]:
    """How many rows each shard may hold: at most one apart, and together all rows."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walks(counts: list[int], points: list[tuple[int, int]], room: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """For each arc its pieces (first rank, end rank, shard, first slot).

    In the first round every arc gives its point's shard what it can take, in
    the order of the ring; then the rest of each arc, in the same order,
    continues clockwise. So only rows that overflow leave their own shard.
    """
    room, filled = list(room), [0] * len(room)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]
    done = [0] * len(counts)

    def take(arc: int, shard: int) -> None:
        n = min(counts[arc] - done[arc], room[shard])
        if n:
            out[arc].append((done[arc], done[arc] + n, shard, filled[shard]))
            done[arc], room[shard], filled[shard] = done[arc] + n, room[shard] - n, filled[shard] + n

    for arc in range(len(counts)):
        take(arc, points[arc][1])
    for arc in range(len(counts)):
        step = 1
        while done[arc] < counts[arc] and step <= len(points):
            take(arc, points[(arc + step) % len(points)][1])
            step += 1
    return out


def arc_of(position: int, points: list[tuple[int, int]]) -> int:
    return bisect_left(points, (position, -1)) % len(points)


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and the ring's own choice, home_shard."""
    spark = docs.sparkSession
    points = ring(shards, virtual)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(docs).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(SEED)).alias("key"),
    )
    # points below the start of each of 1024 equal cells, and the points inside it: a lookup and a few comparisons for each row
    low = -(1 << 63)
    first = [bisect_left(points, (low + (c << 54), -1)) for c in range(1025)]
    inside = [[p for p, _ in points[first[c] : first[c + 1]]] for c in range(1024)]
    look = spark.createDataFrame([(c, first[c], inside[c]) for c in range(1024)], "cell int, first int, inside array<bigint>")
    cell = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(low)), 54).cast("int")
    rows = rows.withColumn("cell", cell).join(F.broadcast(look), "cell")
    arc = F.pmod(F.col("first") + F.size(F.filter("inside", lambda p: p < F.col("key"))), F.lit(len(points)))
    rows = rows.select("doc_id", "size", "text_crc32", "key", arc.alias("arc"), F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SALTS)).cast("int").alias("salt"))

    counted = {(r.arc, r.salt): r.n for r in rows.groupBy("arc", "salt").agg(F.count("*").alias("n")).collect()}
    counts, start = [0] * len(points), []
    for (arc_no, salt), n in sorted(counted.items()):
        start.append((arc_no, salt, counts[arc_no]))
        counts[arc_no] += n
    pieces = [(a, *p) for a, own in enumerate(walks(counts, points, bounds(sum(counts), shards))) for p in own]
    blocks = F.broadcast(spark.createDataFrame(start, "arc int, salt int, before long"))
    places = F.broadcast(spark.createDataFrame([(*p, points[p[0]][1]) for p in pieces], "arc int, first long, end long, shard int, slot0 long, home_shard int"))
    within = Window.partitionBy("arc", "salt").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(blocks, ["arc", "salt"]).withColumn("rank", F.col("before") + F.col("rank") - 1)
    placed = ranked.join(places, (ranked["arc"] == places["arc"]) & (ranked["rank"] >= places["first"]) & (ranked["rank"] < places["end"]))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
