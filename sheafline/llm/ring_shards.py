"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each row has a position on the ring: equal texts stand side by side, in an order
set by doc_id. A row belongs to the first virtual node clockwise whose shard still
has room; what overflows a full shard continues clockwise. Rows only leave their
own arc when its shard is full, so a changed shard count or a changed table moves
few of them where ``slack`` leaves room; without slack, counts are at most one
apart.

Texts that stand more than once are placed first, by slices of the ring that hold
them whole: a slice that doesn't fit into what is left of a shard continues
clockwise to one that has room for all of it. Only rows of texts that stand once are
then dealt one by one into what is left. Rows of equal texts are thus parted only
where their slice fits into no shard.

The rows of an arc or slice are a range of ranks along the ring. The driver decides
on ranges alone, a number set by shards, virtual nodes, slices and partitions; rows
are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table

SHARDS = 24
#: Virtual nodes of a shard.
REPLICAS = 128
#: Bytes that each row takes besides its text.
ROW_BYTES = 8
RING_BITS = 63
#: Slices of the ring in which equal texts are kept together.
SLICE_BITS = 16


def virtual_nodes(shards: int, replicas: int = REPLICAS) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ring order, and the shard of each."""
    at = [
        int.from_bytes(blake2b(f"{s}/{r}".encode(), digest_size=8).digest()) >> (64 - RING_BITS)
        for s in range(shards)
        for r in range(replicas)
    ]
    order = np.argsort(np.array(at, np.int64), kind="stable")
    return np.array(at, np.int64)[order], np.repeat(np.arange(shards), replicas)[order]


def capacities(n: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """Rows that each shard may hold: (1 + slack) times its share; without slack the exact share."""
    if slack > 0:
        return np.full(shards, int(np.ceil((1 + slack) * n / shards)), np.int64)
    return n // shards + (np.arange(shards) < n % shards)


def assign_whole(
    slices: list[tuple[int, int, int]], owner: np.ndarray, room: np.ndarray
) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Ranges as of ``assign_ranges`` for slices that fit somewhere as a whole, and the slices that don't.

    ``slices``: (first node clockwise, first rank, behind the last rank). Takes from ``room``.
    """
    out, left = [], []
    waiting = [(node, a, b, 0) for node, a, b in slices]
    while waiting:
        later = []
        for node, a, b, asked in waiting:
            if asked == len(owner) or b - a > room.max(initial=0):
                left.append((node, a, b))
            elif room[owner[node % len(owner)]] >= b - a:
                room[owner[node % len(owner)]] -= b - a
                out.append((a, b, int(owner[node % len(owner)])))
            else:
                later.append((node + 1, a, b, asked + 1))
        waiting = later
    return out, [(node % len(owner), a, b) for node, a, b in left]


def assign_ranges(
    waiting: list[tuple[int, int, int]], owner: np.ndarray, room: np.ndarray
) -> list[tuple[int, int, int]]:
    """(first rank, behind the last rank, shard) for all rows, in order of rank.

    ``waiting``: (first node clockwise, first rank, behind the last rank) in ring
    order. All rows ask their first node; those sent on ask the next node whose shard
    has room, round by round. In a round, nodes are asked in ring order, and take the
    rows that stand first. Takes from ``room``.
    """
    out = []
    while waiting:
        later = []
        for node, a, b in waiting:
            while not room[owner[node]]:
                node = (node + 1) % len(owner)
            shard = int(owner[node])
            taken = min(b - a, int(room[shard]))
            room[shard] -= taken
            out.append((a, a + taken, shard))
            if a + taken < b:
                later.append(((node + 1) % len(owner), a + taken, b))
        waiting = later
    return sorted(out)


def assign(
    counts: dict[tuple[bool, int], int], nodes: np.ndarray, owner: np.ndarray, room: np.ndarray
) -> list[tuple[int, int, int]]:
    """Ranges for all rows. ``counts``: rows by (text stands once, place): the place is an arc, or a slice of texts that stand more often."""
    end, groups, arcs = 0, [], []
    # Slices stand first, then arcs in ring order; the arc behind the last node belongs to the first one.
    for (single, place), n in sorted(counts.items()):
        node = place if single else int(np.searchsorted(nodes >> (RING_BITS - SLICE_BITS), place))
        (arcs if single else groups).append((node % len(nodes), end, end + n))
        end += n
    whole, parted = assign_whole(groups, owner, room)
    return sorted(whole + assign_ranges(sorted(parted + arcs), owner, room))


def _place_counts(nodes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            at, row, single = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "row", "single"))
            place = np.where(single, np.searchsorted(nodes, at), at >> (RING_BITS - SLICE_BITS))
            both, n = np.unique(np.stack([row >> 33, single.astype(np.int64), place]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(both[0]), "single": pa.array(both[1] == 1), "place": pa.array(both[2]),
                    "n": pa.array(n)
                }
            )

    return run


def _placed(parts: np.ndarray, offsets: np.ndarray, starts: np.ndarray, shards: np.ndarray, slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            rank = offsets[np.searchsorted(parts, row >> 33)] + (row & ((1 << 33) - 1)) if len(row) else row
            seg = np.searchsorted(starts, rank, "right") - 1
            yield pa.RecordBatch.from_pydict(
                {x: batch.column(x) for x in ("doc_id", "size", "text_crc32")}
                | {"shard": pa.array(shards[seg].astype(np.int32)), "slot": pa.array(slots[seg] + rank - starts[seg])}
            )

    return run


def ring_shards(docs: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of ``docs``.

    Without ``slack`` the rows of shards are at most one apart. Slots of a shard run
    from 0 without gaps. A null text has size 8 and the CRC of the empty text; rows
    with null or repeated doc_ids, and rows repeated as a whole, are placed one by
    one; equal texts share a shard unless none has room for them. No documents give
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    high = F.shiftleft(F.shiftrightunsigned("th", 25), 24)
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"),
        F.monotonically_increasing_id().alias("tie")
    )
    with scratch(spark) as kept:
        often = stored(
            rows.groupBy("th").count().where("count > 1").select("th", F.lit(False).alias("single")), "equal-texts"
        )
        # As a stored table, the texts that stand more often have a known size: Spark broadcasts them only below its limit.
        rows = rows.join(often, "th", "left").select(
            "doc_id", "size", "text_crc32",
            high.bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id"), 40)).alias("at"), "tie",
            F.coalesce("single", F.lit(True)).alias("single")
        )
        order = ["single", "at", "doc_id", "tie"]
        ranged = rows.repartitionByRange(
            int(spark.conf.get("spark.sql.shuffle.partitions")), *order
        ).sortWithinPartitions(*order)
        ranged = stored(
            ranged.select("doc_id", "size", "text_crc32", "at", "single", F.monotonically_increasing_id().alias("row")),
            "ring"
        )
        kept.append(ranged)
    nodes, owner = virtual_nodes(shards, replicas)
    found = ranged.select("at", "row", "single").mapInArrow(
        _place_counts(nodes), "part bigint, single boolean, place bigint, n bigint"
    ).groupBy("part", "single", "place").agg(F.sum("n").alias("n")).collect()
    parts = np.unique([x.part for x in found]).astype(np.int64)
    per_part, counts = np.zeros(len(parts), np.int64), {}
    for x in found:
        per_part[np.searchsorted(parts, x.part)] += x.n
        counts[x.single, x.place] = counts.get((x.single, x.place), 0) + x.n
    ranges = assign(counts, nodes, owner, capacities(int(per_part.sum()), shards, slack))
    starts, filled, slots = [], [0] * shards, []
    for a, b, shard in ranges:
        starts.append(a)
        slots.append(filled[shard])
        filled[shard] += b - a
    placed = _placed(
        parts, np.cumsum(per_part) - per_part, np.array(starts, np.int64), np.array([x[2] for x in ranges], np.int64),
        np.array(slots, np.int64)
    )
    return ranged.mapInArrow(placed, "doc_id bigint, size bigint, text_crc32 bigint, shard int, slot bigint")


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard")
    )
