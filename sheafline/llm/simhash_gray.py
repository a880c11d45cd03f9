"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in few bits agree on some of the blocks that their bits
are cut into, whatever the bits are. Each choice of so many blocks is an upper
node's mask; the fingerprints that share its masked pattern form a group. Within
a group, fingerprints stand in the order of their Gray rank, and runs of them
become nodes that keep the bits all members share. Walking pairs of nodes from the
top, the differences of shared bits add up: beyond the limit the pair is pruned
with all below it, and once even the bits not shared cannot exceed the limit, all
members are linked without being compared.

A group of any size is split up: what masks of more blocks leave too large is linked
through the codes around it. Two codes are within the limit exactly if some code lies
within half the limit of both, and no more codes than such a ball holds can meet there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_batches, stored, table
from .components import components, local_roots

BITS = 64
LIMIT = 4
WORDS = 4
SEED = 42
#: Bytes of a text that are hashed at a time, about.
STEP = 1_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Children of a node.
FAN_OUT = 16
#: A group with more fingerprints is dealt anew by masks of more blocks, and if that doesn't help by balls.
LARGE_GROUP = 8_192
#: Fingerprints expected in a group by chance, at most.
CHANCE = 32


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[i : i + 65_536], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def bits_of(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the 64-bit hashes."""
    return _majority(_ones(hashes), len(hashes))


def _blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some ten thousand at a time."""
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > STEP and (m := _SPACE.search(data, start + STEP)):
            end = m.start()
        yield data[start:end].split()
        start = end + 1


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of the text's word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    ones, n, tail = np.zeros(BITS, np.int64), 0, []
    for block in _blocks(text.encode().lower()):
        parts = tail + block
        if len(parts) >= words:
            joined = b" ".join(parts)
            ends = np.cumsum([len(x) + 1 for x in parts])
            last, first = (ends - 1).tolist(), [0, *ends[:-1].tolist()]
            hashes = np.array(
                [xxh64_intdigest(joined[a:b], seed) for a, b in zip(first, last[words - 1 :], strict=False)], "<u8"
            )
            ones += _ones(hashes)
            n += len(hashes)
        tail = parts[-(words - 1) :] if words > 1 and len(parts) >= words else parts if len(parts) < words else []
    if not n:
        return xxh64_intdigest(b" ".join(tail), seed) if tail else 0
    return _majority(ones, n)


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x or "", words, seed) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))})

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    x = np.asarray(x, np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def masks(blocks: int, limit: int = LIMIT) -> list[int]:
    """The choices of ``blocks - limit`` blocks, of which any two codes within the limit share one."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, blocks - limit)]


def blocks_for(n: int, limit: int = LIMIT) -> int:
    """Fewest blocks, two more than the limit at least, with which chance puts at most CHANCE of ``n`` codes into a group."""
    blocks = limit + 2
    while blocks < limit + 4 and n / 2 ** (BITS * (blocks - limit) / blocks) > CHANCE:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grouped(codes: DataFrame, blocks: int, limit: int) -> DataFrame:
    """mask, pattern, fp: a row for each fingerprint and mask."""
    each = F.array(
        *[
            F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern"))
            for i, m in enumerate(masks(blocks, limit))
        ]
    )
    return codes.select("fp", F.explode(each).alias("node")).select("node.mask", "node.pattern", "fp")


def group_links(group: np.ndarray, codes: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all codes of equal ``group`` within ``limit``; equal groups stand together.

    Not every linked pair is returned, but its two codes are connected by those that are.
    """
    order = np.lexsort((gray_rank(codes), group))
    codes, group = codes[order], group[order]
    levels = [{"all": codes, "any": codes, "start": None, "group": group}]
    while len(levels[-1]["group"]) > len(np.unique(levels[-1]["group"])):
        g = levels[-1]["group"]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        inside = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        start = np.flatnonzero(inside % FAN_OUT == 0)
        levels.append(
            {
                "all": np.bitwise_and.reduceat(levels[-1]["all"], start),
                "any": np.bitwise_or.reduceat(levels[-1]["any"], start), "start": np.append(start, len(g)),
                "group": g[start]
            }
        )

    def members(level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code and behind the last code of each node."""
        a, b = nodes, nodes + 1
        for k in range(level, 0, -1):
            a, b = levels[k]["start"][a], levels[k]["start"][b]
        return a, b

    out: list[tuple[np.ndarray, np.ndarray]] = []
    top = len(levels) - 1
    nodes = np.arange(len(levels[top]["group"]))
    todo = [(top, nodes[i : i + 65_536], nodes[i : i + 65_536]) for i in range(0, len(nodes), 65_536)]
    while todo:
        level, a, b = todo.pop()
        x = levels[level]
        if level == 0:
            near = (a != b) & (np.bitwise_count(codes[a] ^ codes[b]) <= limit)
            out.append((a[near], b[near]))
            continue
        free = (x["any"][a] ^ x["all"][a]) | (x["any"][b] ^ x["all"][b])
        differ = (x["all"][a] ^ x["all"][b]) & ~free
        close = np.bitwise_count(differ) <= limit
        whole = np.bitwise_count(differ | free) <= limit
        for i in np.flatnonzero(whole):
            (a0, a1), (b0, b1) = members(level, a[i]), members(level, b[i])
            every = np.concatenate([np.arange(a0, a1), np.arange(b0, b1)])
            out.append((np.full(len(every), a0), every))
        a, b = a[close & ~whole], b[close & ~whole]
        na, nb = (x["start"][n + 1] - x["start"][n] for n in (a, b))
        size = na * nb
        for part in np.split(
            np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(size) // 1_000_000)) + 1
        ) if len(a) else []:
            n = size[part]
            owner = np.repeat(part, n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ca, cb = x["start"][a[owner]] + at // nb[owner], x["start"][b[owner]] + at % nb[owner]
            keep = ca <= cb  # a node with itself: each pair of children once
            todo.append((level - 1, ca[keep], cb[keep]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    root = local_roots(len(codes), a, b)
    linked = np.flatnonzero(root != np.arange(len(codes)))
    return codes[linked], codes[root[linked]]


def _links(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def solved(x: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate([[False], (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])]))
            a, b = group_links(group, np.ascontiguousarray(x[:, 2]).view(np.uint64), limit)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            if not len(batch):
                continue
            held.append(
                np.stack(
                    [
                        batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                        for c in ("mask", "pattern", "fp")
                    ],
                    axis=1
                )
            )
            rows += len(batch)
            if rows < 200_000:
                continue
            x = np.concatenate(held)
            cut = np.flatnonzero((x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1]))
            if len(cut):  # the last group may go on
                yield solved(x[: cut[-1] + 1])
                x = x[cut[-1] + 1 :]
            held, rows = [x], len(x)
        if held:
            yield solved(np.concatenate(held))

    return run


def _balls(radius: int):
    """A row for each code within ``radius`` of each fingerprint: the code as centre, and the fingerprint."""
    flips = np.array(
        [sum(1 << k for k in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)], np.uint64
    ).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("fp").to_numpy()
            for i in range(0, len(codes), 256):
                part = codes[i : i + 256]
                yield pa.RecordBatch.from_pydict(
                    {
                        "centre": pa.array((part[:, None] ^ flips[None, :]).ravel()),
                        "fp": pa.array(np.repeat(part, len(flips)))
                    }
                )

    return run


def ball_links(codes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """a, b: links that connect the distinct fingerprints of ``codes`` (fp), however many lie close together.

    All that meet at a centre are linked to the smallest there. For an even limit only.
    """
    if limit % 2:
        raise ValueError("groups this large need an even limit")
    met = codes.mapInArrow(
        _balls(limit // 2), "centre bigint, fp bigint"
    ).groupBy("centre").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def near_links(codes: DataFrame, limit: int = LIMIT, large: int = LARGE_GROUP) -> DataFrame:
    """a, b: links that connect the distinct fingerprints of ``codes`` (fp) as all pairs within ``limit`` would."""
    blocks = blocks_for(codes.count(), limit)
    found = None
    for dealt in sorted({blocks, limit + 4}):
        nodes = _grouped(codes, dealt, limit)
        heavy = stored(nodes.groupBy("mask", "pattern").count().where(F.col("count") > large).drop("count"), "heavy")
        hot = not heavy.isEmpty()
        if hot:
            codes = stored(nodes.join(heavy, ["mask", "pattern"], "left_semi").select("fp").distinct(), "hot")
            nodes = nodes.join(heavy, ["mask", "pattern"], "left_anti")
        links = nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern").mapInArrow(
            _links(limit), "a bigint, b bigint"
        )
        found = links if found is None else found.unionByName(links)
        if not hot:
            return found
    return found.unionByName(ball_links(codes, limit))


def simhash_groups(docs: DataFrame, words: int = WORDS, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """doc_id, fp (64 bits as a signed number), component_id for each row of ``docs``.

    Fingerprints link at ``limit`` or fewer differing bits; component_id is the
    smallest doc_id that is reachable over links. Null and wordless texts have the
    fingerprint zero and link like any other. Copies count once in the search, so a
    group of any size is one fingerprint. Rows with a null doc_id take part; their
    component_id is null only if no doc_id in the component is known. No documents
    give no rows; other columns are not read.
    """
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint"), F.col("text").cast("string")
        ).mapInArrow(_fingerprints(words, seed), "doc_id bigint, fp bigint"),
        "simhash"
    )
    codes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "codes")
    roots = components(near_links(codes.select("fp"), limit), "simhash-links")
    known = stored(
        codes.join(
            roots.withColumnRenamed("node", "fp"), "fp", "left"
        ).select("fp", "low", F.coalesce("root", "fp").alias("root")),
        "roots"
    )
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    by_code = stored(known.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "lowest")
    return rows.join(by_code, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id"
    )


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, nulls last, then the lowest hash of its text.

    Near copies share 0.8 of their five-word shingles; see ``shingle_copies``. Rows are
    judged by doc_id and text together, so texts that share a doc_id don't stand for
    each other; of rows equal in both, one stays. Null and wordless texts are one
    group; all columns are kept, whatever their names; no documents give no rows.
    """
    from .shingle_copies import copy_groups

    small_batches(spark)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(docs["doc_id"].cast("bigint"), F.lit(0)).alias("id"), docs["doc_id"].isNull().alias("unnamed"),
        F.xxhash64(text).alias("th"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    )
    key = ["id", "unnamed", "th"]
    with scratch(spark) as kept:
        groups = stored(
            copy_groups(docs).select(
                F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("unnamed"), "th", "root"
            ),
            "copy-groups"
        )
        first = groups.groupBy("root").agg(
            F.min(F.struct("unnamed", "id", "th")).alias("first"), F.count("*").alias("n")
        ).where("n > 1")
        first = stored(first.select("root", "first"), "copy-first")
        member = groups.join(first, "root").select(
            *key,
            (F.struct("unnamed", "id", "th") == F.col("first")).alias("stays")
        )
        gone = stored(member.where("not stays").select(*key).distinct(), "near-copies")
        again = stored(member.where("stays").groupBy(*key).count().where("count > 1").select(*key), "same-rows")
        kept += [gone, again]
    left = rows.join(gone, key, "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    # Only rows equal in doc_id and text are brought together; counts of them are summed before the shuffle.
    one = left.join(again, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
    return left.join(again, key, "left_anti").select("row.*").unionByName(one.select("row.*"))
