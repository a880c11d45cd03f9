"""Threshold-scaled sketches of documents.

A sketch holds every distinct shingle hash below a fixed fraction of the hash range,
and where these are few, the few smallest hashes. Two sketches are compared below the
lesser of the limits up to which each is complete, so texts of like length are
compared well however short they are, and containment of a text in a very unequal one
is estimated from the hashes below the fraction. Sketches merge by union.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RollingHash, grouped, mix64, table

#: Bytes in a shingle; a shorter text is one shingle.
SHINGLE = 16
#: One hash in so many is kept.
SCALE = 32
#: Smallest hashes that a text keeps if fewer are below the threshold.
LEAST = 16
BATCH_BYTES = 4_000_000
#: Bytes that are hashed at a time.
STEP = 1_000_000


def sketches(
    texts: list[bytes], shingle: int = SHINGLE, scale: int = SCALE, step: int = STEP, least: int = LEAST
) -> list[np.ndarray]:
    """The sorted 64-bit hashes that each text keeps; long texts are hashed in overlapping steps."""
    pieces = [
        (i, x[a : a + step + shingle - 1])
        for i, x in enumerate(texts)
        for a in range(0, max(1, len(x) - shingle + 1), step)
    ]
    kept: list[list[np.ndarray]] = [[] for _ in texts]
    limit = np.uint64((1 << 64) // scale)
    for first, last in grouped([x for _, x in pieces], step):
        owner = [i for i, _ in pieces[first:last]]
        lengths = np.array([len(x) for _, x in pieces[first:last]], np.int64)
        ends = np.cumsum(lengths)
        roll = RollingHash(np.frombuffer(b"".join(x for _, x in pieces[first:last]), np.uint8))
        hashes = roll.all_of(shingle)
        low = np.flatnonzero(hashes < limit)
        piece = np.searchsorted(ends, low, "right")
        inside = low + shingle <= ends[piece] if len(low) else np.zeros(0, bool)
        low, piece = low[inside], piece[inside]
        cuts = np.searchsorted(piece, np.arange(len(lengths) + 1))
        for k, (i, n) in enumerate(zip(owner, lengths, strict=True)):
            if n >= shingle:
                found = np.unique(hashes[low[cuts[k] : cuts[k + 1]]])
                if len(found) < least:
                    found = np.unique(hashes[ends[k] - n : ends[k] - shingle + 1])[:least]
                kept[i].append(found)
            elif n:
                kept[i].append(mix64(roll.of(ends[k : k + 1] - n, ends[k : k + 1]) ^ np.uint64(n)))
    return [_cut(np.unique(np.concatenate(x)), limit, least) if x else np.zeros(0, np.uint64) for x in kept]


def _cut(hashes: np.ndarray, limit: np.uint64, least: int) -> np.ndarray:
    """Of sorted hashes, those below the limit, or the ``least`` smallest if that is more."""
    return hashes[: max(int(np.searchsorted(hashes, limit)), least)]


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE, least: int = LEAST) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return _cut(np.union1d(a, b), np.uint64((1 << 64) // scale), least)


def _complete(a: np.ndarray, scale: int, least: int) -> np.uint64:
    """The largest hash up to which a sketch has all of its text's."""
    if len(a) < least:
        return np.uint64(0xFFFFFFFFFFFFFFFF)
    return max(a[-1], np.uint64((1 << 64) // scale - 1))


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE, least: int = LEAST) -> float:
    """Share of the smaller sketch that the larger one has, as far as both are complete; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    to = min(_complete(a, scale, least), _complete(b, scale, least))
    a, b = a[a <= to], b[b <= to]
    return len(np.intersect1d(a, b, assume_unique=True)) / max(1, min(len(a), len(b)))


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
        for a, b in grouped(texts, BATCH_BYTES):
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "fingerprint": [to_text(x) for x in sketches(texts[a:b])]
                }
            )


def document_sketches(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (base64 of the sorted 64-bit hashes) of each row of ``docs``.

    Null texts are empty and have an empty fingerprint; equal texts have equal
    ones; repeated and null doc_ids keep a row each; other columns are not read.
    """
    return docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    ).mapInArrow(_sketched, "doc_id bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_PAIR = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()),
        *((x, pa.string()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")),
        ("near_edited", pa.float64()), ("near_next", pa.float64())
    ]
)
#: A range of rows goes by its first row: whether that has no doc_id, its doc_id (or 0), and the hash of its text.
_RANGE = ["unnamed", "id", "h"]
_EDGE = "unnamed boolean, id bigint, h bigint, last boolean, doc_id bigint, text string"


def _rows(ids: list, texts: list[str], follow: list[str]) -> dict:
    """What the query returns for texts and the texts that follow them."""
    from hashlib import sha256

    edits = [edited(t, f).encode() for t, f in zip(texts, follow, strict=True)]
    own = sketches([t.encode() for t in texts])
    shared = len(texts) > 1 and all(a is b for a, b in zip(texts[1:], follow, strict=False))
    after = own[1:] + sketches([follow[-1].encode()]) if shared else sketches([f.encode() for f in follow])
    new = sketches(edits)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [
            sha256(e).hexdigest()
            for e in edits
        ], "fingerprint": [to_text(x) for x in own],
        "edited_fingerprint": [to_text(x) for x in new], "near_edited": [containment(x, y) for x, y in zip(own, new, strict=True)], "near_next": [
            containment(x, y)
            for x, y in zip(own, after, strict=True)
        ],
    }


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the query returns for the rows of one range, in order, but for the last one."""
    held: tuple | None = None
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
        if not ids:
            continue
        if held is not None:
            ids, texts = [held[0], *ids], [held[1], *texts]
        for a, b in grouped(texts[:-1], BATCH_BYTES):
            yield pa.RecordBatch.from_pydict(_rows(ids[a:b], texts[a:b], texts[a + 1 : b + 1]), _SCHEMA)
        held = ids[-1], texts[-1]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of a range."""
    schema = pa.schema(
        [
            ("unnamed", pa.bool_()), ("id", pa.int64()), ("h", pa.int64()), ("last", pa.bool_()),
            ("doc_id", pa.int64()), ("text", pa.string())
        ]
    )
    name, last = None, None
    for batch in batches:
        if not len(batch):
            continue
        if name is None:
            first = batch.slice(0, 1).to_pylist()[0]
            name = {"unnamed": first["doc_id"] is None, "id": first["doc_id"] or 0, "h": first["h"]}
            yield pa.RecordBatch.from_pylist(
                [name | {"last": False, "doc_id": first["doc_id"], "text": first["text"]}], schema
            )
        last = batch.slice(len(batch) - 1)
    if last is not None:
        row = last.to_pylist()[0]
        yield pa.RecordBatch.from_pylist([name | {"last": True, "doc_id": row["doc_id"], "text": row["text"]}], schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, follow = (batch.column(x).to_pylist() for x in ("doc_id", "text", "follow"))
        yield pa.RecordBatch.from_pydict(_rows(ids, [x or "" for x in texts], [x or "" for x in follow]), _SCHEMA)


def neighbour_likeness(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document.

    The next document is that of the next lower doc_id (null last, equal ones by
    text); after the last comes the first, and a single document follows itself.
    One range shuffle puts the rows in order. Only the first and last row of each
    range meet outside their task: two rows a partition. Null texts are empty;
    no documents give no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.xxhash64(text).alias("h"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("text")]
    ranged = rows.repartitionByRange(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), order[0], order[1]
    ).sortWithinPartitions(*order)
    # All readers share the shuffle; the sketches are not stored, as they take as much room as the text.
    ends = ranged.mapInArrow(_edges, _EDGE)
    last = ends.where("last").select(*_RANGE, "doc_id", "text")
    first = ends.where("not last").select(F.struct(*_RANGE).alias("after"), F.col("text").alias("follow"))
    # Which range comes next: a name for each partition of the shuffle above, and no text, in one task.
    by = Window.orderBy("unnamed", F.desc("id"), "h")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    name = F.struct(*_RANGE)
    following = ends.where("last").select(*_RANGE).select(
        *_RANGE,
        F.coalesce(F.lead(name).over(by), F.first(name).over(whole)).alias("after")
    )
    pairs = last.join(following, _RANGE).join(first, "after").select("doc_id", "text", "follow")
    return ranged.select("doc_id", "text").mapInArrow(_in_order, _PAIR).unionByName(pairs.mapInArrow(_ends, _PAIR))


def op10_document_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_likeness(table(spark, sf_dir, "documents"))
