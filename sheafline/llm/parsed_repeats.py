"""Removal of repeated byte strings, by prefix-free parsing.

A rolling hash sets triggers: in every string of the wanted length, the smallest
hash of a short stretch. Equal strings have equal triggers at equal places, so no
string lacks one, and what surrounds a text doesn't matter. From a trigger leftwards
stands the end of a phrase of the dictionary, from a trigger rightwards the parse
goes on. Each string is thus the suffix of a dictionary phrase, then the start of a
suffix of the parse, and the order of both gives the order of the corpus:

* Triggers that stand once in the corpus stand for strings that do not repeat, and
  equal surroundings of a trigger repeat as a whole. Both are settled by counts;
  copies within a step of the parse are counted there.
* Where the surroundings of one trigger differ, dictionary suffixes are ordered from
  the trigger leftwards, parse suffixes from the trigger rightwards, and strings by the
  pair of both ranks. Neighbours of equal rank are equal strings.
* A trigger with many different surroundings is dealt by narrower ones: strings that
  start in the same few bytes before the trigger, grouped by all the bytes that they
  have in common. That goes on down to single strings, so a group of any size is split.

Only hashes travel between tasks, and text only where surroundings differ. Long texts
are parsed in overlapping steps; surroundings that the end of a step cuts in two are
two of one trigger, and are judged there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, grouped, mix64, scratch, small_batches, stored, table

LENGTH = 200
#: Bytes that the rolling hash covers.
STRETCH = 64
#: Bytes of text that one step works on; it takes some hundred bytes of memory for each.
BATCH_BYTES = 1_000_000
#: A group with more members is dealt anew by narrower surroundings.
LARGE_GROUP = 512
#: Starts of strings that stay together when a group is dealt anew, round by round.
WIDTHS = (16, 4, 1)

_PHRASE = "rid binary, lo int, hi int, at int, n bigint, trigger bigint, phrase bigint"
_HARD = "trigger bigint, rid binary, lo int, at int, n bigint, body binary"
_FINER = _HARD + ", phrase bigint, hi int"
_SPAN = "rid binary, lo int, hi int"


def parse(texts: list[bytes], length: int = LENGTH, stretch: int = STRETCH) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, at, trigger, phrase): strings that start from lo to hi in a text and share the trigger at ``at``."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = np.maximum(0, sizes - length + 1)
    if not n.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    roll = RollingHash(data)
    hashes = roll.all_of(stretch)
    # Upper half: hash; lower half: place from behind, so that of equal hashes the last counts.
    low = np.uint64(0xFFFFFFFF)
    order = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    width = length - stretch + 1
    padded = np.full(-(-len(order) // width) * width + width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(order)] = order
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(padded) - width + 1], ahead[width - 1 :])
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())  # starts of all strings
    owner = np.repeat(np.arange(len(texts)), n)
    trigger = (low - (least[at] & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.append(first[1:], len(at)) - 1
    phrase = mix64(roll.of(at[first], at[last] + length) ^ mix64(last - first + 1))
    who = owner[first]
    return who, at[first] - starts[who], at[last] - starts[who], trigger[first] - starts[who], hashes[trigger[first]], phrase


def _ordered_rows(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows by group and content, and how many bytes each shares with the one before it; -1 in another group."""
    wide = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(wide).view(f"S{wide.shape[1]}").ravel(), kind="stable")
    differ = wide[order[1:]] != wide[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), wide.shape[1]) - 4
    return order, np.concatenate([[-1], np.maximum(shared, -1)])


def _ranks(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """[row, k]: the rank of each row's first k bytes in its group; equal ones have equal ranks."""
    order, shared = _ordered_rows(rows, group)
    out = np.empty((len(rows), rows.shape[1] + 1), np.int64)
    out[order] = np.cumsum(shared[:, None] < np.arange(rows.shape[1] + 1)[None, :], axis=0)
    return out


def repeated_in(
    bodies: list[bytes], at: np.ndarray, counts: np.ndarray, group: np.ndarray, length: int = LENGTH
) -> list[np.ndarray]:
    """For each body, which of its strings stand more than once in its group, each counted as often as it occurs.

    ``at``: where in a body the trigger begins that all bodies of a group share.
    """
    size = np.array([len(b) for b in bodies], np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    begin = (np.cumsum(size) - size)[:, None]
    n = size - length + 1
    reach = np.arange(int(at.max(initial=0)))[None, :]
    left = np.where(reach < at[:, None], data[np.maximum(begin + at[:, None] - 1 - reach, 0)], 0)
    reach = np.arange(length)[None, :]
    right = np.where(
        at[:, None] + reach < size[:, None],
        data[np.minimum(begin + at[:, None] + reach, len(data) - 1)], 0
    )
    suffix, parsed = _ranks(left.astype(np.uint8), group), _ranks(right.astype(np.uint8), group)
    owner = np.repeat(np.arange(len(bodies)), n)
    before = at[owner] - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))  # bytes of a string that stand before the trigger
    rank = (before << 56) | (suffix[owner, before] << 28) | parsed[owner, length - before]
    order = np.argsort(rank, kind="stable")
    new = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    place = np.cumsum(new) - 1
    total = np.bincount(place, counts[owner[order]])
    flags = np.empty(len(rank), bool)
    flags[order] = total[place] > 1
    return np.split(flags, np.cumsum(n)[:-1])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [(x or "").encode() for x in batch.column("text").to_pylist()]


def _known(who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring ranges of a text as one."""
    if not len(who):
        return who, lo, hi
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (lo[1:] > hi[:-1] + 1)]))
    return who[first], lo[first], np.maximum.reduceat(hi, first)


def _parsed(length: int, step: int):
    """Distinct surroundings of triggers with their number; and with the number 0, strings known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rid = _encoded(batch), batch.column("rid")
            steps = [(i, a) for i, x in enumerate(texts) for a in range(0, len(x) - length + 1, step)]
            parts, owner, begin = [
                texts[i][a : a + step + length - 1]
                for i, a in steps
            ], np.array([i for i, _ in steps], np.int64), np.array([a for _, a in steps], np.int64)
            for a, b in grouped(parts, step):
                who, lo, hi, at, trigger, phrase = parse(parts[a:b], length)
                if not len(who):
                    continue
                who += a
                who, lo, hi, at = owner[who], lo + begin[who], hi + begin[who], at - lo
                order = np.lexsort((phrase, trigger))
                new = np.concatenate(
                    [[True], (trigger[order][1:] != trigger[order][:-1]) | (phrase[order][1:] != phrase[order][:-1])]
                )
                n = np.bincount(np.cumsum(new) - 1)
                one = order[new]
                again = np.zeros(len(who), bool)
                again[order] = np.repeat(n > 1, n)
                spans = _known(who[again], lo[again], hi[again])
                none = np.zeros(len(spans[0]), np.int64)
                found = {"rid": rid.take(pa.array(np.concatenate([who[one], spans[0]])))}
                for name, kind, x, y in (
                    ("lo", np.int32, lo[one], spans[1]), ("hi", np.int32, hi[one], spans[2]),
                    ("at", np.int32, at[one], none), ("n", np.int64, n, none),
                    ("trigger", np.int64, trigger[one].view(np.int64), none),
                    ("phrase", np.int64, phrase[one].view(np.int64), none)
                ):
                    found[name] = pa.array(np.concatenate([x, y]).astype(kind))
                yield pa.RecordBatch.from_pydict(found)

    return run


def _bodies(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("trigger", pa.int64()), ("rid", pa.binary()), ("lo", pa.int32()), ("at", pa.int32()),
                ("n", pa.int64()), ("body", pa.binary())
            ]
        )
        for batch in batches:
            for text, rid, phrases in zip(
                batch.column("text"), batch.column("rid").to_pylist(), batch.column("phrases").to_pylist(), strict=True
            ):
                data = (text.as_py() or "").encode()
                for i in range(0, len(phrases), 4_096):
                    part = phrases[i : i + 4_096]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "rid": [rid] * len(part), "body": [data[p["lo"] : p["hi"] + length] for p in part]
                        } | {c: [p[c] for p in part] for c in ("trigger", "lo", "at", "n")},
                        schema
                    )

    return run


def _ordered(length: int):
    """The strings that repeat within the groups of a partition; equal triggers stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: pa.Table) -> pa.RecordBatch:
            trigger = rows.column("trigger").to_numpy()
            group = np.cumsum(np.concatenate([[0], trigger[1:] != trigger[:-1]]))
            flags = repeated_in(
                rows.column("body").to_pylist(), rows.column("at").to_numpy().astype(np.int64),
                rows.column("n").to_numpy().astype(np.float64), group, length
            )
            runs = [_runs(f) for f in flags]
            n = [len(a) for a, _ in runs]
            first, last = (np.concatenate([r[k] for r in runs]) for k in (0, 1))
            base = np.repeat(rows.column("lo").to_numpy(), n)
            who = pa.array(np.repeat(np.arange(len(n)), n))
            return pa.RecordBatch.from_pydict(
                {
                    "rid": rows.column("rid").combine_chunks().take(who),
                    "lo": pa.array((base + first).astype(np.int32)), "hi": pa.array((base + last).astype(np.int32))
                }
            )

        held: list[pa.RecordBatch] = []
        for part in (batch.slice(a, 1_000) for batch in batches for a in range(0, len(batch), 1_000)):
            held.append(part)
            if sum(x.nbytes for x in held) < BATCH_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            trigger = rows.column("trigger").to_numpy()
            cut = np.flatnonzero(trigger[1:] != trigger[:-1])
            if len(cut):  # the last group may go on
                yield solved(rows.slice(0, int(cut[-1]) + 1))
                rows = rows.slice(int(cut[-1]) + 1)
            held = rows.combine_chunks().to_batches()
        if held:
            yield solved(pa.Table.from_batches(held))

    return run


def _finer(length: int, width: int):
    """Bodies cut into the strings that start in the same ``width`` bytes before the trigger.

    Their group is named by all bytes that such strings share, in whatever body they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        schema = pa.schema(
            [
                ("trigger", pa.int64()), ("rid", pa.binary()), ("lo", pa.int32()), ("at", pa.int32()),
                ("n", pa.int64()), ("body", pa.binary()), ("phrase", pa.int64()), ("hi", pa.int32())
            ]
        )
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            out = []
            for row in (x for a in range(0, len(batch), 256) for x in batch.slice(a, 256).to_pylist()):
                body, at = row["body"], row["at"]
                strings = len(body) - length + 1
                for k in range((at - strings + 1) // width, at // width + 1):  # strings with k * width to k * width + width - 1 bytes before the trigger
                    a, b = max(0, at - k * width - width + 1), min(strings - 1, at - k * width)
                    part, inside = body[a : b + length], at - a
                    core = body[at - k * width : at + length - k * width - width + 1]
                    group, same = (
                        signed(xxh3_64_intdigest(x, (row["trigger"] ^ y * 0x9E3779B97F4A7C15) % (1 << 64)))
                        for x, y in ((core, k), (part, inside + 1))
                    )
                    out.append((group, row["rid"], row["lo"] + a, inside, row["n"], part, same, row["lo"] + b))
                if len(out) >= 4_096:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)],
                        schema=schema
                    )
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
                )

    return run


def _settled(bodies: DataFrame, length: int, widths: tuple[int, ...]) -> DataFrame:
    """The strings of ``bodies`` that stand more than once among those of one trigger."""
    small, found = bodies, None
    for width in widths:
        large = stored(small.groupBy("trigger").count().where(F.col("count") > LARGE_GROUP).select("trigger"), "large")
        if large.isEmpty():
            break
        parts = stored(
            small.join(large, "trigger", "left_semi").select(*bodies.columns).mapInArrow(_finer(length, width), _FINER),
            "finer"
        )
        entries = stored(
            parts.groupBy("trigger", "phrase").agg(
                F.sum("n").alias("n"), F.min(F.struct("rid", "lo", "at", "body")).alias("one")
            ),
            "finer-dictionary"
        )
        whole = parts.join(
            entries.where("n > 1").select("trigger", "phrase"), ["trigger", "phrase"], "left_semi"
        ).select("rid", "lo", "hi")
        solved = small.join(large, "trigger", "left_anti").select(*bodies.columns).repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_ordered(length), _SPAN).unionByName(whole)
        found = solved if found is None else found.unionByName(solved)
        mixed = stored(
            entries.groupBy("trigger").agg(F.count("*").alias("phrases")).where("phrases > 1"), "finer-mixed"
        )
        small = stored(
            entries.join(mixed, "trigger", "left_semi").select(
                "trigger", "one.rid", "one.lo", "one.at", "n", "one.body"
            ),
            "finer-bodies"
        )
    solved = small.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_ordered(length), _SPAN)
    return solved if found is None else found.unionByName(solved)


def repeat_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """rid, lo, hi: in the text ``rid``, the strings of ``length`` bytes that start from lo to hi repeat.

    ``texts`` has rid (binary), which only rows of equal text may share, and text.
    """
    phrases = stored(texts.mapInArrow(_parsed(length, BATCH_BYTES), _PHRASE), "parse")
    known = phrases.where("n = 0").select("rid", "lo", "hi")
    phrases = phrases.where("n > 0")
    # Most triggers stand once. Only the trigger itself is shuffled to find those that don't.
    twice = stored(phrases.groupBy("trigger").count().where("count > 1").select("trigger"), "triggers")
    # Dealt by text again, so that the rows of a hot phrase, which the join put side by side, can be split.
    parse_rows = stored(
        phrases.join(twice, "trigger", "left_semi").select(*phrases.columns).repartition("rid"), "repeats"
    )
    entries = stored(
        parse_rows.groupBy("trigger", "phrase").agg(
            F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(F.struct("rid", "lo", "hi", "at")).alias("one")
        ),
        "dictionary"
    )
    whole = parse_rows.where("n = 1").join(
        stored(entries.where("n > 1 and rows > 1").select("trigger", "phrase"), "whole"), ["trigger", "phrase"],
        "left_semi"
    ).select("rid", "lo", "hi")
    mixed = stored(entries.groupBy("trigger").agg(F.count("*").alias("phrases")).where("phrases > 1"), "mixed")
    hard = entries.join(mixed, "trigger").select("one.*", "trigger", "n")
    by_text = stored(
        hard.groupBy("rid").agg(F.collect_list(F.struct("trigger", "lo", "hi", "at", "n")).alias("phrases")), "hard"
    )
    bodies = stored(
        texts.join(by_text, "rid").select("text", "rid", "phrases").mapInArrow(_bodies(length), _HARD), "bodies"
    )
    return known.unionByName(whole).unionByName(_settled(bodies, length, WIDTHS))


def merged(lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte ranges that the strings from lo to hi cover, ends excluded."""
    out: list[list[int]] = []
    for i in np.argsort(lo, kind="stable"):
        a, b = int(lo[i]), int(hi[i]) + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(data: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of a text, the number of bytes removed, and of ranges."""
    if not spans:
        return data, 0, 0
    ranges = merged(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]))
    out, at = [], 0
    for a, b in ranges:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out), sum(b - a for a, b in ranges), len(ranges)


def row_id(doc_id: Column, text: Column) -> Column:
    """128 bits of doc_id and text; rows that agree in both share it."""
    return F.unhex(
        F.md5(
            F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text.cast("string"), F.lit("")))
        )
    )


def _with_spans(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns, and ``spans``, the repeats in its text, for each row of ``docs``."""
    rid = row_id(docs["doc_id"], docs["text"])
    with scratch(docs.sparkSession) as kept:
        spans = repeat_spans(docs.select(rid.alias("rid"), docs["text"].cast("string").alias("text")))
        # Rows equal in doc_id and text share a rid; their spans are the same, and stand here once for each.
        by_text = stored(spans.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
        kept.append(by_text)
    rows = docs.select(rid.alias("rid"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return rows.join(by_text, "rid", "left").select("row", "spans")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in batches:
        out, rows = [], batch.column("row")
        for doc_id, text, spans in zip(
            rows.field("doc_id").to_pylist(), rows.field("text"), batch.column("spans"), strict=True
        ):
            data = (text.as_py() or "").encode()
            kept, removed, n = _cut(data, spans.as_py())
            out.append((doc_id, len(data), removed, n, sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(columns[0], pa.int64()),
                **{
                    k: pa.array(v, pa.int64())
                    for k, v in zip(("n_bytes", "n_removed", "n_spans"), columns[1:4], strict=True)
                },
                "kept_sha256": pa.array(columns[4], pa.string())
            }
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with text and n_chars (if there is such a column) after removal; emptied rows go.

    Bytes left of a character that was cut are dropped. Null and short texts stay as
    they are; rows repeated as a whole are copies of each other and lose what they
    share; other columns, whatever their names, are kept; no documents give no rows.
    """
    schema, columns = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            out = {c: rows.field(c) for c in columns}
            text = out["text"].to_pylist()
            cut = [
                (x, 0) if s is None else _cut((x or "").encode(), s)[:2]
                for x, s in zip(text, batch.column("spans").to_pylist(), strict=True)
            ]
            left = [x.decode("utf-8", "ignore") if n else x for x, n in cut]
            out["text"] = pa.array(left, pa.string())
            if "n_chars" in out:
                out["n_chars"] = pa.array(
                    [
                        k if not n else len(x)
                        for k, x, (_, n) in zip(out["n_chars"].to_pylist(), left, cut, strict=True)
                    ],
                    out["n_chars"].type
                )
            yield pa.RecordBatch.from_pydict(out).filter(
                pa.array([bool(x) or not n for x, (_, n) in zip(left, cut, strict=True)], pa.bool_())
            )

    return _with_spans(docs).mapInArrow(run, schema)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``.

    A byte is removed if a string of 200 bytes covers it that also starts elsewhere,
    in this text or another. Null texts are empty; texts below 200 bytes are kept;
    rows repeated as a whole count as copies of each other; no documents give no
    rows; other columns are not read.
    """
    rows = _with_spans(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    return rows.mapInArrow(
        _digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def op6_parsed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without what repeats in them; see ``remove_repeats``."""
    small_batches(spark)
    return remove_repeats(docs)
