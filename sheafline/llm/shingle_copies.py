"""Near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Most links come from the SimHash index: fingerprints of the same shingles that lie
close together are compared in full, and those alike are connected. Fingerprints of
64 bits can't tell all sets that are 0.8 alike, as these differ in about 10 bits, so
the rest is found exactly. In any order of all shingles, two sets this alike share
one among the first fifth, the prefix, of each. Sets that share a prefix shingle and
aren't connected yet are candidates, and candidates are compared in full, so every
pair is found and no other is linked. Shingles of more than a few texts come last in
the order: that decides how many candidates there are, but not what is found. Where
many sets meet, those are no candidates whose sketches differ in more cells than sets
that are alike can.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, forget, mix64, scratch, stored
from .components import components
from .simhash_gray import bits_of, near_links

WORDS = 5
#: Two texts are near copies from this Jaccard similarity on, in per cent.
ALIKE = 80
SEED = 42
#: A shingle of more texts is common, however many texts there are.
COMMON = 8
#: Common shingles at most, those of the most texts; any number is right.
MOST_COMMON = 2_000_000
#: Low bits of a shingle that don't count when common ones are told.
LOW = 24
#: Cells of a sketch at most.
CELLS = 65_536
#: A shingle with more sets is not compared pair by pair at once, but first each with its next few neighbours.
LARGE, NEXT = 16, 3
#: Sets of one shingle that meet in one row, about; more are dealt over blocks.
BLOCK = 512
#: Rounds of neighbours, each in another order, before all pairs that are not yet connected.
ROUNDS = 2
#: Pairs that are held at once, about, and bytes of their sketches.
PAIRS, SKETCHED = 50_000, 4_000_000

#: Entries of prefixes that meet in one place, about.
PLACE = 300_000

_SET = "th bigint, set_id bigint, n int, fp bigint, last bigint, sketch binary"
_MET = "a bigint, b bigint, shingle bigint, n int, at int"
#: An entry of a prefix: sizes are exact below the largest value, and larger sets stand at place 0.
_ENTRY = np.dtype([("shingle", "<u8"), ("set_id", "<i8"), ("n", "<u2"), ("at", "<u2")])
_MOST = 65_535


def shingles(text: str | None, known: dict[bytes, int] | None = None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; a text of fewer words is one, a wordless text has none."""
    from xxhash import xxh64_intdigest

    known = {} if known is None else known
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    for x in set(parts):
        if x not in known:
            known[x] = xxh64_intdigest(x, SEED)
    hashes = np.array([known[x] for x in parts], np.uint64)
    k = min(words, len(hashes))
    n = len(hashes) - k + 1
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(BASE) + hashes[i : i + n]
    return np.unique(mix64(out))


def _need(n: int) -> int:
    """Fewest shingles that a set of ``n`` shares with one it is alike."""
    return -(-n * ALIKE // 100)


def _late(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which shingles are among the common ones, given by their sorted first bits."""
    if not len(common):
        return np.zeros(len(found), bool)
    first = found >> np.uint64(LOW)
    return common[np.minimum(np.searchsorted(common, first), len(common) - 1)] == first


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which one is shared with each set that is alike, the ``common`` ones last."""
    late = _late(found, common)
    return np.concatenate([found[~late], found[late]])[: len(found) - _need(len(found)) + 1]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    known: dict[bytes, int] = {}
    for batch in batches:
        for th, text in zip(batch.column("th").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if len(known) > 100_000:
                known.clear()
            yield th, shingles(text, known)


def _id_of(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def sketch(found: np.ndarray) -> bytes:
    """Whether each of two to four times as many cells as shingles (``CELLS`` at most) holds an odd number of them.

    Two sets of shingles differ in at least as many shingles as their sketches in cells.
    """
    cells = min(max(64, 1 << (2 * len(found)).bit_length()), CELLS)
    held = np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """A row of ``words`` 64-bit words for each sketch of so many or more; shorter ones are rows of zeros."""
    out = np.zeros((len(sketches), words), np.uint64)
    for i, x in enumerate(sketches):
        if len(x) >= words * 8:
            out[i] = np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, words), axis=0)
    return out


def _differ(sketches: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many cells the sketches of each pair differ, the longer one folded to the length of the shorter."""
    words = np.array([len(x) // 8 for x in sketches])
    short = np.minimum(words[a], words[b])
    out = np.zeros(len(a), np.int64)
    for w in np.unique(short):
        rows = _folded(sketches, w)
        these = np.flatnonzero(short == w)
        step = max(1, SKETCHED // (8 * int(w)))
        for i in range(0, len(these), step):
            part = these[i : i + step]
            out[part] = np.bitwise_count(rows[a[part]] ^ rows[b[part]]).sum(axis=1, dtype=np.int64)
    return out


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Each place and its packs; equal places stand together."""
    now, held = None, []
    for batch in batches:
        for place, pack in zip(batch.column("place").to_pylist(), batch.column("pack").to_pylist(), strict=True):
            if place != now and held:
                yield now, held
                held = []
            now = place
            held.append(pack)
    if held:
        yield now, held


def _counted(bits: int):
    """Five bytes for each shingle of a text, in packs: those of a place share the first ``bits``, eight or more, of their shingle.

    They are the next bits, up to ``LOW``, and a byte of the text's hash, by which copies of a text count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x >> np.uint64(LOW) << np.uint64(8)) | np.uint64(th & 255) for th, x in _each([batch])]
            every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            place = (every >> np.uint64(72 - LOW - bits)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
            packed = np.ascontiguousarray(every.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            parts = [packed[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(place)), strict=False)]
            yield pa.RecordBatch.from_pydict({"place": pa.array(place[first]), "pack": pa.array(parts, pa.binary())})

    return run


def _told(bits: int):
    """The common shingles of each place: their first bits, and in the last byte of how many texts they are, as far as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, packs in _places(batches):
            packed = np.frombuffer(b"".join(packs), np.uint8).reshape(-1, 5)
            every = np.zeros((len(packed), 8), np.uint8)
            every[:, :5] = packed
            found, count = np.unique(np.unique(every.view("<u8").ravel()) >> np.uint64(8), return_counts=True)
            # Only the bits that the place doesn't give are new.
            found = (found & np.uint64((1 << (64 - LOW - bits)) - 1)) | np.uint64(place << (64 - LOW - bits))
            often = count > COMMON
            told = (found[often] << np.uint64(8)) | np.minimum(count[often], 255).astype(np.uint64)
            yield pa.RecordBatch.from_pydict({"told": pa.array([told.astype("<u8").tobytes()], pa.binary())})

    return run


def common_shingles(texts: DataFrame) -> np.ndarray:
    """The sorted first bits of the shingles that more than ``COMMON`` of ``texts`` (text, th) have.

    All texts are counted, not a sample: in a sample of a given size, what counts as
    common would be in ever more texts, and lists of such shingles ever longer.
    """
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(max(8, (chars // 6 // PLACE).bit_length()), 24)
    packs = texts.mapInArrow(_counted(bits), "place bigint, pack binary")
    told = packs.repartition("place").sortWithinPartitions("place").mapInArrow(_told(bits), "told binary")
    found = np.frombuffer(b"".join(x.told for x in told.where(F.length("told") > 0).collect()), "<u8")
    most = np.argsort(found & np.uint64(255), kind="stable")[-MOST_COMMON:]
    return np.sort(found[most] >> np.uint64(8))


def _sets(common: np.ndarray):
    """The hash, size and fingerprint of each text's set, and where in the order its prefix ends, coarsened to 63 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ths, ids, sizes, bits, lasts, sketches = [], [], [], [], [], []
            for th, x in _each([batch]):
                ths.append(th)
                ids.append(_id_of(x))
                sizes.append(len(x))
                bits.append(bits_of(x))
                end = prefix(x, common)[-1:] if len(x) else np.zeros(1, np.uint64)
                lasts.append((int(end[0]) >> 2) | (int(_late(end, common)[0]) << 62))
                sketches.append(sketch(x))
            columns = {
                "th": pa.array(ths, pa.int64()), "set_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int32())
            }
            yield pa.RecordBatch.from_pydict(
                columns
                | {"fp": pa.array(np.array(bits, np.uint64).view(np.int64)), "last": pa.array(lasts, pa.int64())}
                | {"sketch": pa.array(sketches, pa.binary())}
            )

    return run


def _packed(common: np.ndarray, bits: int, large: int):
    """The entries of all prefixes in packs: those of a place share the first bits of their shingle.

    A shingle of more than ``large`` sets of a batch leaves a mark in its place, and its
    entries are dealt by set over as many other places.
    """

    def packs(place: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(place, kind="stable")
        place, entries = place[order], entries[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
        parts = [entries[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(place)), strict=False)]
        return pa.RecordBatch.from_pydict(
            {"place": pa.array(place[first].astype(np.int64)), "pack": pa.array(parts, pa.binary())}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - bits)
        for batch in batches:
            sets = {_id_of(x): x for _, x in _each([batch]) if len(x)}
            prefixes = [prefix(x, common) for x in sets.values()]
            size = np.array([len(x) for x in prefixes], np.int64)
            entries = np.zeros(size.sum(), _ENTRY)
            if not len(entries):
                continue
            n = np.repeat([len(x) for x in sets.values()], size)
            at = np.arange(len(entries)) - np.repeat(np.cumsum(size) - size, size)
            entries["shingle"], entries["set_id"] = np.concatenate(prefixes), np.repeat(list(sets), size)
            entries["n"], entries["at"] = np.minimum(n, _MOST), np.where(n < _MOST, at, 0)
            entries = entries[np.argsort(entries["shingle"], kind="stable")]
            new = np.concatenate([[True], entries["shingle"][1:] != entries["shingle"][:-1]])
            count = np.diff(np.append(np.flatnonzero(new), len(entries)))
            hot = np.repeat(count > large, count)
            marks = entries[new][count > large]
            marks["n"] = 0
            usual = np.concatenate([entries[~hot], marks])
            yield packs(usual["shingle"] >> shift, usual)
            if hot.any():
                yield packs((entries["set_id"][hot].view(np.uint64) >> shift) + np.uint64(1 << bits), entries[hot])

    return run


def _near_enough(n_a: np.ndarray, at_a: np.ndarray, n_b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Whether two sets may be alike if an entry of each is the first shingle that they share."""
    return np.minimum(n_a - at_a, n_b - at_b) * (100 + ALIKE) >= (n_a + n_b) * ALIKE


def _met(bits: int, large: int):
    """Of the entries that meet in a place: pairs of sets (a, b), once for each small list, and the entries of large ones (a, shingle, n, at)."""

    def entries_out(x: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(x), pa.int64())
        return pa.RecordBatch.from_pydict(
            {
                "a": pa.array(x["set_id"]), "b": none, "shingle": pa.array(x["shingle"].view(np.int64)),
                "n": pa.array(x["n"].astype(np.int32)), "at": pa.array(x["at"].astype(np.int32))
            }
        )

    def solved(place: int, packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        x = np.frombuffer(b"".join(packs), _ENTRY)
        if place >= 1 << bits:
            yield entries_out(x)
            return
        x = x[np.lexsort((x["set_id"], x["shingle"]))]
        group = np.cumsum(np.concatenate([[0], x["shingle"][1:] != x["shingle"][:-1]]))
        marked = np.bincount(group, x["n"] == 0) > 0
        keep = (x["n"] > 0) & np.concatenate(
            [[True], (group[1:] != group[:-1]) | (x["set_id"][1:] != x["set_id"][:-1]) | (x["n"][:-1] == 0)]
        )
        x, group = x[keep], group[keep]
        size = np.bincount(group, minlength=len(marked))
        big = (marked | (size > large))[group]
        if big.any():
            yield entries_out(x[big])
        few = ~big & (size[group] > 1)
        x, group = x[few], group[few]
        n, ids = x["n"].astype(np.int64), x["set_id"]
        for step in range(1, large):
            a = np.flatnonzero(group[step:] == group[:-step])
            if not len(a):
                break
            low, high = np.minimum(n[a], n[a + step]), np.maximum(n[a], n[a + step])
            a = a[low * 100 >= high * ALIKE]
            none, zero = pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "a": pa.array(np.minimum(ids[a], ids[a + step])), "b": pa.array(np.maximum(ids[a], ids[a + step])),
                    "shingle": none, "n": zero, "at": zero
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, packs in _places(batches):
            yield from solved(place, packs)

    return run


class _Members:
    """The sets of a list: size, place and root, entries in large lists, where the prefix ends, and sketch."""

    def __init__(self, x: pa.StructArray) -> None:
        for c in ("set_id", "n", "at", "root", "hot", "last", "block"):
            setattr(self, c, x.field(c).to_numpy(zero_copy_only=False).astype(np.int64))
        self.sketch = x.field("sketch").to_numpy(zero_copy_only=False)

    def sort(self, order: np.ndarray) -> None:
        for c, x in vars(self).items():
            setattr(self, c, x[order])

    def pairs(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """Pairs that are not yet connected and may be alike, if this is the first shingle that they share.

        What they share in small lists is counted elsewhere; here it is nothing.
        """
        n, rest = self.n, (self.n * ALIKE + 99) // 100 - 1
        fits = (self.root[a] != self.root[b]) & _near_enough(n[a], self.at[a], n[b], self.at[b])
        a, b = a[fits], b[fits]
        beyond = np.where(
            self.last[a] < self.last[b], rest[a],
            np.where(self.last[a] > self.last[b], rest[b], np.maximum(rest[a], rest[b]))
        )
        fits = (np.minimum(self.hot[a], self.hot[b]) + beyond) * (100 + ALIKE) >= (n[a] + n[b]) * ALIKE
        a, b = a[fits], b[fits]
        # Sets that are alike differ in few shingles, so in no more cells.
        fits = _differ(self.sketch, a, b) * (100 + ALIKE) <= (n[a] + n[b]) * (100 - ALIKE)
        a, b = self.set_id[a[fits]], self.set_id[b[fits]]
        return pa.RecordBatch.from_pydict(
            {"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())}
        )


def _candidates(turn: int | None, following: int):
    """Pairs within each list of sets: all, or of ``large`` lists with a ``turn`` the next ``following`` in its order; all of two blocks only across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets, large, across in zip(
                batch.column("sets"), batch.column("large").to_pylist(), batch.column("across").to_pylist(), strict=True
            ):
                x = _Members(sets.values)
                if turn is not None and large:
                    x.sort(np.argsort(mix64(x.set_id.view(np.uint64) + np.uint64(turn))))
                    for step in range(1, following + 1):
                        a = np.arange(max(0, len(x.n) - step))
                        yield x.pairs(a, a + step)
                    continue
                x.sort(np.argsort(x.n, kind="stable"))
                end = np.searchsorted(x.n, x.n * 100 // ALIKE, "right")  # behind the last set small enough for each
                count = np.maximum(end - np.arange(len(x.n)) - 1, 0)
                for part in np.split(np.arange(len(x.n)), np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1):
                    a = np.repeat(part, count[part])
                    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
                    if across:
                        apart = x.block[a] != x.block[b]
                        a, b = a[apart], b[apart]
                    yield x.pairs(a, b)

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose texts are alike; rows with equal b stand together, so its shingles are made once."""
    words: dict[bytes, int] = {}
    last, found = None, None
    for batch in batches:
        keep = []
        for b, x, y in zip(batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
            if len(words) > 100_000:
                words.clear()
            if b != last:
                last, found = b, shingles(y.as_py(), words)
            other = shingles(x.as_py(), words)
            both = len(np.intersect1d(other, found, assume_unique=True))
            keep.append(both * 100 >= (len(other) + len(found) - both) * ALIKE)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of set ids that are alike. Texts travel, not their shingles, which take thrice the room."""
    pairs = stored(pairs.distinct(), "copy-pairs")
    wanted = stored(
        pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct().join(sets, "set_id").select("set_id", "th"),
        "copy-wanted"
    )
    one = stored(texts.join(wanted, "th").dropDuplicates(["set_id"]).select("set_id", "text"), "copy-texts")
    both = pairs.join(
        one.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a"
    ).join(one.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
    links = stored(both.sortWithinPartitions("b").mapInArrow(_alike, "a bigint, b bigint"), "copy-links")
    forget(links.sparkSession, one.stored_at)
    return links


def _close(sets: DataFrame) -> DataFrame:
    """a, b: pairs of sets that the SimHash index holds for close: equal fingerprints, and links of near ones."""
    codes = stored(sets.groupBy("fp").agg(F.min("set_id").alias("one")), "copy-codes")
    equal = sets.join(codes, "fp").where("set_id <> one").select(F.col("one").alias("a"), F.col("set_id").alias("b"))
    links = near_links(codes.select("fp"))
    near = links.join(
        codes.select(F.col("fp").alias("a"), F.col("one").alias("one_a")), "a"
    ).join(codes.select(F.col("fp").alias("b"), F.col("one").alias("one_b")), "b")
    pairs = equal.unionByName(near.select(F.col("one_a").alias("a"), F.col("one_b").alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _possible(counted: DataFrame, known: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b, shared) that may be alike by what their prefixes share, and aren't connected.

    ``known``: set_id, n, last, hot and root of each set; at most ``hot`` of what a
    prefix shares stands in large lists, which ``shared`` doesn't count.
    """
    for side in ("a", "b"):
        own = known.select(
            F.col("set_id").alias(side),
            *[F.col(c).alias(f"{c}_{side}") for c in ("n", "last", "hot", "root")]
        )
        counted = counted.join(own, side)
    rest = {x: F.floor((F.col(f"n_{x}") * ALIKE + 99) / 100) - 1 for x in ("a", "b")}
    beyond = F.when(
        F.col("last_a") < F.col("last_b"), rest["a"]
    ).when(F.col("last_a") > F.col("last_b"), rest["b"]).otherwise(F.greatest(rest["a"], rest["b"]))
    most = F.col("shared") + F.least("hot_a", "hot_b") + beyond
    enough = most * (100 + ALIKE) >= (F.col("n_a") + F.col("n_b")) * ALIKE
    return counted.where(enough & (F.col("root_a") != F.col("root_b"))).select("a", "b")


def _lists(members: DataFrame, turn: int | None, block: int) -> DataFrame:
    """sets, large, across: the sets of each shingle, in blocks; without a ``turn``, a row for each pair of blocks."""
    blocks = F.ceil(F.col("sets_n") / block).cast("int")
    own = F.pmod(F.xxhash64("set_id", F.lit(turn or 0)), blocks).cast("int")
    rows = members.withColumn("block", own)
    if turn is None:
        rows = rows.withColumn(
            "other", F.explode(F.sequence(F.lit(0), blocks - 1))
        ).withColumn("across", F.col("block") != F.col("other"))
        keys = ["shingle", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    else:
        rows = rows.withColumn("across", F.lit(False))
        keys = ["shingle", "block"]
    found = rows.groupBy(*keys).agg(
        F.collect_list(F.struct("set_id", "n", "at", "root", "hot", "last", "block", "sketch")).alias("sets"),
        F.first("large").alias("large"), F.first("across").alias("across")
    )
    return found.select("sets", "large", "across").where(F.size("sets") > 1)


def copy_groups(docs: DataFrame, large: int = LARGE, following: int = NEXT, block: int = BLOCK) -> DataFrame:
    """doc_id, th (hash of the text), root for each row of ``docs``: rows of one root are connected by near copies.

    Null and wordless texts have no shingle and are one group. Equal sets of shingles
    count once in the search. Null and repeated doc_ids keep a row each. No documents
    give no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("th"))
    common = common_shingles(texts)
    with scratch(docs.sparkSession) as kept:
        made = stored(texts.mapInArrow(_sets(common), _SET), "copy-sets")
        sets = stored(
            made.groupBy("set_id").agg(F.min("th").alias("th"), *[F.first(c).alias(c) for c in ("fp", "n", "last", "sketch")]),
            "copy-ids"
        )
        links = _verified(_close(sets), sets, texts)
        roots = components(links, "copy-roots").withColumnRenamed("node", "set_id")
        # Entries travel in packs; each place is sorted and its lists are solved in memory.
        bits = max(1, (made.agg(F.sum(F.ceil(F.col("n") / 5) + 1)).first()[0] or 0) // PLACE).bit_length()
        packs = texts.mapInArrow(_packed(common, bits, large), "place bigint, pack binary")
        met = stored(
            packs.repartition("place").sortWithinPartitions("place").mapInArrow(_met(bits, large), _MET), "copy-met"
        )
        entries = stored(
            met.where("shingle IS NOT NULL").select("shingle", F.col("a").alias("set_id"), "at").distinct(),
            "copy-entries"
        )
        hot = stored(
            entries.groupBy("set_id").agg(F.count("*").alias("hot")).join(sets.select("set_id", "sketch"), "set_id"),
            "copy-hot"
        )
        sizes = stored(
            sets.select("set_id", "n", "last").join(hot.select("set_id", "hot"), "set_id", "left").withColumn(
                "hot", F.coalesce("hot", F.lit(0))
            ),
            "copy-sizes"
        )
        known = sizes.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        counted = met.where("shingle IS NULL").groupBy("a", "b").agg(F.count("*").alias("shared"))
        links = links.unionByName(_verified(_possible(counted, known), sets, texts))
        for turn in (*range(ROUNDS), None):
            roots = components(links, "copy-roots").withColumnRenamed("node", "set_id")
            if entries.isEmpty():
                break
            members = entries.join(sizes, "set_id").join(roots, "set_id", "left").withColumn(
                "root", F.coalesce("root", "set_id")
            )
            # Lists of one root are done.
            size = members.groupBy("shingle").agg(
                F.count("*").alias("sets_n"), F.min("root").alias("low"), F.max("root").alias("high")
            )
            left = stored(
                size.where("low <> high").select("shingle", "sets_n", F.expr(f"sets_n > {large}").alias("large")),
                "copy-left"
            )
            if left.isEmpty():
                break
            entries = stored(entries.join(left.select("shingle"), "shingle", "left_semi"), "copy-entries")
            members = members.join(left, "shingle").join(hot.select("set_id", "sketch"), "set_id")
            pairs = _lists(members, turn, block).mapInArrow(
                _candidates(turn, following), "a bigint, b bigint"
            )
            links = links.unionByName(_verified(pairs, sets, texts))
        else:
            roots = components(links, "copy-roots").withColumnRenamed("node", "set_id")
        by_text = made.select("th", "set_id").distinct().join(roots, "set_id", "left").select(
            "th", F.coalesce("root", "set_id").alias("root")
        )
        by_text = stored(by_text, "copy-texts")
        kept.append(by_text)
    return docs.select(
        F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("th")
    ).join(by_text, "th").select("doc_id", "th", "root")
