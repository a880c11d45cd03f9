"""Benchmark decontamination by the q-gram lemma.

If a document holds an item with at most k edits, an alignment keeps at least
m + 1 - q(k + 1) of the item's m + 1 - q character q-grams, and their diagonals
(place in the document less place in the item) lie within k of each other. Shared
q-grams are counted by item in overlapping bands of diagonals; bands that reach the
bound become regions, and a banded alignment of item and region decides. Items of
equal text are one in the search, regions of many items are aligned side by side,
and a place that many items share is searched in windows of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped, mix64, small_batches, table, texts_of

#: Characters of a q-gram; eight codes of one byte fill a word.
Q = 8
#: Edits that an item may have undergone, as a share of its characters.
EDITS = 0.1
#: Characters of benchmark text that are searched for at a time; a larger benchmark takes several passes.
BLOCK_CHARS = 16_000_000
BATCH_CHARS = 2_000_000
#: Shared q-grams, counted once for each item, that are held at a time, about.
FAN_OUT = 2_000_000
#: Cells of alignments that are worked on side by side, about.
CELLS = 4_000_000
_TABLE_BITS = 22

_PLAIN = re.compile(r"[\W_]+")
_OUT = "doc_id bigint, item_id bigint, edits int, n_chars int"


def normal(text: str) -> str:
    """Lower case; every run of other characters than letters and digits is one space."""
    return _PLAIN.sub(" ", text.lower()).strip()


def _bytes(text: str) -> np.ndarray:
    """A byte for each code point, never zero; equal code points have equal bytes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return ((codes ^ (codes >> 7)) % 255 + 1).astype(np.uint8)


def _grams(data: np.ndarray) -> np.ndarray:
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(data, Q).copy().view("<u8").ravel()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def edits_within_each(items: list[str], regions: list[str], limits: np.ndarray) -> np.ndarray:
    """For each pair, the fewest edits between the item and a part of the region; -1 beyond its limit."""
    out = np.full(len(items), -1, np.int64)
    exact = np.array([a in b for a, b in zip(items, regions, strict=True)], bool)
    out[exact] = 0
    rest = np.flatnonzero(~exact)
    rest = rest[np.argsort([len(items[i]) for i in rest], kind="stable")]
    start = 0
    while start < len(rest):
        width = max(len(regions[i]) for i in rest[start : start + 4_096])
        part = rest[start : start + max(1, min(4_096, CELLS // (width + 1)))]
        start += len(part)
        n = np.array([len(items[i]) for i in part])
        length = np.array([len(regions[i]) for i in part])
        a, b = np.zeros((len(part), n.max()), np.uint32), np.zeros((len(part), length.max()), np.uint32)
        for k, i in enumerate(part):
            a[k, : n[k]], b[k, : length[k]] = _codes(items[i]), _codes(regions[i])
        at = np.arange(b.shape[1] + 1, dtype=np.int32)
        beyond = at[None, :] > length[:, None]
        big = np.int32(1 << 28)
        row = np.where(beyond, big, np.int32(0))
        alive = np.arange(len(part))
        for k in range(a.shape[1]):
            new = np.empty_like(row)
            new[:, 0] = k + 1
            np.minimum(row[:, :-1] + (b[alive] != a[alive, k, None]), row[:, 1:] + 1, out=new[:, 1:])
            row = np.minimum.accumulate(new - at, axis=1) + at
            row[beyond[alive]] = big
            least = row.min(axis=1)
            ends = n[alive] == k + 1
            for j in np.flatnonzero(ends & (least <= limits[part[alive]])):
                out[part[alive[j]]] = least[j]
            stay = ~ends & (least <= limits[part[alive]])
            if not stay.all():
                alive, row = alive[stay], row[stay]
                if not len(alive):
                    break
    return out


def edits_within(item: str, region: str, limit: int) -> int | None:
    """Fewest edits between ``item`` and a part of ``region``; None beyond ``limit``."""
    found = int(edits_within_each([item], [region], np.array([limit]))[0])
    return None if found < 0 else found


class ItemIndex:
    """The q-grams of a block of items, and what each item's bands have to reach."""

    def __init__(self, items: list[tuple[int | None, str]], edits: float = EDITS) -> None:
        members: dict[str, list[int | None]] = {}
        for i, t in items:
            if t := normal(t):
                members.setdefault(t, []).append(i)
        self.members = members
        self.short = [t for t in members if len(t) < Q]
        self.texts = [t for t in members if len(t) >= Q]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        # As many edits as the share allows and the lemma can still see.
        self.limits = np.minimum((self.lengths * edits).astype(np.int64), self.lengths // Q - 1)
        self.needs = self.lengths + 1 - Q * (self.limits + 1)
        grams = [_grams(_bytes(t)) for t in self.texts]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[(mix64(self.grams) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        if self.texts:
            # A window of the shortest item's reach holds its share of what any item has to keep.
            spans = self.lengths + self.limits
            self.window = int(spans.min())
            self.dense = int((self.needs / np.ceil(spans / self.window)).min().clip(1))
            self.reach = int(spans.max())

    def search(self, texts: list[str]) -> list[tuple[int, int | None, int, int]]:
        """(text, item_id, edits, length of the item) for every item that a text holds; items without an id are told apart by text."""
        plain = [normal(t) for t in texts]
        best: dict[tuple[int, str], int] = {
            (k, t): 0
            for t in self.short
            for k, p in enumerate(plain)
            if f" {t} " in f" {p} "
        }
        if self.texts:
            # Long texts are searched in pieces that overlap by more than any item reaches.
            step, over = max(BATCH_CHARS, 8 * self.reach), 2 * self.reach + Q
            pieces = [(k, p[a : a + step + over]) for k, p in enumerate(plain) for a in range(0, max(1, len(p)), step)]
            for a, b in grouped([p for _, p in pieces], step):
                for k, item, e in self._near([p for _, p in pieces[a:b]]):
                    key = pieces[a + k][0], self.texts[item]
                    if e < best.get(key, e + 1):
                        best[key] = e
        found: dict[tuple[int, bool, int, str], tuple[int, int]] = {}
        for (k, t), e in best.items():
            for i in self.members[t]:
                key = (k, i is None, i or 0, t if i is None else "")
                if key not in found or e < found[key][0]:
                    found[key] = e, len(t)
        return [(k, None if unnamed else i, e, n) for (k, unnamed, i, _), (e, n) in sorted(found.items())]

    def _near(self, plain: list[str]) -> Iterator[tuple[int, int, int]]:
        gap = self.reach + 1
        lengths = np.array([len(p) for p in plain], np.int64)
        starts = np.cumsum(lengths + gap) - lengths - gap
        data = np.zeros(int((lengths + gap).sum()), np.uint8)
        for s, p in zip(starts, plain, strict=True):
            data[s : s + len(p)] = _bytes(p)
        grams = _grams(data)
        at = np.flatnonzero(self.seen[(mix64(grams) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        which = np.searchsorted(self.grams, grams[at])
        true = (which < len(self.grams)) & (self.grams[np.minimum(which, len(self.grams) - 1)] == grams[at])
        at, which = at[true], which[true]
        # Windows that hold enough hits of any item; what lies beyond reach of all of them can't be part of an item.
        enough = np.searchsorted(at, at + self.window) - np.arange(len(at)) >= self.dense
        centre = at[enough]
        if not len(centre):
            return
        low = np.searchsorted(centre, at - self.reach)
        near = (low < len(centre)) & (centre[np.minimum(low, len(centre) - 1)] <= at + self.reach)
        at, which = at[near], which[near]
        # Windows of neighbouring hits; each begins as far before the end of the last as an item reaches.
        fan = np.cumsum(self.first[which + 1] - self.first[which])
        first = 0
        while first < len(at):
            before = fan[first - 1] if first else 0
            last = max(
                int(np.searchsorted(fan, before + FAN_OUT, "right")),
                int(np.searchsorted(at, at[first] + 4 * self.reach, "right"))
            )
            yield from self._bands(plain, starts, lengths, at[first:last], which[first:last])
            if last >= len(at):
                break
            first = int(np.searchsorted(at, at[last] - 2 * self.reach))

    def _bands(
        self, plain: list[str], starts: np.ndarray, lengths: np.ndarray, at: np.ndarray, which: np.ndarray
    ) -> Iterator[tuple[int, int, int]]:
        n = self.first[which + 1] - self.first[which]
        every = np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, diagonal = self.owner[every], np.repeat(at, n) - self.place[every]
        width = self.limits[item] + 1
        band = (diagonal + self.reach) // width  # a spread of k lies in two neighbouring bands
        wide = int(band.max(initial=0)) + 2
        flat, counts = np.unique(item * wide + band, return_counts=True)
        keys = np.stack([flat // wide, flat % wide])
        after = np.zeros(len(counts), np.int64)
        follows = flat[1:] == flat[:-1] + 1
        after[:-1][follows] = counts[1:][follows]
        before = np.zeros(len(counts), np.int64)
        before[1:][follows] = counts[:-1][follows]
        full = np.maximum(counts + after, counts + before) >= self.needs[keys[0]]
        places: list[tuple[int, int, int, int]] = []
        for it, b in keys[:, full].T.tolist():
            k, m = int(self.limits[it]), int(self.lengths[it])
            w = k + 1
            for first in (b - 1, b):  # the two pairs that this band belongs to
                low, high = first * w - self.reach - k, (first + 2) * w - self.reach + m + k
                doc = int(np.searchsorted(starts, max(0, (low + high) // 2), "right")) - 1
                a, z = max(0, low - int(starts[doc])), min(int(lengths[doc]), high - int(starts[doc]))
                if a < z:
                    places.append((doc, it, a, z))
        places = list(dict.fromkeys(places))
        for i in range(0, len(places), 20_000):
            part = places[i : i + 20_000]
            edits = edits_within_each(
                [self.texts[it] for _, it, _, _ in part], [plain[doc][a:z] for doc, _, a, z in part],
                self.limits[[it for _, it, _, _ in part]]
            )
            yield from ((doc, it, e) for (doc, it, _, _), e in zip(part, edits.tolist(), strict=True) if e >= 0)


def _found(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
            for a, b in grouped(texts, BATCH_CHARS):
                hits = index.search(texts[a:b])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([ids[a + k] for k, *_ in hits], pa.int64()),
                        "item_id": pa.array([i for _, i, _, _ in hits], pa.int64()),
                        "edits": pa.array([e for *_, e, _ in hits], pa.int32()),
                        "n_chars": pa.array([n for *_, n in hits], pa.int32())
                    }
                )

    return run


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, edits: float = EDITS) -> Iterator[ItemIndex]:
    """Indexes of all items, each of about ``block_chars`` characters; null texts are left out, null item_ids are not."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield ItemIndex([(x.item_id, x.text) for x in part.collect()], edits)


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, item_id, edits, n_chars: a row for each document and benchmark item that it holds.

    Compared are lower-case letters and digits with single spaces between. An item of
    m characters may have undergone ``edits`` * m edits, and one so short that the
    lemma says nothing fewer; an item below 8 characters has to stand as whole words.
    Items without a letter or digit match nothing.
    Items with a null item_id are searched like others, each text as an item. Null texts hold nothing. Null and
    repeated doc_ids are searched row by row. No items, or no documents, give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = None
    for index in blocks_of(benchmark, block_chars, edits):
        part = rows.mapInArrow(_found(index), _OUT)
        found = part if found is None else found.unionByName(part)
    return rows.sparkSession.createDataFrame([], _OUT) if found is None else found


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; see ``benchmark_leaks``.

    Null and empty texts hold no item and stay; repeated
    rows and null ids are judged one by one; all columns are kept; without items, all
    documents stay.
    """
    small_batches(spark)
    for index in blocks_of(table(spark, sf_dir, "benchmark")):

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = texts_of(batch)
                leaks = {a + k for a, b in grouped(texts, BATCH_CHARS) for k, *_ in index.search(texts[a:b])}
                yield batch.filter(pa.array([i not in leaks for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
