"""Byte-level BPE encoding by tree concatenation, and decoding.

Long text is halved down to leaves, without regard to where a token may end. Leaves
are encoded side by side, on several tasks, and neighbours are joined by encoding a
window around their join again, which grows until it begins and ends with tokens
that the two sides already have. Every pair of neighbouring tokens then stood in one
exact encoding, so the joined ids are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped, table, texts_of

#: Longest text, in code points, that is a leaf.
LEAF_CHARS = 8_192
#: Tokens on each side of a join in the first window.
WINDOW = 8
#: Tokens of each side that a window has to repeat.
AGREE = 2
#: Code points that are encoded in one call.
BATCH_CHARS = 1_000_000
#: Code points of long texts for each task that encodes leaves, about.
TASK_CHARS = 16_000_000

#: Pre-tokens that a task remembers, about.
KNOWN = 600_000
#: Fixed value: the split pattern of byte-level tokenizers.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Space, printable ASCII, Latin letters and common punctuation: letters, numbers and spaces in every edition of Unicode alike.
_SURE = regex.compile(
    "[\t\n\r\x20-\x7e\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u017f\u2010-\u2027\u2030-\u205e]*"
)

_OUT = "doc_id bigint, n_tokens bigint, ids binary, decoded string"
_DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class TreeBPE:
    """Encodes and decodes like the library's tokenizer of the same file."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS) -> None:
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        before = config["pre_tokenizer"]
        if before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True) or config["normalizer"]:
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        special = {x["content"]: x["id"] for x in config["added_tokens"]}
        if any(x[k] for x in config["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options are not supported")
        config["truncation"] = config["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(config))
        self.leaf_chars = max(1, leaf_chars)
        self.special, self.joins, self.known = special, 0, {}
        self.split = regex.compile(_SPLIT).findall
        self.find_special = regex.compile(
            "("
            + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")"
        ) if special else None
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = [""] * 256
        for i, b in enumerate([*plain, *(b for b in range(256) if b not in set(plain))]):
            self.alphabet[b] = chr(b) if i < len(plain) else chr(256 + i - len(plain))
        self.ascii = dict(enumerate(self.alphabet[:128]))
        byte = {c: b for b, c in enumerate(self.alphabet)}
        self.bytes = [b""] * (max([*config["model"]["vocab"].values(), *special.values()]) + 1)
        for token, i in config["model"]["vocab"].items():
            self.bytes[i] = bytes(byte[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _halves(self, text: str) -> Iterator[str]:
        if len(text) <= self.leaf_chars:
            yield text
        else:
            half = len(text) // 2
            yield from self._halves(text[:half])
            yield from self._halves(text[half:])

    def cut(self, text: str) -> Iterator[tuple[bool, str]]:
        """The leaves of ``text`` in order; true where one isn't to be joined to that before it: special strings stand alone."""
        for part in self.find_special.split(text) if self.find_special else [text]:
            for k, leaf in enumerate([part] if part in self.special else self._halves(part) if part else ()):
                yield not k, leaf

    def _word(self, word: str) -> bytes:
        """The ids of a pre-token; the model reads bytes as characters of its alphabet."""
        text = word.translate(self.ascii) if word.isascii() else "".join([self.alphabet[x] for x in word.encode()])
        return np.array([x.id for x in self.tokenizer.model.tokenize(text)], "<u4").tobytes()

    def encode_leaves(self, leaves: list[str]) -> list[bytes]:
        """The ids of each leaf by itself, as little-endian unsigned 32-bit integers.

        Each distinct pre-token is encoded once, where all characters are such that no
        reading of the split pattern differs; other leaves go to the library whole.
        """
        words = [
            self.split(x) if _SURE.fullmatch(x) and not (self.find_special and self.find_special.search(x)) else None
            for x in leaves
        ]
        if len(self.known) > KNOWN:
            self.known.clear()
        for w in set(chain.from_iterable(w for w in words if w)).difference(self.known):
            self.known[w] = self._word(w)
        rest = iter(self._encode([x for x, w in zip(leaves, words, strict=True) if w is None]))
        return [
            np.array(next(rest), "<u4").tobytes() if w is None else b"".join(map(self.known.__getitem__, w))
            for w in words
        ]

    def concatenate(self, leaves: list[tuple[bool, bytes]]) -> bytes:
        """The ids of a text from those of its leaves, joined by pairs, then by pairs of pairs."""
        runs: list[list[list[int]]] = []
        if len(leaves) == 1:
            return leaves[0][1]
        for first, raw in leaves:
            if first:
                runs.append([])
            runs[-1].append(np.frombuffer(raw, "<u4").tolist())
        out: list[int] = []
        for run in runs:
            while len(run) > 1:
                run = [self.join(*run[i : i + 2]) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
            out += run[0]
        return np.array(out, "<u4").tobytes()

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring texts, from the ids of each."""
        self.joins += 1
        starts_char = lambda i: self.bytes[i][0] & 0xC0 != 0x80
        size = WINDOW
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            while i > 0 and not starts_char(left[i]):
                i -= 1
            while j < len(right) and not starts_char(right[j]):
                j += 1
            window = self._encode([b"".join([self.bytes[x] for x in (*left[i:], *right[:j])]).decode()])[0]
            a, b = min(AGREE, len(left) - i), min(AGREE, j)
            if (i == 0 or window[:a] == left[i : i + a]) and (j == len(right) or window[-b:] == right[j - b : j]):
                return left[:i] + window + right[j:]
            size *= 2

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        plans = [list(self.cut(x)) if len(x) > self.leaf_chars else [(True, x)] for x in texts]
        ids = iter(self.encode_leaves([leaf for plan in plans for _, leaf in plan]))
        return [self.concatenate([(first, next(ids)) for first, _ in plan]) for plan in plans]

    def decode(self, raw: bytes) -> str:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(raw, "<u4").tolist()]).decode("utf-8", "replace")


def _coder(path: str, leaf_chars: int) -> TreeBPE:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TreeBPE(path, leaf_chars)


def _row(coder: TreeBPE, raw: list[bytes], digest: bool) -> dict:
    from hashlib import sha256

    back = [coder.decode(x) for x in raw]
    out = {"n_tokens": pa.array([len(x) // 4 for x in raw], pa.int64())}
    if digest:
        return out | {
            "ids_sha256": [sha256(x).hexdigest() for x in raw],
            "decoded_sha256": [sha256(x.encode()).hexdigest() for x in back]
        }
    return out | {"ids": pa.array(raw, pa.binary()), "decoded": back}


def _short(path: str, leaf_chars: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, leaf_chars)
        for batch in batches:
            texts, doc_ids = texts_of(batch), batch.column("doc_id")
            for a, b in grouped(texts, BATCH_CHARS):
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": doc_ids.slice(a, b - a)} | _row(coder, coder.encode_batch(texts[a:b]), digest)
                )

    return run


def _cut(path: str, leaf_chars: int):
    """The leaves of each row, with their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, leaf_chars)
        for batch in batches:
            for row, doc_id, text in zip(
                batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True
            ):
                leaves = list(coder.cut(text.as_py()))
                for a in range(0, len(leaves), 256):
                    part = leaves[a : a + 256]
                    n = len(part)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row": pa.array([row] * n, pa.int64()), "doc_id": pa.array([doc_id] * n, pa.int64()),
                            "place": pa.array(range(a, a + n), pa.int32()), "first": [x for x, _ in part],
                            "leaf": [x for _, x in part]
                        }
                    )

    return run


def _leaf_ids(path: str, leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, leaf_chars)
        for batch in batches:
            leaves = batch.column("leaf").to_pylist()
            for a, b in grouped(leaves, BATCH_CHARS):
                ids = coder.encode_leaves(leaves[a:b])
                yield pa.RecordBatch.from_pydict(
                    {c: batch.column(c).slice(a, b - a) for c in ("row", "doc_id", "place", "first")}
                    | {"ids": pa.array(ids, pa.binary())}
                )

    return run


def _concatenated(path: str, leaf_chars: int, digest: bool):
    """A row from the leaves of each, which stand together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, leaf_chars)
        now, doc_id, leaves = None, None, []

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"doc_id": pa.array([doc_id], pa.int64())} | _row(coder, [coder.concatenate(leaves)], digest)
            )

        for batch in batches:
            for row, of, first, ids in zip(
                *(batch.column(c).to_pylist() for c in ("row", "doc_id", "first", "ids")), strict=True
            ):
                if row != now and leaves:
                    yield whole()
                    leaves = []
                now, doc_id = row, of
                leaves.append((first, ids))
        if leaves:
            yield whole()

    return run


def bpe_round_trip(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS, digest: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text.

    With ``digest``, SHA-256 digests stand for the ids and the text. Null texts are
    empty: no ids, an empty text. Null and repeated doc_ids, and rows repeated as a
    whole, keep a row each; no documents give no rows; other columns are not read.

    Texts of one leaf are not shuffled. The leaves of longer ones are dealt over all
    tasks, and their ids brought together once. Rows are told apart by their place in
    the scan, so ``docs`` must give the same rows when it is read again, as files do.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    schema = _DIGEST if digest else _OUT
    out = rows.where(F.length("text") <= leaf_chars).mapInArrow(_short(path, leaf_chars, digest), schema)
    long = rows.where(F.length("text") > leaf_chars)
    chars = long.agg(F.sum(F.length("text").cast("bigint"))).first()[0]
    if not chars:
        return out
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))
    leaves = long.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _cut(path, leaf_chars), "row bigint, doc_id bigint, place int, first boolean, leaf string"
    )
    ids = leaves.repartition(n, "row", "place").mapInArrow(
        _leaf_ids(path, leaf_chars), "row bigint, doc_id bigint, place int, first boolean, ids binary"
    )
    return out.unionByName(
        ids.repartition(n, "row").sortWithinPartitions("row", "place").mapInArrow(
            _concatenated(path, leaf_chars, digest), schema
        )
    )


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)
