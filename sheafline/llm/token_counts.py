"""Token counts from distinct pre-tokens.

The text of a block of documents is split into pre-tokens once. Only the block's
distinct pre-tokens leave the task; each distinct pre-token of the corpus is cut
into pieces once, and the piece counts return to the block, where they are summed
over the documents' pre-token frequencies. Token ids are never made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, texts_of

#: Characters of text in a block. A task holds the block's distinct pre-tokens and frequencies in memory, not its text.
BLOCK_CHARS = 32_000_000
LIMIT = 2048
#: Characters of a text from which on pre-tokens are counted as they are found.
STEP = 1_000_000

_BLOCK = "block bigint, doc_id array<bigint>, n_bytes array<bigint>, fixed array<bigint>, ends array<bigint>, ids binary, freqs binary, words array<string>"


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x, "<i4").tobytes(), 3)


def _unpacked(x: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(x), "<i4")


class PreTokenizer:
    """Splits text as the tokenizer file's normalizer and split pattern do.

    ``special`` strings are found first, as the library does by default, and each
    counts as one token; what lies between them is split on its own.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        special = [x["content"] for x in config["added_tokens"]]
        if any(x[k] for x in config["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options are not supported")
        if not config["normalizer"] or config["pre_tokenizer"]["type"] != "Sequence" or config["pre_tokenizer"]["pretokenizers"][0]["type"] != "Split":
            raise ValueError("a tokenizer with a normalizer and a split pattern is needed")
        split = config["pre_tokenizer"]["pretokenizers"][0]
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("the split pattern must name what is kept")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile(
            "|".join(map(regex.escape, sorted(special, key=len, reverse=True)))
        ) if special else None
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str

    def __call__(self, text: str) -> tuple[int, Counter]:
        """Number of special strings, and the frequencies of pre-tokens; a long text's are never all held at once."""
        parts = self.special.split(text) if self.special else [text]
        found: Counter = Counter()
        for part in parts:
            plain = self._plain(part)
            found.update(
                self.pattern.findall(plain) if len(plain) < STEP else (m[0] for m in self.pattern.finditer(plain))
            )
        return len(parts) - 1, found

    def _plain(self, text: str) -> str:
        return text.lower() if text.isascii() else self.normalize(text)


class Block:
    """Frequencies of the pre-tokens of some documents, by place in the block's vocabulary."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.doc_ids, self.sizes, self.fixed, self.ends = [], [], [], []
        self.ids, self.freqs, self.chars, self.n = [], [], 0, 0

    def add(self, doc_id, text: str, special: int, counts: Counter) -> None:
        index = self.index
        ids = np.array([index.setdefault(w, len(index)) for w in counts], np.int32)
        order = np.argsort(ids)  # words that are new to the block then follow each other
        self.ids.append(ids[order])
        self.freqs.append(np.fromiter(counts.values(), np.int32, len(counts))[order])
        self.n += len(counts)
        self.ends.append(self.n)
        self.doc_ids.append(doc_id)
        self.fixed.append(special)
        self.sizes.append(len(text) if text.isascii() else len(text.encode()))
        self.chars += len(text) + 1

    def row(self) -> pa.RecordBatch:
        import secrets

        many = lambda x, kind=None: pa.array([x], pa.list_(kind or pa.int64()))
        # The name only has to differ between blocks; a repeated task writes its blocks anew.
        return pa.RecordBatch.from_pydict({
            "block": pa.array(
                [secrets.randbits(63)], pa.int64()
            ), "doc_id": many(self.doc_ids), "n_bytes": many(self.sizes), "fixed": many(self.fixed), "ends": many(self.ends),
            "ids": [
                _packed(np.diff(np.concatenate(self.ids), prepend=np.int32(0)))
            ], "freqs": [_packed(np.concatenate(self.freqs))], "words": many(list(self.index), pa.string()),
        })


def _blocks(path: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = PreTokenizer(path)
        block = Block()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                block.add(doc_id, text, *split(text))
                if block.chars >= block_chars:
                    yield block.row()
                    block = Block()
        if block.doc_ids:
            yield block.row()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        # A pre-token is normal already, and a special string inside one was split off before.
        config["normalizer"], config["added_tokens"] = None, []
        config["post_processor"] = config["truncation"] = config["padding"] = None
        tokenizer = Tokenizer.from_str(json.dumps(config))
        known: dict[str, int] = {}
        for batch in batches:
            for a in range(0, len(batch), 20_000):
                part = batch.slice(a, 20_000)
                words = part.column("word").to_pylist()
                # Equal words stand together, so that the last word is the only one that may come again.
                new = [w for w in dict.fromkeys(words) if w not in known]
                known |= zip(new, map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": part.column("block"), "at": part.column("at"),
                        "pieces": pa.array([known[w] for w in words], pa.int32())
                    }
                )
                known = {words[-1]: known[words[-1]]}

    return run


def _sums(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pieces = np.zeros(max(row["at"], default=-1) + 1, np.int64)
                pieces[row["at"]] = row["pieces"]
                ids, freqs = np.cumsum(_unpacked(row["ids"]), dtype=np.int64), _unpacked(row["freqs"])
                sums = np.concatenate([[0], np.cumsum(pieces[ids] * freqs)]) if len(ids) else np.zeros(1, np.int64)
                ends = np.array(row["ends"], np.int64)
                n = sums[ends] - sums[np.concatenate([[0], ends[:-1]])] + np.array(row["fixed"], np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_id"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()), "over_limit": n > limit
                    }
                )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A null text is empty and has 0 tokens; null and repeated doc_ids keep a row
    each; a text of any length is one row of its block; no documents give no
    rows; other columns of ``docs`` are not read.

    A pre-token stands once in each block that has it, and equal ones are brought
    together once; no key has more rows than there are blocks.
    """
    blocks = stored(
        docs.select(
            F.col("doc_id").cast("bigint"), F.col("text").cast("string")
        ).mapInArrow(_blocks(path, block_chars), _BLOCK),
        "blocks"
    )
    words = blocks.select("block", F.posexplode("words").alias("at", "word"))
    pieces = words.repartition("word").sortWithinPartitions("word").mapInArrow(
        _pieces(path), "block bigint, at int, pieces int"
    )
    back = pieces.groupBy("block").agg(F.collect_list(F.struct("at", "pieces")).alias("got"))
    rows = blocks.drop("words").join(back, "block", "left")
    rows = rows.select(
        "doc_id", "n_bytes", "fixed", "ends", "ids", "freqs",
        *(F.coalesce(F.col(f"got.{x}"), F.array().cast("array<int>")).alias(x) for x in ("at", "pieces"))
    )
    return rows.mapInArrow(_sums(limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
