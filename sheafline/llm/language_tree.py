"""Language identification in two steps: the family first, then the language within it.

Both steps are linear support vector machines on hashed letter bigrams and
trigrams: one against the rest between families, one against one between the
languages of a family.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, grouped, mix64, piece_of, small_batches, table, texts_of
from .linear import logistic, train_logistic, train_svm

#: Documents that the model is fitted on, at most; every language has the same share, of its smallest hashes of doc_id.
SAMPLE = 3_000
#: Code points of a document that the model is fitted on, at most: a piece of a longer one, at a place set by its hash.
SAMPLE_CHARS = 20_000
#: Code points that are counted at a time.
STEP = 400_000
BIGRAMS, TRIGRAMS = 1_024, 3_072
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "ur", "bn", "pa", "gu", "mr", "ne"),
    "dravidian": ("ta", "te", "kn", "ml"),
}

#: Letters are the characters of Unicode's category L; numerals and marks are none.
_NOT_LETTERS = regex.compile(r"\P{L}+")


def letters_of(text: str) -> str:
    """Lower-case words with one space before, between and behind them; empty without letters."""
    plain = _NOT_LETTERS.sub(" ", text).strip().lower()
    return f" {plain} " if plain else ""


def _steps(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """(text, piece, grams that start in it) of some thousand code points together; pieces overlap by two."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text), STEP):
            piece = text[a : a + STEP + 2]
            held.append((i, piece, STEP))
            size += len(piece)
            if size >= STEP:
                yield held
                held, size = [], 0
    if held:
        yield held


def features(texts: list[str]) -> np.ndarray:
    """A row of unit length for each text: square roots of hashed bigram and trigram counts."""
    out = np.zeros((len(texts), BIGRAMS + TRIGRAMS), np.float32)
    for held in _steps([letters_of(x) for x in texts]):
        lengths = np.array([len(x) for _, x, _ in held], np.int64)
        codes = np.frombuffer(
            "".join(x for _, x, _ in held).encode("utf-32-le", "surrogatepass"), "<u4"
        ).astype(np.uint64)
        piece = np.repeat(np.arange(len(held)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        owner = np.array([i for i, _, _ in held])
        first = int(owner[0])
        for n, size, column in ((2, BIGRAMS, 0), (3, TRIGRAMS, BIGRAMS)):
            if len(codes) < n:
                continue
            key = np.zeros(len(codes) - n + 1, np.uint64)
            for i in range(n):
                key = (key << np.uint64(21)) | codes[i : len(codes) - n + 1 + i]
            same = (piece[: len(key)] == piece[n - 1 :]) & (place[: len(key)] < STEP)
            at = (owner[piece[: len(key)][same]] - first) * size + (mix64(key[same]) % np.uint64(size)).astype(np.int64)
            rows = int(owner[-1]) - first + 1
            out[
                first : first + rows, column : column + size
            ] += np.bincount(at, minlength=rows * size).reshape(rows, size)
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


class LanguageTree:
    """The fitted model. ``predict`` returns the language and a score for each row of features."""

    def __init__(self, texts: list[str], langs: list[str]) -> None:
        snippets = [(y, z) for x, y in zip(texts, langs, strict=True) for z in (x, x[: 20 + len(x) % 60])]
        y = np.array([s[0] for s in snippets])
        x = features([s[1] for s in snippets])
        known = {code: name for name, codes in FAMILIES.items() for code in codes}
        self.langs = sorted(set(langs))
        family = {c: known.get(c, f"only {c}") for c in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[c for c in self.langs if family[c] == f] for f in self.families]
        own = np.array([self.families.index(family[c]) for c in y]) if len(y) else np.zeros(0, int)
        width = BIGRAMS + TRIGRAMS
        models: list[tuple[np.ndarray | None, np.ndarray]] = []  # rows, None for all, and signs
        self.pairs: list[tuple[int, str, str]] = []
        if len(self.families) > 1:
            for k in range(len(self.families)):
                models.append((None, np.where(own == k, 1, -1)))
        for k, codes in enumerate(self.members):
            for a, b in combinations(codes, 2):
                rows = (y == a) | (y == b)
                models.append((np.flatnonzero(rows), np.where(y[rows] == a, 1, -1)))
                self.pairs.append((k, a, b))
        self.weights, self.bias, self.scale = np.zeros(
            (width, len(models)), np.float32
        ), np.zeros(len(models), np.float32), np.zeros((len(models), 2))
        for i, (rows, sign) in enumerate(models):
            part = x if rows is None else x[rows]
            w, self.bias[i] = train_svm(part, sign.astype(np.float32))
            self.weights[:, i] = w
            self.scale[i] = train_logistic((part @ w + self.bias[i])[:, None], sign > 0)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.weights + self.bias
        p = 1 / (1 + np.exp(-np.clip(margins * self.scale[:, 0] + self.scale[:, 1], -30, 30)))
        n, first = len(x), len(self.families) if len(self.families) > 1 else 0
        family = p[:, :first].argmax(axis=1) if first else np.zeros(n, int)
        score = p[np.arange(n), family] if first else np.ones(n)
        out = np.array([self.members[f][0] for f in range(len(self.families))], object)[family]
        for k, codes in enumerate(self.members):
            rows = np.flatnonzero(family == k)
            if len(codes) == 1 or not len(rows):
                continue
            votes, sure = np.zeros((len(rows), len(codes))), np.ones((len(rows), len(codes)))
            for i, (f, a, b) in enumerate(self.pairs):
                if f == k:
                    pa_, ia, ib = p[rows, first + i], codes.index(a), codes.index(b)
                    votes[:, ia] += (pa_ >= 0.5) + 1e-3 * pa_
                    votes[:, ib] += (pa_ < 0.5) + 1e-3 * (1 - pa_)
                    sure[:, ia], sure[:, ib] = np.minimum(sure[:, ia], pa_), np.minimum(sure[:, ib], 1 - pa_)
            best = votes.argmax(axis=1)
            out[rows] = np.array(codes, object)[best]
            score[rows] *= sure[np.arange(len(rows)), best]
        return list(out), np.clip(score, 0, 1)


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageTree | None:
    """A model from ``docs`` (doc_id, text, lang) with a known lang; None if there are none.

    Ids are chosen first, so that only the sample's texts reach the driver. A language
    with few documents gives all of them, however many others there are.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counts = {x.lang: x.n for x in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = max(1, sample // len(counts))
    # Somewhat more than the share by hash, of which the smallest are kept.
    bound = docs.sparkSession.createDataFrame(
        [(c, min(1.0, (share + 6 * share**0.5 + 20) / n)) for c, n in counts.items()], "lang string, below double"
    )
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    near = usable.select("doc_id", "lang", place.alias("at")).join(F.broadcast(bound), "lang").where(
        F.col("at") < F.col("below") * float(1 << 53)
    ).select("lang", "at", "doc_id").collect()
    kept: dict[str, list[int]] = {}
    for x in sorted(near, key=lambda x: (x.lang, x.at, x.doc_id)):
        if len(own := kept.setdefault(x.lang, [])) < share:
            own.append(x.doc_id)
    chosen = docs.sparkSession.createDataFrame(
        [(c, i) for c, ids in kept.items() for i in dict.fromkeys(ids)], "lang string, doc_id bigint"
    )
    rows = usable.select("doc_id", piece_of(F.col("text"), SAMPLE_CHARS).alias("text"), "lang").join(F.broadcast(chosen), ["lang", "doc_id"]).orderBy(
        F.xxhash64("doc_id"), "doc_id", F.xxhash64("text", "lang"), "text", "lang"
    ).limit(2 * sample).collect()
    return LanguageTree([x.text for x in rows], [x.lang for x in rows])


def _predicted(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in grouped(texts, 2_000_000):
                for i in range(a, b, 256):
                    part = texts[i : min(b, i + 256)]
                    x = features(part)
                    none = ~x.any(axis=1)
                    lang, score = tree.predict(x) if tree else ([UNKNOWN] * len(part), np.zeros(len(part)))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": batch.column("doc_id").slice(i, len(part)),
                            "lang_pred": [UNKNOWN if n else y for y, n in zip(lang, none, strict=True)],
                            "score": pa.array(np.where(none, 0.0, score))
                        }
                    )

    return run


def identify(docs: DataFrame, model: LanguageTree | None) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs``.

    Texts that are null, empty or without a letter are ``und`` with score 0, and so
    is every text without a model. One-letter texts are compared by their bigrams.
    Null and repeated doc_ids keep a row each; other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _predicted(model), "doc_id bigint, lang_pred string, score double"
    )


def held_out():
    return F.coalesce(crc32_of_id(F.col("doc_id")) % 5 == 0, F.lit(False))


def op4_language_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which a language is found: texts that are null, or without a letter, go.

    Without a known lang to learn from, every text with a letter stays. Repeated rows
    and null ids are judged one by one; all columns are kept; no documents give no rows.
    """
    small_batches(spark)
    tree = fit(docs.where(~held_out()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            keep: list[bool] = []
            for i in range(0, len(texts), 256):
                x = features(texts[i : i + 256])
                lang = tree.predict(x)[0] if tree else [""] * len(x)
                keep.extend(bool(found) and y != UNKNOWN for y, found in zip(lang, x.any(axis=1), strict=True))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
