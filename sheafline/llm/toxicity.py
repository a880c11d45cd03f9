"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Two words are alike as far as they share ordered triples of letters, gaps allowed:
a triple counts less the wider it is spread. Inserted characters and gaps thus
weaken a match but don't end it. Similarities to landmark words, whitened by the
landmarks' own kernel matrix, place every word in a short vector; a sentence is the
sum of its words. The machine is trained on sentences: at first the most telling
one of each toxic document, then, in rounds, the one that the last machine scores
highest and all others that it takes for toxic. Its weights fold back into one table of triples, with which a word is
scored without visiting the landmarks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, grouped, piece_of, table, texts_of
from .linear import logistic, train_logistic, train_svm

#: Labelled documents of each class that the model is fitted on, at most; those with the smallest hash of doc_id.
SAMPLE = 1_500
#: Code points of a clean and of a toxic document that the model is fitted on, at most: a piece of a longer one, at a
#: place set by its hash. A piece of a toxic document may hold nothing toxic, so that of toxic ones is longer.
SAMPLE_CHARS = (6_000, 24_000)
LANDMARKS = 128
DECAY = 0.5
#: Letters from the first to the last of a triple, at most.
SPAN = 6
SYMBOLS = 40
ROUNDS = 3
FOLDS = 3
#: How much a machine may give for the sentences that it gets wrong; folds choose.
COSTS = (0.1, 3.0, 10.0)
THRESHOLD = 0.3
#: A word longer than this is scored in overlapping pieces.
PIECE = 64

_SENTENCES = re.compile(r"[.!?]+\s+|\n+|[.!?]+$")
_SPACED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
_JUNK = re.compile(r"[\W_]+")


def sentences_of(text: str) -> Iterator[list[str]]:
    """The words of each sentence; letters that stand alone in a row are one word."""
    text = _SPACED.sub(lambda m: "".join(m[0].split()), text.lower())
    start = 0
    for m in _SENTENCES.finditer(text):
        if words := text[start : m.start()].split():
            yield words
        start = m.end()
    if words := text[start:].split():
        yield words


def _codes(word: str) -> list[int]:
    """1 and 2: begin and end; 3: a digit, as a letter that isn't known; a to z; ten classes of other letters."""
    out = [1]
    for c in _JUNK.sub("", word):
        n = ord(c)
        out.append(n - 93 if 97 <= n <= 122 else 3 if c.isdigit() else 30 + n % 10)
    out.append(2)
    return out if len(out) > 2 else []


#: Offsets of the second and third letter of a triple.
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) of all triples of all words; the weights of a word have the norm 1."""
    codes = [_codes(w) for w in words]
    lengths = np.array([len(c) for c in codes], np.int64)
    flat = np.array([x for c in codes for x in c], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    who, what, how = [], [], []
    for a, b in _OFFSETS:
        if len(flat) <= b:
            continue
        n = len(flat) - b
        same = owner[:n] == owner[b:]
        who.append(owner[:n][same])
        what.append(((flat[:n] * SYMBOLS + flat[a : a + n]) * SYMBOLS + flat[b:])[same])
        how.append(np.full(len(who[-1]), DECAY ** (b - 2), np.float32))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    who, what, how = np.concatenate(who), np.concatenate(what), np.concatenate(how)
    norm = np.sqrt(np.bincount(who, how * how, minlength=len(words)))
    return who, what, (how / norm[who]).astype(np.float32)


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """The similarity of every word to every other one."""
    table = np.zeros((SYMBOLS**3, len(others)), np.float32)
    who, what, how = triples(others)
    np.add.at(table, (what, who), how)
    out = np.zeros((len(words), len(others)), np.float32)
    for a in range(0, len(words), 500):
        who, what, how = triples(words[a : a + 500])
        order = np.argsort(who, kind="stable")
        who, what, how = who[order], what[order], how[order]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
        if len(first):
            out[a + who[first]] = np.add.reduceat(table[what] * how[:, None], first)
    return out


class ToxicityModel:
    """The table of triples, and the calibration of a document's features.

    How strongly the machine is held back is chosen by folds, and the calibration is
    fitted on what machines say of documents that they were not trained on.
    """

    def __init__(self, texts: list[str], toxic: list[int], landmarks: int = LANDMARKS) -> None:
        y = np.array(toxic, np.int64)
        self.table, self.bias, self.calibration = np.zeros(SYMBOLS**3, np.float32), 0.0, None
        self.prior = float(y.mean()) if len(y) else 0.0
        docs = [list(sentences_of(x)) for x in texts]
        if not (0 < y.sum() < len(y)) or not any(docs):
            return
        words = sorted({w for d in docs for s in d for w in s})
        place = {w: i for i, w in enumerate(words)}
        sentences = [(i, np.array([place[w] for w in s], np.int32)) for i, d in enumerate(docs) for s in d]
        owner = np.array([i for i, _ in sentences])
        del docs
        has = [
            np.unique(np.concatenate([s for _, s in sentences[a:b]])) if a < b else np.zeros(0, np.int32)
            for a, b in zip(
                *(np.searchsorted(owner, np.arange(len(y)), side) for side in ("left", "right")), strict=True
            )
        ]
        chosen = [words[i] for i in self._landmarks(words, has, y, landmarks)]
        # Nyström: whiten by the kernel of the landmarks.
        values, vectors = np.linalg.eigh(kernel(chosen, chosen).astype(np.float64))
        keep = values > 1e-3 * values.max()
        white = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        vectors_of = np.zeros((len(words), white.shape[1]), np.float32)
        for a in range(0, len(words), 20_000):
            vectors_of[a : a + 20_000] = kernel(words[a : a + 20_000], chosen) @ white
        x = np.zeros((len(sentences), white.shape[1]), np.float32)
        for k, (_, s) in enumerate(sentences):
            x[k] = vectors_of[s].sum(axis=0) / np.sqrt(len(s))
        fold = np.zeros(len(y), np.int64)
        for label in (0, 1):  # as many of each label in each fold
            fold[y == label] = np.arange((y == label).sum()) % FOLDS
        best = (np.inf,)
        for cost in COSTS:
            told = np.zeros((len(y), 4))
            for k in range(FOLDS):
                w, bias = self._machine(x, owner, sentences, has, y, fold != k, len(words), cost)
                told[fold == k] = _features(np.flatnonzero(fold == k), owner, x @ w + bias, sentences, vectors_of @ w)
            weights = train_logistic(told, y)
            p = np.clip(logistic(told, weights), 1e-6, 1 - 1e-6)
            loss = -np.log(np.where(y == 1, p, 1 - p)).mean()
            if loss < best[0]:
                best = (loss, cost, weights)
        _, cost, self.calibration = best
        w, self.bias = self._machine(x, owner, sentences, has, y, np.ones(len(y), bool), len(words), cost)
        full = np.zeros((SYMBOLS**3, len(chosen)), np.float32)
        who, what, how = triples(chosen)
        np.add.at(full, (what, who), how)
        self.table = full @ (white @ w)

    @staticmethod
    def _odds(has: list[np.ndarray], y: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How many toxic documents hold each word, and the log odds that one does against a clean document."""
        counts = [
            np.bincount(
                np.concatenate([has[i] for i in np.flatnonzero(rows & (y == k))] or [np.zeros(0, int)]), minlength=n
            )
            for k in (0, 1)
        ]
        size = [int((rows & (y == k)).sum()) for k in (0, 1)]
        return counts[1], np.log((counts[1] + 0.5) / (size[1] + 1)) - np.log((counts[0] + 0.5) / (size[0] + 1))

    def _landmarks(self, words: list[str], has: list[np.ndarray], y: np.ndarray, n: int) -> list[int]:
        """Half of words that tell toxic documents, in two of them at least where there are enough, and half common ones."""
        usable = np.array([bool(_codes(w)) for w in words])
        seen, odds = self._odds(has, y, np.ones(len(y), bool), len(words))
        weight = np.where(usable, odds * np.sqrt(seen) * np.where(seen > 1, 1.0, 0.1), -np.inf)
        telling = [i for i in np.argsort(-weight, kind="stable")[: n // 2].tolist() if weight[i] > 0]
        clean = np.bincount(np.concatenate([h for h, k in zip(has, y, strict=True) if not k]), minlength=len(words))
        clean[telling] = 0
        common = [i for i in np.argsort(-clean, kind="stable").tolist() if clean[i] and usable[i]]
        quarter = max(1, n // 4)
        return telling + common[:quarter] + common[quarter :: max(1, len(common) // quarter)][:quarter]

    def _machine(
        self, x: np.ndarray, owner: np.ndarray, sentences: list, has: list[np.ndarray], y: np.ndarray, rows: np.ndarray,
        n: int, cost: float
    ) -> tuple[np.ndarray, float]:
        """Weights and bias from the documents in ``rows``."""
        seen, odds = self._odds(has, y, rows, n)
        telling = odds * np.sqrt(seen) * (seen > 1)
        use = np.flatnonzero(rows[owner])
        positive, own, z = y[owner[use]] == 1, owner[use], x[use]
        score = np.array([telling[sentences[i][1]].max() if p else 0.0 for i, p in zip(use, positive, strict=True)])
        w, bias = np.zeros(x.shape[1], np.float32), 0.0
        for k in range(ROUNDS):
            order = np.lexsort((-score, own))
            best = np.zeros(len(use), bool)
            best[order[np.concatenate([[True], own[order][1:] != own[order][:-1]])]] = True
            # At first only documents with a telling word speak for themselves; later all that the machine takes for toxic.
            take = ~positive | (positive & (best & (score > 0) if not k else best | (score > 0)))
            if not (take & positive).any():
                take |= positive & best
            w, bias = train_svm(z[take], np.where(positive[take], 1.0, -1.0).astype(np.float32), cost=cost)
            score = z @ w + bias
        return w, bias

    def score_words(self, words: list[str]) -> np.ndarray:
        pieces, owner = [], []
        for i, w in enumerate(words):
            for a in range(0, max(1, len(w) - SPAN), PIECE) if len(w) > PIECE else (0,):
                pieces.append(w[a : a + PIECE + SPAN])
                owner.append(i)
        who, what, how = triples(pieces)
        each = np.bincount(who, self.table[what] * how, minlength=len(pieces))
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, owner, each)
        return out

    def features(self, sentences: Iterator[list[str]], known: dict[str, float]) -> list[float]:
        """The best sentence, the best words, and the length of a document; works on some thousand words at a time."""
        best, n, top, held = -3.0, 0, [0.0, 0.0, 0.0], []
        size = 0

        def settle() -> None:
            nonlocal best, top
            self.learn({w for s in held for w in s}, known)
            for s in held:
                scores = [known[w] for w in s]
                best = max(best, sum(scores) / len(s) ** 0.5 + self.bias)
                if max(scores) > top[2]:
                    top = sorted([*top, *[x for x in scores if x > top[2]]], reverse=True)[:3]

        for s in sentences:
            held.append(s)
            n += len(s)
            size += len(s)
            if size > 50_000:
                settle()
                held, size = [], 0
        settle()
        return [best, top[0], sum(top), np.log1p(n)]

    def learn(self, words: set[str], known: dict[str, float]) -> None:
        """Adds the scores of ``words`` to ``known``, which stays within bounds."""
        if len(known) > 300_000:
            known.clear()
        new = list(words.difference(known))
        for a in range(0, len(new), 10_000):
            known.update(zip(new[a : a + 10_000], self.score_words(new[a : a + 10_000]).tolist(), strict=True))

    def score(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        """``known`` keeps the scores of words between calls."""
        if self.calibration is None:
            return np.full(len(texts), self.prior)
        if sum(map(len, texts)) < 2_000_000:  # one pass over all new words is quicker
            docs = [list(sentences_of(x)) for x in texts]
            self.learn({w for d in docs for s in d for w in s}, known)
        else:
            docs = map(sentences_of, texts)
        return logistic(np.array([self.features(d, known) for d in docs]).reshape(len(texts), 4), self.calibration)


def _features(
    which: np.ndarray, owner: np.ndarray, score: np.ndarray, sentences: list, words: np.ndarray
) -> np.ndarray:
    """The features of documents from the scores of their sentences and of all words."""
    out = np.zeros((len(which), 4))
    first, last = (np.searchsorted(owner, which, side) for side in ("left", "right"))
    for k, (a, b) in enumerate(zip(first, last, strict=True)):
        own = words[np.concatenate([s for _, s in sentences[a:b]])] if a < b else np.zeros(0)
        top = np.sort(np.concatenate([np.maximum(own, 0), np.zeros(3)]))[-3:]
        out[k] = max(-3.0, score[a:b].max(initial=-3.0)), top[2], top.sum(), np.log1p(len(own))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model from the texts of ``docs`` whose doc_id has a label in ``labels`` (doc_id, toxic).

    A doc_id with both labels counts as toxic. Ids are chosen first, so that only the
    sample's texts, at most ``sample`` of each class, reach the driver.
    """
    known = labels.where(
        "doc_id is not null and toxic is not null"
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [
        x
        for k in (0, 1)
        for x in known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    ]
    if not ids:
        return ToxicityModel([], [])
    chosen = docs.sparkSession.createDataFrame([(x.doc_id, x.toxic) for x in ids], "doc_id bigint, toxic int")
    pieces = [piece_of(F.col("text"), n) for n in SAMPLE_CHARS]
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "toxic", F.when(F.col("toxic") == 1, pieces[1]).otherwise(pieces[0]).alias("text"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * sample).collect()
    return ToxicityModel([x.text for x in rows], [x.toxic for x in rows])


def _scored(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            texts = texts_of(batch)
            for a, b in grouped(texts, 1_000_000):
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "score": pa.array(model.score(texts[a:b], known), pa.float64())
                    }
                )

    return run


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score, 0 to 1, of each row of ``docs``.

    Null and empty texts get the score of a text without words. Null and repeated
    doc_ids keep a row each; every sentence of a text of any length is scored; other
    columns are not read. A model fitted on one class only scores its share.
    """
    return docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    ).mapInArrow(_scored(model), "doc_id bigint, score double")


def held_out():
    return F.coalesce(crc32_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
