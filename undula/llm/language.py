"""Language identification by error-correcting output codes.

Each language has a codeword of bits; a logistic classifier on hashed byte n-grams predicts each bit.
A text gets the language whose codeword has the least loss, each bit weighted by how well it did on
that language in training; a small gap between the best two flags the text as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import Kept, crc_mod, hash_share, named, slices, text_array, text_bytes
from undula.llm.shingles import LOWER

#: Hashed n-gram bins, and the orders of the n-grams.
BINS, ORDERS = 4096, (2, 3)
#: The sample to fit on has about this many texts of each language, none over SAMPLE_CHARS long.
SAMPLE_TEXTS, SAMPLE_CHARS = 500, 20_000
#: Languages that are learned, at most.
MOST_LANGS = 200
#: The best two languages are ambiguous if the better one's share of the two is below this.
SURE = 0.6
_GROUP = 512
_CLASS = LOWER.copy()  # what is no letter in ASCII counts as a blank
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def code_matrix(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1 and -1: all ways to split up to 7 languages, the best of random codes for more."""
    if k <= 7:
        columns = [[1] + [1 if (c >> i) & 1 else -1 for i in range(k - 1)] for c in range(2 ** (k - 1) - 1)] if k > 1 else [[1]]
        return np.array(columns, np.float64).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, math.ceil(10 * math.log2(k))))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Root n-gram frequencies of unit length, a group of texts at a time."""
    data, at = text_bytes(texts)
    data = _CLASS[data].astype(np.uint32)
    for first in range(0, len(texts), _GROUP):
        last = min(len(texts), first + _GROUP)
        own = data[at[first] : at[last]]
        counts = np.zeros((last - first) * BINS)
        row = np.repeat(np.arange(last - first), np.diff(at[first : last + 1]))
        for n in ORDERS:
            if len(own) < n:
                continue
            code = np.zeros(len(own) - n + 1, np.uint32)
            for k in range(n):
                code = code * np.uint32(0x01000193) + own[k : len(own) - n + 1 + k]
            code = (code * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(20)
            whole = row[: len(code)] == row[n - 1 :]
            counts += np.bincount(row[: len(code)][whole] * BINS + (code[whole] % BINS), minlength=len(counts))
        root = np.sqrt(counts.reshape(last - first, BINS))
        yield (root / np.maximum(np.linalg.norm(root, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Classifier:
    """Bit classifiers, codewords and weights."""

    def __init__(self, texts: list[str], langs: list[str], rounds: int = 120):
        self.langs = sorted(set(langs))
        y = np.searchsorted(self.langs, langs)
        self.code = code_matrix(len(self.langs)) if self.langs else np.zeros((0, 0))
        self.weights, self.bias = np.zeros((BINS, self.code.shape[1]), np.float32), np.zeros(self.code.shape[1], np.float32)
        self.trust = np.ones_like(self.code)
        if len(self.langs) < 2:
            return
        x = np.concatenate(list(features(text_array(pa.array(texts, pa.large_string())))))
        bits = self.code[y].astype(np.float32)
        share = (1.0 / np.bincount(y)[y] / len(self.langs)).astype(np.float32)[:, None]  # languages count alike
        speed = np.zeros_like(self.weights)
        for _ in range(rounds):
            pull = share * bits / (1 + np.exp(np.clip(bits * (x @ self.weights + self.bias), -30, 30)))
            speed = 0.9 * speed + 20.0 * (x.T @ pull - 1e-5 * self.weights)
            self.weights += speed
            self.bias += 5.0 * pull.sum(0)
        right = (x @ self.weights + self.bias) * bits > 0
        self.trust = np.stack([right[y == k].mean(0) for k in range(len(self.langs))]) + 1e-3
        self.trust /= self.trust.sum(1, keepdims=True)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of languages, scores and whether the best two are close."""
        if not self.langs:
            return np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
        best, score, close = [], [], []
        for x in features(texts):
            margin = np.clip(x @ self.weights + self.bias, -8, 8).astype(np.float64)
            loss = (np.log1p(np.exp(-self.code[None] * margin[:, None])) * self.trust[None]).sum(2)
            likely = np.exp(-self.code.shape[1] * (loss - loss.min(1, keepdims=True)))
            likely /= likely.sum(1, keepdims=True)
            top = np.sort(likely, 1)
            best.append(likely.argmax(1))
            score.append(top[:, -1])
            close.append(top[:, -1] < SURE * (top[:, -1] + top[:, -2]) if len(self.langs) > 1 else np.zeros(len(x), bool))
        return (np.concatenate(best), np.concatenate(score), np.concatenate(close)) if best else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Classifier:
    """Learn from a bounded sample of rows with text, language and id.

    Each of the MOST_LANGS most frequent languages gives about `sample_texts` texts of at most
    `sample_chars` characters, drawn by a hash of id and text, in proportion to its count; the driver
    holds no more than half as many again.
    """
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang")).dropna()
    rows = rows.where(F.char_length("text").between(1, sample_chars))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    if not counts:
        return Classifier([], [])
    mark = F.xxhash64("id", "text")
    share = F.coalesce(*[F.when(F.col("lang") == k, hash_share(mark, sample_texts / n, "language")) for k, n in sorted(counts.items())])
    some = rows.where(share).orderBy(mark, "text", "lang").limit(len(counts) * sample_texts * 3 // 2).collect()
    return Classifier([r.text for r in some], [r.lang for r in some])


def identify(docs: DataFrame, model: Classifier, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Predict the language of every whole text; returns `keep`, lang_pred, score and ambiguous.

    lang_pred is ``und``, with score 0, for a text that is null or has no letter, and for all texts if
    nothing was learned.  score is the share of the best language in the decoded likelihoods.
    Of equally likely languages the first in the alphabet is taken, and the text is ambiguous.
    Repeated rows each give a row; an empty table gives an empty result; a kept column that has the name
    of a result gets _kept behind it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = Kept(keep, ("lang_pred", "score", "ambiguous"))
    rows = docs.select(named(text_col).alias("text"), *kept.inside())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in slices(batches, "text"):
            texts = text_array(part.column("text"))
            best, score, close = own.predict(texts)
            known = np.array([bool(own.langs) and any(c.isalpha() for c in t) for t in texts.to_pylist()], bool)
            langs = [own.langs[i] if k else "und" for i, k in zip(best, known, strict=True)]
            made = [pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(close & known)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept.names), *made], [*kept.names, "lang_pred", "score", "ambiguous"])

    done = rows.mapInArrow(run, kept.schema(rows, "lang_pred string, score double, ambiguous boolean"))
    return done.select(*kept.outside(), "lang_pred", "score", "ambiguous")


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of the two folds that may be learned from."""
    return docs.where(crc_mod(named(id_col), 3) != 1)
