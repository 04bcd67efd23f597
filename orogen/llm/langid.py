"""Language identification with blended-spectrum string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import map_batches

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
#: Bounds of what is learned from: labelled rows and landmarks of a language and in all, and languages.
ROWS, MOST_ROWS = 300, 20_000
LANDMARKS, MOST_LANDMARKS = 48, 2_000
MOST_LANGUAGES = 200
#: Numbers of one matrix of presences, and of a table of n-grams, at most.
CELLS, MOST_TABLE = 2_000_000, 1 << 22
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


class Numbered:
    """The place of each of some sorted codes, -1 for all others: by a table where the codes' range is small, else by search."""

    def __init__(self, codes: np.ndarray, limit: int):
        self.codes, self.table = codes, None
        if limit <= MOST_TABLE:
            self.table = np.full(limit, -1, np.int32)
            self.table[codes] = np.arange(len(codes))

    def __getitem__(self, code: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[code]
        if not len(self.codes):
            return np.full(len(code), -1, np.int32)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, -1)


class Grams:
    """The n-grams of the landmarks, orders 1 to 3, each with a column."""

    def __init__(self, landmarks: list[str]):
        points = np.unique(np.concatenate([_points([t]) for t in landmarks] or [np.zeros(0, np.uint32)]))
        letters = points[points > 0]
        self.letters, self.base = Numbered(letters.astype(np.int64), 0x110000), len(letters) + 1
        self.known, self.first, self.columns = [], [], 0
        symbols = self._symbols(_points(landmarks))
        wanted = np.ones(len(symbols), bool)
        for n in ORDERS:
            codes = np.unique(self._ngrams(symbols, n, wanted))
            self.known.append(Numbered(codes, self.base**n))
            self.first.append(self.columns)
            self.columns += len(codes)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """A number for each letter of the landmarks, 0 for all others and for the ends of texts."""
        return self.letters[points].astype(np.int64) + 1

    def _ngrams(self, symbols: np.ndarray, n: int, wanted: np.ndarray) -> np.ndarray:
        """Codes of the n-grams of wanted places, for orders 1, 2, ... in turn: `wanted` loses the places whose n-gram has a symbol 0."""
        m = max(0, len(symbols) - n + 1)
        wanted[m:] = False
        wanted[:m] &= symbols[n - 1 :] > 0
        code = np.zeros(m, np.int64)
        for k in range(n):
            code *= self.base
            code += symbols[k : k + m]
        return code[wanted[:m]]

    def presence(self, texts: list[str]) -> np.ndarray:
        """texts x columns: 1 where the text has the n-gram, over the root of its number of them."""
        out = np.zeros((len(texts), self.columns), np.float32)
        points = _points(texts)
        symbols, at = self._symbols(points), (np.cumsum(points == 0) - (points == 0)).astype(np.int32)
        wanted = np.ones(len(symbols), bool)
        for n, known, first in zip(ORDERS, self.known, self.first):
            column = known[self._ngrams(symbols, n, wanted)]
            hit = column >= 0
            out.ravel()[at[wanted][hit].astype(np.int64) * self.columns + first + column[hit]] = 1
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))

    def batches(self, texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[list[int], np.ndarray]]:
        """Presences of some texts at a time, and which these are; matrices and texts stay in bounds."""
        most, some, size = max(1, CELLS // max(1, self.columns)), [], 0
        for k, text in enumerate(texts):
            some.append(k)
            size += len(text)
            if len(some) >= most or size >= chars or k + 1 == len(texts):
                yield some, self.presence([texts[i] for i in some])
                some, size = [], 0


def _points(texts: list[str]) -> np.ndarray:
    """Code points of the lower-cased texts, each text closed by a zero."""
    joined = "".join(t.lower().replace("\0", " ") + "\0" for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    languages: list[str]
    grams: Grams
    coefficients: np.ndarray  # landmarks x languages
    weights: np.ndarray  # columns x languages: landmark presences times the coefficients


def regression(kernel: np.ndarray, marks: np.ndarray, languages: list[str], ridge: float) -> tuple[list[str], np.ndarray]:
    """Languages and coefficients over the landmarks, from the kernels of labelled texts with the landmarks and of these.

    The Nyström space is spanned by the landmarks; each language is regressed against the rest, languages weighing alike.
    """
    kinds = sorted(set(languages))
    label = np.array([kinds.index(x) for x in languages], int)
    values, vectors = np.linalg.eigh(marks.astype(np.float64))
    good = values > 1e-6 * max(values.max(initial=0.0), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = kernel.astype(np.float64) @ root
    target = np.where(label[:, None] == np.arange(len(kinds)), 1.0, -1.0)
    weight = 1 / np.bincount(label, minlength=len(kinds))[label] * len(label)
    gram = mapped.T @ (mapped * weight[:, None]) + ridge * len(label) * np.eye(mapped.shape[1])
    return kinds, root @ np.linalg.solve(gram, mapped.T @ (target * weight[:, None]))


def _kernel(grams: Grams, texts: list[str], marks: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), len(marks)), np.float32)
    for some, p in grams.batches(texts):
        out[some] = p @ marks.T
    return out


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """Fit on labelled texts in memory; the first `landmarks` of each language span the Nyström space."""
    seen: dict[str, int] = {}
    marked = []
    for text, language in zip(texts, languages):
        seen[language] = seen.get(language, 0) + 1
        if seen[language] <= landmarks:
            marked.append(text)
    grams = Grams(marked)
    marks = grams.presence(marked)
    return _fitted(grams, marks, _kernel(grams, texts, marks), languages, ridge)


def _fitted(grams: Grams, marks: np.ndarray, kernel: np.ndarray, languages: list[str], ridge: float) -> Model:
    """The kernel of two texts is the number of n-grams that both have, over the root of the product of their numbers.

    Counted are n-grams that some landmark has; all others are in no kernel with a landmark.
    """
    if not languages:
        return Model([], grams, np.zeros((0, 0)), np.zeros((0, 0), np.float32))
    kinds, coefficients = regression(kernel, marks @ marks.T, languages, ridge)
    return Model(kinds, grams, coefficients, (marks.T @ coefficients).astype(np.float32))


def score(model: Model, texts: list[str]) -> np.ndarray:
    """texts x languages: the regressions' outputs, by products of batches."""
    out = np.zeros((len(texts), len(model.languages)), np.float32)
    for some, p in model.grams.batches(texts):
        out[some] = p @ model.weights
    return out


def training_sample(docs: DataFrame, learn: Column, per_language: int = ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, text (whole), lang, landmark of about `per_language` labelled rows of each language, by a hash of id and text.

    At most MOST_LANGUAGES languages are learned, the most frequent ones, and fewer rows of each where there are
    many, so the sample is bounded whatever the input. The counts of these languages are all that goes to the
    driver, and they come back as a literal: no text is shuffled.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return rows.where("false").select("doc_id", "text", "lang", F.lit(False).alias("landmark"))
    each, marks = min(per_language, MOST_ROWS // len(counts)), min(landmarks, MOST_LANDMARKS // len(counts))
    n = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], float(r["n"])))), F.col("lang"))
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.select("doc_id", "text", "lang", (place * n).alias("_rank")).where(F.col("_rank") < each)
    return chosen.select("doc_id", "text", "lang", (F.col("_rank") < marks).alias("landmark"))


def learned(docs: DataFrame, learn: Column, per_language: int = ROWS, landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """Fit from a bounded sample of labelled rows.

    The driver gets the landmarks' texts; the executors send it the kernels of the sampled texts with these.
    """
    sample = training_sample(docs, learn, per_language, landmarks)
    marked = sorted((r["lang"], r["text"]) for r in sample.where("landmark").select("lang", "text").collect())
    grams = Grams([t for _, t in marked])
    marks = np.concatenate([grams.presence([t]) for _, t in marked] or [np.zeros((0, grams.columns), np.float32)])
    shared = docs.sparkSession.sparkContext.broadcast((grams, marks))

    def each(batches: Iterator[list[list]]) -> Iterator[list]:
        own, vectors = shared.value
        for languages, texts in batches:
            yield [languages, [row.tobytes() for row in _kernel(own, texts, vectors)]]

    rows = sorted((r["lang"], r["kernel"]) for r in map_batches(sample, ["lang", "text"], each, "lang string, kernel binary").collect())
    kernel = np.array([np.frombuffer(k, np.float32) for _, k in rows], np.float32).reshape(len(rows), len(marks))
    return _fitted(grams, marks, kernel, [x for x, _ in rows], ridge)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every whole text.

    A null text or one without a letter is `und` with score 0; so is every text if nothing was learned. A text
    with letters of which the landmarks have none gets the first language, at an even share. The score is the
    best language's share when the outputs are put through a softmax; ties go to the first language in order.
    Repeated rows, and rows with null ids, are each answered; an empty table gives no rows; other columns are
    ignored, whatever their names. The model's size follows the landmarks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[list[list]]) -> Iterator[list]:
        m = shared.value
        for ids, texts in batches:
            pred, sure = [UNDETERMINED] * len(ids), np.zeros(len(ids))
            some = [i for i, t in enumerate(texts) if t and has_letter(t)] if m.languages else []
            if some:
                out = 4 * score(m, [texts[i] for i in some]).astype(np.float64)
                share = np.exp(out - out.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                sure[some] = share.max(axis=1)
                for i, best in zip(some, share.argmax(axis=1)):
                    pred[i] = m.languages[best]
            yield [ids, pred, sure]

    return map_batches(docs, ["doc_id", "text"], each, "doc_id long, lang_pred string, score double")
