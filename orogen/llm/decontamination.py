"""Benchmark decontamination: a BM25 inverted index of test items, searched by every passage with block-max WAND."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import in_small_batches, keep, map_batches

K1, B = 1.2, 0.75
#: Consecutive items that share one bound in each posting list.
BLOCK = 2
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Least part of an item's own BM25 score that a passage must reach.
LEAST_SCORE = 0.5
#: Words of the question, and of the answer, that must be in the passage.
LEAST_PART = 0.5
#: Postings of one broadcast index (some 40 bytes each). Longer benchmarks are searched part by part.
MOST_POSTINGS = 3_000_000
EPSILON = 1e-9
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
FOUND = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, word_start long"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last sentence, with those before it until it has five words; the question is the rest (or all)."""
    parts = [words_of(s) for s in _SENTENCE.split(text)]
    parts = [p for p in parts if p]
    answer: list[str] = []
    while parts and len(answer) < SHINGLE_WORDS:
        answer = parts.pop() + answer
    question = [w for p in parts for w in p]
    return question or answer, answer


def shingles(words: list[str]) -> set[int]:
    """Hashes of the word shingles; of all words together where there are fewer."""
    from xxhash import xxh3_64_intdigest

    n = SHINGLE_WORDS
    return {xxh3_64_intdigest(" ".join(words[k : k + n])) for k in range(max(1, len(words) - n + 1))} if words else set()


def weighted(items: DataFrame) -> DataFrame:
    """Postings item_id, length, word, df, impact of items (item_id, text): an item scores 1 on a passage that has all its words.

    An impact is the word's BM25 weight in the item over the sum of the item's weights. Document frequencies,
    the number of items and their mean length are those of the whole benchmark.
    """

    def each(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts in batches:
            rows = [(i, w, f, sum(tf.values())) for i, tf in ((i, Counter(words_of(t))) for i, t in zip(ids, texts)) for w, f in tf.items()]
            yield [list(c) for c in zip(*rows)] or [[], [], [], []]

    counted = keep(map_batches(items, ["item_id", "text"], each, "item_id long, word string, tf int, length int"))
    whole = counted.select("item_id", "length").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    n, mean = whole["n"], max(1.0, whole["mean"] or 1.0)
    df = counted.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    own = counted.join(df, "word").select("item_id", "length", "word", "df", weight.alias("own"))
    total = own.groupBy("item_id").agg(F.sum("own").alias("total"))
    return own.join(total, "item_id").select("item_id", "length", "word", "df", (F.col("own") / F.col("total")).alias("impact"))


class Index:
    """Posting lists of items in one order: positions, impacts, and the greatest impact in each block of BLOCK positions.

    Items are ordered by their rarest words, so that like items share a block. All lists lie one after another
    in flat arrays.
    """

    def __init__(self, postings: list[tuple[int, str, int, float]], texts: dict[int, str], stride: int):
        rarest: dict[int, tuple[int, str]] = {}
        for item, word, df, _ in postings:
            rarest[item] = min(rarest.get(item, (df, word)), (df, word))
        self.ids = sorted(rarest, key=lambda i: (rarest[i], i))
        at = {i: k for k, i in enumerate(self.ids)}
        words = [words_of(texts[i]) for i in self.ids]
        self.lengths = [len(w) for w in words]
        self.shingles = [shingles(w) for w in words]
        self.parts = [tuple(set(p) for p in question_and_answer(texts[i])) for i in self.ids]
        self.terms = {w: k for k, w in enumerate(sorted({p[1] for p in postings}))}
        rows = sorted((self.terms[w], at[i], x) for i, w, _, x in postings)
        term = np.array([r[0] for r in rows], np.int64)
        self.items = array("q", [r[1] for r in rows])
        self.impacts = array("d", [r[2] for r in rows])
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1)).tolist()
        # Blocks of each list: their numbers and greatest impacts.
        block = np.array(self.items, np.int64) // BLOCK
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if rows else np.zeros(0, np.int64)
        self.block = block[new]
        self.block_most = np.maximum.reduceat(np.array(self.impacts), new) if rows else np.zeros(0)
        self.block_first = np.searchsorted(term[new], np.arange(len(self.terms) + 1))
        self.block_start, self.block_number = self.block_first.tolist(), array("q", self.block.tolist())
        self.blocks = -(-len(self.ids) // BLOCK)
        self.most = np.maximum.reduceat(np.array(self.impacts), self.first[:-1]) if rows else np.zeros(0)
        #: At least the longest item's words: every span as long as it lies whole in one passage of twice the stride.
        self.stride = stride

    def gathered(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of these terms' blocks in the flat arrays, and the number (among `terms`) of the term of each."""
        a, n = self.block_first[terms], self.block_first[terms + 1] - self.block_first[terms]
        number = np.repeat(np.arange(len(terms)), n)
        return np.arange(len(number)) + (a - np.cumsum(n) + n)[number], number

    def live_passages(self, words: list[str], least: float) -> Iterator[tuple[int, list[int], list[int]]]:
        """(first word, terms, blocks) of the passages of a text with the blocks of items whose bounds reach `least` there.

        The bounds of all the text's words together go first: few texts have a block left. Then those of each
        passage, the words of two neighbouring strides, by one product of presences and bounds.
        """
        get = self.terms.get
        known = {w: t for w in set(words) if (t := get(w)) is not None}
        terms = np.array(list(known.values()), np.int64)
        if self.most[terms].sum() < least - EPSILON:
            return
        at, number = self.gathered(terms)
        block, most = self.block[at], self.block_most[at]
        live = np.bincount(block, most, self.blocks) >= least - EPSILON
        blocks = np.flatnonzero(live)
        if not len(blocks):
            return
        here = live[block]
        bounds = np.zeros((len(terms), len(blocks)))
        bounds[number[here], np.searchsorted(blocks, block[here])] = most[here]
        local = dict(zip(known, range(len(known))))
        every = np.fromiter(map(local.get, words, repeat(-1)), np.int64, len(words))
        place = np.flatnonzero(every >= 0)
        has = np.zeros((-(-len(words) // self.stride), len(terms)), bool)
        has[place // self.stride, every[place]] = True
        if len(has) > 1:
            has = has[:-1] | has[1:]
        reach = has.astype(np.float64) @ bounds >= least - EPSILON
        for p in np.flatnonzero(reach.any(axis=1)):
            yield int(p) * self.stride, sorted(terms[has[p]].tolist()), blocks[reach[p]].tolist()

    def wand(self, terms: list[int], least: float, blocks: list[int]) -> Iterator[tuple[int, float]]:
        """(item, score) of all items of some blocks that reach `least` on these different terms, in order.

        Cursors stand on the terms' lists. The pivot is the first item at which the greatest impacts of the lists
        up to it reach the threshold; what lies before it cannot. If its block is none of the given ones, or the
        bounds of the block for the lists up to the pivot do not reach the threshold, all these cursors go past
        the block, else the pivot is scored.
        """
        items, impacts, first, end = self.items, self.impacts, self.first, len(self.ids)
        cursors = [[items[first[t]], first[t], first[t + 1], float(self.most[t]), t] for t in terms]  # item, place, end, most, term
        need = least - EPSILON

        def forward(cursor: list, to: int) -> None:
            if cursor[0] < to:
                cursor[1] = bisect_left(items, to, cursor[1], cursor[2])
                cursor[0] = items[cursor[1]] if cursor[1] < cursor[2] else end

        for c in cursors:
            forward(c, blocks[0] * BLOCK)
        while True:
            cursors.sort(key=_item)
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0 or cursors[pivot][0] >= end:
                return
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            at = bisect_left(blocks, block)
            if at == len(blocks):
                return
            if blocks[at] != block:
                for c in cursors:
                    forward(c, blocks[at] * BLOCK)
            elif self._bound(block, [c[4] for c in cursors[: pivot + 1]]) < need:
                past = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    past = min(past, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    forward(c, past)
            elif cursors[0][0] == item:
                score = sum(x for _, x in sorted((c[4], impacts[c[1]]) for c in cursors[: pivot + 1]))
                if score >= least:
                    yield item, score
                for c in cursors[: pivot + 1]:
                    forward(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    forward(c, item)

    def _bound(self, block: int, terms: list[int]) -> float:
        total = 0.0
        for t in terms:
            at = bisect_left(self.block_number, block, self.block_start[t], self.block_start[t + 1])
            if at < self.block_start[t + 1] and self.block_number[at] == block:
                total += self.block_most[at]
        return total

    def search(self, words: list[str], least: float) -> Iterator[tuple[int, int, float]]:
        """(first word, item, score) for all passages of a text and all items that reach `least` in them."""
        for start, terms, blocks in self.live_passages(words, least):
            for item, score in self.wand(terms, least, blocks):
                yield start, item, score

    def matches(self, text: str, least: float, similarity: float) -> list[tuple]:
        """Verified items of a text: item, score, overlap, question's and answer's overlap, first word of the passage.

        Of several passages the one with the greatest overlap counts, then the greatest score, then the first.
        """
        words = words_of(text)
        best: dict[int, tuple] = {}
        for start, i, score in self.search(words, least):
            passage = words[start : start + 2 * self.stride]
            own = self.shingles[i]
            n = min(SHINGLE_WORDS, self.lengths[i])
            overlap = len(own & shingles(passage)) / len(own) if n == SHINGLE_WORDS else float(_holds(passage, n, own))
            have = set(passage)
            q, a = (len(p & have) / len(p) for p in self.parts[i])
            if overlap >= similarity and min(q, a) >= LEAST_PART and (i not in best or (overlap, score) > best[i][1::-1]):
                best[i] = (score, overlap, q, a, start)
        return [(self.ids[i], *x) for i, x in sorted(best.items())]


def _item(cursor: list) -> int:
    return cursor[0]


def _holds(passage: list[str], n: int, own: set[int]) -> bool:
    """Whether a passage has the few words of a short item in a row."""
    return any(shingles(passage[k : k + n]) == own for k in range(len(passage) - n + 1))


def indexes(benchmark: DataFrame, most_postings: int = MOST_POSTINGS) -> Iterator[Index]:
    """The benchmark's index, in parts of about `most_postings`; weights are those of the whole, so parts change no result.

    Of rows that repeat an item_id the least text counts. Items without words are in no part.
    """
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    postings = keep(weighted(items))
    seen = postings.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).first()
    parts, stride = max(1, -(-seen["n"] // most_postings)), max(64, seen["longest"] or 0)
    for part in range(parts):
        here = F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part
        texts = {r["item_id"]: r["text"] for r in items.where(here).collect()}
        rows = [(r["item_id"], r["word"], r["df"], r["impact"]) for r in postings.where(here).collect()]
        if rows:
            yield Index(rows, texts, stride)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, similarity: float = SIMILARITY, most_postings: int = MOST_POSTINGS) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap, word_start of all leaks found in whole texts.

    Every passage (overlapping word windows, each twice as long as the longest item, 128 words at least) is a query;
    items whose score reaches `least` of their own are verified: `similarity` of the item's five-word shingles
    must be in the passage, and half of the words of both its question and its answer. A row of docs and an item
    give one row, of the best passage; rows that repeat a doc_id, or have none, are rows like others. Null or
    empty texts and items match nothing, and an empty table gives no rows. Very long texts are searched whole;
    other columns are ignored, whatever their names.
    """
    sc, found = docs.sparkSession.sparkContext, None
    for index in indexes(benchmark, most_postings):
        shared = sc.broadcast(index)

        def each(batches: Iterator[list[list]], shared=shared) -> Iterator[list]:
            for ids, texts in batches:
                rows = [(d, *m) for d, t in zip(ids, texts) if t for m in shared.value.matches(t, least, similarity)]
                yield [list(c) for c in zip(*rows)] or [[]] * 7

        one = map_batches(docs, ["doc_id", "text"], each, FOUND)
        found = one if found is None else found.unionByName(one)
    return docs.sparkSession.createDataFrame([], FOUND) if found is None else found


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, similarity: float = SIMILARITY, most_postings: int = MOST_POSTINGS) -> Column:
    """Whether the column text holds a test item, verified as in contaminated(); false for null and empty texts."""
    sc, found = docs.sparkSession.sparkContext, F.lit(False)
    for index in indexes(benchmark, most_postings):
        found = found | _holder(sc.broadcast(index), least, similarity)("text")
    return found


def _holder(shared: Broadcast, least: float, similarity: float):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and bool(shared.value.matches(t, least, similarity)) for t in texts], dtype=bool)

    return holds


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows in whose text no test item is found; columns as given, null ids and repeated rows too."""
    return in_small_batches(docs).where(~leaks(docs, benchmark, **options))
