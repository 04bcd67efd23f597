"""Best-fit packing of token pieces into sequences, with large items matched first."""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from string import punctuation

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import keep, map_batches, numbered

CAPACITY = 2048
END_ID = 0
#: Words that a worker remembers with their ids; beyond it the memory starts anew.
REMEMBERED = 500_000
_BEYOND_LATIN = re.compile("[^\u0000-\u024f]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    This vocabulary never joins what white space parts, so the ids of a text are the ids of its blank-separated
    chunks in turn; each chunk is encoded once and remembered. Texts of Latin letters are lowered as a whole, as
    the tokenizer does it letter by letter, which leaves fewer different chunks. Strings of special tokens in a text
    are their ids, as the tokenizer has it, wherever they stand and in no other case of letters; they part the text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each worker its core
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        added = self.model.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens must be matched as they stand")
        # The longest is found first. No chunk has a line end, so these names of special tokens are theirs alone.
        self.contents = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, self.contents)) + ")")
        self.fixed = {"": b""} | {f"\n{t.content}": i.to_bytes(4, "little") for i, t in added.items()}
        self.model.encode_special_tokens = True  # for what is left when special tokens are parted from it
        #: The same vocabulary and merges for words that are lower-case letters already.
        self.plain = Tokenizer(self.model.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = dict(self.fixed)

    def forget(self) -> None:
        """A worker lives on and does other work after this; it must not keep what it no longer needs."""
        self.words, self.chunks = {}, dict(self.fixed)

    def _encode_words(self, words: list[str]) -> None:
        """Many plain words at once; the end mark of their last tokens parts them again."""
        groups = [words[k : k + 400] for k in range(0, len(words), 400)]
        found = self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, one in zip(groups, found):
            ids = np.array(one.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(cuts) == len(group) and cuts[-1] == len(raw):
                self.words.update(zip(group, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
            else:
                self.words.update((w, self._one(w)) for w in group)

    def _one(self, word: str) -> bytes:
        return np.array(self.model.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Chunks are mostly a word of lower-case Latin letters with punctuation after it; the word is looked up without it."""
        latin = not _BEYOND_LATIN.search(" ".join(chunks))
        parted, rest = [], []
        for c in chunks:
            word = c.rstrip(punctuation)
            if word.isalpha() and (latin or not _BEYOND_LATIN.search(c)) and word == word.lower():
                parted.append((c, word))
            else:
                rest.append(c)
        words = self.words
        self._encode_words([w for w in {w for _, w in parted} if w not in words])
        for tail in {c[len(w) :] for c, w in parted if len(w) < len(c)} - words.keys():
            words[tail] = self._one(tail)
        self.chunks.update((c, words[w] if len(w) == len(c) else words[w] + words[c[len(w) :]]) for c, w in parted)
        self.chunks.update((c, self._one(c)) for c in rest)

    def encode(self, texts: list[str], together: int = 2_000_000) -> Iterator[bytes]:
        """The texts' ids in turn; words are learned for some millions of characters at a time."""
        group, chars = [], 0
        for text in texts:
            parts = self.special.split(text) if any(t in text for t in self.contents) else [text]
            own = _chunks(parts[0])
            for special, part in zip(parts[1::2], parts[2::2]):
                own += [f"\n{special}", *_chunks(part)]
            group.append(own)
            chars += len(text)
            if chars >= together:
                yield from self._encode(group)
                group, chars = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[bytes]:
        if len(self.chunks) > REMEMBERED:
            self.chunks = dict(self.fixed)
        if len(self.words) > REMEMBERED:
            self.words = {}
        missing = set().union(*group) - self.chunks.keys()
        if missing:
            self._learn(missing)
        for chunks in group:
            yield b"".join(map(self.chunks.__getitem__, chunks))


def _chunks(text: str) -> list[str]:
    latin = text.isascii() or not _BEYOND_LATIN.search(text)
    return (text.lower() if latin else text).replace("\n", " ").split(" ")


@cache
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Token pieces of whole texts: doc_id, piece, start, length, ids_crc32 and, unless left out, ids.

    A document is the tokenizer's ids (none added; those of special tokens that the text spells out) and then id 0. Only a longer one than the capacity
    is cut, into full pieces and a last shorter one. A null text counts as empty: its one piece is the end id.
    """

    def pieces(batches: Iterator[list[list]]) -> Iterator[list]:
        coder, step = tokenizer(tokenizer_path), 4 * capacity
        gc.set_threshold(200_000, 50, 1000)  # what is remembered has no cycles to look for
        for ids, texts in batches:
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, raw in zip(ids, coder.encode([t if t is not None else "" for t in texts])):
                raw += END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    for column, x in zip(rows, row + (np.frombuffer(part, "<u4").astype("int32"),) if with_ids else row):
                        column.append(x)
            yield rows
        coder.forget()

    return map_batches(docs, ["doc_id", "text"], pieces, PIECES + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over a histogram of lengths: rows (length, first rank, ranks, first bin, per bin, offset).

    The ranks of a length from the first on go into successive bins from the first bin on, `per bin` in
    each, at the offset and after it. Lengths over a third of the capacity go first, longest first, each to
    the open bin with the smallest gap that holds it: at most two meet in a bin, and matching the longest
    with the longest that fits gives the most pairs. The smaller ones then fill the smallest gaps that hold
    them, and open new bins when none does. Equal bins are handled as one run, so the work depends on the
    number of different lengths, at most the capacity, not on the number of documents.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first bin, bins)
    out, bins = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        most = 2 if 3 * length > capacity else capacity
        while left:
            gap = min((g for g, r in runs.items() if r and g >= length), default=None)
            if gap is None:
                gap, first = capacity, bins
                each = min(most, capacity // length)
                number = max(1, left // each)
                bins += number
            else:
                first, number = runs[gap].pop()
                each = min(most, gap // length)
            if left < each:  # one bin takes what is left
                each, used = left, 1
            else:
                used = min(number, left // each)
            if used < number:
                runs.setdefault(gap, []).append((first + used, number - used))
            out.append((length, rank, used * each, first, each, capacity - gap))
            rank, left = rank + used * each, left - used * each
            if rest := gap - each * length:
                runs.setdefault(rest, []).append((first, used))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to every piece (columns length, doc_id, piece are read).

    Only the histogram of lengths (at most `capacity` rows) goes to the driver, where it is planned. The
    pieces of a length are numbered on the executors, hot lengths in salted parts, and each finds its run of
    bins by its length and number. Sequences have no empty places before a piece. No pieces: no rows.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a piece is empty or longer than the capacity")
    by_length: dict[int, list] = {}
    for length, rank, ranks, first, each, offset in plan(counts, capacity):
        by_length.setdefault(length, []).append((rank, rank + ranks, first, each, offset))
    rows = [(k, v) for k, v in by_length.items()]
    schema = "length long, runs array<struct<first:long,last:long,bin:long,each:long,offset:long>>"
    runs = spark.createDataFrame(rows, schema)
    ranked = numbered(pieces, ["length"], ["doc_id", "piece"], "_rank")
    # The plan has one row for each length: at most `capacity` rows, so it may be broadcast.
    own = F.filter("runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["last"]))[0]
    return (
        ranked.join(F.broadcast(runs), "length")
        .withColumn("_run", own)
        .withColumn("_at", F.col("_rank") - F.col("_run.first"))
        .withColumn("sequence_id", F.col("_run.bin") + F.expr("_at div _run.each"))
        .withColumn("offset", F.col("_run.offset") + F.col("length") * (F.col("_at") % F.col("_run.each")))
        .drop("_rank", "_run", "_at", "runs")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are encoded once: the pieces without their ids are kept in the shared folder. token_pieces() gives
    the ids of any piece again. Repeated doc_ids are packed as separate documents; extra columns are ignored.
    """
    pieces = keep(token_pieces(docs, tokenizer_path, capacity, with_ids=False))
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
