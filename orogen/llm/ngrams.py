"""Language-model scores of documents: a log-frequency Bloom filter of n-gram counts, probed level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .base import crc32_of_id, in_small_batches, keep

ORDER, PSEUDO = 2, 0.1
#: Hash functions of a level, all within one 64-bit word, and bits for each entry: a level that is not there is found
#: once in some 25 probes.
HASHES, BITS = 4, 10
#: Each level's counts begin a quarter higher than those of the level before (the first ones: one higher).
GROWTH = 1.25
#: Words whose exact counts go to all workers, and their longest; the counts of the others are joined.
COMMON, COMMON_BYTES = 1 << 18, 64
#: A filter is broadcast that has so many bytes at most, by the number of tokens; else n-grams go to its slices, with the same result.
FILTER_BYTES = 32 << 20
LEAST_SLICES, SLICE_ROWS = 1 << 10, 1 << 18
#: Slices that one task builds together, a power of two: their n-grams come from each block of texts in one list.
TOGETHER_SLICES = 16
#: Bytes of texts in a block on average, and the least number of blocks.
BLOCK_BYTES, LEAST_BLOCKS = 6 << 20, 32
END = b""  # a word of no letters
#: The low bits of an n-gram's key name the class of its context, those of a word's key the class that words have.
CLASSES = 64
WORDS = CLASSES - 1
#: Bytes of texts that are counted and scored together.
TOGETHER = 2 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _thresholds() -> np.ndarray:
    t = [1]
    while t[-1] < 1 << 60:
        t.append(max(t[-1] + 1, int(t[-1] * GROWTH)))
    return np.array(t, np.int64)


#: The least count of each level from 1 on, and what a level stands for: 0, then the middle of its counts.
LEAST = _thresholds()
COUNT_OF = np.concatenate([[0.0], (LEAST[:-1] + LEAST[1:] - 1) / 2, [float(LEAST[-1])]])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, "right")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def _of_class(key: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    return (key & ~np.uint64(CLASSES - 1)) | np.asarray(number, np.uint64)


class Tokens:
    """The tokens of some texts in one row: each one's number among the different words, and each text's number of them.

    Words stand between ASCII white space, A-Z lower-cased, and the end (a word of no letters) follows them.
    """

    def __init__(self, texts: pa.Array):
        own = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        # Nothing stands after the last blank: that is the end. An empty text is the end alone.
        closed = pc.if_else(pc.equal(own, ""), own, pc.binary_join_element_wise(own, "", " "))
        parted = pc.ascii_split_whitespace(closed)
        coded = parted.flatten().dictionary_encode()
        self.words, self.at = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64)
        self.lengths = parted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.begins = self.lengths.cumsum() - self.lengths


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some batches in one, so that a word that several texts have is looked up once."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= TOGETHER:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


@dataclass
class Model:
    """What every worker gets: bounded, whatever the corpus. Counts of n-grams are in the filter, not here."""

    order: int
    train_tokens: int
    distinct: int
    common: dict[bytes, int]
    slices: int = LEAST_SLICES
    #: The weight of the shorter n-grams, by class of the context.
    back_off: np.ndarray = field(default_factory=lambda: np.ones(CLASSES))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + PSEUDO) / (self.train_tokens + PSEUDO * (self.distinct + 1))

    def slice_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(6)) & np.uint64(self.slices - 1)).astype(np.int64)


class Passage(Tokens):
    """With the keys of the tokens' n-grams, by order."""

    def __init__(self, texts: pa.Array, model: Model):
        from xxhash import xxh64_intdigest

        super().__init__(texts)
        words = self.words.to_pylist()
        hashes = np.fromiter(map(xxh64_intdigest, words, repeat(42)), np.uint64, len(words))
        #: Exact counts of common words, -1 for the others.
        self.exact = np.fromiter(map(model.common.get, words, repeat(-1)), np.int64, len(words))
        classes = np.where(self.exact < 0, 0, 1 + np.minimum(level_of(self.exact) // 2, 46))
        end = np.uint64(xxh64_intdigest(END, 42))
        context = hashes[self.at]
        #: Keys of the different words, and of each place's longer n-grams with their contexts' classes, by order.
        self.word_keys, self.keys, self.classes = _of_class(hashes, WORDS), [], []
        self.end = self.at[-1] if len(self.at) else 0
        start = end
        for m in range(2, model.order + 1):
            before = self._before(context, start)
            context = _mixed(_mixed(before * _ODD[0]) + hashes[self.at])
            kind = self._before(classes[self.at], classes[self.end] if len(classes) else 0) if m == 2 else np.full(len(self.at), 46 + m)
            self.keys.append(_of_class(context, kind))
            self.classes.append(kind)
            start = _mixed(np.array([start]) * _ODD[0] + end)[0]

    def _before(self, x: np.ndarray, first: int | np.uint64) -> np.ndarray:
        """What stands one token earlier; `first` where a text begins."""
        out = np.roll(x, 1)
        out[self.begins] = first
        return out

    def log_probability(self, levels: Callable[[np.ndarray], np.ndarray], model: Model) -> np.ndarray:
        """The base-10 logarithm of each text's probability, interpolated over the orders.

        Every count is what the levels of the n-gram's key stand for. A longer n-gram's relative frequency weighs
        what its context's class leaves it, and the shorter one the rest.
        """
        if not len(self.at):
            return np.zeros(0)
        of_word = COUNT_OF[levels(self.word_keys)]
        context, texts = of_word[self.at], of_word[self.end]
        p = model.unigram(context)
        for keys, kind in zip(self.keys, self.classes):
            unique, where = np.unique(keys, return_inverse=True)
            counts = COUNT_OF[levels(unique)][where]
            context = self._before(context, texts)
            seen = np.minimum(1.0, counts / np.maximum(context, 1.0))
            back = np.where(context > 0, model.back_off[kind], 1.0)
            p, context = (1 - back) * seen + back * p, counts
        return np.add.reduceat(np.log10(p), self.begins)


# --- counts of the corpus


def word_counts(docs: DataFrame) -> DataFrame:
    """word (its bytes; none for the end), n."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            own = Tokens(batch.column(0))
            yield pa.RecordBatch.from_arrays([own.words, pa.array(np.bincount(own.at, minlength=len(own.words)), pa.int64())], ["word", "n"])

    return in_small_batches(docs).select("text").mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _common(words: DataFrame, most: int) -> dict[bytes, int]:
    """The words that occur most, `most` of them at most; how often one must occur is found by a histogram."""
    short = words.where(F.octet_length("word") <= COMMON_BYTES)
    sizes = dict(short.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1))).collect())
    total, least = 0, None
    for power in sorted(sizes, reverse=True):
        total += sizes[power]
        if total > most:
            break
        least = 2**power
    if least is None:
        return {}
    rows = short.where(F.col("n") >= least).select("word", "n").toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))


def gram_counts(docs: DataFrame, model: Model) -> DataFrame:
    """key, n: n-grams of two words and more, counted for some million tokens at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            keys = Passage(batch.column(0), shared.value).keys
            unique, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return in_small_batches(docs).select("text").mapInArrow(each, "key long, n long")


# --- the filter


def _word_and_mask(keys: np.ndarray, level: np.ndarray | int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word, among so many (fewer than 2**32), of a key's level, and the bits that stand for it there."""
    h = _mixed(keys + np.asarray(level, np.uint64) * _ODD[0])
    one, mask = np.uint64(1), np.zeros(len(h), np.uint64)
    for k in range(HASHES):
        mask |= one << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return (((h >> np.uint64(32)) * np.asarray(words, np.uint64)) >> np.uint64(32)).astype(np.int64), mask


def filter_slice(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit words in which each key stands at all levels up to that of its count."""
    levels = level_of(counts)
    every, last = int(levels.sum()), np.cumsum(levels)
    words = np.zeros(max(1, -(-every * BITS // 64)), np.uint64)
    level = np.arange(every) - np.repeat(last - levels, levels) + 1
    at, mask = _word_and_mask(np.repeat(keys, levels), level, len(words))
    np.bitwise_or.at(words, at, mask)
    return words


class Slices:
    """Slices of a filter in one array."""

    def __init__(self, parts: Iterable[tuple[int, bytes]], slices: int, size: int):
        self.words = np.empty(size // 8, np.uint64)
        self.first, self.size = np.zeros(slices, np.int64), np.zeros(slices, np.uint64)
        at = 0
        for number, b in parts:
            n = len(b) // 8
            self.words[at : at + n] = np.frombuffer(b, np.uint64)
            self.first[number], self.size[number] = at, n
            at += n

    def levels(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The highest level of each key (of the slice `at`): levels are probed from the first up to one that is not there."""
        out = np.zeros(len(keys), np.int64)
        live = np.flatnonzero(self.size[at] > 0)
        keys, at = keys[live], at[live]
        first, size = self.first[at], self.size[at]
        level = 0
        while len(live):
            level += 1
            word, mask = _word_and_mask(keys, level, size)
            there = self.words[first + word] & mask == mask
            live, keys, first, size = live[there], keys[there], first[there], size[there]
            out[live] = level
        return out


def _seen(keys: np.ndarray, n: np.ndarray) -> list[int]:
    """For each class of contexts its n-grams: different, all, single, double."""
    kind = (keys & np.uint64(CLASSES - 1)).astype(np.int64)
    return np.stack([np.bincount(kind, x, CLASSES) for x in (np.ones(len(n)), n, n == 1, n == 2)]).astype(np.int64).ravel().tolist()


def build_filter(grams: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """slice, bits, seen: the filter's slices, and for each class of contexts its n-grams (different, all, single, double).

    Counts are summed and slices built after one shuffle, by slice; a slice has SLICE_ROWS n-grams at most, but for chance.
    """
    own = F.xxhash64("word").bitwiseAND(F.lit(~(CLASSES - 1))).bitwiseOR(F.lit(WORDS))
    number = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(model.slices - 1)).cast("int")
    rows = grams.unionByName(words.select(own.alias("key"), "n")).withColumn("slice", number)
    summed = rows.repartition("slice").groupBy("slice", "key").agg(F.sum("n").alias("n"))

    def build(t: pa.Table) -> pa.Table:
        keys, n = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()
        return pa.table({"slice": t.column("slice")[:1].cast(pa.int32()), "bits": [filter_slice(keys, n).tobytes()], "seen": [_seen(keys, n)]})

    return summed.groupBy("slice").applyInArrow(build, "slice int, bits binary, seen array<long>")


def _back_off(seen: np.ndarray) -> np.ndarray:
    """How often a context of each class meets what it has not met before.

    That is the discount of n-grams (single ones over single ones and twice the double ones) for each different one.
    A class of which nothing is known has what all have; nothing is ever ruled out.
    """
    grams = np.delete(seen, WORDS, axis=1)
    different, every, single, double = grams.sum(axis=1)
    discount = single / (single + 2 * double) if single else 0.0
    overall = discount * different / every if every else 1.0
    own = np.where(seen[1] > 0, discount * seen[0] / np.maximum(seen[1], 1), overall)
    return np.clip(own, 0.01, 1.0)


# --- scores


def _by_broadcast(rows: DataFrame, train: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """Columns of _SCORED; the filter comes to the driver piece by piece."""
    slices = keep(build_filter(gram_counts(train, model), words, model))
    seen = slices.select(F.posexplode("seen").alias("at", "x")).groupBy("at").agg(F.sum("x")).collect()
    table = np.zeros(4 * CLASSES)
    table[[r[0] for r in seen]] = [r[1] for r in seen]
    model.back_off = _back_off(table.reshape(4, CLASSES))
    size = slices.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    sc = rows.sparkSession.sparkContext
    parts = ((r["slice"], r["bits"]) for r in slices.select("slice", "bits").toLocalIterator())
    shared, filled = sc.broadcast(model), sc.broadcast(Slices(parts, model.slices, size))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slices = shared.value, filled.value
        for batch in _grouped(batches):
            yield _scored(batch.column(0), Passage(batch.column(1), model), model, lambda keys: slices.levels(keys, model.slice_of(keys)))

    return in_small_batches(rows).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, _SCORED)


_SCORED = "doc_id long, n_tokens long, score double, common_known long, common_score double, rest array<struct<word:binary,n:long>>"


def _scored(ids: pa.Array, p: Passage, model: Model, levels: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """Columns of _SCORED; the words whose exact counts are not at hand, with how often the text has each, are left for a join."""
    known = p.exact >= 0
    value = np.where(known, np.log10(model.unigram(np.maximum(p.exact, 0))), 0.0)
    asked, words = np.flatnonzero(~known[p.at]), max(1, len(p.words))
    pair, n = np.unique(np.repeat(np.arange(len(ids)), p.lengths)[asked] * words + p.at[asked], return_counts=True)
    ends = np.concatenate([[0], np.bincount(pair // words, minlength=len(ids)).cumsum()])
    rest = pa.StructArray.from_arrays([p.words.take(pa.array(pair % words)), pa.array(n, pa.int64())], ["word", "n"])
    sums = [np.add.reduceat(x[p.at], p.begins) if len(ids) else x[:0] for x in (known.astype(np.int64), value)]
    columns = [ids, pa.array(p.lengths), pa.array(p.log_probability(levels, model)), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "score", "common_known", "common_score", "rest"])


# --- a filter of any size


def _turned(keys: np.ndarray, slices: int) -> np.ndarray:
    """The keys with their slice's number in front, so that what is sorted lies slice by slice."""
    k = np.uint64(slices.bit_length() - 1)
    number = (keys >> np.uint64(6)) & np.uint64(slices - 1)
    return number << (np.uint64(64) - k) | (keys >> (np.uint64(6) + k)) << np.uint64(6) | keys & np.uint64(CLASSES - 1)


def _turned_back(turned: np.ndarray, slices: int) -> np.ndarray:
    k = np.uint64(slices.bit_length() - 1)
    number, rest = turned >> (np.uint64(64) - k), turned & ((np.uint64(1) << (np.uint64(64) - k)) - np.uint64(1))
    return (rest >> np.uint64(6)) << (np.uint64(6) + k) | number << np.uint64(6) | turned & np.uint64(CLASSES - 1)


#: Bytes of a step between keys that are as good as random; higher ones are compressed.
PLAIN = 5
_ZSTD = pa.Codec("zstd", compression_level=1)


def _planes(x: np.ndarray, plain: int) -> list[bytes]:
    """Numbers byte by byte: all lowest bytes, then all next ones, up to the last that is not zero anywhere; from `plain` on compressed."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    rows = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width])
    return [r.tobytes() if k < plain else _ZSTD.compress(r, asbytes=True) for k, r in enumerate(rows)]


def _from_planes(planes: list[bytes], n: int, plain: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    for k, b in enumerate(planes):
        out[:, k] = np.frombuffer(b if k < plain else _ZSTD.decompress(b, n), np.uint8)
    return out.ravel().view("<u8")


def _levels_of_lists(lists: pa.Table) -> np.ndarray:
    """The levels of all keys of a block, in the keys' order."""
    at = sorted(zip(*(lists.column(c).to_pylist() for c in ("part", "n", "levels"))))
    return np.frombuffer(b"".join(_ZSTD.decompress(b, n, asbytes=True) for _, n, b in at), np.uint8).astype(np.int64)


def _keys_of_block(p: Passage, model: Model) -> np.ndarray:
    """All different keys of some texts, turned and sorted: whoever has the texts has them in the same order."""
    return np.unique(_turned(np.concatenate([p.word_keys, *p.keys]), model.slices))


_LISTS = "part int, block int, n int, keys array<binary>, counts array<binary>"
_LEVELS = "block int, part int, n int, levels binary, seen array<long>"


def _lists(texts: pa.Array, learn: np.ndarray, model: Model, block: int) -> pa.Table:
    """The different keys of a block's texts, one list for each part of the filter, and how often learned texts have each."""
    p = Passage(texts, model)
    keys = _keys_of_block(p, model)
    learned = np.repeat(learn, p.lengths)
    counts = np.zeros(len(keys), np.int64)
    for own in [p.word_keys[p.at], *p.keys]:
        unique, n = np.unique(own[learned], return_counts=True)
        counts[np.searchsorted(keys, _turned(unique, model.slices))] += n
    shift = 64 - (model.slices // TOGETHER_SLICES).bit_length() + 1
    part = (keys >> np.uint64(shift)).astype(np.int64)
    begins = np.flatnonzero(np.diff(part, prepend=-1))
    ends = [*begins[1:].tolist(), len(keys)]
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[begins] = keys[begins] & np.uint64((1 << shift) - 1)
    spans = list(zip(begins.tolist(), ends))
    planes = pa.list_(pa.binary())
    return pa.table({
        "part": pa.array(part[begins], pa.int32()), "block": pa.array([block] * len(spans), pa.int32()), "n": pa.array([e - b for b, e in spans], pa.int32()),
        "keys": pa.array([_planes(steps[b:e], PLAIN) for b, e in spans], planes), "counts": pa.array([_planes(counts[b:e], 0) for b, e in spans], planes),
    })


def _levels_of_part(lists: pa.Table, model: Model) -> pa.Table:
    """Some slices of the filter are built, and probed for the keys of each list; what is seen of them goes with the first list."""
    shift, part = 64 - (model.slices // TOGETHER_SLICES).bit_length() + 1, lists.column("part")[0].as_py()
    sizes = lists.column("n").to_pylist()
    front = np.uint64(part << shift if part else 0)
    own = [np.cumsum(_from_planes(x, n, PLAIN), dtype=np.uint64) | front for x, n in zip(lists.column("keys").to_pylist(), sizes)]
    counts = [_from_planes(x, n, 0) for x, n in zip(lists.column("counts").to_pylist(), sizes)]
    turned, where = np.unique(np.concatenate(own), return_inverse=True)
    n = np.bincount(where, np.concatenate(counts), len(turned)).astype(np.int64)
    keys, levels = _turned_back(turned, model.slices), np.zeros(len(turned), np.int64)
    number = model.slice_of(keys)
    begins = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
    for b, e in zip(begins, [*begins[1:], len(keys)]):
        learned = n[b:e] > 0
        bits = filter_slice(keys[b:e][learned], n[b:e][learned]).tobytes()
        levels[b:e] = Slices([(0, bits)], 1, len(bits)).levels(keys[b:e], np.zeros(e - b, np.int64))
    seen = _seen(keys[n > 0], n[n > 0])
    found = np.split(levels.astype(np.uint8)[where], np.cumsum(sizes)[:-1])
    return pa.table({
        "block": lists.column("block"), "part": lists.column("part"), "n": lists.column("n"), "levels": pa.array([_ZSTD.compress(x, asbytes=True) for x in found], pa.binary()),
        "seen": pa.array([seen, *[None] * (len(sizes) - 1)], pa.list_(pa.int64())),
    })


def _by_shuffle(docs: DataFrame, learn: Column, model: Model) -> DataFrame:
    """Columns of _SCORED with a filter of any size, which no task has whole.

    Texts are dealt to blocks by what is in them. A block sends its different keys to the parts of the filter in lists, each
    once, and gets their levels back as one byte each, in the lists' order; no key is stored with a row, and none comes back.
    The texts' shuffle and that of the levels are read twice in one plan, so both readers take all columns: else Spark would
    write each of them twice.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(LEAST_BLOCKS, size // BLOCK_BYTES)
    parts = model.slices // TOGETHER_SLICES
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"), block.alias("block")).repartition(blocks, "block")

    def lists(t: pa.Table) -> pa.Table:
        return _lists(t.column("text").combine_chunks(), t.column("learn").to_numpy(), shared.value, t.column("block")[0].as_py())

    sent = rows.groupBy("block").applyInArrow(lists, _LISTS).repartition(parts, "part")
    levels = sent.groupBy("part").applyInArrow(lambda t: _levels_of_part(t, shared.value), _LEVELS).repartition(blocks, "block")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * CLASSES, np.int64)
        for batch in batches:
            for x in batch.column("seen").drop_null().to_pylist():
                total += np.array(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "x"])

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("all").to_pylist():
                table = np.array([y["x"] for y in x], np.int64).reshape(4, CLASSES)
                yield pa.RecordBatch.from_arrays([pa.array([_back_off(table).tobytes()], pa.binary())], ["back"])

    summed = levels.mapInArrow(seen, "at int, x long").groupBy("at").agg(F.sum("x").alias("x"))
    back = summed.agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("all")).mapInArrow(weights, "back binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return to_arrow_schema(StructType.fromDDL(_SCORED)).empty_table()
        model = replace(shared.value, back_off=np.frombuffer(left.column("back")[0].as_py()))
        held = _levels_of_lists(right)
        p = Passage(left.column("text").combine_chunks(), model)
        keys = _keys_of_block(p, model)
        if len(keys) != len(held):
            raise RuntimeError("a block of texts has other n-grams than when the filter was built")
        return pa.Table.from_batches([_scored(left.column("doc_id").combine_chunks(), p, model, lambda own: held[np.searchsorted(keys, _turned(own, model.slices))])])

    return rows.join(F.broadcast(back)).groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(score, _SCORED)  # one row


def language_model_scores(docs: DataFrame, learn: Column, order: int = ORDER, common: int = COMMON, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row.

    learn: which rows the counts are of; a null is a no. Tokens are the words and an end, which a null or empty text
    has alone. base_score adds up log10((c + 0.1) / (N + 0.1 * (V + 1))) over the tokens, with exact counts: those of
    the commonest words go to all workers, the others' are joined. score is the interpolated n-gram model's, all of
    whose counts are levels found in a log-frequency Bloom filter of the n-grams of all learned rows. Rows that repeat
    an id or a text count and are scored each. Nothing learned: base_score and score are 0 for every text.
    An empty table gives no rows; other columns are ignored.
    """
    train = docs.where(F.coalesce(learn, F.lit(False)))
    words = keep(word_counts(train))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = Model(order, n, v, _common(words, common))
    while model.slices * SLICE_ROWS < n * order:
        model.slices *= 2
    # An n-gram that occurs c times stands at c levels at most.
    found = _by_broadcast(docs, train, words, model) if n * order * BITS // 8 <= filter_bytes else _by_shuffle(docs, learn, model)
    scored = keep(found.withColumn("row", F.monotonically_increasing_id()))
    asked = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    count = F.coalesce("n", F.lit(0))
    each = F.log10((count + PSEUDO) / (n + PSEUDO * (v + 1)))
    rest = asked.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("rest_known"), F.sum(F.col("times") * each).alias("rest_score")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("common_known") + zero("rest_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("common_score") + zero("rest_score")).alias("base_score"), "score",
    )


def scores(docs: DataFrame, fold: int = 10) -> DataFrame:
    """language_model_scores() with held_out: learned are the rows for which `fold` does not divide the CRC-32 of the id.

    Rows with a null id are held out.
    """
    held_out = F.coalesce(crc32_of_id() % fold == 0, F.lit(True))
    found = language_model_scores(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
