"""Repeated passages inside documents: MinHash of sliding paragraphs, exact Jaccard of whole passages, components.

Paragraphs collide first by one MinHash each. Whatever of a document collides with others and is no repeat of the
first of them is looked at again: by the next document that is left for its key, and by its whole paragraphs of as many
words as a passage has, so that an exact repeat is found whoever else has parts of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import in_small_batches, join_counted, keep, map_batches
from .components import components
from .spans import aligned_from, hopeful, run, shingle_hashes, shingles

SIMILARITY = 0.8
#: Words of a passage at least. Shorter pieces that documents share (phrases, licence lines, quotations) are left alone.
LEAST_WORDS = 40
#: Words of a paragraph and of the shingles that its MinHash is taken from. Each word that differs costs a passage
#: five shingles of five words, so passages of 49 words or more that are alike at 0.8 agree in 25 words somewhere,
#: and shorter ones in all: one band of one row finds them all.
PARAGRAPH_WORDS, KEY_WORDS = 25, 8
#: Starts of whole paragraphs (of as many words as a passage has) of which one at least is keyed: of each passage
#: of LEAST_WORDS + STARTS - 1 = 51 words that two documents share, both key the same paragraph.
STARTS = 12
#: Words of the earlier document around the places where keys met, besides a quarter of the words between these: what is
#: alike at 0.8 differs in less. Bounds are multiples of STEP, so that copies of a passage ask for the same words.
CONTEXT, STEP = 64, 32
#: Earlier passages, or ranges of a document, that meet in one row; more are dealt to further rows with the same text.
PORTION = 64
SLOTS = 1 << 20
_WORD = re.compile(r"\w+")
#: Signs that belong to no word: those beyond ASCII, and the bytes below.
_NO_WORDS = re.compile(r"[^\w\x00-\x7F]+")
_SPACED = bytes(k if k > 127 or _WORD.match(chr(k)) else 32 for k in range(256))
_ODD = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NO_SPANS = "array<struct<start:int,end:int,keeper_doc:long,keeper_start:int,keeper_end:int,similarity:double,own:long,other:long>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """32 bits for each word of the lower-cased text."""
    from xxhash import xxh32_intdigest

    low = text.lower() if text else ""
    if not low.isascii():
        low = _NO_WORDS.sub(" ", low)
    words = low.encode().translate(_SPACED).split()  # those that _WORD finds
    return np.fromiter(map(xxh32_intdigest, words), np.uint32, len(words))


def key_hashes(h: np.ndarray) -> np.ndarray:
    """One hash for each run of KEY_WORDS words."""
    n = len(h) - KEY_WORDS + 1
    if n < 1:
        return np.zeros(0, np.int64)
    wide, joined = h.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    for k in range(KEY_WORDS):
        joined += wide[k : k + n] * _ODD[k]
    return _mixed(_mixed(joined)).view(np.int64)


def _longer(g: np.ndarray, words: int) -> np.ndarray:
    """One hash for each run of so many words, KEY_WORDS at least, from the hashes of the shorter runs that make it up."""
    n = len(g) + KEY_WORDS - words
    if n < 1:
        return np.zeros(0, np.int64)
    joined = np.zeros(n, np.uint64)
    for k, at in enumerate([*range(0, words - KEY_WORDS, KEY_WORDS), words - KEY_WORDS]):
        joined += g.view(np.uint64)[at : at + n] * _ODD[k % len(_ODD)]
    return _mixed(joined).view(np.int64)


def band_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different MinHashes of a text's paragraphs (all runs of PARAGRAPH_WORDS words) and where each stands first.

    The MinHash is the least hash of the paragraph's runs of KEY_WORDS words. Neighbours mostly share it, so there
    are about two for each 19 words. It depends on the paragraph alone, wherever the text has it.
    """
    return _least_of_windows(key_hashes(h), PARAGRAPH_WORDS - KEY_WORDS + 1)


def _least_of_windows(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different minima of all windows of this width and the first place of each; the windows double in width."""
    if len(g) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, w = g, 1
    while 2 * w <= width:
        least, w = np.minimum(least[:-w], least[w:]), 2 * w
    least = np.minimum(least[: len(g) - width + 1], least[width - w :])
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    keys, first = np.unique(least[starts], return_index=True)
    starts = starts[first]
    return keys, starts + (g[starts[:, None] + np.arange(width)] == keys[:, None]).argmax(axis=1)


def paragraph_keys(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """key, doc_id, place (first word) of every document of `least` words or more; a key once for each document."""

    def each(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts in batches:
            keys, places, counts = [], [], []
            for text in texts:
                h = word_hashes(text)
                k, at = band_keys(h) if len(h) >= least else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                keys.append(k)
                places.append(at)
                counts.append(len(k))
            yield [np.concatenate(keys), np.repeat(np.array(ids, np.int64), counts), np.concatenate(places).astype(np.int32)] if ids else [[], [], []]

    return map_batches(docs.where("doc_id is not null"), ["doc_id", "text"], each, "key long, doc_id long, place int")


def meetings(keys: DataFrame) -> DataFrame:
    """key, doc_id, place, keeper_doc, keeper_place: the keys that several documents have, and the first of these documents.

    A passage that n documents have costs n rows for each of its keys. Counts are combined before they are shuffled,
    and very common keys are joined by broadcast.
    """
    firsts = keys.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = keep(firsts.select("key", F.col("k.doc_id").alias("keeper_doc"), F.col("k.place").alias("keeper_place"), "n"))
    return join_counted(keys.select("key", "doc_id", "place"), named, "key", keys.count()).select("key", "doc_id", "place", "keeper_doc", "keeper_place")


def asked_ranges(met: DataFrame, words: int | None = None) -> DataFrame:
    """doc_id, keeper_doc, lo, hi, own: each document that met a keeper, and the keeper's words in question.

    own: the keys at which they met, the only ones to start from, so that a document tries each of its places once
    however many keepers it has; null if whole paragraphs of so many words met, for any key around them.
    """
    own = F.collect_set("key") if words is None else F.lit(None).cast("array<long>")
    pairs = met.where("doc_id <> keeper_doc").groupBy("doc_id", "keeper_doc").agg(
        F.min("keeper_place").alias("lo"), (F.max("keeper_place") + (words or KEY_WORDS)).alias("hi"), own.alias("own")
    )
    around = CONTEXT + (F.col("hi") - F.col("lo")) / 4
    lo = F.greatest(F.lit(0), F.floor((F.col("lo") - around) / STEP) * STEP)
    hi = F.ceil((F.col("hi") + around) / STEP) * STEP
    return pairs.select("doc_id", "keeper_doc", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), "own")


def whole_paragraph_keys(docs: DataFrame, holders: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """key, doc_id, place: whole paragraphs of `least` words around the given keys (doc_id, key) of documents.

    The least hash of each STARTS paragraphs in a row is a key, as long as it lies in reach of a place of a given one.
    """
    own = holders.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("key").alias("_held"))
    texts = _asked(docs, holders, "doc_id").select("doc_id", "text").join(own, F.col("doc_id") == F.col("_doc"))

    def each(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts, wanted in batches:
            keys, places, counts = [], [], []
            for text, held in zip(texts, wanted):
                h = word_hashes(text)
                short = key_hashes(h)
                g, near = _longer(short, least), np.flatnonzero(np.isin(short, np.array(held, np.int64)))
                k, at = _least_of_windows(g, min(STARTS, max(1, len(g))))
                after = np.searchsorted(near, at - least - STARTS)
                close = np.append(near, np.iinfo(np.int64).max)[after] <= at + 2 * least + STARTS
                keys.append(k[close])
                places.append(at[close])
                counts.append(int(close.sum()))
            yield [np.concatenate(keys), np.repeat(np.array(ids, np.int64), counts), np.concatenate(places).astype(np.int32)] if ids else [[], [], []]

    return map_batches(texts, ["doc_id", "text", "_held"], each, "key long, doc_id long, place int")


def _slot(c: str) -> F.Column:
    return F.pmod(F.xxhash64(F.col(c)), F.lit(SLOTS)).cast("int")


def _asked(docs: DataFrame, wanted: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """The documents that are wanted, and few others: those of which no id shares a slot go before texts are shuffled.

    The slots are a broadcast of bounded size; where most of them are taken, nothing is saved and nothing lost.
    """
    slots = wanted.select(_slot(column).alias("_slot")).distinct()
    return docs.join(F.broadcast(slots), _slot("doc_id") == F.col("_slot"), how)


def verified(docs: DataFrame, pairs: DataFrame, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, spans: the passages of each document that its keepers have too, checked word by word.

    The keepers' words in question are sent to the other documents, once for all that ask for the same range.
    There every key at which they met is a place to start from; from it both texts are followed to both sides as long
    as they are alike, and the passage counts if it has `least` words and its five-word shingles the similarity.
    """
    def portions(rows: DataFrame, by: str, *order: str) -> DataFrame:
        return rows.withColumn("_portion", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / PORTION))

    asked_of = portions(pairs.select("keeper_doc", "lo", "hi").distinct(), "keeper_doc", "lo", "hi")
    ranges = asked_of.groupBy("keeper_doc", "_portion").agg(F.collect_list(F.struct("lo", "hi")).alias("_ranges"))
    sources = _asked(docs, pairs, "keeper_doc").select("doc_id", "text").join(ranges, F.col("doc_id") == F.col("keeper_doc")).select("doc_id", "text", "_ranges")

    def read(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts, asked in batches:
            rows = []
            for d, text, some in zip(ids, texts, asked):
                h = word_hashes(text)
                rows += [(d, r["lo"], r["hi"], h[r["lo"] : r["hi"]].tobytes()) for r in some]
            yield [list(c) for c in zip(*rows)] or [[]] * 4

    words = map_batches(sources, ["doc_id", "text", "_ranges"], read, "keeper_doc long, lo int, hi int, words binary")
    met = portions(pairs, "doc_id", "keeper_doc", "lo", "hi").join(words, ["keeper_doc", "lo", "hi"])
    got = met.groupBy(F.col("doc_id").alias("_doc"), "_portion").agg(F.array_sort(F.collect_list(F.struct("keeper_doc", "lo", "words", "own"))).alias("_asked"))
    texts = _asked(docs, pairs, "doc_id").select("doc_id", "text").join(got, F.col("doc_id") == F.col("_doc"))

    def align(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, hashes, every, asked in batches:
            yield [ids, hashes, [passages(word_hashes(t), a, least, similarity) for t, a in zip(every, asked)]]

    rows = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "_asked")
    return map_batches(rows, ["doc_id", "text_hash", "text", "_asked"], align, f"doc_id long, text_hash long, spans {_NO_SPANS}").where("size(spans) > 0")


def _is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are among the known ones, which are in order."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def passages(x: np.ndarray, asked: list[dict], least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> list[dict]:
    """The passages that word sequence x shares with the words of its keepers.

    Nothing is followed from places of which the shingles that both have show that it comes to no passage.
    """
    g, own_shingles, known, out = key_hashes(x), shingles(x), shingle_hashes(x), []
    for one in asked:
        y, lo, found = np.frombuffer(one["words"], np.uint32), one["lo"], []
        hope_y = hopeful(_is_in(shingles(y), known), least, similarity)
        if not hope_y.any():
            continue
        gy, hope_x = key_hashes(y), hopeful(_is_in(own_shingles, shingle_hashes(y)), least, similarity)
        if one["own"] is None:
            keys, at = band_keys(y)
        else:
            met = np.flatnonzero(np.isin(gy, np.array(one["own"], np.int64)))
            keys, first = np.unique(gy[met], return_index=True)
            at = met[first]
        keys, at = keys[hope_y[at]], at[hope_y[at]]
        own = np.flatnonzero(_is_in(g, keys) & hope_x[: len(g)])
        places = zip(own.tolist(), at[np.searchsorted(keys, g[own])].tolist())
        tried: dict[int, int] = {}  # for each shift between the two the end of what was followed to no passage
        covered = bytearray(len(x))  # places of which the words lie in a passage
        for i, j in places:
            if covered[i] or i < tried.get(i - j, 0):
                continue
            a, b, c, d, like = aligned_from(x, y, i, j, KEY_WORDS, similarity, least)
            tried[i - j] = i + KEY_WORDS + run(x[i + KEY_WORDS :], y[j + KEY_WORDS :])
            if b - a >= least and like >= similarity:
                found.append((a, b, c + lo, d + lo, like, int(g[a : b - KEY_WORDS + 1].min()), int(gy[c : max(c + 1, d - KEY_WORDS + 1)].min())))
                covered[a : b - KEY_WORDS + 1] = b"\1" * (b - KEY_WORDS + 1 - a)
        names = ("start", "end", "keeper_start", "keeper_end", "similarity", "own", "other")
        out += [dict(zip(names, f)) | {"keeper_doc": one["keeper_doc"]} for f in found]
    return out


def unresolved(met: DataFrame, found: DataFrame) -> DataFrame:
    """key, doc_id, place of the meetings with an earlier document that no passage found so far covers."""
    spans = found.groupBy(F.col("doc_id").alias("_doc")).agg(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"], s["end"])))).alias("_spans"))
    covered = F.exists("_spans", lambda s: (s["start"] <= F.col("place")) & (F.col("place") + KEY_WORDS <= s["end"]))
    rows = met.where("doc_id <> keeper_doc").join(spans, F.col("doc_id") == F.col("_doc"), "left")
    return rows.where(~F.coalesce(covered, F.lit(False))).select("key", "doc_id", "place")


def shared_passages(docs: DataFrame, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, start, end, keeper_doc, keeper_start, keeper_end, similarity, component for each passage that an earlier document has.

    A key's documents meet the first that has it; those which turn out to repeat none of its passages there meet the
    first of the rest, and all that share such a key key their whole paragraphs around it, too. A passage's class is
    the least key in it, which copies share; near copies of other classes are linked, and the components of these
    links name the groups.
    """
    met = keep(meetings(keep(paragraph_keys(docs, least))))
    first = keep(verified(docs, keep(asked_ranges(met)), least, similarity))
    left = keep(unresolved(met, first))
    again = meetings(left)
    holders = met.join(left.select("key").distinct(), "key", "left_semi").select("doc_id", "key")
    whole = meetings(keep(whole_paragraph_keys(docs, holders, least)))
    more = asked_ranges(again).unionByName(asked_ranges(whole, least)).distinct()
    spans = first.unionByName(keep(verified(docs, keep(more), least, similarity)))
    rows = spans.select("doc_id", "text_hash", F.explode("spans").alias("s")).select("doc_id", "text_hash", "s.*")
    labels = components(rows.select(F.col("own").alias("a"), F.col("other").alias("b")))
    named = labels.select(F.col("node").alias("own"), F.col("label").alias("_label"))
    return rows.join(named, "own", "left").withColumn("component", F.coalesce("_label", "own")).drop("own", "other", "_label")


def repeated_passages(docs: DataFrame, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document with passages of `least` words or more that other documents repeat, nearly too.

    doc_id; components, the groups of its repeated passages; n_removed, the passages whose keeper is another
    document; other_docs, the keepers' ids in order; spans, the word ranges (start, end) to remove. A document
    that only keeps what others repeat has n_removed 0 and itself no other_docs. The keeper of a key is the
    document with the smallest doc_id that has it. All exact repeats of LEAST_WORDS + STARTS - 1 words are found; a near
    one is not if all its keys stand in two earlier documents that repeat no passage around them.

    Null, empty and short texts, and documents that share nothing, are not in the result, nor are rows with a null
    doc_id. Rows with one doc_id count as one document. An empty table gives no rows; other columns are ignored.
    """
    found = keep(shared_passages(docs, least, similarity))
    sides = found.select("doc_id", "component").unionByName(found.select(F.col("keeper_doc").alias("doc_id"), "component")).distinct()
    groups = sides.groupBy("doc_id").agg(F.array_sort(F.collect_list("component")).alias("components"))
    own = found.groupBy("doc_id").agg(
        F.count_distinct("start", "end").cast("int").alias("n_removed"),
        F.array_sort(F.collect_set("keeper_doc")).alias("other_docs"),
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
    )
    empty = {"n_removed": F.lit(0), "other_docs": F.array().cast("array<long>"), "spans": F.array().cast("array<struct<start:int,end:int>>")}
    return groups.join(own, "doc_id", "left").withColumns({c: F.coalesce(c, x) for c, x in empty.items()})


def cut_passages(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without these word ranges; what stood around them stays."""
    spans = [m.span() for m in _WORD.finditer(text.lower())] if len(text.lower()) == len(text) else _spans_of(text)
    out, at = [], 0
    for a, b in sorted(ranges):
        if a < len(spans):
            out.append(text[at : max(at, spans[a][0])])
            at = max(at, spans[min(b, len(spans)) - 1][1])
    out.append(text[at:])
    return "".join(out)


def _spans_of(text: str) -> list[tuple[int, int]]:
    """Places in the text of the words of its lower-cased form, where that is longer."""
    origin = [k for k, ch in enumerate(text) for _ in ch.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _WORD.finditer("".join(ch.lower() for ch in text))]


def without_repeats(docs: DataFrame, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, repeated passages removed from all but the first that has them; columns as given.

    A document of which no word is left goes; n_chars, where there is such a column, is counted anew. Only rows
    with the very text that was compared are cut; rows with a null doc_id stay as they are, null texts too.
    """
    spans = shared_passages(docs, least, similarity).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("_cuts"))
    cuts = keep(spans.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_cuts"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else cut_passages(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)], dtype=object)

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = in_small_batches(docs).select(whole, F.col("doc_id"), F.xxhash64("text").alias("_h"))
    asked, rest = _asked(rows, cuts, "_doc"), _asked(rows, cuts, "_doc", "left_anti")
    joined = asked.join(cuts, (F.col("doc_id") == F.col("_doc")) & (F.col("_h") == F.col("_hash")), "left")
    changed = F.when(F.col("_cuts").isNull(), F.col("_row.text")).otherwise(cut("_row.text", "_cuts"))
    new = joined.select("_row", "_cuts", changed.alias("_text")).where("_cuts is null or _text rlike '\\\\w'")
    text = F.struct(*(_replaced(c) for c in docs.columns)).alias("_row")
    return rest.select("_row").unionByName(new.select(text)).select("_row.*")


def _replaced(column: str) -> F.Column:
    own = F.col(f"_row.`{column}`")
    if column == "text":
        return F.col("_text").alias(column)
    if column == "n_chars":
        return F.when(F.col("_cuts").isNull(), own).otherwise(F.char_length("_text").cast("long")).alias(column)
    return own.alias(column)
