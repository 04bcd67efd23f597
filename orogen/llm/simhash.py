"""SimHash fingerprints of whole texts and near-duplicates among them by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import join_counted, keep, map_batches
from .components import components

SHINGLE_WORDS = 4
RADIUS = 4
BITS = 64
SEED = 42
#: Variants that a block holds on average, and those beyond which it is split by more leading bits.
BLOCK_VARIANTS, MOST_VARIANTS = 1_000_000, 4_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if set in over half of the XXH64 hashes of the text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)))) if len(found) >= words else [b" ".join(found)]
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    set_bits = np.zeros(BITS, np.int64)
    bits = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, len(bits), 4096):
        set_bits += np.unpackbits(bits[k : k + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash and the 64-bit fingerprint fp as a long. Null texts and texts without words have fingerprint 0."""

    def each(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, hashes, texts in batches:
            yield [ids, hashes, np.fromiter((simhash(t, words) for t in texts), np.uint64, len(texts)).view(np.int64)]

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(hashed, ["doc_id", "text_hash", "text"], each, "doc_id long, text_hash long, fp long")


def masks(bits: int, radius: int) -> np.ndarray:
    """All words of so many low bits with at most `radius` bits set."""
    one = [1 << k for k in range(bits)]
    return np.array([sum(c) for r in range(radius + 1) for c in combinations(one, r)], np.uint64)


def _meeting(block: pd.DataFrame, bits: int, half: int) -> pd.DataFrame:
    """Links among the fingerprints whose variants fall into one block.

    The block's variants share their leading bits, so the rest of a variant tells it. Those who share a
    variant are all within the radius of each other; each is linked with the first of them only, which
    keeps them connected.
    """
    low_bits = BITS - bits
    if len(block) < 2:
        return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
    fps = np.sort(block["fp"].to_numpy(np.int64).view(np.uint64))
    lead, low = (fps >> np.uint64(low_bits), fps & np.uint64((1 << low_bits) - 1)) if low_bits else (fps, np.zeros(len(fps), np.uint64))
    spent = np.bitwise_count(lead ^ block["block"].to_numpy(np.int64).view(np.uint64)[0])
    variants, owners = [], []
    for d in range(half + 1):
        own = np.flatnonzero(spent == d)
        flips = masks(low_bits, half - d)
        variants.append((low[own][:, None] ^ flips).ravel())
        owners.append(np.repeat(own.astype(np.int32), len(flips)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    del variants, owners
    ordered = np.sort(v)
    met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    none = pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
    if not len(met):
        return none
    at = np.searchsorted(met, v)
    hit = met[np.minimum(at, len(met) - 1)] == v
    at, o = at[hit], o[hit]
    first = np.full(len(met), len(fps), np.int64)
    np.minimum.at(first, at, o)
    pairs = np.unique(first[at] * len(fps) + o)
    a, b = pairs // len(fps), pairs % len(fps)
    true = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= 2 * half)
    return pd.DataFrame({"a": fps[a[true]].view(np.int64), "b": fps[b[true]].view(np.int64)})


def near_links(distinct: DataFrame, radius: int = RADIUS, count: int | None = None, most: int = MOST_VARIANTS) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp), enough to connect all within the radius.

    Every fingerprint stands for its variants: all words within half the radius. Two are within the radius
    just if they share a variant. Variants are dealt out by their leading bits; as most of a fingerprint's
    variants share these, it is sent once for each of the few leading parts that its variants have and the
    variants are spelled out where they meet. The number of leading bits follows the number of fingerprints.
    Near copies share leading bits: a block with more than `most` variants is dealt out again by more bits, in the
    end by whole variants, each of which has at most as many different fingerprints as the ball has words.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    n = distinct.count() if count is None else count
    ball = sum(math.comb(BITS, r) for r in range(half + 1))
    bits, links = min(24, max(8, math.ceil(math.log2(max(2, n * ball / BLOCK_VARIANTS))))), None
    sent = _dealt(distinct.select("fp", F.lit(0).cast("long").alias("block"), F.lit(0).alias("spent")), 0, bits, half)
    while True:
        left = BITS - bits
        weight = F.element_at(F.array(*(F.lit(sum(math.comb(left, r) for r in range(half - d + 1))) for d in range(half + 1))), F.col("spent") + 1)
        heavy = None
        if left:
            heavy = keep(sent.groupBy("block").agg(F.sum(weight.cast("long")).alias("n")).where(F.col("n") > most).select("block"))
            heavy = None if heavy.isEmpty() else heavy
        light = sent if heavy is None else sent.join(heavy, "block", "left_anti")
        if links is not None:  # most blocks of many leading bits hold one fingerprint and have nothing to compare
            light = light.join(light.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block"), "block", "left_semi")
        one = light.groupBy("block").applyInPandas(_block(bits, half), "a long, b long")
        links = one if links is None else links.unionByName(one)
        if heavy is None:
            return links.distinct()
        more = min(left, 16)
        sent = keep(_dealt(sent.join(heavy, "block"), bits, bits + more, half))
        bits += more


def _block(bits: int, half: int):
    return lambda block: _meeting(block, bits, half)


def _dealt(sent: DataFrame, bits: int, to: int, half: int) -> DataFrame:
    """Rows fp, block (leading bits of variants), spent (bits that differ there), dealt by more leading bits."""
    flips = F.array(*(F.struct(F.lit(int(m)).alias("flip"), F.lit(int(m).bit_count()).alias("d")) for m in masks(to - bits, half).astype(np.int64)))
    part = F.shiftrightunsigned("fp", BITS - to).bitwiseAND(F.lit((1 << (to - bits)) - 1))
    rows = sent.select("fp", "block", "spent", F.explode(flips).alias("x")).where(F.col("spent") + F.col("x.d") <= half)
    return rows.select("fp", F.shiftleft("block", to - bits).bitwiseOR(part.bitwiseXOR(F.col("x.flip"))).alias("block"), (F.col("spent") + F.col("x.d")).alias("spent"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, component_id, for every row: documents linked at `radius` or fewer differing bits, through others too.

    Equal fingerprints are one node, so groups of copies of any size cost one node each; component_id is
    the smallest doc_id of all that can be reached. Texts without words have fingerprint 0 and link like any.
    Rows with a null doc_id keep their fingerprint and take part like others; minima pass over nulls. Rows that
    repeat a doc_id are rows like others. An empty table gives no rows; other columns are ignored.
    """
    own = keep(fingerprints(docs, words))
    return _in_components(own, radius).select("doc_id", "fp", "component_id")


def _in_components(own: DataFrame, radius: int) -> DataFrame:
    """Rows doc_id, text_hash, fp with component_id and first, the component's least (doc_id, nulls last; text_hash)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = keep(own.groupBy("fp").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")))
    labels = components(near_links(distinct.select("fp"), radius))
    nodes = keep(
        distinct.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))
    )
    least = nodes.groupBy("label").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("fps"))
    ids = keep(join_counted(nodes.select("fp", "label", "n"), least, "label", nodes.count(), "fps").select("fp", "n", "first"))
    return join_counted(own, ids, "fp", own.count()).select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), "first")


def one_of_each(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """The documents without those that are near-duplicates of an earlier one; columns as given.

    The first of a group is that with the smallest doc_id, null ids last, then by a hash of the text. Of rows
    with one doc_id (or none) and one text one stays.
    """
    rows = _in_components(keep(fingerprints(docs, words)), radius)
    here = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("text_hash") == F.col("first.text_hash"))
    leaders = rows.where(here).groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("_rows"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_text"))
    joined = whole.join(keep(leaders), F.col("_own").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash")))
    once = joined.where("_rows = 1").select("_row")
    return once.unionByName(joined.where("_rows > 1").dropDuplicates(["_doc", "_hash"]).select("_row")).select("_row.*")
