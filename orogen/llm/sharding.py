"""Shards of nearly equal bytes: the minimax contiguous partition of ordered groups of equal texts."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import keep, numbered

SHARDS = 40
OVERHEAD = 16
#: Rows of a summary that go to the driver at once, at most.
SUMMARY_ROWS = 60_000


def digests(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, group: one row for each row of docs. Null and empty texts are two groups."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("-")).alias("group"),
    )


def with_ends(groups: DataFrame) -> DataFrame:
    """Add the running sum `end` over the groups in order, by buckets of the group's first hexadecimal digits."""
    bucketed = groups.withColumn("_bucket", F.substring("group", 1, 4))
    sums = bucketed.groupBy("_bucket").agg(F.sum("bytes").alias("_sum"))
    # One row for each of at most 65,537 buckets, whatever the input.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_bucket").orderBy("group")
    return bucketed.join(starts, "_bucket").select("group", "bytes", (F.col("_start") + F.sum("bytes").over(within)).alias("end"))


class Ends:
    """What the driver knows of the sorted group ends: buckets, each with its first and last end.

    Where a bucket holds several ends, those between are not known yet; then a lookup gives bounds.
    """

    def __init__(self, rows: list[tuple[int, int]]):
        self.first, self.last = [r[0] for r in rows], [r[1] for r in rows]

    def at_most(self, x: int) -> tuple[int, int]:
        """Bounds of the greatest end <= x (0 if none)."""
        i = bisect_right(self.first, x) - 1
        if i < 0:
            return 0, 0
        if self.last[i] <= x:
            return self.last[i], self.last[i]
        return self.first[i], min(x, self.last[i])

    def greedy(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Lower and upper bounds of the cuts when each shard takes all that fits."""
        low, high, lows, highs = 0, 0, [], []
        for _ in range(shards):
            low, high = self.at_most(low + capacity)[0], self.at_most(high + capacity)[1]
            lows.append(low)
            highs.append(high)
        return lows, highs


def minimax_cuts(groups: DataFrame, total: int, largest: int, shards: int, summary_rows: int = SUMMARY_ROWS, capacity: int | None = None) -> tuple[int, list[int]]:
    """The smallest capacity with which the ordered groups fit into the shards, and the cuts (ends) it gives; or the cuts of a given one.

    Binary search over capacities with a greedy check of each. The driver holds a summary of the ends, not
    the ends: first equal buckets over the whole range. The bounds that they give leave a small range of
    capacities, and so a small window for each cut; only these windows are summarised again, finer, until
    the greedy cuts are certain. Each round is one aggregation with at most `summary_rows` result rows.
    """
    if total == 0:
        return 0, [0] * shards
    low, high = (max(largest, -(-total // shards)), -(-total // shards) + largest) if capacity is None else (capacity, capacity)
    windows = [(0, total)]
    rows: list[tuple[int, int]] = []
    while True:
        share = max(1, summary_rows // len(windows))
        widths = [max(1, -(-(b - a) // share)) for a, b in windows]
        bucket = F.lit(None).cast("string")
        for i, ((a, b), width) in enumerate(zip(windows, widths)):
            inside = (F.col("end") > a) & (F.col("end") <= b)
            bucket = F.when(inside, F.concat_ws(":", F.lit(i), F.expr(f"(end - {a} - 1) div {width}"))).otherwise(bucket)
        found = groups.withColumn("_b", bucket).where("_b is not null").groupBy("_b").agg(F.min("end").alias("f"), F.max("end").alias("l"))
        fresh = [(r["f"], r["l"]) for r in found.collect()]
        rows = sorted([r for r in rows if not any(a < r[0] and r[1] <= b for a, b in windows)] + fresh)
        ends = Ends(rows)
        # The least capacity that may do, by the upper bounds, and the least that surely does, by the lower ones.
        may, sure = low, high
        lo, hi = low, high
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ends.greedy(mid, shards)[1][-1] >= total else (mid + 1, hi)
        may = lo
        lo, hi = may, high
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ends.greedy(mid, shards)[0][-1] >= total else (mid + 1, hi)
        sure = lo
        low, high = may, sure
        lows, highs = ends.greedy(low, shards)[0], ends.greedy(high, shards)[1]
        if low == high and lows == highs:
            return low, lows
        windows = []
        for i in range(shards):
            # Whole buckets: the window of a cut runs from the first bucket that it may be in to the last.
            a = bisect_right(ends.first, lows[i]) - 1
            b = bisect_right(ends.first, highs[i]) - 1
            a, b = max(a, 0), max(b, 0)
            window = (ends.first[a] - 1, ends.last[b])
            if windows and window[0] < windows[-1][1]:
                windows[-1] = (windows[-1][0], max(window[1], windows[-1][1]))
            else:
                windows.append(window)


def even_cuts(groups: DataFrame, total: int, capacity: int, cuts: list[int], shards: int, summary_rows: int = SUMMARY_ROWS) -> list[int]:
    """Cuts near to equal parts that keep every shard within the capacity (`cuts`: the greedy ones, the farthest that do).

    Greedy filling leaves all slack to the last shards. The greedy cuts from the other end are the nearest ones
    that do; between both, each cut has the ends around its equal part to choose from, and of all chains within
    the capacity that with the least squared distance to equal parts is taken.
    """
    if total == 0 or shards == 1:
        return cuts
    back = groups.select((total - F.col("end") + F.col("bytes")).alias("end"))
    nearest = [total - c for c in reversed(minimax_cuts(back, total, capacity, shards, summary_rows, capacity)[1][:-1])]
    targets = [total * (k + 1) // shards for k in range(shards - 1)]
    around = groups.agg(*(x for t in targets for x in (F.max(F.when(F.col("end") <= t, F.col("end"))), F.min(F.when(F.col("end") > t, F.col("end")))))).first()
    best: dict[int, tuple[int, tuple[int, ...]]] = {0: (0, ())}
    for k, t in enumerate(targets):
        options = {x for x in (around[2 * k], around[2 * k + 1], nearest[k], cuts[k]) if x is not None and nearest[k] <= x <= cuts[k]}
        best = {
            x: min((cost + (x - t) ** 2, (*chain, x)) for at, (cost, chain) in best.items() if 0 <= x - at <= capacity)
            for x in options
            if any(0 <= x - at <= capacity for at in best)
        }
    return [*min(v for at, v in best.items() if total - at <= capacity)[1], total]


def shard_documents(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, summary_rows: int = SUMMARY_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Law `bytes`: equal texts stay together, and the bytes of the fullest shard are the least possible. Groups
    over an equal share (fewer than there are shards) come first in order and have a shard each; the others
    follow in order of their hash; no shard of these exceeds the smallest feasible capacity, and within it they
    are cut as near to equal parts as that allows. Slots number a
    shard's rows from 0 in salted parts, so a group that holds most rows is not numbered by one task.
    Empty tables give no rows; null texts are a group of their own. grown_shard is null under this law.
    """
    own = keep(digests(docs, overhead))
    groups = own.groupBy("group").agg(F.sum("size").alias("bytes"))
    groups = keep(groups)
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    # At most as many groups as shards can be over an equal share of what is left.
    large, free = [], shards
    for r in groups.orderBy(F.desc("bytes"), "group").limit(shards - 1).collect():
        if r["bytes"] * free <= left or free == 1:
            break
        large.append(r["group"])
        left, free = left - r["bytes"], free - 1
    rest = groups.where(~F.col("group").isin(large)) if large else groups
    rest = keep(with_ends(rest))
    largest = rest.agg(F.max("bytes")).first()[0] or 0
    capacity, cuts = minimax_cuts(rest, left, largest, free, summary_rows)
    cuts = even_cuts(rest, left, capacity, cuts, free, summary_rows)
    inner = sorted(set(cuts[:-1]))
    starts = {r["end"]: r["group"] for r in rest.where(F.col("end").isin(inner)).collect()} if inner else {}
    # A shard begins after the group that ends at its cut; a cut at 0 or repeated leaves a shard empty.
    lasts = [starts.get(c, "") for c in cuts[:-1]]
    after = F.lit(len(large))
    for last in lasts:
        after = after + (F.col("group") > F.lit(last)).cast("int")
    shard = after
    for i, group in enumerate(large):
        shard = F.when(F.col("group") == group, F.lit(i)).otherwise(shard)
    placed = own.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"))
    slotted = numbered(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
