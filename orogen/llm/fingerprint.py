"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import keep

#: Cells of each of the three subtables of a fingerprint.
BASE_CELLS = 8
#: Passes over the subtables, one subtable at a time, before a sketch counts as stuck and a larger one is tried.
PASSES = 12
#: Quantiles of the ids, equal parts of each, and parts of an id that holds more than a quantile's rows.
QUANTILES, PARTS, SALTS = 256, 64, 64
#: Documents that a part should hold, and cells that a partition should.
PART_ROWS, PARTITION_CELLS = 20_000, 4_000_000

OWN, EDITED, NEXT = 0, 1, 2


def paragraph_keys(text: str) -> Column:
    """The digests of the distinct paragraphs of a text column.

    A paragraph is what lies between line ends or after a full stop and white space, so that documents of
    one line have parts too. Blank ones are left out.
    """
    return F.expr(rf"array_distinct(transform(filter(split({text}, '\\n+|(?<=\\.)\\s+'), p -> p <> ''), p -> xxhash64(p)))")


def place(key: Column, table: int | Column, cells: Column, level: int) -> Column:
    """The cell of a subtable that a digest has; another one at each level."""
    return F.xxhash64(F.lit(2), F.lit(level), table if isinstance(table, Column) else F.lit(table), key).bitwiseAND(cells - 1)


def check_of(key: Column) -> Column:
    return F.xxhash64(F.lit(1), key)


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    """Cells: the number of keys put there, and the exclusive or of their digests and of their checks; empty ones go."""
    cells = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return cells.where("n <> 0 or k <> 0 or c <> 0")


def sketches(keys: DataFrame, level: int = 0) -> DataFrame:
    """Cells rid, version, cells, slot (subtable), place, n, k, c of the digests k of each row's version (rid, version, cells, k)."""
    spread = keys.select("rid", "version", "cells", "k", F.explode(F.array(*(F.lit(t) for t in range(3)))).alias("slot"))
    cells = spread.select("rid", "version", "cells", "slot", place(F.col("k"), F.col("slot"), F.col("cells"), level).alias("place"), F.lit(1).alias("n"), "k", check_of(F.col("k")).alias("c"))
    return _summed(cells, "rid", "version", "cells", "slot", "place")


def subtracted(cells: DataFrame) -> DataFrame:
    """The own version's sketch minus that of each other version (sketches are linear): version is the other one."""
    minus = F.when(F.col("version") == OWN, F.lit(1)).otherwise(-1)
    against = F.when(F.col("version") == OWN, F.array(F.lit(EDITED), F.lit(NEXT))).otherwise(F.array("version"))
    rows = cells.select("rid", "cells", "slot", "place", (F.col("n") * minus).alias("n"), "k", "c", F.explode(against).alias("version"))
    return _summed(rows, "rid", "version", "cells", "slot", "place")


def peeled(cells: DataFrame, level: int, passes: int = PASSES) -> DataFrame:
    """rid, version, found (digests that differ) and stuck (cells left) of subtracted sketches; equal ones have no row.

    Each pass takes one subtable. A digest has one cell there, so none is recovered twice: a pure cell is replaced
    by its removal from the two other subtables, and by one more in the count at place -1.
    """
    for step in range(passes):
        table = step % 3
        others = [(table + 1) % 3, (table + 2) % 3]
        pure = (F.col("slot") == table) & (F.col("place") >= 0) & (F.abs("n") == 1) & (check_of(F.col("k")) == F.col("c"))
        cell = lambda slot, at, n, k, c: F.struct(F.lit(slot).alias("slot") if isinstance(slot, int) else slot, at.alias("place"), n.alias("n"), k.alias("k"), c.alias("c"))
        zero = F.lit(0).cast("long")
        gone = [cell(t, place(F.col("k"), t, F.col("cells"), level), -F.col("n"), F.col("k"), F.col("c")) for t in others]
        found = cell(0, F.lit(-1).cast("long"), F.lit(1).cast("long"), zero, zero)
        own = cell(F.col("slot"), F.col("place"), F.col("n"), F.col("k"), F.col("c"))
        rows = cells.select("rid", "version", "cells", F.explode(F.when(pure, F.array(*gone, found)).otherwise(F.array(own))).alias("x"))
        cells = _summed(rows.select("rid", "version", "cells", "x.*"), "rid", "version", "cells", "slot", "place")
    return cells.groupBy("rid", "version").agg(
        F.sum(F.when(F.col("place") < 0, F.col("n")).otherwise(0)).alias("found"), F.sum((F.col("place") >= 0).cast("int")).alias("stuck")
    )


def as_strings(cells: DataFrame) -> DataFrame:
    """rid, fingerprint, edited_fingerprint: the cells that are not empty, in order."""
    text = F.concat_ws(".", F.col("slot"), F.col("place"), F.col("n"), F.lower(F.hex("k")), F.lower(F.hex(F.col("c").bitwiseAND(F.lit(0xFFFFFFFF)))))
    rows = cells.select("rid", "version", F.struct("slot", "place", text.alias("text")).alias("cell"))
    strings = lambda version: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("version") == version, F.col("cell")))), lambda x: x["text"]), " ")
    return rows.groupBy("rid").agg(strings(OWN).alias("fingerprint"), strings(EDITED).alias("edited_fingerprint"))


def _places_in_order(docs: DataFrame, quantiles: int, part_rows: int) -> Column | None:
    """The bucket of a row, rising as doc_id falls; None for an empty table.

    Quantiles part the rows evenly however the ids lie; each is cut into equal ranges of ids. An id (or null)
    that takes more than a quantile is cut by the rank of the text's hash instead.
    """
    shares = [k / quantiles for k in range(quantiles + 1)]
    seen = docs.agg(F.percentile_approx("doc_id", shares, 100 * quantiles).alias("cuts"), F.count(F.lit(1)).alias("n")).first()
    if not seen["n"]:
        return None
    cuts = sorted(seen["cuts"] or [], reverse=True)
    heavy = {a for a, b in zip(cuts, cuts[1:]) if a == b}
    edges = sorted(set(cuts), reverse=True)
    parts = max(1, min(PARTS, seen["n"] // max(1, part_rows * max(1, len(edges)))))
    width, salt = max(PARTS, SALTS), F.shiftrightunsigned("_h", 58).cast("long")

    def within(number: int, top: int | None, bottom: int | None) -> Column:
        if parts == 1 or top is None or bottom is None:
            return F.lit(number * width).cast("long")
        return number * width + F.least(F.lit(parts - 1), F.expr(f"(cast({top} as decimal(20,0)) - doc_id) div {max(1, -(-(top - bottom) // parts))}"))

    def search(low: int, high: int) -> Column:
        """Bucket 2 k holds the ids from below edge k - 1 down to edge k, 2 k + 1 edge k itself where it is heavy."""
        if low == high:
            return within(2 * low, edges[low - 1] if low else None, edges[low] if low < len(edges) else None)
        mid = (low + high) // 2
        right = search(mid + 1, high)
        left = search(low, mid)
        if edges[mid] in heavy:
            return F.when(F.col("doc_id") == edges[mid], (2 * mid + 1) * width + salt).when(F.col("doc_id") > edges[mid], left).otherwise(right)
        return F.when(F.col("doc_id") >= edges[mid], left).otherwise(right)

    last = (2 * len(edges) + 1) * width
    return F.when(F.col("doc_id").isNull(), last + salt).otherwise(search(0, len(edges)))


def with_next(docs: DataFrame, quantiles: int = QUANTILES, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, text, next_text: the text of the next document in descending doc_id (after the last: the first).

    Rows with the same or a null doc_id follow each other in order of their texts' hashes, null ids last. Rows
    move once, to buckets in order; the first row of each bucket is also sent to the end of the bucket before.
    The buckets' first rows (ids and hashes, at most some ten thousand whatever the input) pass the driver.
    """
    spark = docs.sparkSession
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1)).alias("_r"))
    bucket = _places_in_order(docs, quantiles, part_rows)
    if bucket is None:
        return docs.select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
    keyed = hashed.withColumn("_b", bucket)
    firsts = sorted((r["_b"], r["f"]["_r"], r["f"]["_h"]) for r in keyed.groupBy("_b").agg(F.min(F.struct("_r", "_h")).alias("f")).collect())
    sent = [(*first, firsts[k - 1][0]) for k, first in enumerate(firsts)]
    wanted = spark.createDataFrame(sent, "_b long, _r long, _h long, _to long")
    # One row for each bucket: bounded by the numbers of quantiles and parts.
    ghosts = keyed.join(F.broadcast(wanted), ["_b", "_r", "_h"]).groupBy("_to").agg(F.min("text").alias("text"))
    whole = keyed.select("_b", F.lit(False).alias("_ghost"), "doc_id", "_r", "_h", "text").unionByName(
        ghosts.select(F.col("_to").alias("_b"), F.lit(True).alias("_ghost"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("_r"), F.lit(0).cast("long").alias("_h"), "text")
    )
    after = Window.partitionBy("_b").orderBy("_ghost", "_r", "_h")
    return whole.select("doc_id", "text", "_ghost", F.lead("text").over(after).alias("next_text")).where("not _ghost").drop("_ghost")


def _dealt(rows: DataFrame, cells: int, *by: str) -> DataFrame:
    """Rows to partitions by `by`, as many as keep the cells of each in bounds; all later steps stay in them."""
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(shuffles, -(-cells // PARTITION_CELLS)), *by)


def _of_version(keys: Column, version: int) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(version).alias("version"), k.alias("k")))


def differences(pairs: DataFrame, level: int, cells: Column) -> DataFrame:
    """rid, version, found, stuck for pairs of key arrays (rid, version, a: own, b: the version's)."""
    signed = pairs.select("rid", cells.alias("cells"), "version", F.explode(F.concat(_of_version(F.col("a"), OWN), _of_version(F.col("b"), NEXT))).alias("x"))
    # Both sides' sketches in one aggregation: the other side's cells count negative.
    spread = signed.select("rid", "version", "cells", F.col("x.k").alias("k"), F.when(F.col("x.version") == OWN, 1).otherwise(-1).alias("n"), F.explode(F.array(*(F.lit(t) for t in range(3)))).alias("slot"))
    rows = spread.select("rid", "version", "cells", "slot", place(F.col("k"), F.col("slot"), F.col("cells"), level).alias("place"), "n", "k", check_of(F.col("k")).alias("c"))
    return peeled(_summed(rows, "rid", "version", "cells", "slot", "place"), level)


def edited_fingerprints(docs: DataFrame, base_cells: int = BASE_CELLS, quantiles: int = QUANTILES, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document. A likeness is the share of equal paragraphs (of all distinct ones of both), from the digests
    that peeling the subtracted fingerprints recovers. Where they do not peel, larger sketches of both are
    subtracted, with cells for all their digests, then twice as many and so on until every pair has peeled.

    Null texts count as empty; two texts without paragraphs are alike (1). Rows with one doc_id, or with none,
    are rows like others. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(own, quantiles, part_rows).withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next_text, 1, cast(n_chars div 3 as int)))"))
    rows = keep(
        both.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            paragraph_keys("text").alias("own"), paragraph_keys("edited").alias("edited"), paragraph_keys("next_text").alias("next"),
        )
    )
    sizes = {c: F.size(c).cast("long") for c in ("own", "edited", "next")}
    total = rows.agg(F.sum(sizes["own"] + sizes["edited"] + sizes["next"])).first()[0] or 0
    dealt = _dealt(rows, 6 * total, "rid")
    versions = ((OWN, "own"), (EDITED, "edited"), (NEXT, "next"))
    keys = dealt.select(
        "rid", F.lit(base_cells).alias("cells"),
        F.explode(F.concat(*(_of_version(F.col(c), v) for v, c in versions))).alias("x"),
    ).select("rid", "cells", "x.*")
    base = sketches(keys)
    numbers = dealt.select("rid", "doc_id", "n_chars", "edited_sha256", *(sizes[c].alias(f"n_{c}") for c in sizes))
    shown = numbers.join(as_strings(base.where(F.col("version") != NEXT)), "rid", "left")

    arrays = dealt.select("rid", F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.col("own").alias("a"), F.col(c).alias("b")) for v, c in versions[1:]))).alias("x")).select("rid", "x.*")
    found = peeled(subtracted(base), 0)
    done, level, growth = [], 0, 1
    while True:
        tried = keep(arrays.join(found, ["rid", "version"], "left").select("rid", "version", F.coalesce("found", F.lit(0)).alias("d"), F.when(F.col("stuck") > 0, F.struct("a", "b")).alias("again")))
        done.append(tried.where("again is null").select("rid", "version", "d"))
        left = tried.where("again is not null").select("rid", "version", "again.*")
        cells = left.agg(F.sum(F.size("a").cast("long") + F.size("b"))).first()[0]
        if not cells:
            break
        level, growth = level + 1, 2 * growth
        arrays = _dealt(left, 3 * cells, "rid", "version")
        # At most two digests for each three cells at the first of these, and a power of two in each subtable.
        wide = F.expr(f"cast(shiftleft(1L, cast(ceil(log2(greatest(8, (size(a) + size(b)) * {growth / 4}))) as int)) as int)")
        found = differences(arrays, level, wide)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    d = every.groupBy("rid").agg(*(F.sum(F.when(F.col("version") == v, F.col("d")).otherwise(0)).alias(f"d_{c}") for v, c in versions[1:]))
    near = lambda c: F.when(F.col("n_own") + F.col(f"n_{c}") == 0, F.lit(1.0)).otherwise(
        (F.col("n_own") + F.col(f"n_{c}") - F.col(f"d_{c}")) / (F.col("n_own") + F.col(f"n_{c}") + F.col(f"d_{c}")).cast("double")
    )
    named = lambda n, c: F.concat_ws("/", n, F.coalesce(c, F.lit("")))
    return shown.join(d, "rid").select(
        "doc_id", "n_chars", "edited_sha256", named("n_own", "fingerprint").alias("fingerprint"), named("n_edited", "edited_fingerprint").alias("edited_fingerprint"),
        near("edited").alias("near_edited"), near("next").alias("near_next"),
    )
