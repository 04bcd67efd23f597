"""Hard negatives of anchors: exact inner-product windows, searched dimension by dimension in vertical blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import keep, numbered

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
SCALE, MOST = 256, 1 << 26
#: Dimensions that are read before the candidates are looked at again, rows and bytes of a block, bytes of a band of anchors.
STEP, BLOCK_ROWS, BLOCK_BYTES, BAND_BYTES = 8, 8192, 8 << 20, 8 << 20
_BLOCK = "rows int, ids binary, labels binary, columns binary"


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: components as floor(scale * x), of rows that have an id, a label and finite components.

    Beyond plus or minus 2**26 components are held there, so that sums stay whole.
    """
    whole = F.transform(F.col("embedding"), lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.lit(scale) * x.cast("double")))).cast("int"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


def _matrix(v: pa.Array) -> np.ndarray:
    """One column for each row, shorter vectors filled up with zeros."""
    lengths, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((int(lengths.max(initial=0)), len(lengths)), np.int32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(flat)) - np.repeat(lengths.cumsum() - lengths, lengths), row] = flat
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """The rows as blocks of bounded size, each dimension of a block in one piece."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).combine_chunks()
            ids, labels = (t.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
            packed_columns = [pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, _matrix(t.column("v").combine_chunks()))]
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *packed_columns], ["rows", "ids", "labels", "columns"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                longest = max((int(b.column(2).value_lengths().to_numpy(zero_copy_only=False).max(initial=1)) for b in (part, *waiting)), default=1)
                if waiting and ((n := sum(b.num_rows for b in waiting)) + part.num_rows > BLOCK_ROWS or 4 * longest * (n + part.num_rows) > BLOCK_BYTES):
                    yield packed()
                    waiting.clear()
                waiting.append(part)
        if waiting:
            yield packed()

    return rows.select("vec_id", "label", "v").mapInArrow(pack, _BLOCK)


class Block:
    """Rows by dimensions: ids, labels, and for each dimension its values and their least and most."""

    def __init__(self, rows: int, ids: bytes, labels: bytes, columns: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.columns = np.frombuffer(columns, np.int32).reshape(-1, rows) if columns else np.zeros((0, rows), np.int32)
        peak = float(np.abs(self.columns).max(initial=0))
        # Sums of products are exact in doubles up to 2**53, and products of doubles are the faster ones.
        self.kind = np.float64 if peak * MOST * max(1, len(self.columns)) < 2**52 else np.int64
        self.columns = self.columns.astype(self.kind)
        self.least, self.most = self.columns.min(axis=1, initial=MOST), self.columns.max(axis=1, initial=-MOST)


def _scan(block: Block, anchor: np.ndarray, bitmap: np.ndarray, useful: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the bitmap that stay useful, and their exact scores.

    Dimensions are read by the anchor's descending magnitude. After every few, what the rest can add at least and at
    most gives each candidate a lower and an upper bound, and those that are no longer useful leave the bitmap.
    """
    n = min(len(anchor), len(block.columns))
    order = np.argsort(-np.abs(anchor[:n]), kind="stable")
    q = anchor[:n].astype(block.kind)
    ends = q * block.least[:n], q * block.most[:n]
    rest = [np.append(f(*ends)[order][::-1].cumsum()[::-1], 0) for f in (np.minimum, np.maximum)]
    live = np.flatnonzero(bitmap)
    partial = np.zeros(len(live), block.kind)
    for m in range(0, n, STEP):
        dims, after = order[m : m + STEP], min(m + STEP, n)
        some = block.columns[dims] if 2 * len(live) > len(bitmap) else block.columns[dims[:, None], live]
        partial = partial + (q[dims] @ some)[live] if some.shape[1] != len(live) else partial + q[dims] @ some
        keeps = useful(partial + rest[0][after], partial + rest[1][after])
        if not keeps.all():
            live, partial = live[keeps], partial[keeps]
        if not len(live):
            break
    return live, partial.astype(np.int64)


def _kth(x: np.ndarray, k: int) -> float:
    """The k-th greatest; minus infinity if there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k > 0 else -np.inf


class Best:
    """The k greatest scores so far, ties by the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bar(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            s, d = np.append(self.scores, scores), np.append(self.ids, ids)
            first = np.lexsort((d, -s))[: self.k]
            self.scores, self.ids = s[first], d[first]


def _positives(block: Block, anchor: dict, best: Best) -> None:
    bitmap = (block.labels == anchor["label"]) & (block.ids != anchor["vec_id"])
    live, scores = _scan(block, anchor["v"], bitmap, lambda lower, upper: upper >= max(best.bar(), _kth(lower, best.k)))
    best.add(scores, block.ids[live])


def _negatives(block: Block, anchor: dict, windows: dict[tuple[int, int], Best]) -> None:
    """windows: for the least and the greatest score of each, its best so far."""
    bitmap = (block.labels != anchor["label"]) & (block.ids != anchor["vec_id"])

    def useful(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lower), bool)
        for (low, high), best in windows.items():
            bar = max(low, best.bar(), _kth(lower[(lower >= low) & (upper <= high)], best.k))
            out |= (upper >= bar) & (lower <= high)
        return out

    live, scores = _scan(block, anchor["v"], bitmap, useful)
    for (low, high), best in windows.items():
        fit = (scores >= low) & (scores <= high)
        best.add(scores[fit], block.ids[live[fit]])


def _searched(stored: DataFrame, anchors: list[dict], begin: Callable[[dict], dict[int, Best]], step: Callable, schema: str) -> DataFrame:
    """Every block against a band of anchors; each task gives its best rows, which later are merged."""
    shared = stored.sparkSession.sparkContext.broadcast(anchors)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = shared.value
        state = [begin(a) for a in band]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(**row)
                for a, s in zip(band, state):
                    if s:
                        step(block, a, s)
        for at in range(0, len(band), 1024):
            found = [(a["number"], key, b) for a, s in zip(band[at : at + 1024], state[at : at + 1024]) for key, b in s.items() if len(b.ids)]
            if found:
                sizes = [len(b.ids) for *_, b in found]
                columns = [np.repeat([x[0] for x in found], sizes), np.repeat([x[1][-1] for x in found], sizes), *(np.concatenate([getattr(x[2], c) for x in found]) for c in ("ids", "scores"))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return stored.mapInArrow(run, schema)


def _best(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, band_bytes: int = BAND_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, embedding; those without any of these, or with a null or non-finite component, take no part.
    Anchors meet all rows, block by block: the rows are stored once as vertical blocks, and the anchors go to them in
    bands of bounded size. Scores are whole inner products of quantised components; vectors of different lengths meet
    in the dimensions that both have. Rows with the anchor's own vec_id are no partners of it; rows that repeat
    another vec_id, and anchors that do, count each. Ties go by the smaller vec_id. An anchor without positives, or a
    positive without negatives in its window, gives no row; an empty table gives none. Other columns are ignored.
    """
    spark = rows.sparkSession
    ready = keep(quantised(rows).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    stored = keep(blocks(ready))
    own = keep(numbered(ready.where(is_anchor), [], ["vec_id", "label", "v"], "number"))
    count, longest = own.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    found = None
    size = max(1, band_bytes // (8 * max(1, longest or 1) + 2048))
    for first in range(0, count, size):
        these = own.where(F.col("number").between(first, first + size - 1))
        band = [r.asDict() | {"v": np.array(r["v"], np.int64)} for r in these.collect()]
        near = _searched(stored, band, lambda a: {(0,): Best(positives)}, lambda block, a, s: _positives(block, a, s[(0,)]), "number long, none long, positive_id long, positive_score long")
        near = keep(_best(near, ["number"], "positive_score", "positive_id", positives).select("number", "positive_id", "positive_score"))
        windows: dict[int, set[int]] = {}
        for r in near.select("number", "positive_score").distinct().collect():
            windows.setdefault(r[0], set()).add(r[1])
        for a in band:
            # Whole scores s with low * p <= 100 * s <= high * p, named by p.
            a["windows"] = {(-(-low * p // 100), high * p // 100, p) for p in windows.get(a["number"], ()) if -(-low * p // 100) <= high * p // 100}
        far = _searched(
            stored, band, lambda a: {w: Best(negatives) for w in a["windows"]},
            lambda block, a, s: _negatives(block, a, {w[:2]: b for w, b in s.items()}), "number long, positive_score long, negative_id long, negative_score long",
        )
        far = _best(far, ["number", "positive_score"], "negative_score", "negative_id", negatives)
        part = keep(near.join(far, ["number", "positive_score"]).join(these.select("number", F.col("vec_id").alias("anchor_id")), "number"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """Labels of rows whose vec_id 7 divides go on by one, 9 to 0; other columns than these three are left out."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), "embedding")


ORACLE_SQL = """
with ready as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0)::bigint as score
  from ready a join ready b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id,
       row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)::int as rank,
       s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) <= 10
"""
