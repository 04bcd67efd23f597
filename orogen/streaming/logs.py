"""The event log as a stream: heads, windows, folded state, violations, and appends that take each event once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import log
from ..tables import cut

_STATE = "stream_key string, plate_id string, sequence long, is_retired boolean, retirement_reason string"


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_heads(events: DataFrame) -> DataFrame:
    """Head of each stream after each batch; for update or complete mode."""
    return log.heads(events, "tick", "event_id")


def tick_windows(events: DataFrame, width: int) -> DataFrame:
    """Counts in tumbling windows of integer ticks."""
    return events.groupBy("stream_key", (F.floor(F.col("tick") / width) * width).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def sliding_windows(events: DataFrame, width: int, step: int) -> DataFrame:
    """Counts in windows of `width` integer ticks that begin every `step`; a tick is in width / step of them."""
    begins = F.explode(F.transform(F.sequence(F.lit(0), F.lit(width // step - 1)), lambda k: (F.floor(F.col("tick") / step) - k) * step))
    return events.select("stream_key", begins.alias("window_start")).groupBy("stream_key", "window_start").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, time: str, delay: str) -> DataFrame:
    """One row for each event id within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["event_id"])


def plate_state(events: DataFrame) -> DataFrame:
    """Each plate's state after each batch that touches it. State is a few fields for each plate; nothing is evicted,
    as a retired plate may be created again, and no late tick is dropped: order is by sequence."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, made, retired, reason = state.get if state.exists else (-1, False, False, None)
        for b in batches:
            for seq, kind, why in zip(b["sequence"], b["event_type"], b["reason"]):
                made = made or kind == "PlateCreated"
                if seq > last:
                    last, retired, reason = seq, kind == "PlateRetired", why if kind == "PlateRetired" else None
        state.update((int(last), bool(made), bool(retired), reason))
        if made:
            yield pd.DataFrame([(*key, int(last), bool(retired), reason)], columns=["stream_key", "plate_id", "sequence", "is_retired", "retirement_reason"])

    rows = events.where("event_type in ('PlateCreated', 'PlateRetired')").select("stream_key", "plate_id", "sequence", "event_type", "reason")
    return rows.groupBy("stream_key", "plate_id").applyInPandasWithState(update, _STATE, "last long, made boolean, retired boolean, reason string", "update", "NoTimeout")


def _and(schema: StructType, number: str) -> StructType:
    """The schema and the number of its folder."""
    return StructType([*schema.fields, StructField(number, IntegerType())])


def each_batch(events: DataFrame, checkpoint: str, do: Callable[[DataFrame, int], None]) -> None:
    """Hand each batch and its number to `do`, until all that is there has been read. A repeated batch has its number again."""
    events.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_once(events: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream's batches to a log, each event once.

    A batch is written to a folder of its number, so a repeated one replaces itself. Rows at or before the head
    that the batches before left in their stream are refused, whether repeated or late; they go to `path`/refused.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.dropDuplicates(["stream_key", "sequence"])
        before = spark.read.schema(_and(own.schema, "batch")).parquet(f"{path}/log").where(F.col("batch") < number) if number else own.limit(0)
        heads = before.groupBy("stream_key").agg(F.max("sequence").alias("_head"))
        known = own.join(heads, "stream_key", "left").withColumn("_late", F.coalesce(F.col("sequence") <= F.col("_head"), F.lit(False)))
        known.where("not _late").select(own.columns).write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        known.where("_late").select(own.columns).write.mode("overwrite").parquet(f"{path}/refused/batch={number}")

    each_batch(events, checkpoint, write)


def maintained(events: DataFrame, path: str, checkpoint: str, report: bool = False) -> None:
    """Keep, batch by batch, the events that decide the state of plates, boundaries and junctions (log.last_writers).

    State n is made from state n - 1 and batch n, whatever order sequences come in; a repeated batch makes the
    same. With `report` each batch's violations of the event rules are written to `path`/report: what the rules
    need of earlier events is in the state. A batch is written first: its rows are read many times, and from files
    each reader takes its own columns only.
    """

    def fold(rows: DataFrame, number: int) -> None:
        spark, batch = rows.sparkSession, cut(rows)
        both = batch if number == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/state={number - 1}"))
        if report:
            mine = batch.select("stream_key", "sequence").distinct()
            log.invariant_report(both).join(mine, ["stream_key", "sequence"], "left_semi").write.mode("overwrite").parquet(f"{path}/report/batch={number}")
        log.last_writers(both).write.mode("overwrite").parquet(f"{path}/state={number}")

    each_batch(events, checkpoint, fold)


_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A count of keys would cost a look-up before each write; a batch's changes are saved, not the whole state.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, so that it is not bound by an executor's heap."""
    before = {key: spark.conf.get(key, None) for key in _ON_DISK}
    for key, value in _ON_DISK.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def maintained_table(events: DataFrame, fold: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Keep a table of entities, folded by log.plates, boundaries or junctions, up to date with a stream.

    The fold is a streaming aggregation: each entity's state is a row of the state store, and each batch writes the
    entities that it touched, in a folder of its number; what others are is neither read nor written. Sequences may
    come in any order. A repeated batch replaces its folder. Nothing is evicted: a retired entity may be created again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _state_on_disk(events.sparkSession):
        fold(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """The newest row of each entity of a table that maintained_table() keeps (schema: of its rows)."""
    rows = spark.read.schema(_and(schema, "batch")).parquet(path)
    last = rows.groupBy("stream_key", key).agg(F.max_by(F.struct(*(c for c in schema.names if c not in ("stream_key", key))), "batch").alias("_last"))
    return last.select("stream_key", key, "_last.*").select(schema.names)


def late_events(events: DataFrame) -> DataFrame:
    """stream_key, sequence, tick, greatest_tick of events whose tick is less than one before them; for append mode.

    Each stream's greatest tick so far is its state. Within a batch events count in order of their sequence.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("sequence")
        top = rows["tick"].cummax().shift()
        known = state.get[0] if state.exists else None
        if known is not None:
            top = top.fillna(known).clip(lower=known)
        late = rows.assign(greatest_tick=top)[(rows["tick"] < top)]
        state.update((int(max(rows["tick"].max(), known if known is not None else rows["tick"].max())),))
        yield late.astype({"greatest_tick": "int64"})[["stream_key", "sequence", "tick", "greatest_tick"]]

    rows = events.select("stream_key", "sequence", "tick")
    return rows.groupBy("stream_key").applyInPandasWithState(update, "stream_key string, sequence long, tick long, greatest_tick long", "greatest long", "append", "NoTimeout")


def sessions(events: DataFrame, by: str, time: str, gap: str, delay: str) -> DataFrame:
    """`by`, session_start, n: events of which none is more than the gap after the one before; for append mode.

    A session is told when the watermark, `delay` behind the newest event, has passed its end; rows that come later than
    that are left out of it.
    """
    window = F.session_window(time, gap).alias("session")
    return events.withWatermark(time, delay).groupBy(by, window).agg(F.min(time).alias("session_start"), F.count(F.lit(1)).alias("n")).select(by, "session_start", "n")


def appended(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write an append-mode stream as Parquet until all that is there has been read, and read it."""
    with _state_on_disk(rows.sparkSession):
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def latest_state(spark: SparkSession, path: str, schema) -> DataFrame:
    """The deciding events of the newest state under a path; log.plates() and the other folds make tables of them."""
    newest = spark.read.schema(_and(schema, "state")).parquet(path).agg(F.max("state")).first()[0]
    return spark.read.schema(schema).parquet(f"{path}/state={newest}")
