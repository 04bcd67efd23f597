"""The event log: cutoffs, heads, order checks, hash chains, folds to state, references and invariants."""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .earlier import bucket_of, with_earlier, with_place

ZERO_HASH = "0" * 64
PAYLOAD = ["plate_id", "boundary_id", "junction_id", "plate_id_left", "plate_id_right", "boundary_type", "geometry", "boundary_ids", "location", "reason"]


def _earlier(events: DataFrame, name: str, column: str, kind: str = "last") -> DataFrame:
    return with_earlier(events, ["stream_key"], ["sequence"], bucket_of("sequence"), name, F.col(column), kind)


def read_events(spark: SparkSession, path: str, schema, stream: str | None = None, from_sequence: int = 0, check_links: bool = False) -> DataFrame:
    """Scan a log that is partitioned by stream_key; both filters reach the files.

    With check_links every row (columns previous_hash, hash) gets linked: whether it names the hash of the row
    before it; the first one that is read is taken as it is.
    """
    log = spark.read.schema(schema).parquet(path).where(F.col("sequence") >= from_sequence)
    log = log.where(F.col("stream_key") == stream) if stream is not None else log
    return with_links(log) if check_links else log


def with_links(events: DataFrame) -> DataFrame:
    return _earlier(events, "_before", "hash").withColumn("linked", F.coalesce(F.col("previous_hash") == F.col("_before"), F.lit(True))).drop("_before")


def at_tick(events: DataFrame, tick: int) -> DataFrame:
    return events.where(F.col("tick") <= tick)


def at_sequence(events: DataFrame, sequence: int) -> DataFrame:
    """A negative number gives the empty log."""
    return events.where(F.col("sequence") <= sequence) if sequence >= 0 else events.where(F.lit(False))


def from_sequence(events: DataFrame, sequence: int) -> DataFrame:
    return events.where(F.col("sequence") >= sequence)


def active(entities: DataFrame) -> DataFrame:
    return entities.where(~F.col("is_retired"))


def heads(events: DataFrame, *columns: str) -> DataFrame:
    """The last sequence of each stream, with other columns of its row."""
    last = F.max(F.struct("sequence", *columns)).alias("h")
    return events.groupBy("stream_key").agg(last).select("stream_key", "h.*")


def counts(events: DataFrame, width: int) -> DataFrame:
    """Events by stream, type and tick range."""
    return events.groupBy("stream_key", "event_type", F.floor(F.col("tick") / width).alias("tick_range")).agg(F.count(F.lit(1)).alias("n"))


def tick_decreases(events: DataFrame) -> DataFrame:
    """Rows whose tick is less than that of the sequence before."""
    return _earlier(events, "previous_tick", "tick").where("tick < previous_tick")


def late(events: DataFrame) -> DataFrame:
    """Rows whose tick is less than some tick before in sequence."""
    return _earlier(events, "greatest_tick", "tick", "max").where("tick < greatest_tick")


def capabilities(events: DataFrame) -> DataFrame:
    """Whether a stream's ticks never decrease, computed from the rows."""
    rows = _earlier(events, "previous", "tick")
    return rows.groupBy("stream_key").agg(F.bool_and(F.coalesce(F.col("tick") >= F.col("previous"), F.lit(True))).alias("is_monotone"), F.count(F.lit(1)).alias("n"))


def is_sorted(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """Whether a column rises strictly with (order, column) in each group: columns `by`, sorted."""
    seen = with_earlier(rows, [by], [order, column], bucket_of(order), "_before", F.col(column))
    return seen.groupBy(by).agg(F.bool_and(F.coalesce(F.col(column) > F.col("_before"), F.lit(True))).alias("sorted"))


def _hadoop_path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(path: str, stream: str) -> str:
    return f"{path}/_commits/{quote(stream, safe='')}"


def commits(spark: SparkSession, path: str, stream: str) -> list[tuple[int, int, str]]:
    """number, head and batch of a stream's commits in their order: one small record for each append."""
    at, fs = _hadoop_path(spark, _commits(path, stream))
    if not fs.exists(at):
        return []
    names = [s.getPath().getName().split("_") for s in fs.listStatus(at)]
    return sorted((int(n), int(head), batch) for n, head, batch in (x for x in names if len(x) == 3 and x[0].isdigit()))


def committed(spark: SparkSession, path: str, schema, streams: list[str]) -> DataFrame:
    """The rows of committed appends of some streams; what a writer left that was refused or died is not among them."""
    folders = [f"{path}/{batch}" for s in streams for _, _, batch in commits(spark, path, s)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def checked_append(new: DataFrame, path: str, expected_head: int | None, tick_policy: str = "Allow") -> None:
    """Append one stream's batch: not empty, sequences strictly increasing after the expected head, ticks by policy.

    The batch is written to a folder of its own; then a record of the stream's next commit is made, if no other has it.
    So of two writers that expect one head the second fails, wherever both are in their work, and its rows are never
    part of the log. Heads are read from the records, not from the rows. A writer that dies between taking a commit and
    recording it leaves a lock without a record: appends to the stream fail until it is removed, none is lost.
    """
    spark = new.sparkSession
    row = new.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stream_key").alias("streams"), F.countDistinct("sequence").alias("distinct"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.min("stream_key").alias("stream")).first()
    if not row["n"]:
        raise ValueError("the batch is empty")
    if row["streams"] != 1 or row["distinct"] != row["n"]:
        raise ValueError("a batch has one stream and no sequence twice")
    before = commits(spark, path, row["stream"])
    head = before[-1][1] if before else None
    if head != expected_head or (head is not None and row["first"] <= head):
        raise ValueError(f"the head is {head}, not {expected_head}, or the batch begins before it")
    if tick_policy == "Reject" and not tick_decreases(new).isEmpty():
        raise ValueError("a tick decreases")
    batch = uuid.uuid4().hex
    new.write.parquet(f"{path}/{batch}")
    _commit(spark, path, row["stream"], len(before), row["last"], batch)


def _commit(spark: SparkSession, path: str, stream: str, number: int, head: int, batch: str) -> None:
    """Take the stream's commit of this number. A lock of that name is created where none is: only one writer can."""
    lock, fs = _hadoop_path(spark, f"{_commits(path, stream)}/locks/{number}")
    try:
        fs.create(lock, False).close()
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        folder, fs = _hadoop_path(spark, f"{path}/{batch}")
        fs.delete(folder, True)
        raise ValueError(f"another writer has appended to {stream}") from e
    record, fs = _hadoop_path(spark, f"{_commits(path, stream)}/{number}_{head}_{batch}")
    fs.create(record, False).close()


def write_indexed(events: DataFrame, path: str, width: int = 100_000) -> None:
    """Write a log by buckets of its sequence, and beside it an index: each bucket's number of rows, least and greatest tick."""
    rows = events.withColumn("bucket", bucket_of("sequence", width))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/log")
    written = events.sparkSession.read.schema(rows.schema).parquet(f"{path}/log")
    written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("tick").alias("least"), F.max("tick").alias("greatest")).write.parquet(f"{path}/index")


def scan_until_tick(spark: SparkSession, path: str, schema, tick: int) -> DataFrame:
    """Events up to a tick of a log with an index. Buckets that begin after the tick are not opened, wherever they are.

    A log whose ticks go back is read right: each bucket is judged by its own least tick, not by where it stands. The
    index has a row for each bucket; the planner prunes the log's folders by it.
    """
    index = spark.read.parquet(f"{path}/index").where(F.col("least") <= tick).select("bucket")
    own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    log = spark.read.schema(StructType([*own.fields, StructField("bucket", LongType())])).parquet(f"{path}/log")
    return log.join(F.broadcast(index), "bucket", "left_semi").where(F.col("tick") <= tick).drop("bucket")


def assign_sequences(plans: DataFrame, head: int = -1) -> DataFrame:
    """Sequence after the head in order of (kind, order_key, asset) within each stream."""
    number = F.col("order_key") if dict(plans.dtypes)["order_key"] in ("int", "bigint") else None
    buckets = [F.col("kind"), F.substring(F.col("order_key").cast("string"), 1, 4) if number is None else bucket_of("order_key")]
    return with_place(plans, ["stream_key"], ["order_key", "asset"], buckets, "_place").withColumn("sequence", F.lit(head) + F.col("_place")).drop("_place")


def payload_text() -> Column:
    return F.to_json(F.struct("event_id", "event_type", *PAYLOAD))


def _digest(tick: int, previous: str, payload: str) -> str:
    return hashlib.sha256(f"1\n{tick}\n{previous}\n{payload}".encode()).hexdigest()


def build_chain(events: DataFrame) -> DataFrame:
    """Add previous_hash and hash (hexadecimal SHA-256 of version, tick, previous hash and payload).

    A chain is sequential within its stream; streams are done in parallel, each sorted by sequence and read
    in batches, so a long stream is not held in memory at once.
    """
    rows = events.select("stream_key", "sequence", "tick", "event_id", payload_text().alias("payload"))
    dealt = rows.repartition("stream_key").sortWithinPartitions("stream_key", "sequence")

    def chain(batches):
        stream, last = None, ZERO_HASH
        for batch in batches:
            before, own = [], []
            for s, t, p in zip(batch["stream_key"], batch["tick"], batch["payload"]):
                if s != stream:
                    stream, last = s, ZERO_HASH
                before.append(last)
                last = _digest(t, last, p)
                own.append(last)
            yield batch.drop(columns=["payload"]).assign(previous_hash=before, hash=own)

    return dealt.mapInPandas(chain, "stream_key string, sequence long, tick long, event_id string, previous_hash string, hash string")


def chain_faults(chained: DataFrame) -> DataFrame:
    """Rows (with columns previous_hash, hash, payload) that do not link to the row before or do not hash to their hash."""
    own = F.sha2(F.concat_ws("\n", F.lit("1"), F.col("tick").cast("string"), "previous_hash", "payload"), 256)
    rows = _earlier(chained, "_before", "hash").withColumn("_before", F.coalesce("_before", F.lit(ZERO_HASH)))
    faults = rows.withColumn("bad_link", F.col("previous_hash") != F.col("_before")).withColumn("bad_hash", F.col("hash") != own)
    return faults.where("bad_link or bad_hash").select("stream_key", "sequence", "bad_link", "bad_hash")


def _last(column: str, *types: str, also: Column | None = None) -> Column:
    """The value at the greatest sequence among the events that write the attribute; nulls are values."""
    writes = F.col("event_type").isin(*types)
    if also is not None:
        writes = writes & also
    return F.max_by(F.struct(F.col(column).alias("v")), F.when(writes, F.col("sequence")))["v"].alias(column)


def _retired(kind: str) -> Column:
    at = F.when(F.col("event_type").isin(f"{kind}Created", f"{kind}Retired"), F.col("sequence"))
    return F.max_by(F.col("event_type") == f"{kind}Retired", at).alias("is_retired")


def _folded(events: DataFrame, kind: str, key: str, values: list[Column]) -> DataFrame:
    rows = events.where(F.col("event_type").startswith(kind) & F.col(key).isNotNull())
    reason = F.max_by(F.struct(F.when(F.col("event_type") == f"{kind}Retired", F.col("reason")).alias("v")), F.when(F.col("event_type").isin(f"{kind}Created", f"{kind}Retired"), F.col("sequence")))
    made = F.count_if(F.col("event_type") == f"{kind}Created").alias("_made")
    return rows.groupBy("stream_key", key).agg(*values, _retired(kind), reason["v"].alias("retirement_reason"), made).where("_made > 0").drop("_made")


def plates(events: DataFrame) -> DataFrame:
    """Latest state of each plate. A second create un-retires. Entities that were never created are left out."""
    return _folded(events, "Plate", "plate_id", [])


def boundaries(events: DataFrame) -> DataFrame:
    made = "BoundaryCreated"
    return _folded(events, "Boundary", "boundary_id", [
        _last("plate_id_left", made), _last("plate_id_right", made),
        _last("boundary_type", made, "BoundaryTypeChanged"), _last("geometry", made, "BoundaryGeometryUpdated"),
    ])


def junctions(events: DataFrame) -> DataFrame:
    """An update with no boundary ids or no location keeps the old ones."""
    made, new = F.col("event_type") == "JunctionCreated", "JunctionUpdated"
    return _folded(events, "Junction", "junction_id", [
        _last("boundary_ids", "JunctionCreated", new, also=made | (F.size("boundary_ids") > 0)),
        _last("location", "JunctionCreated", new, also=made | F.col("location").isNotNull()),
    ])


def motion_segments(events: DataFrame) -> DataFrame:
    """Latest upsert of each segment that is not retired. Columns event_type (Upserted or Retired), plate_id, segment_id and values."""
    values = [c for c in events.columns if c not in ("stream_key", "plate_id", "segment_id", "sequence")]
    last = F.max_by(F.struct(*values), "sequence").alias("s")
    return events.groupBy("stream_key", "plate_id", "segment_id").agg(last).select("stream_key", "plate_id", "segment_id", "s.*").where("event_type <> 'Retired'").drop("event_type")


def snapshot_index(events: DataFrame, tick: int) -> DataFrame:
    """For a snapshot of the events up to a tick: its last sequence, and the least tick that it left out before it."""
    kept = events.groupBy("stream_key").agg(F.max(F.when(F.col("tick") <= tick, F.col("sequence"))).alias("last_sequence"))
    rows = events.select("stream_key", "sequence", "tick").join(kept, "stream_key")
    skipped = F.min(F.when((F.col("sequence") <= F.col("last_sequence")) & (F.col("tick") > tick), F.col("tick")))
    return rows.groupBy("stream_key", "last_sequence").agg(skipped.alias("min_skipped_tick")).withColumn("snapshot_tick", F.lit(tick).cast("long"))


def usable_snapshots(index: DataFrame, tick: int) -> DataFrame:
    """The greatest snapshot tick <= T of each stream that has no skipped event up to T."""
    good = index.where((F.col("snapshot_tick") <= tick) & (F.col("min_skipped_tick").isNull() | (F.col("min_skipped_tick") > tick)))
    best = F.max(F.struct("snapshot_tick", "last_sequence", "min_skipped_tick")).alias("s")
    return good.groupBy("stream_key").agg(best).select("stream_key", "s.*")


KINDS = {"Plate": "plate_id", "Boundary": "boundary_id", "Junction": "junction_id"}


def as_events(state: DataFrame, kind: str, template: DataFrame) -> DataFrame:
    """Snapshot rows of one kind as create and retire events before all others (sequences -2 and -1)."""
    have = [c for c in template.columns if c in state.columns]
    row = {c: F.lit(None).cast(f.dataType) for c, f in ((c, template.schema[c]) for c in template.columns)} | {"tick": F.lit(0).cast("long")}
    made = row | {c: F.col(c) for c in have} | {"sequence": F.lit(-2).cast("long"), "event_type": F.lit(f"{kind}Created")}
    gone = row | {"stream_key": F.col("stream_key"), KINDS[kind]: F.col(KINDS[kind]), "sequence": F.lit(-1).cast("long"), "event_type": F.lit(f"{kind}Retired"), "reason": F.col("retirement_reason")}
    of = lambda rows, values: rows.select(*(values[c].alias(c) for c in template.columns))
    return of(state, made).unionByName(of(state.where("is_retired"), gone))


def folds(events: DataFrame) -> dict[str, DataFrame]:
    return {"Plate": plates(events), "Boundary": boundaries(events), "Junction": junctions(events)}


def write_snapshot(events: DataFrame, folder: str, tick: int) -> None:
    """The three entity tables of a log, and each stream's last sequence, in partitions of stream and snapshot tick. A repeated write replaces itself."""
    tables = {f"{kind.lower()}_state": state for kind, state in folds(events).items()} | {"heads": heads(events).withColumnRenamed("sequence", "last_sequence")}
    for name, rows in tables.items():
        out = rows.withColumn("snapshot_tick", F.lit(tick).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("stream_key", "snapshot_tick").parquet(f"{folder}/{name}")


def read_snapshot(spark: SparkSession, folder: str, tick: int) -> dict[str, DataFrame]:
    """Tables by kind, and heads, of one snapshot tick."""
    names = {kind: f"{kind.lower()}_state" for kind in KINDS} | {"heads": "heads"}
    return {kind: spark.read.parquet(f"{folder}/{name}").where(F.col("snapshot_tick") == tick).drop("snapshot_tick") for kind, name in names.items()}


def snapshot_plus_tail(snapshot: dict[str, DataFrame], events: DataFrame) -> DataFrame:
    """The log that folds to the same state: snapshot rows as events, and the events after each stream's last sequence; streams without a snapshot whole."""
    tail = events.join(snapshot["heads"].select("stream_key", "last_sequence"), "stream_key", "left").where("last_sequence is null or sequence > last_sequence").select(events.columns)
    for kind in KINDS:
        tail = tail.unionByName(as_events(snapshot[kind], kind, events))
    return tail


def last_writers(events: DataFrame) -> DataFrame:
    """The events that decide the state: for each entity the last one that wrote each of its attributes.

    The log without all others folds to the same state, also when more events are added in any order.
    """
    t, seq = F.col("event_type"), F.col("sequence")
    some = lambda c: F.max(F.when(c, seq))
    made, life = t.endswith("Created"), t.endswith("Created") | t.endswith("Retired")
    ids = (t == "JunctionCreated") | ((t == "JunctionUpdated") & (F.size("boundary_ids") > 0))
    at = (t == "JunctionCreated") | ((t == "JunctionUpdated") & F.col("location").isNotNull())
    writes = [made, life, made | (t == "BoundaryTypeChanged"), made | (t == "BoundaryGeometryUpdated"), ids, at]
    entity = F.coalesce("plate_id", "boundary_id", "junction_id")
    last = events.groupBy("stream_key", F.substring(t, 1, 5).alias("_kind"), entity.alias("_entity")).agg(F.array_compact(F.array_distinct(F.array(*(some(w) for w in writes)))).alias("_s"))
    return events.join(last.select("stream_key", F.explode("_s").alias("sequence")).distinct(), ["stream_key", "sequence"], "left_semi")


def plates_as_events(state: DataFrame, template: DataFrame) -> DataFrame:
    """Snapshot rows of plates as create and retire events before all others (sequences -2 and -1)."""
    row = {c: F.lit(None).cast(t) for c, t in template.dtypes}
    made = state.select(*(v.alias(c) for c, v in (row | {"stream_key": F.col("stream_key"), "sequence": F.lit(-2).cast("long"), "tick": F.lit(0).cast("long"), "event_type": F.lit("PlateCreated"), "plate_id": F.col("plate_id")}).items()))
    gone = state.where("is_retired").select(*(v.alias(c) for c, v in (row | {"stream_key": F.col("stream_key"), "sequence": F.lit(-1).cast("long"), "tick": F.lit(0).cast("long"), "event_type": F.lit("PlateRetired"), "plate_id": F.col("plate_id"), "reason": F.col("retirement_reason")}).items()))
    return made.unionByName(gone)


def plates_from_snapshot(snapshot: DataFrame, index: DataFrame, events: DataFrame) -> DataFrame:
    """Snapshot rows and the events after each stream's last sequence, folded again."""
    tail = events.join(index.select("stream_key", "last_sequence"), "stream_key").where("sequence > last_sequence").drop("last_sequence")
    return plates(plates_as_events(snapshot, events).unionByName(tail.select(events.columns)))


def dangling(boundaries_: DataFrame, plates_: DataFrame, junctions_: DataFrame) -> DataFrame:
    """References of active boundaries and junctions to entities that do not exist or are retired."""
    p = plates_.select("stream_key", F.col("plate_id").alias("ref"), F.col("is_retired").alias("gone"))
    b = boundaries_.select("stream_key", F.col("boundary_id").alias("ref"), F.col("is_retired").alias("gone"))
    to_plates = active(boundaries_).select("stream_key", F.col("boundary_id").alias("owner"), F.explode(F.array("plate_id_left", "plate_id_right")).alias("ref"))
    to_boundaries = active(junctions_).select("stream_key", F.col("junction_id").alias("owner"), F.explode("boundary_ids").alias("ref"))
    reason = F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "retired").alias("why")
    checked = [x.join(y, ["stream_key", "ref"], "left").select("stream_key", "owner", "ref", reason) for x, y in ((to_plates, p), (to_boundaries, b))]
    return checked[0].unionByName(checked[1]).where("why is not null").distinct()


def references_before(events: DataFrame) -> DataFrame:
    """For each plate reference of a BoundaryCreated event, the plate's state just before the event's sequence.

    An as-of join with strictly smaller sequence: plate lifecycle rows and reference rows together look back by
    buckets of the sequence, so a plate that most boundaries refer to is spread over tasks.
    """
    life = events.where(F.col("event_type").isin("PlateCreated", "PlateRetired")).select(
        "stream_key", F.col("plate_id").alias("ref"), "sequence", F.when(F.col("event_type") == "PlateCreated", "active").otherwise("retired").alias("state"), F.lit(None).cast("string").alias("owner"))
    refs = events.where("event_type = 'BoundaryCreated'").select(
        "stream_key", F.explode(F.array_distinct(F.array("plate_id_left", "plate_id_right"))).alias("ref"), "sequence", F.lit(None).cast("string").alias("state"), F.col("boundary_id").alias("owner"))
    both = with_earlier(life.unionByName(refs), ["stream_key", "ref"], ["sequence"], bucket_of("sequence"), "before", F.col("state"))
    return both.where("owner is not null").select("stream_key", "sequence", "owner", "ref", F.coalesce("before", F.lit("missing")).alias("before"))


def lifecycle_faults(events: DataFrame) -> DataFrame:
    """Events on an entity that was not created before, or is retired, by their sequence (a create is always allowed)."""
    entity = F.coalesce("plate_id", "boundary_id", "junction_id")
    mark = F.when(F.col("event_type").endswith("Created"), "active").when(F.col("event_type").endswith("Retired"), "retired")
    marked = events.select("stream_key", "sequence", entity.alias("entity"), "event_type", mark.alias("_mark"))
    rows = with_earlier(marked, ["stream_key", "entity"], ["sequence"], bucket_of("sequence"), "before", F.col("_mark")).withColumn("before", F.coalesce("before", F.lit("missing")))
    return rows.where(~F.col("event_type").endswith("Created") & (F.col("before") != "active")).select("stream_key", "sequence", "entity", "event_type", "before")


def live_junction_faults(events: DataFrame) -> DataFrame:
    """Retirements of a boundary that an active junction refers to at that sequence (FR-016).

    Junction versions become ranges of sequences; retirements meet them by boundary id, the range is a residual.
    What a version keeps of those before, and where the next begins, is looked for by buckets of the sequence.
    """
    made = F.col("event_type") == "JunctionCreated"
    by, j = ["stream_key", "junction_id"], events.where(F.col("event_type").startswith("Junction"))
    ids = F.when(made | ((F.col("event_type") == "JunctionUpdated") & (F.size("boundary_ids") > 0)), F.col("boundary_ids"))
    gone = F.when(F.col("event_type") == "JunctionRetired", True).when(made, False)
    rows = j.select(*by, "sequence", (-F.col("sequence")).alias("_back"), ids.alias("_ids"), gone.alias("_gone"))
    rows = with_earlier(rows, by, ["sequence"], bucket_of("sequence"), "ids", F.col("_ids"))
    rows = with_earlier(rows, by, ["sequence"], bucket_of("sequence"), "gone", F.col("_gone"))
    rows = with_earlier(rows, by, ["_back"], bucket_of("_back"), "to_seq", F.col("sequence"))
    versions = rows.select(*by, F.col("sequence").alias("from_seq"), "to_seq", F.coalesce("_ids", "ids").alias("ids"), F.coalesce("_gone", "gone").alias("gone"))
    live = versions.where("not gone").select("stream_key", "junction_id", "from_seq", "to_seq", F.explode("ids").alias("boundary_id"))
    retired = events.where("event_type = 'BoundaryRetired'").select("stream_key", "boundary_id", "sequence")
    inside = (F.col("from_seq") < F.col("sequence")) & (F.col("to_seq").isNull() | (F.col("sequence") < F.col("to_seq")))
    return retired.join(live, ["stream_key", "boundary_id"]).where(inside).select("stream_key", "sequence", "boundary_id", "junction_id").distinct()


def invariant_report(events: DataFrame) -> DataFrame:
    """All violations of the event rules as rows: stream_key, sequence, rule, entity, detail."""
    row = lambda df, rule, entity, detail: df.select("stream_key", "sequence", F.lit(rule).alias("rule"), F.col(entity).alias("entity"), detail.alias("detail"))
    same = events.where("event_type = 'BoundaryCreated' and plate_id_left = plate_id_right")
    refs = references_before(events).where("before <> 'active'")
    order = lifecycle_faults(events)
    live = live_junction_faults(events)
    off = F.abs(F.sqrt(F.col("location.nx") ** 2 + F.col("location.ny") ** 2 + F.col("location.nz") ** 2) - 1) > 1e-6
    shape = events.where((F.col("event_type") == "JunctionCreated") & (off | (F.col("location.radius") <= 0) | (F.size("boundary_ids") < 2)))
    parts = [
        row(same, "BoundarySeparatesTwoPlates", "boundary_id", F.lit("equal")), row(refs, "BoundarySeparatesTwoPlates", "owner", F.concat_ws(" ", "ref", "before")),
        row(order, "LifecycleOrdering", "entity", F.col("before")), row(live, "FR-016", "boundary_id", F.col("junction_id")), row(shape, "JunctionGeometry", "junction_id", F.lit("location or boundaries")),
    ]
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return report


def assert_valid(events: DataFrame) -> None:
    first = invariant_report(events).orderBy("sequence").first()
    if first is not None:
        raise ValueError(f"{first['rule']} at sequence {first['sequence']}: {first['entity']} {first['detail']}")


def without_faults(events: DataFrame) -> DataFrame:
    """The events that break no rule; the fold of a log with bad events ignores these."""
    return events.join(invariant_report(events).select("stream_key", "sequence").distinct(), ["stream_key", "sequence"], "left_anti")


def ingest_audit(events: DataFrame) -> DataFrame:
    """Count, first and last sequence and an order-defined digest of each stream.

    The digest is of the digests of buckets of 1,000 sequences, so no row holds a whole stream.
    """
    line = F.concat_ws(":", F.col("sequence").cast("string"), "event_id")
    bucket = F.floor(F.col("sequence") / 1000)
    # Digests of digests: of 1,000 sequences, of 1,000 of these, then of all.
    parts = events.groupBy("stream_key", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", line.alias("t")))), lambda x: x["t"]), "\n"), 256).alias("d"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), "\n"), 256)
    sums = [F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")]
    wide = parts.groupBy("stream_key", F.floor(F.col("bucket") / 1000).alias("wide")).agg(*sums, joined.alias("d")).withColumnRenamed("wide", "bucket")
    return wide.groupBy("stream_key").agg(F.sum("n").alias("n_events"), F.min("first").alias("first_sequence"), F.max("last").alias("last_sequence"), joined.alias("digest"))
