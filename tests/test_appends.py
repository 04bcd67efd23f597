"""Appends by two writers, and scans that open only what they need."""

import pytest
from pyspark.sql import functions as F

from orogen.operators import log

SCHEMA = "stream_key string, sequence long, tick long, event_id string"


def batch(spark, first, last, stream="a/b c", step=1):
    return spark.createDataFrame([(stream, k, k * step, f"e{k}") for k in range(first, last + 1)], SCHEMA)


def test_of_two_writers_with_one_expected_head_one_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    log.checked_append(batch(spark, 0, 4), path, None)
    commit, other = log._commit, []

    def interleaved(*args):
        """Another writer appends between this one's check of the head and its commit."""
        if not other:
            other.append(True)
            log.checked_append(batch(spark, 5, 6), path, 4)
        return commit(*args)

    monkeypatch.setattr(log, "_commit", interleaved)
    with pytest.raises(ValueError, match="another writer"):
        log.checked_append(batch(spark, 5, 9), path, 4)
    rows = log.committed(spark, path, SCHEMA, ["a/b c"])
    assert sorted(r["sequence"] for r in rows.collect()) == list(range(7))
    assert [head for _, head, _ in log.commits(spark, path, "a/b c")] == [4, 6]
    with pytest.raises(ValueError, match="the head is 6"):
        log.checked_append(batch(spark, 7, 8), path, 4)
    log.checked_append(batch(spark, 7, 8), path, 6)
    log.checked_append(batch(spark, 0, 0, "other"), path, None)
    assert log.committed(spark, path, SCHEMA, ["a/b c", "other", "none"]).count() == 10
    assert log.committed(spark, path, SCHEMA, ["none"]).count() == 0
    with pytest.raises(ValueError, match="empty"):
        log.checked_append(batch(spark, 1, 0), path, 8)
    with pytest.raises(ValueError, match="tick"):
        log.checked_append(batch(spark, 9, 10, step=-1), path, 8, "Reject")


def test_rows_of_a_writer_that_died_are_not_read(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    monkeypatch.setattr(log, "_commit", lambda *_: None)
    log.checked_append(batch(spark, 0, 4), path, None)
    monkeypatch.undo()
    log.checked_append(batch(spark, 0, 1), path, None)
    assert log.committed(spark, path, SCHEMA, ["a/b c"]).count() == 2


def test_a_scan_opens_only_buckets_that_begin_before_the_tick(spark, tmp_path):
    """Ticks rise, but the last bucket goes back: it is read, those between are not."""
    path = f"file://{tmp_path}/log"
    events = batch(spark, 0, 999).withColumn("tick", F.when(F.col("sequence") >= 950, 3).otherwise(F.col("tick")))
    log.write_indexed(events, path, 50)
    found = log.scan_until_tick(spark, path, SCHEMA, 120)
    assert sorted(r["sequence"] for r in found.collect()) == [*range(121), *range(950, 1000)]
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    text = plan.toString()
    assert "dynamicpruning" in text.lower() or "PartitionFilters: [isnotnull(bucket" in text
    node, read = [plan], []
    while node:
        p = node.pop()
        if p.nodeName().startswith("Scan parquet"):
            m = p.metrics().get("numFiles")
            read += [m.get().value()] if m.isDefined() else []
        kids = p.children() if p.nodeName() != "AdaptiveSparkPlan" else None
        node += [p.executedPlan()] if kids is None else [kids.apply(i) for i in range(kids.size())]
    assert not read or min(read) <= 4
