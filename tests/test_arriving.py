"""Streams of the events: parts in files of few rows, and rows whose times are not in order of their ids."""

import pytest
from pyspark.sql import functions as F

from orogen.plans import stream_queries
from orogen.plans.log_queries import x8_sessions


@pytest.fixture()
def folder(spark, tmp_path):
    """Events of which every third one is long before the others, in 900 days."""
    rows = spark.range(3000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 3 * 38_880_000 + F.col("id") * 611 % 90_001).alias("ts"), (F.col("id") * 7 % 40).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("click", "view", "signup"))), (F.col("id") % 3 + 1).cast("int")).alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("order", ["event_id", "ts"])
def test_a_batch_is_a_part_in_files_of_few_rows(spark, folder, monkeypatch, tmp_path, order):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 150)
    stream, batches = stream_queries.arriving(spark, folder, order=order), []
    named = stream.select("event_id", "ts", F.input_file_name().alias("file"))
    run = named.writeStream.foreachBatch(lambda batch, n: batches.append([tuple(r) for r in batch.collect()])).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    assert len(batches) == 3 and sorted(r[0] for b in batches for r in b) == list(range(3000))
    at = 0 if order == "event_id" else 1
    assert all(max(r[at] for r in a) < min(r[at] for r in b) for a, b in zip(batches, batches[1:]))
    assert all(len({r[2] for r in b}) > 3 for b in batches)


def test_sessions_lose_no_row_whatever_the_order_of_ids(spark, folder):
    assert sorted(map(tuple, stream_queries.x8_stream_sessions(spark, folder).collect())) == sorted(map(tuple, x8_sessions(spark, folder).collect()))


def test_no_first_row_of_a_long_log_is_late(spark, folder):
    assert sorted(map(tuple, stream_queries.x7_deduplicated_events(spark, folder).collect())) == [("click", 1000, 0, 2997), ("signup", 1000, 2, 2999), ("view", 1000, 1, 2998)]
