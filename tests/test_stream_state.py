"""State of the rate limit and of the detection stream: few keys whatever the number of clients, right counts in them."""

import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from domainlake.operators import behaviour as B
from domainlake.session import fresh_dir
from domainlake.streaming import jobs
from tests.test_behaviour import START

QUERIES = "id long, ts timestamp, client_ip string, domain string, query_type string, dga_prob double, decision double"
ANSWERS = "id long, ts timestamp, domain string, ip string"


def landed(spark, rows, schema, name, files=1):
    path = fresh_dir(spark, name)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def state_rows(stream):
    """The most rows of state that a batch of the stream wrote or left."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("noop").option("checkpointLocation", fresh_dir(spark, "state-rows"))
    with jobs.state_partitions(spark, 2):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return max(n for p in query.recentProgress for op in p.stateOperators for n in (op.numRowsUpdated, op.numRowsTotal))


def test_rate_limit_state_does_not_grow_with_clients(spark):
    rows = [(i, START + timedelta(seconds=i % 60), f"c{i % 400}") for i in range(800)]
    path = landed(spark, rows, "id long, ts timestamp, client_ip string", "many-clients")
    stream = jobs.stream_rate_limit(jobs.file_stream(spark, path), seconds=60, limit=1, slices=10)
    assert state_rows(stream) <= 2 * jobs.BUCKETS


def test_detection_state_does_not_grow_with_names(spark):
    at = [START + timedelta(seconds=i % 60) for i in range(800)]
    queries = landed(spark, [(i, t, f"c{i % 400}", f"d{i}.com", "A", 0.0, 0.0) for i, t in enumerate(at)], QUERIES, "many-queries")
    answers = landed(spark, [(i, t, f"d{i}.com", "10.0.0.1") for i, t in enumerate(at)], ANSWERS, "many-answers")
    stream = jobs.events_in_order(jobs.file_stream(spark, queries), jobs.file_stream(spark, answers), seconds=60)
    assert state_rows(stream) <= 2 * jobs.BUCKETS


def test_clients_of_a_bucket_are_counted_apart(spark):
    """Files out of order, null and empty clients, ids beyond what a float holds."""
    rng = random.Random(3)
    rows = [((1 << 60) + i, START + timedelta(milliseconds=rng.randrange(6_000)), rng.choice(["a", "b", "c", "", None])) for i in range(300)]
    schema = "id long, ts timestamp, client_ip string"
    path = landed(spark, rows, schema, "shared-bucket", files=4)
    stream = jobs.stream_rate_limit(jobs.file_stream(spark, path, 1), 1.0, 5, slices=2, buckets=2)
    got = jobs.settled(jobs.run_to_table(stream, "shared-bucket-rate")).collect()
    want = B.rate_limit_flags(spark.createDataFrame(rows, schema), 1.0, 5).select("id", "client_ip", "recent", "rate_limited")
    assert {tuple(r) for r in got} == {tuple(r) for r in want.collect()} and len(got) == len(rows)


def test_a_batch_after_which_nothing_counts_any_more(spark):
    """The third file is within the delay of the batch before, and out of every window that can still be asked for."""
    path = fresh_dir(spark, "nothing-kept")
    for i, at in enumerate([0, 10, 5, 20]):
        spark.createDataFrame([(i, START + timedelta(seconds=at), "c")], "id long, ts timestamp, client_ip string").coalesce(1).write.mode("append").parquet(path)
    stream = jobs.stream_rate_limit(jobs.file_stream(spark, path, 1), 0.1, 1, slices=600, delay="1 second")
    got = jobs.settled(jobs.run_to_table(stream, "nothing-kept-rate")).collect()
    assert sorted(map(tuple, got)) == [(i, "c", 1, False) for i in range(4)]


@pytest.mark.parametrize("width", [0, 1, 40, 10_000])
def test_trailing_counts_equal_a_plain_count(width):
    rng = random.Random(width)
    who = [rng.choice(["a", "b", "", None]) for _ in range(150)]
    times = [rng.randrange(300) for _ in who]
    parts = pa.chunked_array([pa.array(who[:40], pa.string()), pa.array(who[40:], pa.string())])
    got = jobs._trailing(parts, np.array(times), width)
    want = [sum(v == w and t - width <= u <= t for v, u in zip(who, times)) for w, t in zip(who, times)]
    assert got.tolist() == want


class State:
    """What a processor sees of its key's state."""

    def __init__(self):
        self.value, self.watermark, self.hasTimedOut, self.timeout = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value, self.timeout = None, None

    def setTimeoutTimestamp(self, at):
        assert at > 0 and at >= self.watermark
        self.timeout = at

    def getCurrentWatermarkMs(self):
        return self.watermark


def test_events_are_given_out_once_the_watermark_passes(monkeypatch):
    monkeypatch.setattr(jobs, "HANDED_OVER", 1)  # blank rows follow whatever is held
    rng, state, out, landed_rows, blanks = random.Random(5), State(), [], [], 0
    process = jobs.InOrder(1_000_000, 10)
    for batch in range(14):
        frames = []
        if batch < 10:
            new = [
                {
                    "kind": rng.randrange(2), "id": len(landed_rows) + k, "t": batch * 500_000 + rng.randrange(1, 900_000),
                    "client_ip": rng.choice(["x", "y", None]), "domain": rng.choice(["p", "q", None]), "query_type": "A",
                    "dga_prob": float("nan"), "decision": 0.5, "ip": None, "own": k % 7 > 0,
                }
                for k in range(25)
            ]
            new = [r for r in new if r["t"] > state.watermark * 1000]
            landed_rows += new
            frames = [pd.DataFrame(new)]
        state.hasTimedOut = not frames
        if frames or (state.timeout is not None and state.timeout < state.watermark):
            for frame in process((0, 0), iter(frames), state):
                blanks += int(frame["kind"].isna().sum())
                rows = frame[frame["kind"].notna()].to_dict("records")
                assert all(r["t"] <= state.watermark * 1000 for r in rows)
                out += rows
        state.watermark = batch * 500 + 400
    assert sorted(r["id"] for r in out) == [r["id"] for r in landed_rows if r["own"]] and state.value is None and blanks
    of = lambda r: (r["kind"], (r["domain"] if r["kind"] else r["client_ip"]) or "")
    for r in out:
        assert r["recent"] == sum(of(x) == of(r) and r["t"] - 1_000_000 <= x["t"] <= r["t"] for x in landed_rows)
