"""Structured Streaming jobs over the query log, the alerts and landed feeds."""

import os
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from domainlake.constants import FLUX_LIMIT, RATE_LIMIT, SHADOWING_LIMIT
from domainlake.operators import detection
from domainlake.operators.behaviour import crossing_points, micros, with_base
from domainlake.operators.lists import new_entries
from domainlake.operators.scoring import Settings, query_type_filter, score_queries
from domainlake.session import fresh_dir
from domainlake.sources.tables import write_alerts, write_query_log
from domainlake.sources.versioned import VersionedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State store for large keyed state; custom state needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet file stream over a folder, or over a single file by its name in the folder."""
    batch = spark.read.parquet(path)
    files = batch.inputFiles()
    reader = spark.readStream.schema(batch.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if len(files) == 1 and os.path.basename(files[0]) == os.path.basename(path):
        folder, name = os.path.split(path)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None):
    """Start stateful queries inside with n state partitions, by default one per core.

    The number is fixed in a query's checkpoint, so choose it for the cluster it will run on.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n or spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def run_to_table(
    stream: DataFrame, name: str, mode: str = "append", partitions: int | None = None
) -> DataFrame:
    """Process all available input into parquet in the shared folder and read it back; for endless
    streams start the writer with a trigger of its own."""
    spark = stream.sparkSession
    path = fresh_dir(spark, name)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
    )
    with state_partitions(spark, partitions):
        query = writer.start(f"{path}/table")
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def stream_score(
    queries: DataFrame,
    log_path: str,
    alert_path: str,
    checkpoint: str,
    add_probabilities: Callable[[DataFrame], DataFrame],
    read_blocklist: Callable[[], DataFrame] | None = None,
    settings: Settings = Settings(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score each micro-batch by its names alone and write log and alerts.

    The blocklist is read again for every batch, so a refreshed list takes effect at once. A batch
    writes into its own folder and overwrites it when replayed, so a restart duplicates nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        listed = read_blocklist() if read_blocklist else None
        scored = score_queries(add_probabilities(batch), listed, settings=settings).persist()
        write_query_log(scored, f"{log_path}/batch_id={batch_id}", mode="overwrite")
        write_alerts(scored, f"{alert_path}/batch_id={batch_id}", mode="overwrite")
        scored.unpersist()

    return (
        queries.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_rate_windows(
    queries: DataFrame, window: str = "1 second", slide: str = "100 milliseconds",
    limit: int = RATE_LIMIT, delay: str = "10 seconds",
) -> DataFrame:
    """Clients above the limit per sliding window. Counts combine map-side, so no key is hot."""
    return (
        queries.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide), "client_ip")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit)
        .select("client_ip", F.col("window.start").alias("window_start"), "n")
    )


#: Clients, or names, are dealt to so many keys of state per time span; a query keeps the number that its checkpoint began with.
BUCKETS = 16
#: Bytes of state that a worker may gather before it hands them over.
HANDED_OVER = 1 << 24


def _columns(frames: Iterator[pd.DataFrame], schema: pa.Schema) -> pa.Table:
    """The columns of `schema` of some frames."""
    arrays = ([pa.array(f[c.name].to_numpy(), c.type, from_pandas=True) for c in schema] for f in frames)
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(a, schema=schema) for a in arrays], schema)


def _packed(rows: pa.Table) -> bytes:
    """Rows as one value of state, which is read and written at once."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pa.Table:
    """The rows of `_packed`."""
    return pa.ipc.open_stream(pa.py_buffer(value)).read_all()


def _trailing(who: pa.ChunkedArray, times: np.ndarray, width: int) -> np.ndarray:
    """How many rows of the same `who` lie in the trailing window of each row, ends included."""
    owner = who.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    instants, at = np.unique(times, return_inverse=True)
    first = np.searchsorted(instants, instants - width, side="left")[at]
    # Numbers in the order of owner and time; they stay far below 2 ** 63, as both are counted.
    base = owner * (len(instants) + 1)
    order = np.sort(base + at)
    return np.searchsorted(order, base + at, side="right") - np.searchsorted(order, base + first, side="left")


class TrailingCount:
    """Counts the queries of each client in the trailing window, whatever order they arrive in.

    Keys are (bucket, span): clients are dealt to buckets, and the rows of a bucket to the spans of `_spans`, with
    their context. So a call counts many clients at once and sees at most a few windows of them, and the number of
    calls grows neither with the clients nor with the rows. State holds the queries that a row after the watermark
    may still count or be counted by, as one value. A late query raises the counts of those after it, which are
    emitted again.
    """

    ARRIVED = pa.schema({"t": pa.int64(), "id": pa.int64(), "client_ip": pa.string(), "own": pa.bool_()})

    def __init__(self, width: int, span: int, limit: int):
        self.width, self.span, self.limit = width, span, limit

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _columns(frames, self.ARRIVED)
        rows = rows.append_column("recent", pa.array(np.zeros(len(rows), np.int64)))
        if state.exists:
            rows = pa.concat_tables([_unpacked(state.get[0]), rows])
        times = rows["t"].to_numpy()
        recent = _trailing(rows["client_ip"], times, self.width)
        changed = (recent != rows["recent"].to_numpy()) & rows["own"].to_numpy()
        out = rows.select(["id", "client_ip"]).filter(pa.array(changed)).to_pandas()
        yield out.assign(recent=recent[changed], rate_limited=recent[changed] > self.limit)
        now, end = state.getCurrentWatermarkMs(), (int(key[1]) + 1) * self.span // 1000
        kept = rows.drop_columns("recent").append_column("recent", pa.array(recent)).filter(pa.array(times >= now * 1000 - self.width))
        if len(kept) and end > now:
            state.update((_packed(kept),))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()


def _spans(rows: DataFrame, width: int, slices: int) -> DataFrame:
    """`rows(t)` by time span; those of the last window of a span also come to the next one as context."""
    span = width * slices
    own = F.floor(F.col("t") / span)
    near_end = F.col("t") >= (own + 1) * span - width
    spans = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("span", F.explode(spans)).withColumn("own", F.col("span") == own)


def _bucket(who: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(who), F.lit(buckets)).alias("bucket")


def stream_rate_limit(
    queries: DataFrame, seconds: float = 1.0, limit: int = RATE_LIMIT, slices: int = 10,
    delay: str = "10 seconds", buckets: int = BUCKETS,
) -> DataFrame:
    """(id, client_ip, recent, rate_limited): the exact trailing count of each query, as soon as it arrives.

    Queries of one client with equal timestamps count each other. Where a late query raises the count of one
    already emitted, that one is emitted again, so the largest count of an id is its last word (`settled`);
    queries later than `delay` or without a timestamp are dropped. One client is spread over its time spans, and
    `buckets` of clients over the tasks of a span.
    """
    width = int(seconds * 1_000_000)
    timed = queries.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("t", micros())
    known = timed.where("t is not null").withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    bucket = _bucket(F.col("client_ip"), buckets)
    keyed = _spans(known, width, slices).select("ts", "id", "client_ip", "t", "span", "own", bucket)
    use_rocksdb(queries.sparkSession)
    counted = keyed.groupBy("bucket", "span").applyInPandasWithState(
        TrailingCount(width, width * slices, limit),
        outputStructType="id bigint, client_ip string, recent bigint, rate_limited boolean",
        stateStructType="held binary",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    return counted.withColumn("id", F.nullif("id", F.lit(NO_ID)))


def settled(emitted: DataFrame) -> DataFrame:
    """The last word on every query of a written `stream_rate_limit`; counts only grow."""
    return emitted.groupBy("id", "client_ip").agg(F.max("recent").alias("recent"), F.max("rate_limited").alias("rate_limited"))


#: What a detection stream keeps of an event until its turn comes, and gives out then.
EVENT = "kind int, id bigint, t bigint, client_ip string, domain string, query_type string, dga_prob double, decision double, ip string"
_EVENT_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
QUERY, ANSWER = 0, 1
NO_ID = -(1 << 63)


class InOrder:
    """Holds the events of a key back until the watermark passes them, and counts trailing queries.

    Keys are (bucket, span) of clients for queries and of domains for answers. What is given out is final: no earlier
    event of the key can come any more. State holds the events that wait, packed by the batch they came with, the
    least time of them, and the times of the last window.
    """

    WAITING = pa.schema({
        "kind": pa.int32(), "id": pa.int64(), "t": pa.int64(), "client_ip": pa.string(), "domain": pa.string(), "query_type": pa.string(),
        "dga_prob": pa.float64(), "decision": pa.float64(), "ip": pa.string(), "own": pa.bool_(),
    })

    def __init__(self, width: int, batch_rows: int):
        self.width, self.batch_rows, self.gathered = width, max(batch_rows, 0), 0

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        first, waiting, times = state.get if state.exists else (None, [], None)
        waiting, times = [*waiting], times and _unpacked(times)
        if not state.hasTimedOut:
            new = _columns(frames, self.WAITING)
            waiting.append(_packed(new))
            least = pc.min(new["t"]).as_py()
            first = least if first is None else min(first, least)
        if first is not None and first > now:
            yield from self._handed_over(waiting)
        else:
            rows = pa.concat_tables([self.WAITING.empty_table(), *map(_unpacked, waiting)])
            passed = pc.less_equal(rows["t"], now)
            rest = rows.filter(pc.invert(passed))
            ready, times = self._counted(rows.filter(passed), times, now)
            yield ready
            waiting, first = [_packed(rest)] if len(rest) else [], pc.min(rest["t"]).as_py()
        # Come back for the next event, or to forget the times once they are out of every window.
        due = first if first is not None else times and pc.max(times["t"]).as_py() + self.width
        if due is None:
            state.remove()
        else:
            state.update((first, waiting, times and _packed(times)))
            state.setTimeoutTimestamp(max(-(-due // 1000) - 1, 1))

    def _counted(self, ready: pa.Table, times: pa.Table | None, now: int) -> tuple[pd.DataFrame, pa.Table | None]:
        """The events that `now` has passed with their counts, and the times that later ones may still count."""
        query = pc.equal(ready["kind"], QUERY)
        name = pc.fill_null(pc.if_else(query, ready["client_ip"], ready["domain"]), "")
        who = pc.binary_join_element_wise(pc.if_else(query, "c", "d"), name, "")
        seen = pa.table({"who": who, "t": ready["t"]})
        seen = pa.concat_tables([seen, times]) if times else seen
        at = seen["t"].to_numpy()
        recent = pa.array(_trailing(seen["who"], at, self.width)[: len(ready)])
        out = ready.append_column("recent", recent).filter(ready["own"]).drop_columns("own").to_pandas()
        kept = seen.filter(pa.array(at > now - self.width))
        return out, kept if len(kept) else None

    def _handed_over(self, waiting: list[bytes]) -> Iterator[pd.DataFrame]:
        """Rows without a kind, which are left out later: a worker keeps state until that many rows of output follow."""
        self.gathered += sum(map(len, waiting))
        if self.gathered > HANDED_OVER:
            self.gathered = 0
            blank = [n for n in self.WAITING.names if n != "own"]
            yield pd.DataFrame({n: None for n in [*blank, "recent"]}, index=range(self.batch_rows + 1))


def events_in_order(
    queries: DataFrame, answers: DataFrame, seconds: float = 1.0, slices: int = 10, delay: str = "10 seconds",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Queries and answers of two streams once no earlier ones can come, with `recent` of the queries.

    Each is given out once, in the batch after the watermark passes it, so batches follow each other in time.
    Keys are (bucket, span), with buckets of clients for queries and of domains for answers. Events without a
    timestamp belong to no order and are left out, and so are those later than `delay`.
    """
    width = int(seconds * 1_000_000)
    kinds = dict(part.split() for part in EVENT.split(", "))

    def as_events(rows: DataFrame, kind: int) -> DataFrame:
        names = set(rows.columns)
        columns = [(F.col(c) if c in names else F.lit(None)).cast(t).alias(c) for c, t in kinds.items() if c not in ("kind", "t", "id")]
        # Whole numbers with a null among them would reach the workers as floats.
        columns.append(F.coalesce(F.col("id").cast("bigint"), F.lit(NO_ID)).alias("id"))
        return rows.select(F.lit(kind).alias("kind"), F.col("ts").cast("timestamp").alias("ts"), *columns)

    events = as_events(queries, QUERY).unionByName(as_events(answers, ANSWER)).where("ts is not null")
    timed = events.withWatermark("ts", delay).withColumn("t", micros())
    who = F.when(F.col("kind") == QUERY, F.concat(F.lit("c"), F.coalesce("client_ip", F.lit("")))).otherwise(
        F.concat(F.lit("d"), F.coalesce("domain", F.lit("")))
    )
    keyed = _spans(timed.withColumn("bucket", _bucket(who, buckets)), width, slices).where((F.col("kind") == QUERY) | F.col("own"))
    spark = queries.sparkSession
    use_rocksdb(spark)
    ordered = keyed.select("bucket", "span", "ts", *_EVENT_COLUMNS, "own").groupBy("bucket", "span").applyInPandasWithState(
        InOrder(width, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))),
        outputStructType=f"{EVENT}, recent bigint",
        stateStructType="first bigint, waiting array<binary>, times binary",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    return ordered.where("kind is not null").withColumn("id", F.nullif("id", F.lit(NO_ID)))


def stream_detect(
    queries: DataFrame,
    answers: DataFrame,
    log_path: str,
    alert_path: str,
    state_path: str,
    checkpoint: str,
    read_blocklist: Callable[[], DataFrame] | None = None,
    whitelist: DataFrame | None = None,
    settings: Settings = Settings(),
    seconds: float = 1.0,
    rate_limit: int = RATE_LIMIT,
    shadow_limit: int = SHADOWING_LIMIT,
    flux_limit: int = FLUX_LIMIT,
    delay: str = "10 seconds",
    trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """The whole path of a live query log: rate limit, lists, behaviour, score, log and alerts.

    `queries(id, ts, client_ip, domain, query_type, dga_prob, decision)` and `answers(id, ts, domain, ip)` are
    streams. Events are put in order (`events_in_order`), and each batch of them is decided as `score_log`
    decides a whole log: a batch adds the first sightings of sub-domains and addresses to a versioned table,
    and the point at which a name crosses its limit to another. Keys that have crossed need no sightings any
    more, so there are at most limit + 1 for each. Sightings are counted by bounded heaps across tasks, so no
    name is hot. A replayed batch rewrites its own folders. `trigger` is what `DataStreamWriter.trigger` takes,
    all available input by default.
    """
    spark = queries.sparkSession
    crossings = VersionedTable(spark, f"{state_path}/crossings", "kind int, key string, crossing struct<ts: timestamp, id: bigint>")
    limits = {QUERY: shadow_limit, ANSWER: flux_limit}

    def open_only(rows: DataFrame) -> DataFrame:
        return rows.join(crossings.read().select("kind", "key"), ["kind", "key"], "left_anti")

    sightings = VersionedTable(
        spark, f"{state_path}/sightings", "kind int, key string, member string, at struct<ts: timestamp, id: bigint>", merge=open_only
    )

    def first_sightings(rows: DataFrame, kind: int, key: str, member: str, at: str) -> DataFrame:
        firsts = rows.where(F.col(key).isNotNull() & F.col(member).isNotNull())
        firsts = firsts.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(member).alias("member"), F.col(at).alias("at"))
        return firsts.groupBy("kind", "key", "member").agg(F.min("at").alias("at"))

    def write(batch: DataFrame, batch_id: int) -> None:
        events = batch.withColumn("ts", F.timestamp_micros("t")).persist()
        try:
            # One job evaluates the state; a batch that only holds events back has nothing to decide.
            if not events.count():
                return
            passed = events.where((F.col("kind") == QUERY) & (F.col("recent") <= rate_limit))
            analysed = query_type_filter(passed.select("id", "ts", "client_ip", "domain", "query_type", "dga_prob", "decision"))
            listed = read_blocklist() if read_blocklist else None
            names = detection.named(analysed, listed, whitelist, settings)
            answered = events.where(F.col("kind") == ANSWER).withColumn("at", F.struct("ts", "id"))
            new = first_sightings(detection.feeding(names), QUERY, "base", "sub", "first_seen").unionByName(
                first_sightings(answered, ANSWER, "domain", "ip", "at")
            )
            known, crossed = sightings.read(batch_id), crossings.read(batch_id)
            new = new.join(known.select("kind", "key", "member"), ["kind", "key", "member"], "left_anti")
            new = new.join(crossed.select("kind", "key"), ["kind", "key"], "left_anti")
            sightings.append(batch_id, new)
            added = spark.read.schema(sightings.schema).parquet(f"{sightings.path}/delta={batch_id}")
            touched = known.join(added.select("kind", "key").distinct(), ["kind", "key"], "left_semi").unionByName(added)
            points = [
                crossing_points(touched.where(F.col("kind") == kind), "key", "member", limit, F.col("at")).withColumn("kind", F.lit(kind))
                for kind, limit in limits.items()
            ]
            crossings.append(batch_id, points[0].unionByName(points[1]))
            points = crossings.read(batch_id + 1)
            shadow, flux = (
                points.where(F.col("kind") == kind).select(F.col("key").alias(name), "crossing")
                for kind, name in ((QUERY, "base"), (ANSWER, "domain"))
            )
            scored = detection.scored(analysed, names, shadow, flux, settings).persist()
            write_query_log(scored, f"{log_path}/batch_id={batch_id}", mode="overwrite")
            write_alerts(scored, f"{alert_path}/batch_id={batch_id}", mode="overwrite")
            scored.unpersist()
        finally:
            events.unpersist()

    ordered = events_in_order(queries, answers, seconds, delay=delay, buckets=buckets)
    writer = ordered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    with state_partitions(spark):
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def _distinct_per_window(
    stream: DataFrame, key: str, member: str, window: str, delay: str, exact: bool
) -> DataFrame:
    """(key, window_start, members): distinct members per key and tumbling window."""
    events = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    slot = F.window("ts", window)
    if exact:
        # One state entry per (key, member, window): a hot key spreads over its members.
        once = events.select(slot.alias("window"), key, member).dropDuplicates(
            ["window", key, member]
        )
        counted = once.groupBy("window", key).agg(F.count(F.lit(1)).alias("members"))
    else:
        counted = events.groupBy(slot, key).agg(F.approx_count_distinct(member).alias("members"))
    return counted.select(key, F.col("window.start").alias("window_start"), "members")


def stream_shadowing(
    queries: DataFrame, limit: int = SHADOWING_LIMIT, window: str = "1 hour",
    delay: str = "10 minutes", exact: bool = False,
) -> DataFrame:
    """Bases with more than `limit` distinct first labels inside a window."""
    events = with_base(queries).filter("base is not null")
    found = _distinct_per_window(events, "base", "sub", window, delay, exact)
    return found.filter(F.col("members") > limit)


def stream_fast_flux(
    resolutions: DataFrame, limit: int = FLUX_LIMIT, window: str = "1 hour",
    delay: str = "10 minutes", exact: bool = False,
) -> DataFrame:
    """Domains with more than `limit` distinct addresses inside a window."""
    found = _distinct_per_window(resolutions, "domain", "ip", window, delay, exact)
    return found.filter(F.col("members") > limit)


class Crossing(StatefulProcessor):
    """Emits a key once, when its count of distinct members first exceeds the limit."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        before = self.count.get()[0] if self.count.exists() else 0
        total = before + sum(len(pdf) for pdf in rows)
        self.count.update((total,))
        if before <= self.limit < total:
            yield pd.DataFrame({"key": [key[0]], "members": [total]})

    def close(self) -> None:
        pass


def stream_crossings(stream: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """(key, members) once per key that exceeds `limit` distinct members over the whole stream.

    For streams that end; `stream_recrossings` keeps bounded state on endless ones.

    Members are first made distinct with state per (key, member), spread over all tasks; the state
    of a key is then a single number.
    """
    use_rocksdb(stream.sparkSession)
    return (
        stream.select(key, member)
        .dropDuplicates([key, member])
        .groupBy(key)
        .transformWithStateInPandas(
            statefulProcessor=Crossing(limit),
            outputStructType="key string, members bigint",
            outputMode="Append",
            timeMode="None",
        )
    )


class ActiveMembers(StatefulProcessor):
    """Emits a key whenever its active members become more than the limit; members not seen for a while go.

    State holds a key's active members, and goes with the last of them.
    """

    def __init__(self, limit: int, ttl: int):
        self.limit, self.ttl = limit, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getListState("members", "member string, t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        # Members in the order in which they were last seen, so that the first ones expire first.
        active = OrderedDict(sorted(((m, t) for m, t in self.members.get()), key=lambda x: x[1]))
        found = []
        for t, member in pd.concat(list(rows)).sort_values(["t", "id"])[["t", "member"]].itertuples(index=False):
            while active and next(iter(active.values())) <= t - self.ttl:
                active.popitem(last=False)
            before = len(active)
            if active.get(member, t) <= t:
                active[member] = t
                active.move_to_end(member)
            if before <= self.limit < len(active):
                found.append((key[0], pd.Timestamp(t, unit="us"), len(active)))
        self._keep(active)
        yield pd.DataFrame(found, columns=["key", "at", "members"]).astype({"at": "datetime64[us]", "members": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        since = timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl
        self._keep(OrderedDict((m, t) for m, t in self.members.get() if t > since))
        yield pd.DataFrame([], columns=["key", "at", "members"]).astype({"key": "str", "at": "datetime64[us]", "members": "int64"})

    def _keep(self, active: OrderedDict) -> None:
        if active:
            self.members.put(list(active.items()))
            self.handle.registerTimer(int(-(-(max(active.values()) + self.ttl) // 1000)))
        else:
            self.members.clear()

    def close(self) -> None:
        pass


def stream_recrossings(
    stream: DataFrame, key: str, member: str, limit: int, ttl: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """(key, at, members) each time a key's members seen within `ttl` become more than `limit`.

    A member counts until `ttl` after it was last seen, so a key that fell back and rises again is emitted
    again, and the state of an endless stream is bounded by the members of the last `ttl`. Rows of a batch
    are taken in order of time; a row later than its batch only prolongs its member.
    """
    use_rocksdb(stream.sparkSession)
    micros_of = stream.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {ttl})")).first()[0]
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("t", micros())
    rows = rows.select(F.col(key).alias("key"), F.col(member).alias("member"), "ts", "t", F.coalesce("id", F.lit(NO_ID)).alias("id"))
    return rows.where("key is not null and member is not null and t is not null").groupBy("key").transformWithStateInPandas(
        statefulProcessor=ActiveMembers(limit, micros_of),
        outputStructType="key string, at timestamp, members bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_new_alerts(alerts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Every alert id once, however often it is delivered within the delay."""
    return (
        alerts.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["id"])
    )


def stream_timeline(queries: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Closed minutes with their query and blocked counts; later rows are dropped."""
    return (
        queries.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 minute"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("blocked").alias("blocked"))
        .select(F.col("window.start").alias("minute"), "total", "blocked")
    )


LIST = "id bigint, domain string, category string, source string"


def blocklist_table(spark: SparkSession, path: str, every: int = 10) -> VersionedTable:
    """The versioned blocklist that `stream_feed_refresh` keeps; version -1 is the list it starts from."""
    return VersionedTable(spark, path, LIST, every)


def stream_feed_refresh(
    spark: SparkSession,
    feed_path: str,
    parse: Callable[[DataFrame], DataFrame],
    listed: VersionedTable,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Add newly landed feed files to a versioned blocklist.

    Each batch writes its new domains as a version and compares with the last snapshot and the versions since,
    so what it reads doesn't grow with the number of batches. A replayed batch rewrites the same rows, also
    after a compaction.
    """

    def write(lines: DataFrame, batch_id: int) -> None:
        entries = parse(lines).withColumn("seq", F.lit(batch_id))
        fresh = new_entries(listed.read(batch_id), entries).withColumn("id", F.lit(None).cast("bigint"))
        listed.append(batch_id, fresh)

    return (
        spark.readStream.text(feed_path)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
