"""Behavioural detection over query and resolution logs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from domainlake.constants import DEFAULT_TTL, FLUX_LIMIT, RATE_LIMIT, SHADOWING_LIMIT
from domainlake.operators.joins import lookup
from domainlake.operators.lists import utc_day
from domainlake.session import written


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _arrivals_and_departures(log: DataFrame, width: int) -> DataFrame:
    """(client_ip, at, step): queries of a client that arrive at an instant, and that age out just after.

    Queries of equal client and time are counted before the shuffle. `at` is twice the time, odd just after it.
    """
    counts = log.filter("_t is not null").groupBy("client_ip", "_t").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "client_ip",
        F.explode(
            F.array(
                F.struct((F.col("_t") * 2).alias("at"), F.col("n").alias("step")),
                F.struct(((F.col("_t") + width) * 2 + 1).alias("at"), (-F.col("n")).alias("step")),
            )
        ).alias("mark"),
    ).select("client_ip", "mark.at", "mark.step")


def rate_limit_flags(log: DataFrame, seconds: float = 1.0, limit: int = RATE_LIMIT) -> DataFrame:
    """Add `recent` (queries of the client in the trailing window, inclusive) and `rate_limited`.

    Queries of one client with equal timestamps count each other. A query adds one when it arrives and
    takes one away just after it has aged out, so `recent` is a running sum. The marks are cut into slices
    of even size in the order of client and time, so a client with any share of the log has as many
    slices as its share asks for; a slice starts from the totals of the client's slices before it. Queries
    without a timestamp are kept with `recent` 0, never limited.
    """
    width = int(seconds * 1_000_000)
    timed = log.withColumn("_t", micros())
    marks = _arrivals_and_departures(timed, width)
    # Written, so that totals and running sums see the same slices whatever executor computes them.
    placed = written(
        marks.repartitionByRange("client_ip", "at").withColumn("slice", F.spark_partition_id()), "rate-marks"
    )
    totals = placed.groupBy("client_ip", "slice").agg(F.sum("step").alias("step"))
    earlier = Window.partitionBy("client_ip").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("client_ip", "slice", F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("before"))
    so_far = Window.partitionBy("client_ip", "slice").orderBy("at")
    same = F.col("m.client_ip").eqNullSafe(F.col("b.client_ip")) & (F.col("m.slice") == F.col("b.slice"))
    counted = (
        placed.withColumn("within", F.sum("step").over(so_far))
        .filter("step > 0")
        .alias("m")
        .join(before.alias("b"), same)
        .select(
            F.struct(F.col("m.client_ip").alias("client"), (F.col("m.at") / 2).cast("long").alias("t")).alias("_when"),
            (F.col("before") + F.col("within")).alias("recent"),
        )
    )
    # A row without a timestamp has a key of its own, which meets nothing.
    key = F.struct(F.col("client_ip").alias("client"), F.coalesce("_t", F.lit(-(1 << 62)) + F.pmod(F.xxhash64(*log.columns), F.lit(1 << 20))).alias("t"))
    rows = lookup(timed.withColumn("_when", key), counted, "_when")
    recent = F.coalesce("recent", F.lit(0)).cast("long")
    return rows.select(*log.columns, recent.alias("recent"), (recent > limit).alias("rate_limited"))


def first_k(value: str | Column, k: int) -> Column:
    """Aggregate: the k least values of a group in ascending order.

    A bounded heap for each group that is merged across tasks, so at most k values of a group leave a
    task, for any k.
    """
    return F.array_sort(InternalFunction.collect_top_k(F.col(value) if isinstance(value, str) else value, k, True))


def crossing_points(
    events: DataFrame, key: str, member: str, limit: int, sighting: Column | None = None
) -> DataFrame:
    """(key, crossing): the event at which a key's distinct members first exceed `limit`.

    An event is struct(ts, id), or the given `sighting` column of the same form.
    Events collapse to the first sighting of each (key, member) before the shuffle, and each task passes on
    the first limit + 1 sightings of a key at most, so a key holding a third of all events costs no more
    than any other.
    """
    at = F.struct("ts", "id") if sighting is None else sighting
    firsts = events.groupBy(key, member).agg(F.min(at).alias("crossing"))
    least = firsts.groupBy(key).agg(first_k("crossing", limit + 1).alias("_first"))
    return least.filter(F.size("_first") > limit).select(key, F.element_at("_first", limit + 1).alias("crossing"))


def reached(crossing: str) -> Column:
    """Whether the row is at or after the event in `crossing`; false without one."""
    return F.coalesce(F.struct("ts", "id") >= F.col(crossing), F.lit(False))


def _flag_from(events: DataFrame, crossings: DataFrame, key: str, name: str) -> DataFrame:
    """Flag events at or after the crossing of their key.

    Events without a key get one of their own that matches nothing, so they spread over all tasks.
    """
    own = F.concat(F.lit("#"), F.col("id").cast("string"))
    return (
        lookup(
            events.withColumn("_key", F.coalesce(F.col(key), own)),
            crossings.withColumnRenamed(key, "_key"),
            "_key",
        )
        .withColumn(name, F.col(key).isNotNull() & reached("crossing"))
        .drop("crossing", "_key")
    )


def with_base(log: DataFrame) -> DataFrame:
    """Add `base` (last two labels; NULL below three labels) and `sub` (first label)."""
    domain = F.col("domain")
    dots = F.length(domain) - F.length(F.replace(domain, F.lit("."), F.lit("")))
    return log.withColumn(
        "base", F.when(dots >= 2, F.substring_index(domain, ".", -2))
    ).withColumn("sub", F.substring_index(domain, ".", 1))


def shadowing_flags(log: DataFrame, limit: int = SHADOWING_LIMIT) -> DataFrame:
    """Add `shadowing`: the base domain has shown more than `limit` distinct first labels so far."""
    events = with_base(log)
    crossings = crossing_points(events.filter("base is not null"), "base", "sub", limit)
    return _flag_from(events, crossings, "base", "shadowing").drop("base", "sub")


def shadowing_bases(
    log: DataFrame, limit: int = SHADOWING_LIMIT, approximate: bool = False
) -> DataFrame:
    """Bases above the limit with their distinct labels, requests and distinct clients.

    Exact counts take two levels: rows collapse to (base, label, client) in the tasks that read them, and
    members are counted from there, without a copy of the log for each distinct count. Approximate ones
    are those of `base_sketches`.
    """
    if approximate:
        return bases_from_sketches(base_sketches(log), limit)
    events = with_base(log).filter("base is not null")
    met = events.groupBy("base", "sub", "client_ip").agg(F.count(F.lit(1)).alias("n"))
    labels = met.groupBy("base", "sub").agg(F.sum("n").alias("n"))
    found = labels.groupBy("base").agg(F.count("sub").alias("sub_labels"), F.sum("n").alias("requests"))
    clients = met.groupBy("base", "client_ip").agg(F.lit(1)).groupBy("base").agg(F.count("client_ip").alias("clients"))
    return found.filter(F.col("sub_labels") > limit).join(clients, "base")


def base_sketches(log: DataFrame, bits: int = 12) -> DataFrame:
    """(day, base, labels, clients, requests): mergeable sketches of a day's distinct labels and clients.

    To be stored: the next day's log adds its own rows, and any span of days is merged from them.
    """
    events = with_base(log).filter("base is not null").withColumn("day", utc_day(F.col("ts"), dict(log.dtypes)["ts"]))
    return events.groupBy("day", "base").agg(
        F.hll_sketch_agg("sub", bits).alias("labels"),
        F.hll_sketch_agg("client_ip", bits).alias("clients"),
        F.count(F.lit(1)).alias("requests"),
    )


def bases_from_sketches(sketches: DataFrame, limit: int = SHADOWING_LIMIT) -> DataFrame:
    """What `shadowing_bases` counts, estimated from stored sketches (standard error 1.6 % at 12 bits)."""
    merged = sketches.groupBy("base").agg(
        F.hll_sketch_estimate(F.hll_union_agg("labels")).alias("sub_labels"),
        F.sum("requests").alias("requests"),
        F.hll_sketch_estimate(F.hll_union_agg("clients")).alias("clients"),
    )
    return merged.filter(F.col("sub_labels") > limit)


def fast_flux_flags(resolutions: DataFrame, limit: int = FLUX_LIMIT) -> DataFrame:
    """Add `fast_flux`: the domain has resolved to more than `limit` distinct addresses so far."""
    crossings = crossing_points(resolutions, "domain", "ip", limit)
    return _flag_from(resolutions, crossings, "domain", "fast_flux")


def response_profile(resolutions: DataFrame) -> DataFrame:
    """Per response (its id): the address list and lowest TTL (60 without one).

    A response is one packet, so its address list is small by construction.
    """
    return resolutions.groupBy("id", "domain").agg(
        F.array_sort(F.collect_set("ip")).alias("ips"),
        F.coalesce(F.min("ttl"), F.lit(DEFAULT_TTL)).alias("min_ttl"),
    )


def resolution_profile(resolutions: DataFrame) -> DataFrame:
    """Per domain: distinct addresses, answers and lowest TTL, without collecting addresses."""
    return resolutions.groupBy("domain").agg(
        F.count_distinct("ip").alias("n_ips"),
        F.count(F.lit(1)).alias("answers"),
        F.coalesce(F.min("ttl"), F.lit(DEFAULT_TTL)).alias("min_ttl"),
    )


def behaviour_join(
    log: DataFrame,
    resolutions: DataFrame,
    seconds: float = 1.0,
    rate_limit: int = RATE_LIMIT,
    shadow_limit: int = SHADOWING_LIMIT,
    flux_limit: int = FLUX_LIMIT,
) -> DataFrame:
    """Queries that pass the rate limiter with their shadowing and fast-flux state.

    Rate-limited queries are removed first and feed no later state. A query sees the addresses its
    domain had resolved to by the query's own (ts, id).
    """
    # Written, as the crossings and the flags both read it.
    passed = written(rate_limit_flags(log, seconds, rate_limit).filter(~F.col("rate_limited")), "passed")
    flagged = shadowing_flags(passed.drop("rate_limited", "recent"), shadow_limit)
    crossings = crossing_points(resolutions, "domain", "ip", flux_limit)
    return _flag_from(flagged, crossings, "domain", "fast_flux")
