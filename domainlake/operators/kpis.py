"""Monitoring aggregates over the query log, the alerts and the blocklist."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domainlake.operators.lists import utc_day
from domainlake.operators.scoring import canonical_threat_type
from domainlake.session import written


def newest() -> list[Column]:
    """Newest first, with the id as tie-break."""
    return [F.desc("ts"), F.desc("id")]


def _counts() -> dict[str, Column]:
    """Counters by reporting vocabulary; the engine's own kinds count under their reporting names."""
    kind = canonical_threat_type(F.col("threat_type"))
    return {
        "total": F.count(F.lit(1)),
        "blocked": F.count_if(F.col("blocked")),
        "dga": F.count_if(kind == "DGA"),
        "tunnel": F.count_if(kind == "Tunneling"),
        "phishing": F.count_if(kind == "Phishing"),
        "blocklist_hits": F.count_if(kind == "Blocklist"),
    }


def kpi_stats(log: DataFrame, blocklist: DataFrame) -> DataFrame:
    """All counters in one pass over the log, plus the blocklist size."""
    size = blocklist.agg(F.count(F.lit(1)).alias("n")).scalar()
    return log.agg(*[c.alias(n) for n, c in _counts().items()]).withColumn("blocklist_size", size)


def client_risk(log: DataFrame) -> DataFrame:
    """Per client: queries, blocked queries and highest score, most blocked first."""
    return (
        log.groupBy("client_ip")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("blocked").alias("blocked"),
            F.round(F.max("threat_score").cast("decimal(18,6)"), 1)
            .cast("double")
            .alias("max_score"),
        )
        .orderBy(F.desc("blocked"), "client_ip")
    )


def client_risk_top(log: DataFrame, n: int = 6) -> DataFrame:
    """Top clients with their blocked share (rounded half up) and colour band."""
    share = F.least(
        F.lit(100), F.floor(F.col("blocked") / F.col("total") * 100 + 0.5).cast("int")
    )
    return (
        client_risk(log)
        .limit(n)
        .withColumn("risk_pct", share)
        .withColumn(
            "colour",
            F.when(F.col("risk_pct") > 30, "red")
            .when(F.col("risk_pct") > 10, "amber")
            .otherwise("green"),
        )
    )


def timeline(log: DataFrame) -> DataFrame:
    """Queries and blocked queries per minute."""
    return (
        log.groupBy(F.date_trunc("minute", "ts").alias("minute"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("blocked").alias("blocked"))
        .withColumn("t", F.date_format("minute", "HH:mm"))
    )


def timeline_minutes(log: DataFrame) -> DataFrame:
    return timeline(log).orderBy("minute")


def timeline_recent(log: DataFrame, n: int = 30) -> DataFrame:
    """The last n minute buckets, oldest first."""
    return timeline(log).orderBy(F.desc("minute")).limit(n).orderBy("minute")


def latest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*newest()).limit(n)


def paged(df: DataFrame, page: int, order: list[Column], size: int = 100) -> DataFrame:
    """Page `page` (1-based) with the total number of pages; for shallow pages."""
    pages = df.agg(F.ceil(F.count(F.lit(1)) / size).alias("n")).scalar()
    return (
        df.orderBy(*order)
        .offset((page - 1) * size)
        .limit(size)
        .withColumn("page", F.lit(page))
        .withColumn("total_pages", pages)
    )


def paged_log(log: DataFrame, page: int, size: int = 100) -> DataFrame:
    return paged(log, page, newest(), size)


def day_counts(log: DataFrame) -> list[tuple]:
    """(day, rows) of a log that is stored by day, newest first; reads no column but the folders' names."""
    days = log.groupBy("dt").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each day
    return sorted(((r["dt"], r["n"]) for r in days), key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)


def _of_days(log: DataFrame, days: list) -> DataFrame:
    """Rows of the given days, by a filter on the folders."""
    known = [d for d in days if d is not None]
    chosen = F.col("dt").isin(known) if known else F.lit(False)
    return log.filter(chosen | F.col("dt").isNull() if None in days else chosen)


def paged_stored_log(log: DataFrame, page: int, size: int = 100, days: list[tuple] | None = None) -> DataFrame:
    """`paged_log` of a log stored by day: only the days that the page touches are read, however deep it is.

    The rows of the days decide which those are; pass `day_counts` to ask for them once for many pages.
    """
    days = day_counts(log) if days is None else days
    start, before, skipped, touched = (page - 1) * size, 0, 0, []
    for day, n in days:
        if before + n <= start:
            skipped += n
        elif before < start + size:
            touched.append(day)
        before += n
    rows = _of_days(log, touched).drop("dt").orderBy(*newest()).offset(start - skipped).limit(size)
    return rows.withColumn("page", F.lit(page)).withColumn("total_pages", F.lit(-(-before // size)).cast("long"))


def paged_log_after(
    log: DataFrame, ts: str, id: int, size: int = 100, days: list[tuple] | None = None
) -> DataFrame:
    """The page that follows the row (ts, id), by a filter that is pushed down.

    Of a log stored by day (with a column dt, days in UTC) the row's own day is read and as many earlier ones as
    their rows ask for; without that column the scan is pruned by file statistics alone.
    """
    at = F.lit(ts).cast(dict(log.dtypes)["ts"])
    older = (F.col("ts") < at) | ((F.col("ts") == at) & (F.col("id") < id))
    if "dt" in log.columns:
        days = day_counts(log) if days is None else days
        own = log.sparkSession.range(1).select(utc_day(at, dict(log.dtypes)["ts"]).alias("d")).first()["d"]
        touched, n = [], 0
        for day, rows in days:
            if day is not None and day > own:
                continue
            touched.append(day)
            n += rows if day != own else 0
            if n >= size:
                break
        log = _of_days(log, touched).drop("dt")
    return log.filter(older).orderBy(*newest()).limit(size)


def paged_blocklist(blocklist: DataFrame, page: int, size: int = 100) -> DataFrame:
    return paged(blocklist, page, [F.desc("id")], size)


def engine_share(log: DataFrame) -> DataFrame:
    """Query counts and share per engine; `safe` is everything not blocked."""
    counts = _counts()
    one = log.agg(*[c.alias(n) for n, c in counts.items()])
    return one.select(
        "total",
        F.stack(
            F.lit(4),
            F.lit("dga"), F.col("dga"),
            F.lit("tunnel"), F.col("tunnel"),
            F.lit("blocklist"), F.col("blocklist_hits"),
            F.lit("safe"), F.col("total") - F.col("blocked"),
        ).alias("engine", "n"),
    ).select("engine", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).alias("share"))


def one_decimal(x: Column) -> Column:
    """One decimal, rounding the exact binary value; exact ties go up."""
    tie = (x * 4 == F.floor(x * 4)) & (F.pmod(F.floor(x * 4), F.lit(2)) == 1)
    return F.when(tie, F.floor(x * 10 + 0.5) / 10).otherwise(F.format_number(x, 1).cast("double"))


def block_rate(log: DataFrame) -> DataFrame:
    """Blocked share of all queries in percent with one decimal, 0.0 without queries."""
    rate = one_decimal(F.col("blocked") / F.nullif(F.col("total"), F.lit(0)) * 100)
    return log.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("blocked").alias("blocked")
    ).withColumn("block_rate", F.coalesce(rate, F.lit(0.0)))


def query_rate(log: DataFrame) -> DataFrame:
    """Queries per minute between successive minute snapshots, never negative.

    The previous snapshot is looked up inside the day; only the last snapshot of each day is
    carried over, so the one unpartitioned window sees one row per day.
    """
    minutes = timeline(log).withColumn("day", F.to_date("minute"))
    in_day = Window.partitionBy("day").orderBy("minute")
    across = Window.orderBy("day")
    days = (
        minutes.groupBy("day")
        .agg(F.max("minute").alias("_last"))
        .withColumn("_carried", F.lag("_last").over(across))
        .drop("_last")
    )
    previous = F.coalesce(F.lag("minute").over(in_day), F.col("_carried"))
    elapsed = (
        F.unix_micros(F.col("minute").cast("timestamp"))
        - F.unix_micros(F.col("previous").cast("timestamp"))
    ) / 60_000_000
    return (
        minutes.join(days, "day")
        .withColumn("previous", previous)
        .filter("previous is not null")
        .withColumn("minutes", elapsed)
        .withColumn(
            "per_minute",
            F.greatest(F.lit(0), F.floor(F.col("total") / F.col("minutes") + 0.5).cast("bigint")),
        )
        .select("minute", "total", "minutes", "per_minute")
    )


def new_alerts(alerts: DataFrame, seen: DataFrame) -> DataFrame:
    """Alerts whose id has not been shown yet."""
    return alerts.join(seen.select("id"), "id", "left_anti")


def minute_counts(log: DataFrame) -> DataFrame:
    """Counters and the highest score by minute and client: what all dashboard counts are sums of."""
    return log.groupBy(F.date_trunc("minute", "ts").alias("minute"), "client_ip").agg(
        *[c.alias(n) for n, c in _counts().items()], F.max("threat_score").alias("max_score")
    )


def _latest_since(log: DataFrame, per_minute: DataFrame, n: int) -> DataFrame:
    """`latest` of a log whose rows per minute are known: only the minutes that the n rows fall into."""
    minutes = per_minute.filter("minute is not null").groupBy("minute").agg(F.sum("total").alias("n"))
    seen, since = 0, None
    for r in minutes.orderBy(F.desc("minute")).limit(n).collect():
        seen, since = seen + r["n"], r["minute"]
        if seen >= n:
            return latest(log.filter(F.col("ts") >= F.lit(since)), n)
    return latest(log, n)


def kpi_summary(log: DataFrame, alerts: DataFrame, blocklist: DataFrame) -> dict[str, DataFrame]:
    """All dashboard parts from one scan of the log and one of the alerts.

    The log is summed up by minute and client once, and written. The newest rows are read by a filter on
    the minutes they fall into, which a log stored by time prunes to its end.
    """
    base = written(minute_counts(log), "minute-counts")
    counters = list(_counts())
    size = blocklist.agg(F.count(F.lit(1)).alias("n")).scalar()
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]
    minutes = base.groupBy("minute").agg(F.sum("total").alias("total"), F.sum("blocked").alias("blocked"))
    clients = base.groupBy("client_ip").agg(
        F.sum("total").alias("total"),
        F.sum("blocked").alias("blocked"),
        F.round(F.max("max_score").cast("decimal(18,6)"), 1).cast("double").alias("max_score"),
    )
    return {
        "stats": base.agg(*total).withColumn("blocklist_size", size),
        "timeline": minutes.withColumn("t", F.date_format("minute", "HH:mm")).orderBy(F.desc("minute")).limit(30).orderBy("minute"),
        "queries": _latest_since(log, base, 50),
        "clients": clients.orderBy(F.desc("blocked"), "client_ip").limit(6),
        "alerts": latest(alerts, 10),
    }


def label_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def source_counts(corpus: DataFrame, n: int = 15) -> DataFrame:
    """The n most frequent sources."""
    return (
        corpus.groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "source")
        .limit(n)
    )


def family_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
