"""Blocklist and whitelist maintenance."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domainlake.functions.text import strip


def new_entries(current: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose domain is not listed yet; of several the earliest (by `seq`) wins.

    The rank filter on 1 runs map-side too, so repeats of one domain are not shuffled.
    """
    order = Window.partitionBy("domain").orderBy("seq")
    return (
        entries.filter("domain is not null and domain <> ''")
        .withColumn("_rn", F.row_number().over(order))
        .filter("_rn = 1")
        .join(current.select("domain"), "domain", "left_anti")
        .select("domain", "category", "source")
    )


def append_blocklist(current: DataFrame, entries: DataFrame) -> DataFrame:
    """`current` plus its new entries, whose id is NULL."""
    fresh = new_entries(current, entries).withColumn("id", F.lit(None).cast("bigint"))
    return current.select("id", "domain", "category", "source").unionByName(fresh)


def add_to_list(current: DataFrame, names: DataFrame) -> DataFrame:
    """One-column list plus the trimmed, lower-cased new names."""
    cleaned = names.select(F.lower(strip(F.col("domain"))).alias("domain")).filter("domain <> ''")
    return current.select("domain").unionByName(cleaned).distinct()


def remove_from_list(current: DataFrame, names: DataFrame) -> DataFrame:
    """List without the trimmed, lower-cased names."""
    cleaned = names.select(F.lower(strip(F.col("domain"))).alias("domain"))
    return current.join(cleaned, "domain", "left_anti")


def blocklist_by_category(blocklist: DataFrame) -> DataFrame:
    return blocklist.groupBy("category", "source").agg(F.count(F.lit(1)).alias("entries"))


def alert_rows(scored: DataFrame) -> DataFrame:
    """Alert per blocked query; confidence is the score as a fraction."""
    return scored.filter("blocked").select(
        "id", "ts", "client_ip", "domain", "threat_type",
        (F.col("score") / 100.0).alias("confidence"), "reason",
    )


def utc_day(ts: Column, kind: str) -> Column:
    """Day of a timestamp in UTC, whatever the session's time zone; one without a zone is taken as it is."""
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()) if kind == "timestamp" else ts)


def with_day(df: DataFrame) -> DataFrame:
    """`df` with dt, the UTC day of its ts, dealt out so that a day is written in few files.

    Adaptive execution joins small days into one task and splits large ones.
    """
    return df.withColumn("dt", utc_day(F.col("ts"), dict(df.dtypes)["ts"])).hint("rebalance", "dt")


def log_rows(scored: DataFrame) -> DataFrame:
    """Query-log row per scored query; the type is always logged as 'A'."""
    return scored.select(
        "id", "ts", "client_ip", "domain", F.lit("A").alias("query_type"), "blocked",
        "threat_type", F.col("score").cast("double").alias("threat_score"),
    )
