"""Stored tables: schemas, readers and writers."""

from pyspark.sql import DataFrame, SparkSession

from domainlake.operators.lists import alert_rows, log_rows, with_day

SCHEMAS = {
    "dns_queries": "id bigint, ts timestamp, client_ip string, domain string, query_type string, "
    "blocked boolean, threat_type string, threat_score double",
    "alerts": "id bigint, ts timestamp, client_ip string, domain string, threat_type string, "
    "confidence double, reason string",
    "static_blocklist": "id bigint, domain string, category string, source string",
    "training_domains": "id bigint, domain string, label int, source string, family string",
    "whitelist": "id bigint, domain string",
    "resolutions": "id bigint, ts timestamp, domain string, ip string, ttl int",
    "system_settings": "id int, dga_enabled int, tunnel_enabled int, risk_threshold double",
}


def read_table(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """One of the SCHEMAS tables from a parquet folder, or from the catalog without a path."""
    if path is None:
        return spark.table(name)
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def write_query_log(scored: DataFrame, path: str, mode: str = "append") -> None:
    """Append scored queries, one folder per day."""
    with_day(log_rows(scored)).write.mode(mode).partitionBy("dt").parquet(path)


def write_alerts(scored: DataFrame, path: str, mode: str = "append") -> None:
    """Append an alert per blocked query, one folder per day."""
    with_day(alert_rows(scored)).write.mode(mode).partitionBy("dt").parquet(path)


def write_list(names: DataFrame, path: str) -> None:
    """Write a rewritten list to a new folder; readers switch to it when it is complete."""
    names.write.mode("errorifexists").parquet(path)
