"""Streaming jobs run to completion over the event table as a file stream.

Windowed results are append-only: a window is final once the watermark has passed its end, so the
checks keep windows that end at or before the latest event minus the delay.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlake.plans.behaviour import BASED, RATE_SQL
from domainlake.plans.catalog import query, ts_text
from domainlake.plans.feeds import HOSTS_TOKENS_SQL
from domainlake.plans.scoring import BEHAVED, DOH, SAFE, SCORE_LOG_SQL, TRAFFIC
from domainlake.plans.views import Views
from domainlake.session import fresh_dir
from domainlake.sources.feeds import parse_hosts_tokens
from domainlake.streaming import jobs

TEXT = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def stream(v: Views, view: str) -> DataFrame:
    """One of the event views over the event table as a stream."""
    events = jobs.file_stream(v.spark, f"{v.path}/events.parquet")
    if view in ("alerts", "answer_log"):
        return v.over(view, dns_log=v.over("dns_log", events=events))
    return v.over(view, events=events)


@query(
    "l1_stream_score_stateless",
    f"select case when {DOH} then 'DOH_BYPASS' when {SAFE} then 'None' else threat_type end as "
    f"threat_type, {DOH} or (not {SAFE} and score >= 60) as blocked, count(*) as n from typed "
    "where query_type in ('A', 'AAAA', 'CNAME') group by all",
    ["client_traffic"],
    TRAFFIC,
)
def stream_score(v: Views):
    path = fresh_dir(v.spark, "stream-score")
    jobs.stream_score(
        stream(v, "client_traffic"),
        log_path=f"{path}/log",
        alert_path=f"{path}/alerts",
        checkpoint=f"{path}/checkpoint",
        add_probabilities=lambda batch: batch,
        read_blocklist=lambda: v.blocklist,
    ).awaitTermination()
    log = v.spark.read.parquet(f"{path}/log")
    return log.groupBy("threat_type", "blocked").agg(F.count(F.lit(1)).alias("n"))


@query("l1_stream_score", SCORE_LOG_SQL, ["client_traffic", "client_answers"], BEHAVED)
def stream_detect(v: Views):
    """The whole live path; equals the whole path of the stored log."""
    path = fresh_dir(v.spark, "stream-detect")
    traffic = stream(v, "client_traffic")
    answers = v.over("client_answers", client_traffic=stream(v, "client_traffic"))
    # A later event of nobody's moves the watermark past the last event; it is never given out itself.
    beat = v.events.agg((F.max(F.col("ts").cast("timestamp")) + F.expr("interval 1 day")).alias("ts"))
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in traffic.dtypes if name != "ts"]
    beat.select("ts", *blank).withColumn("ts", F.col("ts").cast(dict(traffic.dtypes)["ts"])).select(traffic.columns).write.parquet(f"{path}/beat")
    listed = v.client_traffic.select("domain").filter("domain = 'shop7.example.com'").distinct()
    jobs.stream_detect(
        traffic.unionByName(jobs.file_stream(v.spark, f"{path}/beat")),
        answers,
        log_path=f"{path}/log",
        alert_path=f"{path}/alerts",
        state_path=f"{path}/state",
        checkpoint=f"{path}/checkpoint",
        read_blocklist=lambda: listed,
        seconds=3600,
        rate_limit=2,
    ).awaitTermination()
    log = v.spark.read.parquet(f"{path}/log")
    return log.select("id", "domain", F.col("threat_score").cast("long").alias("score"), "threat_type", "blocked")


@query(
    "l2_stream_rate_limit",
    f"select id, client_ip, recent, recent > 2 as rate_limited from ({RATE_SQL}) t",
    ["dns_log"],
)
def stream_rate_limit(v: Views):
    flagged = jobs.stream_rate_limit(stream(v, "dns_log"), seconds=3600, limit=2)
    return jobs.settled(jobs.run_to_table(flagged, "rate-limit"))


@query(
    "l2_stream_rate_windows",
    f"select client_ip, {TEXT.format('w')} as window_start, count(*) as n from (select client_ip, "
    "unnest([date_trunc('hour', ts) - interval 30 minute, date_trunc('hour', ts), "
    "date_trunc('hour', ts) + interval 30 minute]) as w, ts from dns_log) t where w <= ts and "
    "ts < w + interval 1 hour and w + interval 1 hour <= (select max(ts) - interval 10 minute "
    "from dns_log) group by client_ip, w having count(*) > 1",
    ["dns_log"],
)
def stream_rate_windows(v: Views):
    windows = jobs.stream_rate_windows(
        stream(v, "dns_log"), "1 hour", "30 minutes", limit=1, delay="10 minutes"
    )
    return ts_text(jobs.run_to_table(windows, "rate-windows"), "window_start")


def _windowed(source: str, key: str, member: str, limit: int) -> str:
    return (
        f"select {key}, {TEXT.format('w')} as window_start, count(distinct {member}) as members "
        f"from (select *, date_trunc('day', ts) as w from {source}) t where {key} is not null and "
        f"w + interval 1 day <= (select max(ts) - interval 10 minute from {source}) "
        f"group by {key}, w having count(distinct {member}) > {limit}"
    )


@query(
    "l3_stream_shadowing",
    _windowed("based", "base", "sub", 3),
    ["dns_log"],
    [("based", f"{BASED} dns_log")],
)
def stream_shadowing(v: Views):
    found = jobs.stream_shadowing(stream(v, "dns_log"), limit=3, window="1 day", exact=True)
    return ts_text(jobs.run_to_table(found, "shadowing"), "window_start")


@query("l3_stream_shadowing_approx")
def stream_shadowing_approx(v: Views):
    found = jobs.stream_shadowing(stream(v, "dns_log"), limit=3, window="1 day")
    return ts_text(jobs.run_to_table(found, "shadowing-approx"), "window_start")


@query(
    "l3_stream_fast_flux",
    _windowed("resolution_log", "domain", "ip", 1),
    ["resolution_log"],
)
def stream_fast_flux(v: Views):
    found = jobs.stream_fast_flux(stream(v, "resolution_log"), limit=1, window="1 day", exact=True)
    return ts_text(jobs.run_to_table(found, "fast-flux"), "window_start")


@query(
    "l3_stream_crossings",
    "select domain as key, count(distinct ip) as members from resolution_log group by domain "
    "having count(distinct ip) > 3",
    ["resolution_log"],
)
def stream_crossings(v: Views):
    crossed = jobs.stream_crossings(stream(v, "resolution_log"), "domain", "ip", 3)
    return jobs.run_to_table(crossed, "crossings")


@query(
    "l3_stream_recrossings",
    f"select e.domain as key, {TEXT.format('e.ts')} as at, count(distinct p.ip) as members from resolution_log e "
    "join resolution_log p on p.domain = e.domain and p.ts > e.ts - interval 2 day and (p.ts < e.ts or "
    "(p.ts = e.ts and p.id <= e.id)) group by e.id, e.domain, e.ts having count(distinct p.ip) > 1 and "
    "count(distinct p.ip) filter (where p.id <> e.id) <= 1",
    ["resolution_log"],
)
def stream_recrossings(v: Views):
    found = jobs.stream_recrossings(stream(v, "resolution_log"), "domain", "ip", 1, ttl="2 days")
    return ts_text(jobs.run_to_table(found, "recrossings"), "at")


@query(
    "l4_stream_new_alerts",
    "select id, domain, threat_type from alerts",
    ["alerts"],
)
def stream_new_alerts(v: Views):
    alerts = stream(v, "alerts")
    repeated = alerts.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    shown = jobs.stream_new_alerts(repeated).select("id", "domain", "threat_type")
    return jobs.run_to_table(shown, "new-alerts")


@query(
    "l5_stream_timeline",
    f"select {TEXT.format('m')} as minute, count(*) as total, count(*) filter (where blocked) as "
    "blocked from (select *, date_trunc('minute', ts) as m from dns_log) t where m + interval 1 "
    "minute <= (select max(ts) - interval 10 minute from dns_log) group by m",
    ["dns_log"],
)
def stream_timeline(v: Views):
    return ts_text(jobs.run_to_table(jobs.stream_timeline(stream(v, "dns_log")), "timeline"), "minute")


@query(
    "l6_stream_feed_refresh",
    "select domain, category, source from blocklist union all select distinct domain, category, "
    f"source from ({HOSTS_TOKENS_SQL}) h where domain not in (select domain from blocklist)",
    ["blocklist", "hosts_lines"],
)
def stream_feed_refresh(v: Views):
    path = fresh_dir(v.spark, "feed-refresh")
    listed = jobs.blocklist_table(v.spark, f"{path}/list")
    listed.append(-1, v.blocklist)
    v.hosts_lines.write.text(f"{path}/landed")
    jobs.stream_feed_refresh(
        v.spark, f"{path}/landed", parse_hosts_tokens, listed, f"{path}/checkpoint"
    ).awaitTermination()
    return listed.read().select("domain", "category", "source")
