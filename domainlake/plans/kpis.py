"""Dashboard aggregates over the query log."""

from pyspark.sql import functions as F

from domainlake.operators import kpis as O
from domainlake.operators.lists import with_day
from domainlake.plans.catalog import query, rounded, ts_text
from domainlake.plans.views import Views
from domainlake.session import fresh_dir

TEXT = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
LOG_COLUMNS = (
    f"id, {TEXT.format('ts')} as ts, client_ip, domain, query_type, blocked, threat_type, "
    "round(threat_score, 6) as threat_score"
)
MINUTES = (
    "select date_trunc('minute', ts) as m, count(*) as total, "
    "count(*) filter (where blocked) as blocked from dns_log group by 1"
)
CLIENTS = (
    "select client_ip, count(*) as total, count(*) filter (where blocked) as blocked, "
    "round(max(threat_score)::decimal(18, 6), 1)::double as max_score from dns_log group by 1"
)
COUNTS = (
    "count(*) as total, count(*) filter (where blocked) as blocked, "
    "count(*) filter (where threat_type = 'DGA') as dga, "
    "count(*) filter (where threat_type = 'Tunneling') as tunnel, "
    "count(*) filter (where threat_type = 'Phishing') as phishing, "
    "count(*) filter (where threat_type = 'Blocklist') as blocklist_hits"
)


@query(
    "f1_kpi_stats",
    f"select {COUNTS}, (select count(*) from blocklist) as blocklist_size from dns_log",
    ["dns_log", "blocklist"],
)
def kpi_stats(v: Views):
    return O.kpi_stats(v.dns_log, v.blocklist)


@query("f2_client_risk", CLIENTS, ["dns_log"])
def client_risk(v: Views):
    return O.client_risk(v.dns_log)


@query(
    "f3_client_risk_top",
    "select *, case when risk_pct > 30 then 'red' when risk_pct > 10 then 'amber' else 'green' end "
    "as colour from (select *, least(100, floor(blocked / total * 100 + 0.5))::int as risk_pct "
    f"from ({CLIENTS}) c order by blocked desc, client_ip limit 6) t",
    ["dns_log"],
)
def client_risk_top(v: Views):
    return O.client_risk_top(v.dns_log)


def _minutes(df):
    return ts_text(df, "minute")


@query(
    "f4_timeline_minutes",
    f"select {TEXT.format('m')} as minute, strftime(m, '%H:%M') as t, total, blocked "
    f"from ({MINUTES}) x",
    ["dns_log"],
)
def timeline_minutes(v: Views):
    return _minutes(O.timeline_minutes(v.dns_log))


@query(
    "f5_timeline_recent",
    f"select {TEXT.format('m')} as minute, strftime(m, '%H:%M') as t, total, blocked "
    f"from ({MINUTES}) x order by m desc limit 30",
    ["dns_log"],
)
def timeline_recent(v: Views):
    return _minutes(O.timeline_recent(v.dns_log))


@query(
    "f6_recent_queries",
    f"select {LOG_COLUMNS} from (select * from dns_log order by ts desc, id desc limit 50) t",
    ["dns_log"],
)
def recent_queries(v: Views):
    return rounded(ts_text(O.latest(v.dns_log, 50), "ts"))


@query(
    "f7_recent_alerts",
    f"select id, {TEXT.format('ts')} as ts, client_ip, domain, threat_type, "
    "round(confidence, 6) as confidence, reason "
    "from (select * from alerts order by ts desc, id desc limit 20) t",
    ["alerts"],
)
def recent_alerts(v: Views):
    return rounded(ts_text(O.latest(v.alerts, 20), "ts"))


@query(
    "f8_paged_log",
    f"select {LOG_COLUMNS}, 3 as page, (select ceil(count(*) / 100)::bigint from dns_log) as "
    "total_pages from (select * from dns_log order by ts desc, id desc limit 100 offset 200) t",
    ["dns_log"],
)
def paged_log(v: Views):
    return rounded(ts_text(O.paged_log(v.dns_log, 3), "ts"))


@query(
    "f8_paged_log_keyset",
    f"select {LOG_COLUMNS} from (select * from dns_log where ts < timestamp '2024-01-15 12:00:00' "
    "order by ts desc, id desc limit 100) t",
    ["dns_log"],
)
def paged_log_keyset(v: Views):
    return rounded(ts_text(O.paged_log_after(v.dns_log, "2024-01-15 12:00:00", 0), "ts"))


HOURLY = "select * replace (date_trunc('hour', ts) as ts) from dns_log"


def _stored_by_day(v: Views):
    """The query log in folders by day, its times cut to the hour so that many are equal."""
    path = fresh_dir(v.spark, "log-by-day")
    log = v.dns_log.withColumn("ts", F.date_trunc("hour", "ts").cast(dict(v.dns_log.dtypes)["ts"]))
    with_day(log).write.partitionBy("dt").parquet(path)
    return v.spark.read.parquet(path).select(*log.columns, "dt")


@query(
    "f8_paged_log_by_day",
    f"select {LOG_COLUMNS}, 7 as page, (select ceil(count(*) / 100)::bigint from dns_log) as "
    f"total_pages from (select * from ({HOURLY}) order by ts desc, id desc limit 100 offset 600) t",
    ["dns_log"],
)
def paged_log_by_day(v: Views):
    """A deep page of a stored log: it reads the folders of the days it touches."""
    return rounded(ts_text(O.paged_stored_log(_stored_by_day(v), 7), "ts"))


@query(
    "f8_paged_log_after_tie",
    f"select {LOG_COLUMNS} from ({HOURLY}) h, (select ts as last_ts, id as last_id from ({HOURLY}) order by ts desc, id desc "
    "limit 1 offset 400) a where ts < last_ts or (ts = last_ts and id < last_id) order by ts desc, id desc limit 100",
    ["dns_log"],
)
def paged_log_after_tie(v: Views):
    """The page that follows a row with the same time as its neighbours."""
    log = _stored_by_day(v)
    row = O.latest(log, 401).orderBy("ts", "id").first()
    return rounded(ts_text(O.paged_log_after(log, str(row["ts"]), row["id"]), "ts"))


@query(
    "f9_paged_blocklist",
    "select *, 1 as page, (select ceil(count(*) / 100)::bigint from blocklist) as total_pages "
    "from (select * from blocklist order by id desc limit 100) t",
    ["blocklist"],
)
def paged_blocklist(v: Views):
    return O.paged_blocklist(v.blocklist, 1)


@query(
    "f10_engine_share",
    f"select engine, n, round(n / total, 6) as share from (select total, unnest(["
    "{'engine': 'dga', 'n': dga}, {'engine': 'tunnel', 'n': tunnel}, "
    "{'engine': 'blocklist', 'n': blocklist_hits}, {'engine': 'safe', 'n': total - blocked}], "
    f"recursive := true) from (select {COUNTS} from dns_log) c) t",
    ["dns_log"],
)
def engine_share(v: Views):
    return rounded(O.engine_share(v.dns_log))


@query(
    "f11_block_rate",
    "select count(*) as total, count(*) filter (where blocked) as blocked, "
    "printf('%.1f', count(*) filter (where blocked) / count(*) * 100)::double as block_rate "
    "from dns_log",
    ["dns_log"],
)
def block_rate(v: Views):
    return O.block_rate(v.dns_log)


@query(
    "f12_query_rate",
    f"select {TEXT.format('m')} as minute, total, round(gap, 6) as minutes, "
    "greatest(0, floor(total / gap + 0.5))::bigint as per_minute from (select *, "
    "(epoch_us(m) - epoch_us(lag(m) over (order by m))) / 60000000 as gap "
    f"from ({MINUTES}) x) t where gap is not null",
    ["dns_log"],
)
def query_rate(v: Views):
    return rounded(_minutes(O.query_rate(v.dns_log)))


@query(
    "f13_new_alerts",
    "select id, domain, threat_type from alerts where threat_type <> 'DGA'",
    ["alerts"],
)
def new_alerts(v: Views):
    seen = v.alerts.filter("threat_type = 'DGA'")
    return O.new_alerts(v.alerts, seen).select("id", "domain", "threat_type")


@query(
    "f14_kpi_summary",
    "select 'stats' as part, item, n::double as value from (unpivot (select "
    f"{COUNTS}, (select count(*) from blocklist) as blocklist_size from dns_log) on columns(*) "
    "into name item value n) s union all "
    f"select 'timeline', {TEXT.format('m')}, total from (select * from ({MINUTES}) x order by m desc "
    "limit 30) t union all select 'queries', id::varchar, round(threat_score, 6) from (select * from "
    "dns_log order by ts desc, id desc limit 50) q union all select 'clients', client_ip, blocked "
    f"from (select * from ({CLIENTS}) c order by blocked desc, client_ip limit 6) k union all "
    "select 'alerts', id::varchar, round(confidence, 6) from (select * from alerts "
    "order by ts desc, id desc limit 10) a",
    ["dns_log", "alerts", "blocklist"],
)
def kpi_summary(v: Views):
    parts = O.kpi_summary(v.dns_log, v.alerts, v.blocklist)
    stats = parts["stats"].unpivot([], parts["stats"].columns, "item", "value")
    items = {
        "timeline": ("minute", "total"),
        "queries": ("id", "threat_score"),
        "clients": ("client_ip", "blocked"),
        "alerts": ("id", "confidence"),
    }
    out = stats.select(F.lit("stats").alias("part"), "item", F.col("value").cast("double"))
    for part, (item, value) in items.items():
        df = ts_text(parts[part], "minute") if part == "timeline" else parts[part]
        named = F.col(item).cast("string").alias("item")
        out = out.unionByName(
            df.select(F.lit(part).alias("part"), named, F.col(value).cast("double").alias("value"))
        )
    return rounded(out)


@query(
    "f15_label_counts",
    "select label, count(*) as n from domain_corpus group by label",
    ["domain_corpus"],
)
def label_counts(v: Views):
    return O.label_counts(v.domain_corpus)


@query(
    "f15_source_counts",
    "select source, count(*) as n from dirty_corpus group by source order by n desc, source limit 15",
    ["dirty_corpus"],
)
def source_counts(v: Views):
    return O.source_counts(v.dirty_corpus)


@query(
    "f15_family_counts",
    "select family, count(*) as n from domain_corpus group by family",
    ["domain_corpus"],
)
def family_counts(v: Views):
    return O.family_counts(v.domain_corpus)
