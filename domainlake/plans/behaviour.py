"""Rate limiting, shadowing and fast flux over the logs."""

from pyspark.sql import functions as F

from domainlake.operators import behaviour as B
from domainlake.plans.catalog import query
from domainlake.plans.views import Views
from domainlake.session import fresh_dir

RATE_SQL = (
    "select *, count(*) over (partition by client_ip order by ts "
    "range between interval 1 hour preceding and current row) as recent from dns_log"
)
BASED = (
    "select *, case when len(string_split(domain, '.')) >= 3 then split_part(domain, '.', -2) "
    "|| '.' || split_part(domain, '.', -1) end as base, split_part(domain, '.', 1) as sub from "
)


def running_distinct(source: str, key: str, member: str) -> str:
    """SQL: `source` plus `so_far`, the distinct members of the key up to the row."""
    return (
        f"select *, sum(first) over (partition by {key} order by ts, id "
        "rows between unbounded preceding and current row) as so_far from (select *, "
        f"case when row_number() over (partition by {key}, {member} order by ts, id) = 1 "
        f"then 1 else 0 end as first from {source}) f"
    )


@query(
    "e1_rate_limit_flags",
    f"select id, client_ip, recent, recent > 2 as rate_limited from ({RATE_SQL}) t",
    ["dns_log"],
)
def rate_limit_flags(v: Views):
    flagged = B.rate_limit_flags(v.dns_log, seconds=3600, limit=2)
    return flagged.select("id", "client_ip", "recent", "rate_limited")


@query(
    "e1_rate_limit_one_second",
    "select id, count(*) over (partition by client_ip order by ts range between interval 1 second "
    "preceding and current row) > 50 as rate_limited from dns_log",
    ["dns_log"],
)
def rate_limit_one_second(v: Views):
    return B.rate_limit_flags(v.dns_log).select("id", "rate_limited")


@query(
    "e2_shadowing_flags",
    "select id, domain, base is not null and so_far > 50 as shadowing from ("
    + running_distinct(f"({BASED} dns_log) b", "base", "sub")
    + ") t",
    ["dns_log"],
)
def shadowing_flags(v: Views):
    return B.shadowing_flags(v.dns_log).select("id", "domain", "shadowing")


@query(
    "e3_shadowing_bases",
    "select base, count(distinct sub) as sub_labels, count(*) as requests, "
    f"count(distinct client_ip) as clients from ({BASED} dns_log) b where base is not null "
    "group by base having count(distinct sub) > 50",
    ["dns_log"],
)
def shadowing_bases(v: Views):
    return B.shadowing_bases(v.dns_log)


@query(
    "e3_shadowing_bases_low",
    "select base, count(distinct sub) as sub_labels, count(*) as requests, "
    f"count(distinct client_ip) as clients from ({BASED} dns_log) b where base is not null "
    "group by base having count(distinct sub) > 3",
    ["dns_log"],
)
def shadowing_bases_low(v: Views):
    return B.shadowing_bases(v.dns_log, 3)


@query(
    "e3_shadowing_bases_sketched",
    "select base, count(distinct sub) as exact_labels, count(*) as requests, true as labels_near, true as clients_near "
    f"from ({BASED} dns_log) b where base is not null group by base",
    ["dns_log"],
)
def shadowing_bases_sketched(v: Views):
    """Estimates merged from stored daily sketches lie within five standard errors of the exact counts."""
    path = fresh_dir(v.spark, "sketches")
    B.base_sketches(v.dns_log).write.partitionBy("day").parquet(path)
    estimated = B.bases_from_sketches(v.spark.read.parquet(path), 0)
    exact = B.shadowing_bases(v.dns_log, 0)
    near = lambda c: F.abs(F.col(f"e.{c}") - F.col(f"x.{c}")) <= 0.08 * F.col(f"x.{c}") + 0.5
    return estimated.alias("e").join(exact.alias("x"), "base").select(
        "base", F.col("x.sub_labels").alias("exact_labels"), F.col("e.requests").alias("requests"),
        near("sub_labels").alias("labels_near"), near("clients").alias("clients_near"),
    )


@query(
    "e4_fast_flux_flags",
    "select id, domain, ip, so_far > 3 as fast_flux from ("
    + running_distinct("resolution_log", "domain", "ip")
    + ") t",
    ["resolution_log"],
)
def fast_flux_flags(v: Views):
    return B.fast_flux_flags(v.resolution_log).select("id", "domain", "ip", "fast_flux")


@query(
    "e5_response_profile",
    "select id, domain, string_agg(distinct ip, ',' order by ip) as ips, min(ttl) as min_ttl "
    "from answer_log group by id, domain",
    ["answer_log"],
)
def response_profile(v: Views):
    return B.response_profile(v.answer_log).withColumn("ips", F.array_join("ips", ","))


@query(
    "e5_resolution_profile",
    "select domain, count(distinct ip) as n_ips, count(*) as answers, min(ttl) as min_ttl "
    "from resolution_log group by domain",
    ["resolution_log"],
)
def resolution_profile(v: Views):
    return B.resolution_profile(v.resolution_log)


@query(
    "e6_behaviour_join",
    "select f.id, f.domain, f.shadowing, coalesce((f.ts > c.ts) or (f.ts = c.ts and f.id >= c.id), "
    "false) as fast_flux from (select id, ts, domain, base is not null and so_far > 30 as shadowing "
    f"from ({running_distinct('based', 'base', 'sub')}) s) f left join flux c using (domain)",
    ["dns_log", "answer_log"],
    [
        ("passed", f"select * from ({RATE_SQL}) r where recent <= 2"),
        ("based", f"{BASED} passed"),
        (
            "flux",
            "select domain, min(ts) as ts, arg_min(id, (ts, id)) as id from ("
            + running_distinct("answer_log", "domain", "ip")
            + ") t where so_far > 3 group by domain",
        ),
    ],
)
def behaviour_join(v: Views):
    joined = B.behaviour_join(
        v.dns_log, v.answer_log, seconds=3600, rate_limit=2, shadow_limit=30
    )
    return joined.select("id", "domain", "shadowing", "fast_flux")
