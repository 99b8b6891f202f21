"""Lists, score, type, reason and the flagship crawl report."""

from pyspark.sql import functions as F

from domainlake.constants import (
    BLOCKLIST_REASON, CANONICAL_THREAT, DOH_REASON, DOH_RESOLVERS, SAFE_DOMAINS,
)
from domainlake.operators import detection
from domainlake.operators import scoring as O
from domainlake.operators import urls as U
from domainlake.plans import sqltext as S
from domainlake.plans.catalog import query, rounded
from domainlake.plans.views import Views

POINTS = S.score_ctes("scoring_input")
BAND = (
    "case when score >= 80 then 'CRITICAL' when score >= 60 then 'HIGH' "
    "when score >= 40 then 'MEDIUM' else 'LOW' end"
)


def _signals(v: Views):
    """Scoring input with signals per distinct domain joined back, up to the type."""
    names = v.scoring_input.select("domain").distinct()
    rows = O.lookup(v.scoring_input, O.domain_signals(names), "domain")
    rows = rows.withColumn("tunnel_prob", O.tunnel_probability(F.col("decision")))
    return O.threat_type(O.threat_score(rows))


def _long(df, *names: str):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query(
    "d1_blocklist_match",
    "select id, domain, lower(domain) in (select lower(domain) from blocklist) as "
    "in_static_blocklist from domain_corpus",
    ["domain_corpus", "blocklist"],
)
def blocklist_match(v: Views):
    return O.blocklist_match(v.domain_corpus.select("id", "domain"), v.blocklist)


@query(
    "d2_safe_list",
    f"select id, domain, domain in ({S.quoted(SAFE_DOMAINS)}) as safe_listed from client_traffic",
    ["client_traffic"],
)
def safe_list(v: Views):
    return O.safe_list_passthrough(v.client_traffic).select("id", "domain", "safe_listed")


@query(
    "d3_whitelist_bypass",
    "select id, domain, lower(domain) in (select lower(domain) from domain_corpus "
    "where source = 'catalog') as whitelisted from squat_input",
    ["squat_input", "domain_corpus"],
)
def whitelist(v: Views):
    listed = v.domain_corpus.filter("source = 'catalog'").select(
        F.concat(F.lit("  "), F.upper("domain")).alias("domain")
    )
    return O.whitelist_bypass(v.squat_input, listed)


@query(
    "d4_threat_score", "select id, domain, score from typed", ["scoring_input"], POINTS
)
def threat_score(v: Views):
    return _long(_signals(v).select("id", "domain", "score"), "score")


@query(
    "d5_threat_type", "select id, domain, threat_type from typed", ["scoring_input"], POINTS
)
def threat_type(v: Views):
    return _signals(v).select("id", "domain", "threat_type")


@query(
    "d6_reason", f"select id, domain, {S.REASON} as reason from typed", ["scoring_input"], POINTS
)
def reason(v: Views):
    return O.reason(_signals(v)).select("id", "domain", "reason")


CANONICAL = "case threat_type " + " ".join(
    f"when '{k}' then '{n}'" for k, n in CANONICAL_THREAT.items()
) + " else threat_type end"


@query(
    "d7_canonical_threat_type",
    f"select threat_type, {CANONICAL} as canonical, count(*) as n from typed "
    "group by threat_type, canonical",
    ["scoring_input"],
    POINTS,
)
def canonical(v: Views):
    named = _signals(v).withColumn("canonical", O.canonical_threat_type(F.col("threat_type")))
    return named.groupBy("threat_type", "canonical").agg(F.count(F.lit(1)).alias("n"))


TERMS = {
    "dga_probability": "dga_prob * 40",
    "anomaly_score": "tunnel_prob * 20",
    "entropy_score": "entropy * 15",
    "lookalike_score": "lookalike_score * 10",
    "tld_risk": "tld_risk * 10",
    "jaro_winkler": "jaro_winkler_score * 5",
    "keywords": "least(kw_hits * 8, 20)",
    "brand_distance": "case when min_lev between 1 and 2 then 15.0 else 0.0 end",
}
LARGEST = "greatest(" + ", ".join(f"({t})::double" for t in TERMS.values()) + ")"


@query(
    "d8_score_contributions",
    "select id, domain, " + ", ".join(f"round(({t})::double, 6) as p_{n}" for n, t in TERMS.items())
    + ", case " + " ".join(f"when ({t})::double = {LARGEST} then '{n}'" for n, t in TERMS.items())
    + f" end as top_signal, round({LARGEST}, 6) as top_points from typed",
    ["scoring_input"],
    POINTS,
)
def contributions(v: Views):
    df = O.score_contributions(_signals(v))
    points = [F.col("contributions")[n].alias(f"p_{n}") for n in TERMS]
    return rounded(df.select("id", "domain", *points, "top_signal", "top_points"))


@query(
    "d9_verdict_flags",
    "select id, domain, score >= 60 as blocked, printf('%.3f', dga_prob)::double as dga_prob, "
    "printf('%.3f', tunnel_prob)::double as tunnel_score, round(entropy * 4, 6) as entropy, "
    "case when lookalike_score > 0.5 then 'Yes' end as lookalike from typed",
    ["scoring_input"],
    POINTS,
)
def verdict_flags(v: Views):
    return rounded(
        O.verdict_flags(_signals(v)).select(
            "id", "domain", "blocked", "dga_prob", "tunnel_score", "entropy", "lookalike"
        )
    )


@query(
    "d10_risk_band",
    f"select {BAND} as risk, case when score >= 50 then threat_type || ' (Malicious)' "
    "else 'Legitimate' end as ml_verdict, count(*) as n from typed group by 1, 2",
    ["scoring_input"],
    POINTS,
)
def risk_band(v: Views):
    return (
        _signals(v)
        .select(
            O.risk_band(F.col("score")).alias("risk"),
            O.ml_verdict(F.col("score"), F.col("threat_type")).alias("ml_verdict"),
        )
        .groupBy("risk", "ml_verdict")
        .agg(F.count(F.lit(1)).alias("n"))
    )


TRAFFIC = S.score_ctes("client_traffic")
DOH = f"client_ip in ({S.quoted(DOH_RESOLVERS)})"
SAFE = f"domain in ({S.quoted(SAFE_DOMAINS)})"


@query(
    "d11_doh_bypass",
    f"select id, client_ip, domain, case when {DOH} then 100 when {SAFE} then 0 else score end "
    f"as score, case when {DOH} then 'DOH_BYPASS' when {SAFE} then 'None' else threat_type end as "
    f"threat_type, {DOH} or (not {SAFE} and score >= 60) as blocked, "
    f"case when {DOH} then '{DOH_REASON}' when {SAFE} then 'Fast-path cached (Safe LUT)' "
    f"else {S.REASON} end as reason from typed where query_type in ('A', 'AAAA', 'CNAME')",
    ["client_traffic"],
    TRAFFIC,
)
def doh_bypass(v: Views):
    scored = O.score_queries(v.client_traffic)
    return _long(
        scored.select("id", "client_ip", "domain", "score", "threat_type", "blocked", "reason"),
        "score",
    )


@query(
    "d12_query_type_filter",
    "select query_type, count(*) as n from dns_log where query_type in ('A', 'AAAA', 'CNAME') "
    "group by query_type",
    ["dns_log"],
)
def query_type_filter(v: Views):
    return O.query_type_filter(v.dns_log).groupBy("query_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d13_probability_rescale",
    "select id, greatest(0.0, least(1.0, 0.5 - decision)) as tunnel_prob from scoring_input",
    ["scoring_input"],
)
def probability_rescale(v: Views):
    return v.scoring_input.select(
        "id", O.tunnel_probability(F.col("decision")).alias("tunnel_prob")
    )


DIRTY = (
    "select id, case when id % 11 = 0 then null else domain end as domain, "
    "case when id % 13 = 0 then null else dga_prob end as dga_prob, decision from scoring_input"
)


@query(
    "d14_error_quarantine",
    "select id, 'ERROR' as threat_type, 0::bigint as score, case when domain is null then "
    "'domain is missing' else 'dga_prob is missing' end as reason, false as blocked "
    "from dirty where domain is null or dga_prob is null",
    ["scoring_input"],
    [("dirty", DIRTY)],
)
def error_quarantine(v: Views):
    dirty = v.spark.sql(DIRTY.replace("scoring_input", "{rows}"), rows=v.scoring_input)
    failed = O.error_quarantine(dirty)[1]
    return _long(failed.select("id", "threat_type", "score", "reason", "blocked"), "score")


@query(
    "d15_model_sanity_flag",
    "select case when dga_prob > 0.55 or decision < -0.1 then 'THREAT' else 'CLEAN' end as flag, "
    "count(*) as n from scoring_input group by 1",
    ["scoring_input"],
)
def model_sanity(v: Views):
    return O.model_sanity_flag(v.scoring_input).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d16_feature_toggles",
    "select id, least(trunc(0.0 * 40 + tunnel_prob * 20 + entropy * 15 + lookalike_score * 10 "
    "+ tld_risk * 10 + jaro_winkler_score * 5 + least(kw_hits * 8, 20) "
    "+ case when min_lev between 1 and 2 then 15 else 0 end), 100)::bigint as score from typed",
    ["scoring_input"],
    POINTS,
)
def feature_toggles(v: Views):
    names = v.scoring_input.select("domain").distinct()
    rows = O.lookup(v.scoring_input, O.domain_signals(names), "domain")
    scored = O.verdicts(rows, O.Settings(dga_enabled=False))
    return _long(scored.select("id", "score"), "score")


LISTED = "lower(domain) in (select lower(domain) from blocklist)"


@query(
    "score_domains",
    f"select id, domain, case when {LISTED} then 100 else score end as score, "
    f"case when {LISTED} then 'THREAT_INTEL' else threat_type end as threat_type, "
    f"case when {LISTED} then '{BLOCKLIST_REASON}' else {S.REASON} end as reason, "
    f"{LISTED} or score >= 60 as blocked, {LISTED} as in_static_blocklist, "
    f"round(case when {LISTED} then 1.0::double else tld_risk end, 6) as tld_risk from typed",
    ["scoring_input", "blocklist"],
    POINTS,
)
def score_domains(v: Views):
    scored = O.score_domains(v.scoring_input, v.blocklist)
    return rounded(
        _long(
            scored.select(
                "id", "domain", "score", "threat_type", "reason", "blocked",
                "in_static_blocklist", "tld_risk",
            ),
            "score",
        )
    )


TRAFFIC_BASE = (
    "case when len(string_split(domain, '.')) >= 3 then split_part(domain, '.', -2) || '.' || "
    "split_part(domain, '.', -1) end as base, split_part(domain, '.', 1) as sub"
)
TRAFFIC_LISTED = "(domain = 'shop7.example.com')"
BEHAVED = [
    *TRAFFIC,
    (
        "passed",
        "select * from (select *, count(*) over (partition by client_ip order by ts range between "
        "interval 1 hour preceding and current row) as recent from client_traffic) r "
        "where recent <= 2 and query_type in ('A', 'AAAA', 'CNAME')",
    ),
    (
        "shadowed",
        "select id, base is not null and count(distinct_sub) over (partition by base order by ts, "
        "id) > 50 as shadowing from (select *, case when feeds and row_number() over (partition by "
        "base, sub, feeds order by ts, id) = 1 then sub end as distinct_sub from (select *, "
        f"not ({SAFE}) and not {TRAFFIC_LISTED} as feeds, {TRAFFIC_BASE} from passed) a) b",
    ),
    (
        "flux",
        "select domain, min((ts, id)) as since from (select *, sum(first) over (partition by domain "
        "order by ts, id rows unbounded preceding) as so_far from (select *, case when row_number() "
        "over (partition by domain, ip order by ts, id) = 1 then 1 else 0 end as first "
        "from client_answers) f) g where so_far > 3 group by domain",
    ),
    (
        "flagged",
        "select t.*, shadowing, coalesce((t.ts, t.id) >= since, false) as fast_flux from typed t "
        "join shadowed using (id) left join flux using (domain)",
    ),
    (
        "behaved",
        "select *, least(trunc(total + case when shadowing then 30 else 0 end + case when fast_flux "
        "then 25 else 0 end), 100)::bigint as points from flagged",
    ),
]


SCORE_LOG_SQL = (
    f"select id, domain, case when {DOH} then 100 when {SAFE} then 0 when {TRAFFIC_LISTED} then 100 "
    f"else points end as score, case when {DOH} then 'DOH_BYPASS' when {SAFE} then 'None' "
    f"when {TRAFFIC_LISTED} then 'THREAT_INTEL' when fast_flux then 'FAST_FLUX' when shadowing then "
    "'DNS_SHADOWING' when points < 30 then 'CLEAN' when dga_prob > 0.55 then 'DGA' "
    "when tunnel_prob > 0.6 then 'TUNNELING' when min_lev <= 2 or lookalike_score > 0.5 then "
    f"'PHISHING' else 'SUSPICIOUS' end as threat_type, {DOH} or (not {SAFE} and ({TRAFFIC_LISTED} "
    "or points >= 60)) as blocked from behaved"
)


@query(
    "e6_score_log",
    SCORE_LOG_SQL,
    ["client_traffic", "client_answers"],
    BEHAVED,
)
def score_log(v: Views):
    listed = v.client_traffic.select("domain").filter("domain = 'shop7.example.com'").distinct()
    scored = detection.score_log(
        v.client_traffic, v.client_answers, listed, seconds=3600, rate_limit=2
    )
    return _long(scored.select("id", "domain", "score", "threat_type", "blocked"), "score")


CRAWL = S.score_ctes("crawl")
CRAWL_HOSTS = (
    f"select {S.host_full('url')} as domain, count(*) as n_pages, 0.0 as dga_prob, "
    "0.5 as decision from pages group by 1"
)


@query(
    "crawl_risk_report",
    f"select {BAND.replace('score', 'final')} as risk, kind as threat_type, reasons as reason, "
    "count(*) as hosts, sum(n_pages)::bigint as n_pages, max(final)::bigint as max_score from ("
    f"select n_pages, case when {LISTED} then 100 else score end as final, "
    f"case when {LISTED} then 'THREAT_INTEL' else threat_type end as kind, "
    f"case when {LISTED} then '{BLOCKLIST_REASON}' else {S.REASON} end as reasons from typed) t "
    "group by 1, 2, 3",
    ["blocklist"],
    [("crawl", CRAWL_HOSTS), *CRAWL],
)
def crawl_risk_report(v: Views):
    """Which crawled hosts look malicious, and why; model outputs are held at zero."""
    hosts = (
        U.normalize_url(v.pages.select("url"))
        .groupBy("domain")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .withColumn("dga_prob", F.lit(0.0))
        .withColumn("decision", F.lit(0.5))
    )
    scored = O.score_domains(hosts, v.blocklist)
    return (
        scored.withColumn("risk", O.risk_band(F.col("score")))
        .groupBy("risk", "threat_type", "reason")
        .agg(
            F.count(F.lit(1)).alias("hosts"),
            F.sum("n_pages").alias("n_pages"),
            F.max("score").cast("bigint").alias("max_score"),
        )
    )
