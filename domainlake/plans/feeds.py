"""Feed readers over rendered feed lines."""

from pyspark.sql import functions as F

from domainlake.plans.catalog import query
from domainlake.plans.sqltext import host_feed, host_full, host_train
from domainlake.plans.views import Views
from domainlake.session import fresh_dir
from domainlake.sources import feeds, tables

CONTENT = "trim(value) <> '' and not starts_with(trim(value), '#')"
UNSTRIPPED = "trim(value) <> '' and not starts_with(value, '#')"
TOKENS = "string_split_regex(trim(value), '\\s+')"
HEADER = "GlobalRank,TldRank,Domain"


def _training(domain: str, source: str, where: str, family: str, lines: str, label=1, once=False):
    return (
        f"select {'distinct' if once else ''} {domain} as domain, {label} as label, "
        f"'{source}' as source, {family} as family from {lines} where {where}"
    )


def _blocklist(domain: str, category: str, source: str, where: str, lines: str, once=False):
    return (
        f"select {'distinct' if once else ''} {domain} as domain, '{category}' as category, "
        f"'{source}' as source from {lines} where {where}"
    )


def _feed(name: str, lines: str, parse, sql: str):
    query(name, sql, [lines])(lambda v: parse(getattr(v, lines)))


HOSTS_TOKENS_SQL = _blocklist(
    f"{TOKENS}[2]", "Malware/Ads", "hosts",
    f"{CONTENT} and {TOKENS}[1] in ('0.0.0.0', '127.0.0.1') and {TOKENS}[2] not in "
    "('localhost', 'localhost.localdomain', 'broadcasthost', 'local', '0.0.0.0')",
    "hosts_lines",
)
_feed("a1_hosts_tokens", "hosts_lines", feeds.parse_hosts_tokens, HOSTS_TOKENS_SQL)
_feed(
    "a2_hosts_prefix", "hosts_lines", feeds.parse_hosts_prefix,
    _blocklist(
        "trim(replace(trim(value), '0.0.0.0 ', ''))", "Malware/Ads", "hosts",
        "starts_with(trim(value), '0.0.0.0 ') "
        "and trim(replace(trim(value), '0.0.0.0 ', '')) not in ('', '0.0.0.0')",
        "hosts_lines",
    ),
)
_feed(
    "a3_hosts_last_token", "hosts_lines", feeds.parse_hosts_last_token,
    _training(
        f"lower({TOKENS}[-1])", "malware_hosts",
        f"{UNSTRIPPED} and len({TOKENS}) >= 2 and contains({TOKENS}[-1], '.')",
        "'malware'", "hosts_lines",
    ),
)
_feed(
    "a4_url_list", "url_lines", feeds.parse_url_list,
    _training(
        host_full("value"), "url_list", f"{CONTENT} and length({host_full('value')}) > 3",
        "'phishing'", "url_lines", once=True,
    ),
)
_feed(
    "a4_url_blocklist", "url_lines", feeds.parse_url_blocklist,
    _blocklist(
        host_feed("value"), "Phishing", "url_list",
        f"trim(value) <> '' and {host_feed('value')} <> ''", "url_lines", once=True,
    ),
)
_feed(
    "a4_url_training", "url_lines", feeds.parse_url_training,
    _training(
        host_train("value"), "url_list", f"({host_train('value')}) is not null", "'phishing'",
        "url_lines",
    ),
)
THIRD_QUOTED = "string_split(value, '\",\"')[3]"
_feed(
    "a5_quoted_csv_urls", "quoted_lines", feeds.parse_quoted_csv_urls,
    "select distinct domain, 1 as label, 'quoted_csv' as source, 'malware' as family from ("
    f"select {host_full(f'trim(trim({THIRD_QUOTED}), chr(34))')} as domain from quoted_lines "
    f"where {UNSTRIPPED}) t where length(domain) > 3 "
    "and not regexp_matches(domain, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$')",
)
_feed(
    "a5_quoted_csv_blocklist", "quoted_lines", feeds.parse_quoted_csv_blocklist,
    _blocklist(
        f"replace({host_feed(THIRD_QUOTED)}, chr(34), '')", "Malware", "quoted_csv",
        f"{CONTENT} and replace({host_feed(THIRD_QUOTED)}, chr(34), '') <> ''", "quoted_lines",
        once=True,
    ),
)
_feed(
    "a6_scored_csv_urls", "scored_lines", feeds.parse_scored_csv_urls,
    "select distinct domain, 1 as label, 'scored_csv' as source, 'phishing' as family from ("
    f"select {host_full(chr(39).join(['trim(trim(string_split(value, ', ',', ')[3]), chr(34))']))} "
    "as domain from scored_lines "
    "where not starts_with(value, '#') and not starts_with(value, '\"date')) t "
    "where length(domain) > 3",
)
SECOND = "replace(string_split(value, ',')[2], chr(34), '')"
_feed(
    "a7_verified_csv_urls", "verified_lines", feeds.parse_verified_csv_urls,
    _training(
        host_train(SECOND), "verified_csv",
        f"not starts_with(value, '#') and not contains(substr(lower(value), 1, 5), 'url') "
        f"and len(string_split(value, ',')) > 1 and ({host_train(SECOND)}) is not null",
        "'phishing'", "verified_lines",
    ),
)


def _family_sql(name: str, domain: str, family: str, lines: str) -> str:
    return (
        f"select domain, 1 as label, '{name}' as source, family from (select {domain} as domain, "
        f"{family} as family from {lines} where {CONTENT}) t "
        "where length(domain) > 3 and contains(domain, '.')"
    )


TAB = "string_split(trim(value), chr(9))"
COMMA = "string_split(trim(value), ',')"
_feed(
    "a8_family_tsv", "family_tsv_lines", feeds.parse_family_tsv,
    _family_sql(
        "family_tsv", f"lower(trim(case when len({TAB}) >= 2 then {TAB}[2] else {TAB}[1] end))",
        f"case when len({TAB}) >= 2 then lower(trim({TAB}[1])) else 'unknown_dga' end",
        "family_tsv_lines",
    ),
)
_feed(
    "a9_family_csv", "family_csv_lines", feeds.parse_family_csv,
    _family_sql(
        "family_csv", f"lower(trim({COMMA}[1]))",
        f"case when len({COMMA}) >= 2 then lower(trim({COMMA}[2])) else 'unknown' end",
        "family_csv_lines",
    ),
)
_feed(
    "a10_ranked_csv", "ranked_lines", feeds.parse_ranked_csv,
    "select trim(replace(split_part(value, ',', 2), chr(34), '')) as domain, 0 as label, "
    "'ranked_csv' as source, 'legitimate' as family from ranked_lines",
)
query(
    "a10_ranked_csv_header",
    "select lower(trim(split_part(value, ',', 3))) as domain, 0 as label, 'ranked_csv' as source, "
    f"'legitimate' as family from ranked_header_lines where value <> '{HEADER}' "
    "and length(trim(split_part(value, ',', 3))) > 3",
    ["ranked_header_lines"],
)(lambda v: feeds.parse_ranked_csv_with_header(v.ranked_header_lines, HEADER))
_feed(
    "a11_labelled_csv", "labelled_lines", feeds.parse_labelled_csv,
    "select trim(replace(split_part(value, ',', 1), chr(34), '')) as domain, 1 as label, "
    "'labelled_csv' as source, coalesce(nullif(trim(split_part(value, ',', 3)), ''), 'unknown') "
    "as family from labelled_lines where lower(trim(split_part(value, ',', 2))) = 'dga'",
)
_feed(
    "a12_domain_list", "domain_lines", feeds.parse_domain_list,
    _training("trim(value)", "domain_list", UNSTRIPPED, "'unknown'", "domain_lines"),
)
query(
    "a12_domain_list_no_comments",
    _training("trim(value)", "domain_list", "trim(value) <> ''", "'unknown'", "domain_lines"),
    ["domain_lines"],
)(lambda v: feeds.parse_domain_list(v.domain_lines, comments=False))
_feed(
    "a13_mixed_list", "mixed_lines", feeds.parse_mixed_list,
    "select domain, 1 as label, 'mixed_list' as source, 'phishing' as family from (select coalesce("
    f"{host_train('value')}, case when contains(value, '.') and not starts_with(value, '#') "
    "then trim(value) end) as domain from mixed_lines where trim(value) <> '') t "
    "where domain is not null",
)


#: Stored tables by the views that fill them.
STORED = {
    "dns_queries": "select id, ts, client_ip, domain, query_type, blocked, threat_type, threat_score from dns_log",
    "alerts": "select id, ts, client_ip, domain, threat_type, confidence, reason from alerts",
    "static_blocklist": "select id, domain, category, source from blocklist",
    "training_domains": "select id, domain, label, source, family from domain_corpus",
    "whitelist": "select id, domain from domain_corpus where label = 0",
    "resolutions": "select id, ts, domain, ip, ttl from resolution_log",
}


@query(
    "a14_read_table",
    " union all ".join(
        f"select '{name}' as name, count(*) as n, count(distinct domain) as domains, sum(id)::bigint as ids from ({sql}) t"
        for name, sql in STORED.items()
    ),
    ["dns_log", "alerts", "blocklist", "domain_corpus", "resolution_log"],
)
def read_table(v: Views):
    """What the stored tables hold once they are written and read by name."""
    out = None
    for name, sql in STORED.items():
        source = sql.split(" from ")[1].split(" ")[0]
        rows = v.spark.sql(sql.replace(f" from {source}", " from {source}"), source=getattr(v, source))
        path = fresh_dir(v.spark, name)
        kinds = dict(field.split(" ") for field in tables.SCHEMAS[name].split(", "))
        rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]).write.parquet(path)
        stored = tables.read_table(v.spark, name, path)
        part = stored.agg(
            F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("domains"), F.sum("id").alias("ids")
        )
        out = part if out is None else out.unionByName(part)
    return out
