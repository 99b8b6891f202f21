"""URL normalisation, unmasking and masking reports."""

from pyspark.sql import functions as F

from domainlake.operators import urls as U
from domainlake.plans.catalog import query, ts_text
from domainlake.plans.sqltext import host_feature, host_feed, host_full, host_train
from domainlake.plans.views import Views
from domainlake.constants import REDIRECT_PARAMS

SOURCES = ["url_feed", "masked_feed"]
ALL_URLS = (
    "(select page_id, url from url_feed union all select page_id, url from masked_feed) t"
)


def _urls(v: Views):
    return v.url_feed.select("page_id", "url").unionByName(v.masked_feed)


for _name, _variant, _sql in [
    ("b1a_normalize_full", "full", host_full("url")),
    ("b1b_normalize_feed", "feed", host_feed("url")),
    ("b1c_normalize_feature", "feature", host_feature("url")),
    ("b1d_normalize_train", "training", host_train("url")),
]:
    query(_name, f"select page_id, url, {_sql} as domain from {ALL_URLS}", SOURCES)(
        lambda v, variant=_variant: U.normalize_url(_urls(v), variant=variant)
    )


@query(
    "b2_url_to_domain",
    f"select domain, count(*) as n_urls, strftime(min(first_seen), '%Y-%m-%d %H:%M:%S') as "
    f"first_seen from (select url, {host_full('url')} as domain, min(ts) as first_seen from "
    "(select url, ts from url_feed join events on page_id = event_id) s group by url) t "
    "where length(domain) > 3 group by domain",
    ["url_feed"],
)
def url_to_domain(v: Views):
    seen = v.url_feed.join(v.events, F.col("page_id") == F.col("event_id")).select(
        "url", F.col("ts").alias("seen")
    )
    return ts_text(U.url_to_domain_table(seen), "first_seen")


# Up to four hops, one recursion step each; the fixture has at most two.
HOP_TARGET = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(q, '(?i)(?:^|&){p}=(https?%3A%2F%2F[^&]+|https?://[^&]+)', 1), '')"
    for p in REDIRECT_PARAMS
) + ")"
QUERY_PART = "regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"
HOPS = [
    (
        "starts",
        "select page_id, raw, case when regexp_matches(d, '^https?://') then d else "
        "'http://' || d end as url from (select page_id, url as raw, url_decode(trim(url)) as d "
        f"from {ALL_URLS}) s",
    ),
    (
        "hops(page_id, raw, url, hop)",
        "select page_id, raw, url, 0 from starts union all "
        "select page_id, raw, url_decode(target), hop + 1 from ("
        f"select *, {HOP_TARGET} as target from (select *, {QUERY_PART} as q from hops) a) b "
        "where target is not null",
    ),
    (
        "ends",
        "select page_id, raw, max(hop)::bigint as hop, "
        "lower(split_part(regexp_replace(regexp_extract(arg_max(url, hop), "
        "'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':', 1)) as final_domain "
        "from hops group by page_id, raw",
    ),
]


@query(
    "b3_unmask_urls",
    "select distinct page_id, raw as url, final_domain, hop as redirect_chain_length from ends",
    SOURCES,
    HOPS,
)
def unmask_urls(v: Views):
    return U.unmask_urls(_urls(v)).withColumn(
        "redirect_chain_length", F.col("redirect_chain_length").cast("bigint")
    ).distinct()


ZERO = "".join(map(chr, [0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0xFEFF]))


@query(
    "b4_clean_hosts",
    "select page_id, url, split_part(split_part(regexp_replace(rtrim(regexp_replace("
    f"regexp_replace(lower(trim(url)), '[{ZERO}]', '', 'g'), '^.*@', ''), '.'), "
    f"'^https?://', ''), '/', 1), ':', 1) as clean_domain from {ALL_URLS}",
    SOURCES,
)
def clean_hosts(v: Views):
    return U.clean_hosts(_urls(v), "url")


@query(
    "b5_masked_url_report",
    "select technique, count(*) as n_urls, count(distinct final_domain) as n_hosts from ("
    "select final_domain, unnest(list_filter(["
    "case when contains(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@') "
    "then 'user_info' end, case when hop > 0 then 'redirect' end, "
    f"case when regexp_matches(url, '[{ZERO}]') then 'zero_width' end, "
    "case when regexp_extract(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), "
    "'^([^@:/?#]*)', 1) <> final_domain then 'host_mismatch' end], lambda x: x is not null)) "
    f"as technique from {ALL_URLS} join (select distinct page_id, raw, hop, final_domain from ends)"
    " e on e.page_id = t.page_id and e.raw = t.url) x group by technique",
    SOURCES,
    HOPS,
)
def masked_url_report(v: Views):
    return U.masked_url_report(_urls(v))


@query(
    "b6_punycode_flag",
    "select domain, domain like 'xn--%' as punycode from (select distinct domain from names "
    "union all select 'xn--' || domain from names) t",
    ["names"],
)
def punycode_flag(v: Views):
    names = v.names
    encoded = names.select(F.concat(F.lit("xn--"), "domain").alias("domain"))
    return U.punycode_flag(names.unionByName(encoded))
