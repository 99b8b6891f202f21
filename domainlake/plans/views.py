"""Domain-shaped views over the benchmark tables, and readers for both engines.

The view texts run unchanged on Spark (`Views`) and, as common table expressions, in the SQL check
(`with_views`). Every view covers its whole source tables.
"""

from pyspark.sql import DataFrame, SparkSession

TABLES = ["events", "pages", "documents", "part"]

VIEWS = {
    # Query log: one row per event.
    "dns_log": """
select event_id as id, ts,
  concat('10.0.', cast(floor(user_id / 256) as int), '.', cast(user_id % 256 as int)) as client_ip,
  concat('h', regexp_extract(props, '([0-9]+)', 1), '.', event_type,
         cast(user_id % 10 as int), '.com') as domain,
  case cast(event_id % 8 as int) when 4 then 'AAAA' when 5 then 'CNAME' when 6 then 'MX'
    when 7 then 'TXT' else 'A' end as query_type,
  event_type in ('error', 'signup', 'purchase') as blocked,
  case event_type when 'error' then 'DGA' when 'signup' then 'Tunneling'
    when 'purchase' then 'Phishing' else 'None' end as threat_type,
  least(value, 100.0) as threat_score
from {events}""",
    # Alerts: the blocked rows of the log.
    "alerts": """
select id, ts, client_ip, domain, threat_type, threat_score / 100 as confidence,
  concat(threat_type, ' activity') as reason
from {dns_log} where blocked""",
    # Resolver answers: two addresses per event.
    "resolution_log": """
select event_id as id, ts, concat(event_type, cast(user_id as string), '.com') as domain,
  concat('198.51.100.', regexp_extract(props, '([0-9]+)', 1)) as ip,
  cast(10 + event_id % 300 as int) as ttl
from {events}""",
    # Answers for the names of the query log itself.
    "answer_log": """
select id, ts, domain, concat('203.0.', cast(id % 7 as int), '.', cast(id % 251 as int)) as ip,
  cast(60 as int) as ttl from {dns_log}
union all
select id, ts, domain, concat('198.51.100.', cast(id % 199 as int)) as ip, cast(30 as int) as ttl
from {dns_log}""",
    # Traffic that touches the safe list, the resolver list and mixed-case names.
    "client_traffic": """
select event_id as id, ts,
  case cast(user_id % 25 as int) when 1 then '8.8.8.8' when 2 then '1.1.1.1' when 3 then '9.9.9.9'
    else concat('10.0.', cast(floor(user_id / 256) as int), '.', cast(user_id % 256 as int)) end
    as client_ip,
  case event_type when 'click' then 'www.google.com' when 'view' then 'Google.com'
    when 'signup' then concat('login', cast(user_id as string), '.paypa1-secure.xyz')
    when 'error' then concat('a', cast(user_id as string), 'xkqzr7bmncvpq.tk')
    else concat('shop', cast(user_id as string), '.example.com') end as domain,
  case cast(event_id % 8 as int) when 4 then 'AAAA' when 5 then 'CNAME' when 6 then 'MX'
    when 7 then 'TXT' else 'A' end as query_type,
  cast(event_id % 101 as double) / 100 as dga_prob,
  cast(event_id % 41 as double) / 20 - 1 as decision
from {events}""",
    # Answers for the traffic: two addresses per event.
    "client_answers": """
select id, ts, domain, concat('203.0.113.', cast(id % 5 as int)) as ip, cast(60 as int) as ttl
from {client_traffic}
union all select id, ts, domain, concat('198.51.100.', cast(id % 2 as int)), cast(30 as int)
from {client_traffic}""",
    # URL feed: plain, user-info masked, redirect, port.
    "url_feed": """
select page_id, url as raw_url, case cast(page_id % 4 as int)
  when 1 then concat(regexp_extract(url, '^([a-z]+://)', 1), 'google.com@',
                     regexp_extract(url, '^[a-z]+://(.*)$', 1))
  when 2 then concat('http://r.example.net/out?id=7&next=', split_part(url, '?', 1))
  when 3 then concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), ':8080',
                     regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1))
  else url end as url
from {pages}""",
    # Masked URLs: two nested redirects, escaped redirect, zero-width characters, user info.
    "masked_feed": """
select page_id, case cast(page_id % 6 as int)
  when 0 then concat('http://a.example.net/?goto=http://b.example.net/?url=', url)
  when 1 then concat('http://a.example.net/x?next=https%3A%2F%2Fsafe@', host, '/p&goto=http://no.com')
  when 2 then concat('http://pay<zero width space>pal.com@', host, '/')
  when 3 then concat('HTTPS://User:pw@', upper(host), ':8443/a?nexturl=http://no.com')
  when 4 then concat(' ', host, '. ')
  else url end as url
from (select page_id, split_part(url, '#', 1) as url,
        regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from {pages}) p""",
    # Training corpus: hash-like names, crawl hosts, product-name hosts.
    "domain_corpus": """
select doc_id as id, domain, label, source, family from (
  select doc_id, concat(substr(md5(cast(doc_id as string)), 1, cast(8 + doc_id % 12 as int)),
         case when doc_id % 3 = 0 then '.xyz' when doc_id % 3 = 1 then '.com' else '.tk' end)
         as domain, 1 as label, 'hash' as source, 'dga' as family from {documents}
  union all select 1000000000 + page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 0, 'crawl',
         'legitimate' from {pages}
  union all select 2000000000 + p_partkey,
         concat(replace(p_name, ' ', case when p_partkey % 2 = 0 then '-' else '' end), '.com'),
         0, 'catalog', 'legitimate' from {part}) x""",
    # Blocklist: hosts that were reached through campaign links.
    "blocklist": """
select min(page_id) as id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as domain,
  case when min(page_id) % 2 = 0 then 'Phishing' else 'Malware' end as category,
  'derived' as source
from {pages} where url like '%utm_source%'
group by regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)""",
    # Brand look-alikes mixed with ordinary names.
    "squat_input": """
select p_partkey as id, case cast(p_partkey % 14 as int)
  when 0 then 'paypal-login.xyz' when 1 then 'amaz0n.top' when 2 then 'googel.click'
  when 3 then 'google.com.verify.tk' when 4 then 'secure-netflix-verify.xyz'
  when 5 then 'pyapal.com' when 6 then 'g00gle.xyz' when 7 then 'Faceb00k.club'
  when 8 then 'secure-apple-login.tk' when 9 then 'paypa1-verify.top' when 10 then 'netflx.site'
  when 11 then 'g0ogle-login.xyz' when 12 then 'ggoogle.pw'
  else concat(replace(p_name, ' ', '-'), '.com') end as domain
from {part}""",
    # Everything that looks like a domain or URL, once.
    "names": """
select distinct domain from (
  select domain from {domain_corpus} union all select domain from {squat_input}
  union all select domain from {dns_log} union all select domain from {client_traffic}
  union all select url from {pages}) x""",
    # One row per name with stand-in model outputs, so that scores have an exact expectation.
    "scoring_input": """
select id, domain, cast(id % 101 as double) / 100 as dga_prob,
  cast(id % 41 as double) / 20 - 1 as decision from (
  select id, domain from {domain_corpus}
  union all select 3000000000 + id, domain from {squat_input}
  union all select 4000000000 + page_id, url from {pages}) x""",
    # A corpus with dirty rows: padding, upper case, missing names, repeated domains.
    "dirty_corpus": """
select id, case cast(id % 9 as int) when 0 then null when 1 then concat('  ', upper(domain), ' ')
    when 2 then split_part(domain, '.', 1) else domain end as domain, label, source, family
from {domain_corpus}
union all select 5000000000 + id, domain, 1, 'recheck', 'unknown' from {blocklist}""",
}

VIEWS["masked_feed"] = VIEWS["masked_feed"].replace("<zero width space>", chr(0x200B))

# Text lines as the feed readers find them: entries, comments, blank lines, padding.
FEED_LINES = {
    "hosts_lines": """
select case cast(id % 6 as int) when 0 then concat('0.0.0.0 ', domain)
  when 1 then concat('127.0.0.1', chr(9), domain, ' alias.', domain)
  when 2 then concat('# 0.0.0.0 ', domain) when 3 then concat('  0.0.0.0  ', domain, ' # ', family)
  when 4 then concat('::1 ', upper(domain)) else domain end as value
from {domain_corpus}
union all select case cast(page_id % 3 as int) when 0 then '127.0.0.1 localhost'
  when 1 then '0.0.0.0 0.0.0.0' else '' end from {pages}""",
    "url_lines": """
select case cast(page_id % 5 as int) when 0 then concat('  ', url, ' ') when 1 then concat('#', url)
  else url end as value from {url_feed}
union all select raw_url from {url_feed}
union all select case cast(page_id % 3 as int) when 0 then '' when 1 then concat('x', cast(page_id as string))
  else concat('Host', cast(page_id as string), '.Example.org./p?q=1:2') end from {pages}""",
    "quoted_lines": """
select case cast(page_id % 4 as int) when 0 then concat('# ', url)
  when 1 then concat('"', cast(page_id as string), '","2024-01-01","http://10.0.', cast(page_id % 9 as string), '.7/x","online"')
  else concat('"', cast(page_id as string), '","2024-01-01","', url, '","online","malware"') end as value
from {url_feed}
union all select concat('"', cast(page_id as string), '","short"') from {pages}""",
    "scored_lines": """
select case cast(page_id % 5 as int) when 0 then '"date","score","url","ip"'
  when 1 then concat('# ', url) when 2 then concat('"2024-01-01","4.2"')
  else concat('"2024-01-01","4.2", "', url, '","10.0.0.1"') end as value from {url_feed}""",
    "verified_lines": """
select case cast(page_id % 5 as int) when 0 then 'id,url,verified' when 1 then concat('# ', url)
  when 2 then 'alone' else concat(cast(page_id as string), ',"', url, '",yes') end as value
from {url_feed}""",
    "family_tsv_lines": """
select case cast(id % 5 as int) when 0 then concat('# ', domain) when 1 then upper(domain)
  when 2 then concat(family, chr(9), 'nodot') when 3 then concat(upper(family), chr(9), domain, chr(9), 'x')
  else concat(family, chr(9), ' ', domain, ' ') end as value from {domain_corpus}""",
    "family_csv_lines": """
select case cast(id % 5 as int) when 0 then concat('# ', domain) when 1 then upper(domain)
  when 2 then concat('nodot,', family) else concat(domain, ', ', upper(family), ',2024-01-01') end
  as value from {domain_corpus}""",
    "ranked_lines": """
select case when id % 7 = 0 then concat('"', cast(id as string), '","', domain, '"')
  else concat(cast(id as string), ', ', domain) end as value from {domain_corpus}""",
    "ranked_header_lines": """
select case when id % 50 = 0 then 'GlobalRank,TldRank,Domain'
  else concat(cast(id as string), ',1,', upper(domain), ',com') end as value from {domain_corpus}""",
    "labelled_lines": """
select case when id % 4 = 0 then concat('"', domain, '",dga') when label = 1
  then concat(domain, ', DGA ,', family) else concat(domain, ',legit,alexa') end as value
from {domain_corpus}""",
    "domain_lines": """
select case cast(id % 4 as int) when 0 then concat('#', domain) when 1 then concat(' ', domain, ' ')
  when 2 then '   ' else domain end as value from {domain_corpus}""",
    "mixed_lines": """
select case cast(page_id % 4 as int) when 0 then concat('# ', url) when 1 then concat(' #a.', raw_url)
  when 2 then 'a.b' else url end as value from {url_feed}
union all select case when id % 3 = 0 then 'nodot' else domain end from {domain_corpus}""",
}
VIEWS |= FEED_LINES


def _dependencies(name: str) -> list[str]:
    """View names used by `name`, deepest first, itself last."""
    order: list[str] = []
    for other in VIEWS:
        if "{" + other + "}" in VIEWS[name]:
            order += [d for d in _dependencies(other) if d not in order]
    return [*order, name]


class Views:
    """Tables and views of one data folder as DataFrames: `Views(spark, path).dns_log`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        return self.over(name)

    def over(self, name: str, **given: DataFrame) -> DataFrame:
        """A view, with some of its inputs replaced (a stream, for example)."""
        text = VIEWS[name]
        inputs = [n for n in [*TABLES, *VIEWS] if "{" + n + "}" in text]
        frames = {n: given[n] if n in given else getattr(self, n) for n in inputs}
        return self.spark.sql(text, **frames)


def with_views(names: list[str], sql: str, ctes: list[tuple[str, str]] = ()) -> str:
    """SQL text for the check: the needed views and `ctes` as common table expressions."""
    needed: list[str] = []
    for name in names:
        needed += [d for d in _dependencies(name) if d not in needed]
    plain = {n: n for n in [*TABLES, *VIEWS]}
    parts = [f"{n} as ({VIEWS[n].format(**plain)})" for n in needed]
    parts += [f"{n} as ({text})" for n, text in ctes]
    return "with recursive " + ",\n".join(parts) + "\n" + sql if parts else sql
