"""Training-set jobs and list maintenance."""

from pyspark.sql import functions as F

from domainlake.constants import DOH_REASON
from domainlake.operators import corpus as O
from domainlake.operators import lists, scoring
from domainlake.plans.catalog import ORACLES, QUERIES, query, rounded
from domainlake.plans.scoring import DOH, SAFE, TRAFFIC
from domainlake.plans.sqltext import REASON
from domainlake.plans.squats import CANDIDATE_SQL, LEVELS
from domainlake.plans.views import Views
from domainlake.session import fresh_dir
from domainlake.sources import tables

ORDERED = "md5('42|' || id), id"
CLEAN = (
    "select * exclude rn from (select id, lower(trim(domain)) as domain, label, source, family, "
    "row_number() over (partition by lower(trim(domain)) order by id) as rn from dirty_corpus "
    "where domain is not null and length(trim(domain)) > 2 and contains(domain, '.')) t where rn = 1"
)
FEEDS = [
    "a3_hosts_last_token", "a4_url_list", "a4_url_training", "a5_quoted_csv_urls", "a6_scored_csv_urls",
    "a7_verified_csv_urls", "a8_family_tsv", "a9_family_csv", "a10_ranked_csv", "a10_ranked_csv_header",
    "a11_labelled_csv", "a12_domain_list", "a12_domain_list_no_comments", "a13_mixed_list",
]
ENTRY_FEEDS = ["a1_hosts_tokens", "a2_hosts_prefix", "a4_url_blocklist", "a5_quoted_csv_blocklist"]
LOOKALIKES = " union all ".join(
    f"select domain, 1 as label, 'lookalike' as source, '{n}' as family from ({sql}) {n}" for n, sql in CANDIDATE_SQL.items()
)
#: Rows that the models learn from: the corpus and a seeded sample of the look-alikes.
TRAINING = [
    *LEVELS,
    (
        "training_input",
        "select id, domain, label, source, family from domain_corpus union all select id, domain, 1, 'lookalike', "
        "'lookalike' from (select *, row_number() over (order by md5('42|' || id), id) as r from (select domain, "
        "list_reduce(list_transform(string_split(substr(md5(domain), 1, 15), ''), lambda c: "
        "(strpos('0123456789abcdef', c) - 1)::bigint), lambda a, b: a * 16 + b) as id "
        f"from (select distinct domain from ({LOOKALIKES}) l) d) k) t where r <= 2000",
    ),
    ("training_clean", CLEAN.replace("dirty_corpus", "training_input")),
]


@query(
    "g1_union_feeds",
    "select domain, label::int as label, source, family from ("
    + " union all ".join(f"(select domain, label, source, family from ({ORACLES[n]}) t)" for n in FEEDS)
    + " union all "
    + " union all ".join(f"(select domain, 1, source, lower(category) from ({ORACLES[n]}) t)" for n in ENTRY_FEEDS)
    + f" union all {LOOKALIKES}) u",
    [],
    LEVELS,
)
def union_feeds(v: Views):
    """Every reader's rows and all look-alike candidates."""
    read = [QUERIES[n](v.spark, v.path) for n in [*FEEDS, *ENTRY_FEEDS]]
    return O.union_feeds([*read, O.lookalike_feed(v.spark)])


@query(
    "g1_with_lookalikes",
    "select id, domain, label, source, family from training_input",
    ["domain_corpus"],
    TRAINING,
)
def with_lookalikes(v: Views):
    return O.with_lookalikes(v.domain_corpus)


@query(
    "g2_distinct_per_class",
    "select distinct domain, label from dirty_corpus",
    ["dirty_corpus"],
)
def distinct_per_class(v: Views):
    return O.distinct_per_class(v.dirty_corpus)


@query("g3_clean_corpus", CLEAN, ["dirty_corpus"])
def clean_corpus(v: Views):
    return O.clean_corpus(v.dirty_corpus)


def _ranked(columns: str, partition: str, source: str) -> str:
    return (
        f"select {columns}, row_number() over (partition by {partition} order by {ORDERED}) as r, "
        f"count(*) over (partition by {partition}) as n from {source}"
    )


@query(
    "g4_balance_classes",
    f"select id, domain, label from ({_ranked('id, domain, label', 'label', 'domain_corpus')}) t "
    "where r <= (select min(c) from (select count(*) as c from domain_corpus group by label) m)",
    ["domain_corpus"],
)
def balance_classes(v: Views):
    return O.balance_classes(v.domain_corpus).select("id", "domain", "label")


@query(
    "g4_balance_classes_limited",
    f"select id, domain, label from ({_ranked('id, domain, label', 'label', 'clean')}) t "
    "where r <= least((select min(c) from (select count(*) as c from clean group by label) m), "
    "45000)",
    ["dirty_corpus"],
    [("clean", CLEAN)],
)
def balance_limited(v: Views):
    clean = O.clean_corpus(v.dirty_corpus)
    return O.balance_classes(clean, limit=45_000).select("id", "domain", "label")


@query(
    "g5_cap_per_source",
    "select id, source from (select id, source, row_number() over (partition by source order by id) "
    "as r from dirty_corpus) t where r <= 2000",
    ["dirty_corpus"],
)
def cap_per_source(v: Views):
    return O.cap_per_source(v.dirty_corpus, 2000).select("id", "source")


@query(
    "g6_sample_n",
    f"select id, domain from (select id, domain, row_number() over (order by {ORDERED}) as r "
    "from domain_corpus) t where r <= 1000",
    ["domain_corpus"],
)
def sample_n(v: Views):
    return O.sample_n(v.domain_corpus, 1000).select("id", "domain")


@query(
    "g7_stratified_split",
    f"select id, label, r / n <= 0.8 as is_train from ({_ranked('id, label', 'label', 'domain_corpus')}) t",
    ["domain_corpus"],
)
def stratified_split(v: Views):
    return O.stratified_split(v.domain_corpus).select("id", "label", "is_train")


@query(
    "g8_stratified_folds",
    f"select id, label, ((r - 1) % 5)::int as fold from ({_ranked('id, label', 'label', 'domain_corpus')}) t",
    ["domain_corpus"],
)
def stratified_folds(v: Views):
    return O.stratified_folds(v.domain_corpus).select("id", "label", "fold")


@query(
    "g9_class_weights",
    "select label, count(*) as n, round((select count(*) from domain_corpus) / "
    "((select count(distinct label) from domain_corpus) * count(*)), 6) as weight "
    "from domain_corpus group by label",
    ["domain_corpus"],
)
def class_weights(v: Views):
    return rounded(O.class_weights(v.domain_corpus))


@query(
    "g10_cross_label_conflicts",
    "select domain, count(distinct label) as labels, count(*) as n_rows from dirty_corpus "
    "group by domain having count(distinct label) > 1",
    ["dirty_corpus"],
)
def cross_label_conflicts(v: Views):
    return O.cross_label_conflicts(v.dirty_corpus)


ENTRIES = (
    "select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as domain, 'Crawl' as category, "
    "'pages' as source, page_id as seq from {pages} union all "
    "select domain, 'DGA', source, id + 1000000000 from {domain_corpus} where label = 1"
)


@query(
    "k1_append_blocklist",
    "select id, domain, category, source from blocklist union all select null, domain, category, "
    "source from (select *, row_number() over (partition by domain order by seq) as rn from entries "
    "where domain <> '') e where rn = 1 and domain not in (select domain from blocklist)",
    ["blocklist", "domain_corpus"],
    [("entries", ENTRIES.format(pages="pages", domain_corpus="domain_corpus"))],
)
def append_blocklist(v: Views):
    entries = v.spark.sql(ENTRIES, pages=v.pages, domain_corpus=v.domain_corpus)
    return lists.append_blocklist(v.blocklist, entries)


@query(
    "k2_add_to_list",
    "select domain from blocklist union select lower(trim(domain)) from squat_input",
    ["blocklist", "squat_input"],
)
def add_to_list(v: Views):
    padded = v.squat_input.select(F.concat(F.lit(" "), F.upper("domain")).alias("domain"))
    return lists.add_to_list(v.blocklist, padded)


@query(
    "k2_remove_from_list",
    "select domain from blocklist where category <> 'Phishing'",
    ["blocklist"],
)
def remove_from_list(v: Views):
    gone = v.blocklist.filter("category = 'Phishing'").select(F.upper("domain").alias("domain"))
    return lists.remove_from_list(v.blocklist, gone).select("domain")


FINAL = (
    f"select id, ts, client_ip, domain, case when {DOH} then 100 when {SAFE} then 0 else score end "
    f"as final, case when {DOH} then 'DOH_BYPASS' when {SAFE} then 'None' else threat_type end as "
    f"kind, {DOH} or (not {SAFE} and score >= 60) as stopped, case when {DOH} then "
    f"'{DOH_REASON}' when {SAFE} then 'Fast-path cached (Safe LUT)' else {REASON} end as "
    "why from typed where query_type in ('A', 'AAAA', 'CNAME')"
)


@query(
    "k3_write_query_log",
    "select strftime(ts, '%Y-%m-%d') as dt, query_type, threat_type, blocked, count(*) as n, "
    "round(sum(threat_score), 6) as total_score from (select ts, 'A' as query_type, kind as "
    "threat_type, stopped as blocked, final::double as threat_score from final) t group by all",
    ["client_traffic"],
    [*TRAFFIC, ("final", FINAL)],
)
def write_query_log(v: Views):
    path = fresh_dir(v.spark, "query-log")
    tables.write_query_log(scoring.score_queries(v.client_traffic), path)
    stored = v.spark.read.parquet(path)
    return (
        stored.groupBy(
            F.col("dt").cast("string").alias("dt"), "query_type", "threat_type", "blocked"
        )
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("threat_score"), 6).alias("total_score"))
    )


@query(
    "k4_write_alerts",
    "select id, client_ip, domain, kind as threat_type, round((final / 100)::double, 6) as "
    "confidence, why as reason from final where stopped",
    ["client_traffic"],
    [*TRAFFIC, ("final", FINAL)],
)
def write_alerts(v: Views):
    path = fresh_dir(v.spark, "alerts")
    tables.write_alerts(scoring.score_queries(v.client_traffic), path)
    stored = tables.read_table(v.spark, "alerts", path)
    return rounded(stored.drop("ts", "dt"))


@query(
    "k5_blocklist_by_category",
    "select category, source, count(*) as entries from blocklist group by category, source",
    ["blocklist"],
)
def blocklist_by_category(v: Views):
    return lists.blocklist_by_category(v.blocklist)
