"""Look-alike candidates against observed names, keyword chains, encoded labels."""

from pyspark.sql import functions as F

from domainlake import constants as K
from domainlake.operators import squats as O
from domainlake.plans.catalog import query
from domainlake.plans.sqltext import ENTROPY, quoted, shape_ctes, sql_list
from domainlake.plans.views import Views


def _unnest(**lists) -> str:
    """SQL: every combination of fixed word lists."""
    tables = ", ".join(
        f"(select unnest({sql_list(values)}) as {name}) t{i}"
        for i, (name, values) in enumerate(lists.items())
    )
    return f"(select * from {tables})"


GLYPH_PAIRS = "[" + ", ".join(
    f"{{'c': '{ch}', 's': '{s}'}}" for ch, subs in K.HOMOGLYPHS.items() for s in subs
) + "]"
SUBSTITUTE = (
    "select distinct brand, substr(label, 1, i - 1) || g.s || substr(label, i + 1) as label "
    "from (select brand, label, unnest(range(1, length(label) + 1)) as i from {0}) p, "
    f"(select unnest({GLYPH_PAIRS}) as g) x where substr(label, i, 1) = g.c"
)
SWAP_PAIRS = "[" + ", ".join(f"{{'o': '{a}', 'n': '{b}'}}" for a, b in K.DIGIT_SWAPS) + "]"
NUMBERED = (
    "(select brand, i, length(brand) as n, substr(brand, i, 1) as ch from (select brand, "
    f"unnest(range(1, length(brand) + 1)) as i from {_unnest(brand=K.WIDE_BRANDS)}) q)"
)
EDITS = (
    "select brand, substr(brand, 1, i - 1) || substr(brand, i + 1, 1) || ch || substr(brand, i + 2) "
    f"as label from {NUMBERED} a where n > 3 and i < n union all "
    f"select brand, substr(brand, 1, i - 1) || substr(brand, i + 1) from {NUMBERED} a "
    "where n > 4 and i > 1 and i < n union all "
    f"select brand, substr(brand, 1, i) || substr(brand, i) from {NUMBERED} a union all "
    f"select brand, substr(brand, 1, i) || chr(ascii(ch) + 1) || substr(brand, i + 1) "
    f"from {NUMBERED} a union all "
    f"select brand, substr(brand, 1, i) || chr(ascii(ch) - 1) || substr(brand, i + 1) "
    f"from {NUMBERED} a"
)
CANDIDATE_SQL = {
    "combosquat": "select brand || sep || kw || '.' || tld as domain, brand from "
    + _unnest(brand=K.WIDE_BRANDS, kw=K.WIDE_KEYWORDS, tld=K.WIDE_TLDS, sep=["-", "", "."])
    + " a union select kw || sep || brand || '.' || tld, brand from "
    + _unnest(brand=K.WIDE_BRANDS, kw=K.WIDE_KEYWORDS, tld=K.WIDE_TLDS, sep=["-", "", "."])
    + " b union select unnest([brand || '-' || kw || '.' || tld, brand[:-2] || '1-' || kw || '.' "
    "|| tld, 'secure-' || brand || '-' || kw || '.' || tld]), brand from "
    + _unnest(brand=K.SQUAT_BRANDS, kw=K.SQUAT_KEYWORDS, tld=K.SQUAT_TLDS[:4]) + " c",
    "homoglyph": "select distinct lower(label || '.' || tld) as domain, brand from ("
    "select * from level1 union all select * from level2) l, "
    f"(select unnest({sql_list(K.WIDE_TLDS)}) as tld) t",
    "typo": f"select distinct label || '.' || tld as domain, brand from ({EDITS}) e, "
    f"(select unnest({sql_list(K.WIDE_TLDS)}) as tld) t",
    "subdomain": "select brand || '.com.' || word || '.' || tld as domain, brand from "
    + _unnest(brand=K.WIDE_BRANDS, word=K.SUBDOMAIN_WORDS, tld=K.WIDE_TLDS) + " a",
    "digit_swap": "select distinct substr(brand, 1, strpos(brand, g.o) - 1) || g.n || "
    "substr(brand, strpos(brand, g.o) + 1) || '-' || kw || '.' || tld as domain, brand from "
    + _unnest(brand=K.WIDE_BRANDS, kw=K.WIDE_KEYWORDS, tld=K.WIDE_TLDS)
    + f" a, (select unnest({SWAP_PAIRS}) as g) s where contains(brand, g.o)",
}
LEVELS = [
    (
        "level1",
        SUBSTITUTE.replace("{0}", f"(select brand, brand as label from {_unnest(brand=K.WIDE_BRANDS)} b)"),
    ),
    ("level2", SUBSTITUTE.replace("{0}", "level1")),
]


def _report(candidates, observed):
    """Per brand: candidates, observed candidates and their sightings."""
    seen = observed.groupBy(F.lower("domain").alias("domain")).agg(
        F.count(F.lit(1)).alias("sightings")
    )
    return (
        candidates.join(seen, "domain", "left")
        .groupBy("brand")
        .agg(
            F.count(F.lit(1)).alias("candidates"),
            F.count("sightings").alias("observed"),
            F.coalesce(F.sum("sightings"), F.lit(0)).alias("sightings"),
        )
    )


for _i, (_name, _make) in enumerate(O.CANDIDATES.items(), start=1):
    query(
        f"i{_i}_{_name}_candidates",
        "select brand, count(*) as candidates, count(sightings) as observed, "
        f"coalesce(sum(sightings), 0)::bigint as sightings from ({CANDIDATE_SQL[_name]}) c "
        "left join (select lower(domain) as domain, count(*) as sightings from squat_input "
        "group by 1) s using (domain) group by brand",
        ["squat_input"],
        LEVELS if _name == "homoglyph" else [],
    )(lambda v, make=_make: _report(make(v.spark), v.squat_input))


@query(
    "i6_observed_squats",
    "select domain, brand, technique, sightings from (select lower(domain) as domain, "
    "count(*) as sightings from squat_input group by 1) s join ("
    + " union all ".join(
        f"select domain, brand, '{n}' as technique from ({sql}) {n}"
        for n, sql in CANDIDATE_SQL.items()
    )
    + ") c using (domain)",
    ["squat_input"],
    LEVELS,
)
def observed_squats(v: Views):
    return O.observed_squats(v.squat_input)


@query(
    "i7_keyword_chain_match",
    "select id, domain, array_to_string(list_sort(brands), ',') as brands, "
    "array_to_string(list_sort(keywords), ',') as keywords from (select id, domain, "
    f"list_distinct(list_filter(words, lambda w: w in ({quoted(K.WIDE_BRANDS)}))) as brands, "
    f"list_distinct(list_filter(words, lambda w: w in ({quoted(K.WIDE_KEYWORDS)}))) as keywords "
    "from (select id, domain, string_split(split_part(lower(domain), '.', 1), '-') as words "
    "from squat_input) t) u where len(brands) >= 1 and len(keywords) between 2 and 3",
    ["squat_input"],
)
def keyword_chain_match(v: Views):
    return O.keyword_chain_match(v.squat_input)


@query(
    "i8_encoded_label_report",
    "select base, kind, count(distinct sld) as n_labels, count(*) as n_rows, "
    "max(length(sld))::int as longest from (select sld, substr(host, length(sld) + 2) as base, "
    "case when regexp_full_match(sld, '[0-9a-f]{16,48}') then 'hex' "
    "when regexp_full_match(sld, '[a-z0-9+/]{14,60}=*') and entropy > 3 then 'base64' end as kind "
    f"from (select domain, sld, host, {ENTROPY} as entropy from shapes) s) t "
    "where kind is not null group by base, kind",
    ["names"],
    shape_ctes("names"),
)
def encoded_label_report(v: Views):
    return O.encoded_label_report(v.names)
