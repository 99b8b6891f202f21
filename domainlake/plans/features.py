"""Feature columns over every distinct name of the tables."""

from domainlake.constants import (
    FEATURE_COLUMNS, LEGACY_BIGRAMS, LEGACY_BRANDS, LEGACY_KEYWORDS, LEGACY_RISKY_TLDS,
)
from domainlake.operators import features as O
from domainlake.plans import sqltext as S
from domainlake.plans.catalog import query, rounded
from domainlake.plans.views import Views

SHAPES = S.shape_ctes("names")


def _one_feature(name: str):
    return lambda v: rounded(O.domain_features(v.names).select("domain", name))


for _i, _name in enumerate(FEATURE_COLUMNS, start=1):
    if _name == "jaro_winkler_score":
        _sql = (
            "select domain, round(coalesce(jaro_winkler_score, 0), 6) as jaro_winkler_score "
            "from labels0 left join jw_best using (sld)"
        )
        query(f"c{_i}_{_name}", _sql, ["names"], SHAPES + S.JW_CTES)(_one_feature(_name))
    else:
        _sql = f"select domain, round({S.FEATURE_SQL[_name]}, 6) as {_name} from shapes"
        query(f"c{_i}_{_name}", _sql, ["names"], SHAPES)(_one_feature(_name))


@query(
    "c18_brand_match",
    "select domain, nearest.brand as brand, nearest.distance::int as distance, round(jw, 6) as similarity, "
    "(case when nearest.distance between 1 and 2 then 1.0 when nearest.distance <= 4 then 0.5 "
    "else 0.0 end)::double as lookalike_score from (select domain, sld, list_min(list_transform("
    f"range(1, 32), lambda i: {{'distance': levenshtein(sld, {S.sql_list(S.K.BRANDS)}[i]), "
    f"'position': i, 'brand': {S.sql_list(S.K.BRANDS)}[i]}})) as nearest from labels0) n "
    "left join jw on jw.sld = n.sld and jw.brand = nearest.brand",
    ["names"],
    SHAPES + S.JW_CTES,
)
def brand_match(v: Views):
    return rounded(O.brand_match(v.names))


LEGACY_SQL = {
    "length": "length(host)::double",
    "num_subdomains": "(labels - 1)::double",
    "vowel_ratio": S.FEATURE_SQL["vowel_ratio"],
    "consonant_ratio": S.FEATURE_SQL["consonant_ratio"],
    "digit_ratio": S.FEATURE_SQL["digit_ratio"],
    "special_char_count": "len(list_filter(chars, lambda c: "
    "regexp_matches(c, '[^a-z0-9]')))::double",
    "entropy": f"({S.ENTROPY})",
    "ngram_randomness": f"1 - {S.bigrams_in(LEGACY_BIGRAMS)} / pairs",
    "repeated_char_score": S.REPEATED,
    "tld_risk": f"(tld in ({S.quoted(LEGACY_RISKY_TLDS)}))::int::double",
    "suspicious_keyword_score": f"{S.hits('host', LEGACY_KEYWORDS)} / {len(LEGACY_KEYWORDS)}",
    "lookalike_score": "(dist between 1 and 2)::int::double",
    "max_consec_cons": f"({S.CONSONANT_RUN})::double",
    "unique_char_ratio": S.FEATURE_SQL["unique_char_ratio"],
    "hex_char_ratio": S.FEATURE_SQL["hex_char_ratio"],
}


@query(
    "c19_legacy_features",
    "select domain, " + ", ".join(f"round({c}, 6) as {n}" for n, c in LEGACY_SQL.items())
    + " from shapes",
    ["names"],
    S.shape_ctes("names", host="trim(lower(domain))", brands=LEGACY_BRANDS),
)
def legacy_features(v: Views):
    return rounded(O.legacy_features(v.names))


@query(
    "domain_features",
    "select domain, " + ", ".join(
        f"round({S.FEATURE_SQL[n]}, 6) as {n}" for n in FEATURE_COLUMNS if n in S.FEATURE_SQL
    ) + ", round(coalesce(jaro_winkler_score, 0), 6) as jaro_winkler_score "
    "from shapes left join jw_best using (sld)",
    ["names"],
    SHAPES + S.JW_CTES,
)
def domain_features(v: Views):
    return rounded(O.domain_features(v.names))


@query(
    "domain_features_per_query",
    f"select id, domain, round({S.FEATURE_SQL['entropy']}, 6) as entropy, "
    f"round({S.FEATURE_SQL['tld_risk']}, 6) as tld_risk from dns_log join shapes using (domain)",
    ["dns_log"],
    S.shape_ctes("dns_log"),
)
def features_per_query(v: Views):
    joined = O.with_features(v.dns_log.select("id", "domain"))
    return rounded(joined.select("id", "domain", "entropy", "tld_risk"))
