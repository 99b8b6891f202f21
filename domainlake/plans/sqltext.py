"""SQL fragments of the checks, written independently of the column functions they check."""

from domainlake import constants as K


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_list(values) -> str:
    return f"[{quoted(values)}]"


def host_full(x: str) -> str:
    url = f"url_decode(trim({x}))"
    whole = f"case when starts_with({url}, 'http') then {url} else 'http://' || {url} end"
    netloc = f"regexp_extract({whole}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    return f"trim(lower(split_part(regexp_replace({netloc}, '^.*@', ''), ':', 1)), '.')"


def host_feed(x: str) -> str:
    line = f"trim({x})"
    piece = (
        f"case when contains({line}, '://') then split_part({line}, '/', 3) "
        f"else split_part({line}, '/', 1) end"
    )
    return f"lower(split_part({piece}, ':', 1))"


def host_feature(x: str) -> str:
    name = f"trim(lower({x}))"
    rest = f"case when contains({name}, '://') then split_part({name}, '://', 2) else {name} end"
    return f"split_part({rest}, '/', 1)"


def host_train(x: str) -> str:
    line = f"trim({x})"
    rest = f"case when contains({line}, '://') then split_part({line}, '://', 2) else {line} end"
    host = f"split_part({rest}, '/', 1)"
    return (
        f"case when not starts_with({line}, '#') and contains({host}, '.') "
        f"and length({host}) > 3 then lower({host}) end"
    )


TLD_CASE = (
    "(case tld " + " ".join(f"when '{t}' then {r}" for t, r in K.TLD_RISK.items())
    + " else 0.1 end)::double"
)


def hits(column: str, words) -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains({column}, w)))"


def brand_distance(column: str, brands) -> str:
    return f"list_min(list_transform({sql_list(brands)}, lambda b: levenshtein({column}, b)))"


def ratio(char_class: str) -> str:
    return f"len(list_filter(chars, lambda c: regexp_matches(c, '{char_class}'))) / size"


ENTROPY = (
    "0 - coalesce(list_sum(list_transform(list_distinct(chars), lambda c: "
    "((length(sld) - length(replace(sld, c, ''))) / size) "
    "* log2((length(sld) - length(replace(sld, c, ''))) / size))), 0)"
)
CONSONANT_RUN = (
    "coalesce(list_max(list_transform(regexp_extract_all(sld, "
    "'[b-df-hj-np-tv-z]+'), lambda r: length(r))), 0)"
)


def bigrams_in(words) -> str:
    return f"len(list_filter(bigrams, lambda b: list_contains({sql_list(words)}, b)))"


REPEATED = "len(list_filter(bigrams, lambda b: substr(b, 1, 1) = substr(b, 2, 1))) / size"
LOOKALIKE = (
    "(case when dist between 1 and 2 then 1.0 when dist <= 4 then 0.5 else 0.0 end)::double"
)

FEATURE_SQL = {
    "length": "least(length(host) / 63, 1.0)",
    "num_subdomains": "least((labels - 1) / 5, 1.0)",
    "vowel_ratio": ratio("[aeiou]"),
    "consonant_ratio": ratio("[b-df-hj-np-tv-z]"),
    "digit_ratio": ratio("[0-9]"),
    "special_char_count": "least(len(list_filter(chars, lambda c: "
    "regexp_matches(c, '[^a-z0-9]'))) / 10, 1.0)",
    "entropy": f"least(({ENTROPY}) / 4, 1.0)",
    "ngram_randomness": f"1 - {bigrams_in(K.COMMON_BIGRAMS)} / pairs",
    "repeated_char_score": REPEATED,
    "tld_risk": TLD_CASE,
    "suspicious_keyword_score": f"{hits('host', K.PHISH_KEYWORDS)} / {len(K.PHISH_KEYWORDS)}",
    "lookalike_score": LOOKALIKE,
    "max_consec_cons": f"least({CONSONANT_RUN} / 8, 1.0)",
    "unique_char_ratio": "len(list_distinct(chars)) / size",
    "hex_char_ratio": ratio("[0-9a-f]"),
    "char_continuity": f"{bigrams_in(K.IMPOSSIBLE_BIGRAMS)} / pairs",
}


def shape_ctes(source: str, host: str | None = None, brands=K.BRANDS) -> list[tuple[str, str]]:
    """CTEs hosts and shapes: per distinct domain of `source` the pieces the features use."""
    host = host or host_feature("domain")
    return [
        ("hosts", f"select distinct domain, {host} as host from {source}"),
        (
            "labels0",
            "select *, split_part(host, '.', 1) as sld, "
            "case when contains(host, '.') then split_part(host, '.', -1) else '' end as tld, "
            "len(string_split(host, '.')) as labels from hosts",
        ),
        (
            "shapes",
            "select *, case when sld = '' then [] else string_split(sld, '') end as chars, "
            "list_transform(range(1, length(sld)), lambda i: substr(sld, i, 2)) as bigrams, "
            "greatest(length(sld), 1) as size, greatest(length(sld) - 1, 1) as pairs, "
            f"{brand_distance('sld', brands)} as dist from labels0",
        ),
    ]


# Jaro-Winkler by walking the label one character per recursion step.
JW_CTES = [
    (
        "jw_pairs",
        f"select sld, brand from (select distinct sld from labels0 where sld <> '') s, "
        f"(select unnest({sql_list(K.BRANDS)}) as brand) b",
    ),
    (
        "jw_walk(sld, brand, i, rest, hit)",
        "select sld, brand, 1, brand, '' from jw_pairs union all "
        "select sld, brand, i + 1, "
        "case when p > 0 then substr(rest, 1, lo + p - 2) || '~' || substr(rest, lo + p) "
        "else rest end, case when p > 0 then hit || ch else hit end from ("
        "select *, strpos(substr(rest, lo, greatest(hi - lo + 1, 0)), ch) as p from ("
        "select *, substr(sld, i, 1) as ch, greatest(i - reach, 1) as lo, "
        "least(i + reach, length(brand)) as hi from ("
        "select *, greatest(greatest(length(sld), length(brand)) // 2 - 1, 0) as reach "
        "from jw_walk where i <= length(sld)) a) b) c",
    ),
    (
        "jw_done",
        "select sld, brand, hit, length(hit) as k, list_aggregate(list_transform("
        "range(1, length(brand) + 1), lambda j: case when substr(rest, j, 1) = '~' "
        "then substr(brand, j, 1) else '' end), 'string_agg', '') as theirs "
        "from jw_walk where i = length(sld) + 1",
    ),
    (
        "jw_jaro",
        "select sld, brand, case when k = 0 then 0 else (k / length(sld) + k / length(brand) + "
        "(k - len(list_filter(range(1, k + 1), lambda j: substr(hit, j, 1) <> "
        "substr(theirs, j, 1))) / 2) / k) / 3 end as jaro, "
        "case when k = 0 then 0 else len(list_filter([1, 2, 3, 4], lambda j: "
        "j <= length(sld) and j <= length(brand) "
        "and substr(sld, j, 1) = substr(brand, j, 1))) end as same from jw_done",
    ),
    (
        "jw",
        "select sld, brand, case when sld = brand then 1.0 else "
        "jaro + same * 0.1 * (1 - jaro) end as jw from jw_jaro",
    ),
    (
        "jw_best",
        f"select sld, case when max(jw) > 0.85 and sld not in ({quoted(K.BRANDS)}) "
        "then max(jw) else 0.0 end as jaro_winkler_score from jw group by sld",
    ),
]


def score_ctes(source: str) -> list[tuple[str, str]]:
    """CTEs up to `points`: every signal of a scored row before rounding."""
    signals = ", ".join(
        f"{FEATURE_SQL[n]} as {n}" for n in ("entropy", "lookalike_score", "tld_risk")
    )
    return [
        *shape_ctes(source),
        *JW_CTES,
        (
            "signals",
            f"select s.domain, s.sld, {signals}, "
            f"coalesce(jaro_winkler_score, 0.0) as jaro_winkler_score, "
            f"{hits('lower(s.domain)', K.PHISH_KEYWORDS)} as kw_hits, "
            f"{brand_distance('split_part(lower(s.domain), chr(46), 1)', K.BRANDS)} as min_lev "
            "from shapes s left join jw_best using (sld)",
        ),
        (
            "points",
            "select *, dga_prob * 40 + tunnel_prob * 20 + entropy * 15 + lookalike_score * 10 "
            "+ tld_risk * 10 + jaro_winkler_score * 5 + least(kw_hits * 8, 20) "
            "+ case when min_lev between 1 and 2 then 15 else 0 end as total from (select *, "
            "greatest(0.0, least(1.0, -decision + 0.5)) as tunnel_prob "
            f"from {source} join signals using (domain)) p",
        ),
        ("scored", "select *, least(trunc(total), 100)::bigint as score from points"),
        (
            "typed",
            "select *, case when score < 30 then 'CLEAN' when dga_prob > 0.55 then 'DGA' "
            "when tunnel_prob > 0.6 then 'TUNNELING' "
            "when min_lev <= 2 or lookalike_score > 0.5 then 'PHISHING' else 'SUSPICIOUS' end "
            "as threat_type from scored",
        ),
    ]


REASON = (
    "coalesce(nullif(concat_ws(' | ', "
    "case when dga_prob > 0.55 then 'DGA probability ' || printf('%.0f', dga_prob * 100) || '%' end, "
    "case when entropy > 0.75 then 'High entropy (' || printf('%.1f', entropy * 4) || ')' end, "
    "case when lookalike_score > 0.5 then 'Brand lookalike detected' end, "
    "case when kw_hits > 0 then 'Phishing keywords found' end, "
    "case when tld_risk > 0.7 then 'High-risk TLD' end), ''), 'No threats detected')"
)
