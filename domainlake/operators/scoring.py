"""From features and model outputs to verdicts: lists, score, type, reason, contributions."""

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainlake import constants as K
from domainlake.functions import lexical as L
from domainlake.functions import similarity as S
from domainlake.functions.text import blank_to_null, part, round_exact
from domainlake.operators.features import brand_columns, feature_columns
from domainlake.operators.joins import lookup

VERDICT_COLUMNS = [
    "score", "threat_type", "dga_prob", "tunnel_score", "reason", "blocked", "entropy",
    "in_static_blocklist", "lookalike", "lookalike_similarity", "tld_risk",
]


@dataclass(frozen=True)
class Settings:
    """Job parameters; the blocking threshold is inclusive unless `strict`."""

    dga_enabled: bool = True
    tunnel_enabled: bool = True
    threshold: float = K.BLOCK_SCORE
    strict: bool = False
    doh_resolvers: tuple[str, ...] = tuple(K.DOH_RESOLVERS)
    safe_domains: tuple[str, ...] = tuple(K.SAFE_DOMAINS)

    @classmethod
    def from_table(cls, rows: DataFrame, **more) -> "Settings":
        """Settings stored in a table with one row of each id: those of the smallest id, else the defaults."""
        row = rows.orderBy("id").first()
        if row is None:
            return cls(**more)
        stored = {"dga_enabled": row["dga_enabled"] != 0, "tunnel_enabled": row["tunnel_enabled"] != 0}
        if row["risk_threshold"] is not None:
            stored["threshold"] = row["risk_threshold"]
        return cls(**{**stored, **more})

    def blocks(self, score: Column) -> Column:
        return score > self.threshold if self.strict else score >= self.threshold


def tunnel_probability(decision: Column) -> Column:
    """Clamp 0.5 - decision to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), -decision + 0.5))


def model_sanity_flag(df: DataFrame) -> DataFrame:
    """THREAT when either model alone is convinced."""
    threat = (F.col("dga_prob") > 0.55) | (F.col("decision") < -0.1)
    return df.withColumn("flag", F.when(threat, "THREAT").otherwise("CLEAN"))


def apply_toggles(df: DataFrame, settings: Settings) -> DataFrame:
    """Switch a model off by zeroing its probability."""
    if not settings.dga_enabled:
        df = df.withColumn("dga_prob", F.lit(0.0))
    if not settings.tunnel_enabled:
        df = df.withColumn("tunnel_prob", F.lit(0.0))
    return df


def domain_signals(domains: DataFrame) -> DataFrame:
    """Features plus the two signals taken from the raw name: keyword hits and brand distance.

    The first label of the raw name is nearly always the one already compared.
    """
    named = brand_columns(domains.withColumn("_label", part(F.lower("domain"), ".", 1)))
    distance = F.when(F.col("_label") == F.col("sld"), F.col("_distance")).otherwise(
        S.min_distance("_label", K.BRANDS)
    )
    return named.select(
        *domains.columns,
        *feature_columns().values(),
        L.keyword_hits("lower(domain)", K.PHISH_KEYWORDS).alias("kw_hits"),
        distance.alias("min_lev"),
    )


def _flag(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(False)


def contribution_points(df: DataFrame) -> dict[str, Column]:
    """Points of every signal in the order in which they are added up."""
    return {
        "dga_probability": F.col("dga_prob") * K.DGA_POINTS,
        "anomaly_score": F.col("tunnel_prob") * K.TUNNEL_POINTS,
        "entropy_score": F.col("entropy") * K.ENTROPY_POINTS,
        "lookalike_score": F.col("lookalike_score") * K.LOOKALIKE_POINTS,
        "tld_risk": F.col("tld_risk") * K.TLD_POINTS,
        "jaro_winkler": F.col("jaro_winkler_score") * K.JARO_WINKLER_POINTS,
        "keywords": F.least(
            F.col("kw_hits") * K.KEYWORD_POINTS, F.lit(K.KEYWORD_POINTS_CAP)
        ).cast("double"),
        "brand_distance": F.when(
            F.col("min_lev").between(1, 2), float(K.BRAND_DISTANCE_POINTS)
        ).otherwise(0.0),
        "dns_shadowing": F.when(_flag(df, "shadowing"), float(K.SHADOWING_POINTS)).otherwise(0.0),
        "fast_flux": F.when(_flag(df, "fast_flux"), float(K.FLUX_POINTS)).otherwise(0.0),
    }


def threat_score(df: DataFrame) -> DataFrame:
    """Add `score`: the weighted sum, truncated to an integer and capped at 100."""
    total = reduce(add, contribution_points(df).values())
    return df.withColumn("score", F.least(total.cast("int"), F.lit(100)))


def threat_type(df: DataFrame) -> DataFrame:
    """Add `threat_type`; a behavioural finding overrides, and fast flux overrides shadowing."""
    brand = (F.col("min_lev") <= 2) | (F.col("lookalike_score") > 0.5)
    return df.withColumn(
        "threat_type",
        F.when(_flag(df, "fast_flux"), "FAST_FLUX")
        .when(_flag(df, "shadowing"), "DNS_SHADOWING")
        .when(F.col("score") < 30, "CLEAN")
        .when(F.col("dga_prob") > 0.55, "DGA")
        .when(F.col("tunnel_prob") > 0.6, "TUNNELING")
        .when(brand, "PHISHING")
        .otherwise("SUSPICIOUS"),
    )


def reason(df: DataFrame) -> DataFrame:
    """Add `reason`: the findings in fixed order joined by ' | '."""
    flux = _flag(df, "fast_flux")
    percent = F.format_number(F.col("dga_prob") * 100, 0)
    bits = F.format_number(F.col("entropy") * 4, 1)
    findings = F.concat_ws(
        " | ",
        F.when(_flag(df, "shadowing") & ~flux, K.SHADOWING_FINDING),
        F.when(flux, K.FLUX_FINDING),
        F.when(
            F.col("dga_prob") > 0.55, F.concat(F.lit("DGA probability "), percent, F.lit("%"))
        ),
        F.when(F.col("entropy") > 0.75, F.concat(F.lit("High entropy ("), bits, F.lit(")"))),
        F.when(F.col("lookalike_score") > 0.5, K.LOOKALIKE_FINDING),
        F.when(F.col("kw_hits") > 0, K.KEYWORD_FINDING),
        F.when(F.col("tld_risk") > 0.7, K.TLD_FINDING),
    )
    return df.withColumn("reason", F.coalesce(blank_to_null(findings), F.lit(K.NO_FINDING)))


def score_contributions(df: DataFrame) -> DataFrame:
    """Add `contributions` (signal -> points), `top_signal` and `top_points`."""
    points = contribution_points(df)
    ranked = F.array_max(
        F.array(
            *[
                F.struct(c.alias("points"), F.lit(-i).alias("order"), F.lit(n).alias("name"))
                for i, (n, c) in enumerate(points.items())
            ]
        )
    )
    return (
        df.withColumn(
            "contributions",
            F.map_from_arrays(
                F.array(*[F.lit(n) for n in points]), F.array(*points.values())
            ),
        )
        .withColumn("_top", ranked)
        .withColumn(
            "top_signal", F.when(F.col("_top.points") > 0, F.col("_top.name")).otherwise("entropy")
        )
        .withColumn("top_points", F.greatest(F.col("_top.points"), F.lit(0.0)))
        .drop("_top")
    )


def verdict_flags(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add blocked and the reported forms of the signals (rounded probabilities, entropy bits)."""
    return df.withColumns(
        {
            "blocked": settings.blocks(F.col("score")),
            "dga_prob": round_exact(F.col("dga_prob"), 3),
            "tunnel_score": round_exact(F.col("tunnel_prob"), 3),
            "entropy": F.col("entropy") * 4,
            "lookalike": F.when(F.col("lookalike_score") > 0.5, "Yes"),
            "lookalike_similarity": F.col("lookalike_score"),
        }
    )


def risk_band(score: Column) -> Column:
    return (
        F.when(score >= 80, "CRITICAL")
        .when(score >= 60, "HIGH")
        .when(score >= 40, "MEDIUM")
        .otherwise("LOW")
    )


def ml_verdict(score: Column, kind: Column) -> Column:
    return F.when(score >= 50, F.concat(kind, F.lit(" (Malicious)"))).otherwise("Legitimate")


def canonical_threat_type(kind: Column) -> Column:
    """Engine vocabulary to reporting vocabulary; unknown values pass through."""
    pairs = [F.lit(x) for kv in K.CANONICAL_THREAT.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), kind)


def blocklist_match(df: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Add in_static_blocklist: case-insensitive exact match. Spark picks the join by size."""
    listed = blocklist.select(F.lower("domain").alias("_listed")).distinct().withColumn(
        "_hit", F.lit(True)
    )
    keyed = df.withColumn("_listed", F.lower("domain"))
    return (
        lookup(keyed, listed, "_listed")
        .withColumn("in_static_blocklist", F.coalesce("_hit", F.lit(False)))
        .drop("_hit", "_listed")
    )


def safe_list_passthrough(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add safe_listed: exact, case-sensitive membership in the short safe list."""
    return df.withColumn(
        "safe_listed", F.coalesce(F.col("domain").isin(*settings.safe_domains), F.lit(False))
    )


def whitelist_bypass(df: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Add whitelisted: the (trimmed, lower-cased) name is on the user's list."""
    listed = whitelist.select(F.trim(F.lower("domain")).alias("_listed")).distinct().withColumn(
        "_hit", F.lit(True)
    )
    keyed = df.withColumn("_listed", F.trim(F.lower("domain")))
    return (
        lookup(keyed, listed, "_listed")
        .withColumn("whitelisted", F.coalesce("_hit", F.lit(False)))
        .drop("_hit", "_listed")
    )


def query_type_filter(df: DataFrame) -> DataFrame:
    """Only address and alias lookups are analysed."""
    return df.filter(F.col("query_type").isin(K.ANALYSED_QUERY_TYPES))


def _override(df: DataFrame, hit: Column, values: dict) -> DataFrame:
    """Replace verdict columns where `hit` holds; a None value means NULL."""
    types = dict(df.dtypes)
    return df.withColumns(
        {
            name: F.when(hit, F.lit(value).cast(types[name])).otherwise(F.col(name))
            for name, value in values.items()
        }
    )


def doh_bypass_override(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Clients that are themselves public encrypted-DNS resolvers are always blocked."""
    hit = F.coalesce(F.col("client_ip").isin(*settings.doh_resolvers), F.lit(False))
    return _override(
        df,
        hit,
        {"blocked": True, "score": 100, "threat_type": "DOH_BYPASS", "reason": K.DOH_REASON},
    )


def row_error(df: DataFrame) -> Column:
    """Why a row cannot be analysed, NULL for good rows."""
    return (
        F.when(F.col("domain").isNull(), "domain is missing")
        .when(F.col("dga_prob").isNull() | F.isnan("dga_prob"), "dga_prob is missing")
        .when(F.col("decision").isNull() | F.isnan("decision"), "decision is missing")
    )


def error_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (good rows, failed rows); failed rows carry an ERROR verdict."""
    marked = df.withColumn("_error", row_error(df))
    good = marked.filter(F.col("_error").isNull()).drop("_error")
    failed = marked.filter(F.col("_error").isNotNull()).select(
        *[c for c in df.columns if c not in VERDICT_COLUMNS],
        F.lit(0).alias("score"),
        F.lit("ERROR").alias("threat_type"),
        F.lit(0.0).alias("dga_prob"),
        F.lit(None).cast("double").alias("tunnel_score"),
        F.col("_error").alias("reason"),
        F.lit(False).alias("blocked"),
        F.lit(0.0).alias("entropy"),
        F.lit(False).alias("in_static_blocklist"),
        F.lit(None).cast("string").alias("lookalike"),
        F.lit(0.0).alias("lookalike_similarity"),
        F.lit(0.0).alias("tld_risk"),
    )
    return good, failed


def verdicts(signals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Verdict columns for rows that already carry domain_signals, dga_prob and decision."""
    df = signals.withColumn("tunnel_prob", tunnel_probability(F.col("decision")))
    df = apply_toggles(df, settings)
    return verdict_flags(reason(threat_type(threat_score(df))), settings)


SAFE_VERDICT = {
    "score": 0, "threat_type": "None", "reason": K.SAFE_REASON, "blocked": False,
    "dga_prob": 0.0, "tunnel_score": None, "entropy": 0.0, "in_static_blocklist": False,
    "lookalike": None, "lookalike_similarity": 0.0, "tld_risk": 0.0,
}
LISTED_VERDICT = {
    "score": 100, "threat_type": "THREAT_INTEL", "reason": K.BLOCKLIST_REASON, "blocked": True,
    "dga_prob": 1.0, "tunnel_score": 1.0, "entropy": 0.0, "lookalike": None,
    "lookalike_similarity": 0.0, "tld_risk": 1.0,
}


def listed_names(
    names: DataFrame, blocklist: DataFrame | None = None, whitelist: DataFrame | None = None
) -> DataFrame:
    """Add in_static_blocklist and, with a whitelist, whitelisted to distinct names."""
    if blocklist is None:
        names = names.withColumn("in_static_blocklist", F.lit(False))
    else:
        names = blocklist_match(names, blocklist)
    return names if whitelist is None else whitelist_bypass(names, whitelist)


def with_signals(
    df: DataFrame, blocklist: DataFrame | None = None, whitelist: DataFrame | None = None
) -> DataFrame:
    """Add signals and list matches, computed once per distinct domain and joined back.

    Query logs repeat the same names, so this is far cheaper than scoring every row.
    """
    names = df.select("domain").filter("domain is not null").distinct()
    return lookup(df, domain_signals(listed_names(names, blocklist, whitelist)), "domain")


def decide(
    rows: DataFrame, settings: Settings = Settings(), safe_list: bool = False
) -> DataFrame:
    """Verdict columns for rows from `with_signals`; list and error verdicts replace the score.

    Precedence, strongest first: safe list, whitelist, blocklist, row error, score. A listed name needs
    no model output to be blocked.
    """
    listed = F.coalesce("in_static_blocklist", F.lit(False))
    out = verdicts(rows.withColumn("_error", F.when(~listed, row_error(rows))), settings)
    out = _override(out, F.col("_error").isNotNull(), {**SAFE_VERDICT, "threat_type": "ERROR"})
    out = out.withColumn("reason", F.coalesce("_error", "reason"))
    out = _override(out, listed, LISTED_VERDICT)
    if "whitelisted" in out.columns:
        bypass = {"score": 0, "threat_type": "None", "reason": K.WHITELIST_REASON, "blocked": False}
        out = _override(out, F.coalesce("whitelisted", F.lit(False)), bypass)
    if safe_list:
        out = _override(
            safe_list_passthrough(out, settings), F.col("safe_listed"), SAFE_VERDICT
        )
    return out


def score_domains(
    df: DataFrame,
    blocklist: DataFrame | None = None,
    whitelist: DataFrame | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Verdict per row of `df(domain, dga_prob, decision, ...)`.

    Optional boolean columns `shadowing` and `fast_flux` add their points and decide the type.
    """
    keep = [c for c in df.columns if c not in ("dga_prob", "decision")]
    return decide(with_signals(df, blocklist, whitelist), settings).select(*keep, *VERDICT_COLUMNS)


def score_queries(
    log: DataFrame,
    blocklist: DataFrame | None = None,
    whitelist: DataFrame | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Verdict per logged query: type gate, safe list, scoring, resolver override.

    The safe list has a dozen names, so scoring them too costs a dozen rows.
    """
    analysed = query_type_filter(log)
    keep = [c for c in log.columns if c not in ("dga_prob", "decision")]
    rows = decide(with_signals(analysed, blocklist, whitelist), settings, safe_list=True)
    return doh_bypass_override(rows.select(*keep, *VERDICT_COLUMNS), settings)
