"""The whole path of a logged query: rate limit, lists, behaviour, score, resolver rule."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlake.constants import FLUX_LIMIT, RATE_LIMIT, SHADOWING_LIMIT
from domainlake.operators import behaviour as B
from domainlake.operators import scoring as S
from domainlake.session import written


def named(
    analysed: DataFrame, blocklist: DataFrame | None, whitelist: DataFrame | None, settings: S.Settings
) -> DataFrame:
    """A row for each distinct domain of the queries: its first sighting, lists, base and first label."""
    firsts = (
        analysed.filter("domain is not null")
        .groupBy("domain")
        .agg(F.min(F.struct("ts", "id")).alias("first_seen"))
    )
    return B.with_base(S.safe_list_passthrough(S.listed_names(firsts, blocklist, whitelist), settings))


def feeding(names: DataFrame) -> DataFrame:
    """The names that count as sub-domains; listed ones are decided by their list."""
    return names.filter("base is not null and not safe_listed and not in_static_blocklist")


def scored(analysed: DataFrame, names: DataFrame, shadow: DataFrame, flux: DataFrame, settings: S.Settings) -> DataFrame:
    """Verdicts of queries, given the crossing points `shadow(base, crossing)` and `flux(domain, crossing)`."""
    keep = [c for c in analysed.columns if c not in ("dga_prob", "decision")]
    # Names without a base get a key of their own, so that they spread over all tasks.
    key = F.coalesce("base", F.concat(F.lit("#"), "domain"))
    table = (
        S.domain_signals(names)
        .join(flux.withColumnRenamed("crossing", "flux_from"), "domain", "left")
        .withColumn("_key", key)
        .join(shadow.select(F.col("base").alias("_key"), "crossing"), "_key", "left")
        .withColumn("shadow_from", F.when(F.col("base").isNotNull(), F.col("crossing")))
        .drop("_key", "crossing", "base", "sub", "first_seen", "safe_listed")
    )
    rows = S.lookup(analysed, table, "domain").withColumns(
        {"shadowing": B.reached("shadow_from"), "fast_flux": B.reached("flux_from")}
    )
    decided = S.decide(rows.drop("shadow_from", "flux_from"), settings, safe_list=True)
    return S.doh_bypass_override(decided.select(*keep, *S.VERDICT_COLUMNS), settings)


def score_log(
    log: DataFrame,
    resolutions: DataFrame,
    blocklist: DataFrame | None = None,
    whitelist: DataFrame | None = None,
    settings: S.Settings = S.Settings(),
    seconds: float = 1.0,
    rate_limit: int = RATE_LIMIT,
    shadow_limit: int = SHADOWING_LIMIT,
    flux_limit: int = FLUX_LIMIT,
) -> DataFrame:
    """Verdict per query of `log(id, ts, client_ip, domain, query_type, dga_prob, decision)`.

    The rate limiter sees every query type and drops what exceeds the limit. Safe-listed and
    blocklisted names are decided by their list and do not feed the shadowing state.

    Everything but the rate limit depends on the domain or its base, so lists, signals and crossing
    points meet in one table with a row per distinct domain, and the log is joined once.
    """
    passed = B.rate_limit_flags(log, seconds, rate_limit).filter(~F.col("rate_limited"))
    # Written, as first sightings and the final join both read it.
    analysed = written(S.query_type_filter(passed.drop("rate_limited", "recent")), "analysed")
    names = named(analysed, blocklist, whitelist, settings)
    shadow = B.crossing_points(feeding(names), "base", "sub", shadow_limit, F.col("first_seen"))
    flux = B.crossing_points(resolutions, "domain", "ip", flux_limit)
    return scored(analysed, names, shadow, flux, settings)
