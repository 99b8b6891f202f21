"""Feature tables over distinct domains."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainlake import constants as K
from domainlake.functions import lexical as L
from domainlake.functions import similarity as S
from domainlake.functions.text import strip
from domainlake.functions.urls import host_of_domain
from domainlake.operators.joins import lookup


def host_columns(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Add `host` and `sld`, the left-most label."""
    return df.withColumn("host", host_of_domain(F.col(domain))).withColumn(
        "sld", L.sld_of(F.col("host"))
    )


def brand_columns(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Add host, sld and the intermediate columns of the brand features and the entropy.

    The brand tests share a projection with the entropy, whose lambda keeps that projection out of
    whole-stage code generation: as one fused method they would be too long for the JIT compiler.
    """
    sld = F.col("sld")
    return (
        host_columns(df, domain)
        .withColumns({"_size": F.greatest(F.length(sld), F.lit(1)), "_letters": S.letter_mask("sld")})
        .withColumns(
            {
                "_distance": S.min_distance("sld", K.BRANDS),
                "_near": S.near_brands("sld", "_size", "_letters"),
                "_bits": L.shannon_bits(sld),
            }
        )
    )


def feature_columns() -> dict[str, Column]:
    """The 17 features over the columns of `brand_columns`, in their fixed order."""
    columns = L.feature_columns()
    columns["entropy"] = F.least(F.col("_bits") / 4, F.lit(1.0))
    columns["lookalike_score"] = S.lookalike_score(F.col("_distance"))
    columns["jaro_winkler_score"] = S.jaro_winkler_score("sld", "_near")
    return {name: columns[name].alias(name) for name in K.FEATURE_COLUMNS}


def domain_features(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Add the 17 feature columns. Give it distinct domains; every column is row-local."""
    return brand_columns(df, domain).select(*df.columns, *feature_columns().values())


def with_features(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Features for a table with repeated domains: compute once per distinct domain, join back."""
    table = domain_features(df.select(domain).distinct(), domain)
    return lookup(df, table, domain)


def brand_match(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Nearest brand of each label, its edit distance, Jaro-Winkler similarity and score."""
    return (
        host_columns(df, domain)
        .withColumn("_near", S.nearest_brand(F.col("sld")))
        .withColumn("brand", F.col("_near.brand"))
        .select(
            *df.columns,
            "brand",
            F.col("_near.distance").alias("distance"),
            F.expr(S.jaro_winkler("sld", "brand")).alias("similarity"),
            S.lookalike_score(F.col("_near.distance")).alias("lookalike_score"),
        )
    )


def legacy_features(df: DataFrame, domain: str = "domain") -> DataFrame:
    """The older 15 unnormalised features: shorter lists, and no scheme or path removal."""
    host, sld = F.col("host"), F.col("sld")
    distance = F.col("_distance")
    columns = {
        "length": F.length(host),
        "num_subdomains": L.labels(host) - 1,
        "vowel_ratio": L.share_of_chars(sld, "aeiou"),
        "consonant_ratio": L.share_of(sld, L.CONSONANT),
        "digit_ratio": L.share_of(sld, L.DIGIT),
        "special_char_count": L.special_chars(sld),
        "entropy": L.shannon_bits(sld),
        "ngram_randomness": L.ngram_randomness(sld, K.LEGACY_BIGRAMS),
        "repeated_char_score": L.repeated_chars(sld),
        "tld_risk": L.tld_of(host).isin(K.LEGACY_RISKY_TLDS),
        "suspicious_keyword_score": L.keyword_hits("host", K.LEGACY_KEYWORDS)
        / len(K.LEGACY_KEYWORDS),
        "lookalike_score": (distance > 0) & (distance <= 2),
        "max_consec_cons": L.longest_consonant_run(sld),
        "unique_char_ratio": L.distinct_chars(sld) / F.greatest(F.length(sld), F.lit(1)),
        "hex_char_ratio": L.share_of_chars(sld, "0123456789abcdef"),
    }
    return (
        df.withColumn("host", strip(F.lower(F.col(domain))))
        .withColumn("sld", L.sld_of(F.col("host")))
        .withColumn("_distance", S.min_distance("sld", K.LEGACY_BRANDS, within=2))
        .select(*df.columns, *[c.cast("double").alias(name) for name, c in columns.items()])
    )
