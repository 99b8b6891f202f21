"""URL jobs: hosts per feed, redirect unmasking, masking report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlake.constants import ZERO_WIDTH
from domainlake.functions import urls as U
from domainlake.functions.text import strip

NORMALISERS = {
    "full": U.host_of_url,
    "feed": U.host_of_feed_line,
    "feature": U.host_of_domain,
    "training": U.host_of_training_line,
}


def normalize_url(df: DataFrame, url: str = "url", variant: str = "full") -> DataFrame:
    """Add `domain`, the host of `url` by one of the NORMALISERS."""
    return df.withColumn("domain", NORMALISERS[variant](F.col(url)))


def url_to_domain_table(df: DataFrame, url: str = "url", seen: str = "seen") -> DataFrame:
    """(domain, n_urls, first_seen): distinct URLs per host and the earliest sighting."""
    once = df.groupBy(url).agg(F.min(seen).alias("first_seen"))
    return (
        once.withColumn("domain", U.host_of_url(F.col(url)))
        .filter(F.length("domain") > 3)
        .groupBy("domain")
        .agg(F.count(F.lit(1)).alias("n_urls"), F.min("first_seen").alias("first_seen"))
    )


def unmask_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Add final_domain and redirect_chain_length; embedded redirects are followed to the end."""
    return df.withColumn("_hop", U.unmask(F.col(url))).select(
        *df.columns, "_hop.final_domain", "_hop.redirect_chain_length"
    )


def clean_hosts(df: DataFrame, host: str = "domain") -> DataFrame:
    return df.withColumn("clean_domain", U.clean_host(F.col(host)))


def masking_techniques(df: DataFrame, url: str = "url") -> DataFrame:
    """One row per masked URL and `technique`, the disguise it uses.

    The rows are filtered after the explode: a filter on the unmasked columns would be pushed below
    them and follow every redirect chain again.
    """
    raw = F.col(url)
    found = {
        "user_info": U.authority(strip(raw)).contains("@"),
        "redirect": F.col("redirect_chain_length") > 0,
        "zero_width": F.translate(raw, ZERO_WIDTH, "") != raw,
        "host_mismatch": F.col("visible_host") != F.col("final_domain"),
    }
    return (
        unmask_urls(df, url)
        .withColumn("visible_host", U.visible_host(raw))
        .withColumn("technique", F.explode(F.array(*[F.when(c, n) for n, c in found.items()])))
        .filter("technique is not null")
    )


def masked_url_report(df: DataFrame, url: str = "url") -> DataFrame:
    """Masked URLs and distinct final hosts per technique."""
    return (
        masking_techniques(df, url)
        .groupBy("technique")
        .agg(
            F.count(F.lit(1)).alias("n_urls"),
            F.count_distinct("final_domain").alias("n_hosts"),
        )
    )


def punycode_flag(df: DataFrame, domain: str = "domain") -> DataFrame:
    return df.withColumn("punycode", U.is_punycode(F.col(domain)))
