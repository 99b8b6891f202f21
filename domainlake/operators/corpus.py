"""Labelled domain corpora: union, cleaning, balancing, splitting, weighting."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from domainlake.functions.text import strip
from domainlake.operators.ranking import first_n_per_group, seeded_rank
from domainlake.operators.squats import squat_candidates

CORPUS_COLUMNS = ["domain", "label", "source", "family"]


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """One table (domain, label, source, family) from feeds that may lack a family.

    Entries of a blocklist (domain, category, source) are malicious names of their category's family.
    """

    def complete(df: DataFrame) -> DataFrame:
        if "label" not in df.columns:
            df = df.withColumn("label", F.lit(1)).withColumn("family", F.lower("category"))
        if "family" not in df.columns:
            df = df.withColumn("family", F.lit("unknown"))
        return df.select(
            "domain", F.col("label").cast("int"), "source",
            F.coalesce("family", F.lit("unknown")).alias("family"),
        )

    return reduce(DataFrame.unionByName, map(complete, feeds))


def lookalike_feed(spark: SparkSession) -> DataFrame:
    """All look-alike candidates of the protected brands as malicious names; a technique is a family."""
    return squat_candidates(spark).select(
        "domain", F.lit(1).alias("label"), F.lit("lookalike").alias("source"), F.col("technique").alias("family")
    )


def with_lookalikes(corpus: DataFrame, n: int = 2000, seed: int = 42) -> DataFrame:
    """`corpus(id, domain, label, source, family)` and a seeded sample of n look-alikes, with ids from their names."""
    number = F.conv(F.substring(F.md5("domain"), 1, 15), 16, 10).cast("bigint")
    names = lookalike_feed(corpus.sparkSession).select("domain").distinct().withColumn("id", number)
    drawn = sample_n(names, n, seed).withColumns(
        {"label": F.lit(1), "source": F.lit("lookalike"), "family": F.lit("lookalike")}
    )
    columns = ["id", *CORPUS_COLUMNS]
    return corpus.select(columns).unionByName(drawn.select(columns))


def distinct_per_class(corpus: DataFrame) -> DataFrame:
    """Each domain once per label; a domain may stay in both classes."""
    return corpus.select("domain", "label").distinct()


def clean_corpus(corpus: DataFrame) -> DataFrame:
    """Strip and lower names, drop unusable ones, keep the first row (by id) of each domain.

    The rank filter on 1 runs map-side too, so copies of a frequent name are not shuffled.
    """
    usable = (
        corpus.filter("domain is not null")
        .withColumn("domain", F.lower(strip(F.col("domain"))))
        .filter((F.length("domain") > 2) & F.col("domain").contains("."))
    )
    first = Window.partitionBy("domain").orderBy("id")
    return usable.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def balance_classes(
    corpus: DataFrame, limit: int | None = None, seed: int = 42
) -> DataFrame:
    """Equal class sizes by seeded sampling without replacement; `limit` caps both classes.

    Rows without a label don't set the size, but are sampled down to it like a class.
    """
    labelled = F.when(F.col("label").isNotNull(), F.col("group_size"))
    size = F.min(labelled).over(Window.partitionBy())  # over the slice counts only
    size = F.coalesce(size, F.col("group_size"))
    if limit is not None:
        size = F.least(size, F.lit(limit))
    return seeded_rank(corpus, ["label"], ["id"], seed, limit=size).drop("rank", "group_size")


def cap_per_source(corpus: DataFrame, n: int) -> DataFrame:
    """At most n rows per source, in id order."""
    return first_n_per_group(corpus, ["source"], [F.col("id")], n, ["id"])


def sample_n(corpus: DataFrame, n: int = 200_000, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows by seeded sampling without replacement."""
    whole = corpus.withColumn("_all", F.lit(0))
    ranked = seeded_rank(whole, ["_all"], ["id"], seed, limit=n)
    return ranked.drop("_all", "rank", "group_size")


def stratified_split(corpus: DataFrame, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Add `is_train`: a seeded share of every class, and of the rows without a label."""
    return (
        seeded_rank(corpus, ["label"], ["id"], seed)
        .withColumn("is_train", F.col("rank") / F.col("group_size") <= train)
        .drop("rank", "group_size")
    )


def stratified_folds(corpus: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold` in 0..k-1, evenly spread over every class, and over the rows without a label."""
    return (
        seeded_rank(corpus, ["label"], ["id"], seed)
        .withColumn("fold", ((F.col("rank") - 1) % k).cast("int"))
        .drop("rank", "group_size")
    )


def class_weights(corpus: DataFrame) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class). One row per class."""
    counts = corpus.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    return counts.withColumn(
        "weight",
        F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n")),
    )


def with_class_weights(corpus: DataFrame) -> DataFrame:
    """Add `weight`, null without a label. The weight table has one row per class, two here."""
    return corpus.join(F.broadcast(class_weights(corpus).drop("n")), "label", "left")


def cross_label_conflicts(corpus: DataFrame) -> DataFrame:
    """Domains that appear with more than one label."""
    return (
        corpus.groupBy("domain")
        .agg(F.count_distinct("label").alias("labels"), F.count(F.lit(1)).alias("n_rows"))
        .filter("labels > 1")
    )
