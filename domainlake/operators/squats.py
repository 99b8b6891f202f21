"""Look-alike names of protected brands: enumeration, and matching against observed domains.

Candidates come from fixed word lists, so their number is fixed (a few hundred thousand) and does
not grow with the data. Observed domains meet them in one equi-join.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domainlake import constants as K
from domainlake.functions import lexical as L
from domainlake.functions.text import let
from domainlake.operators.features import host_columns

SEPARATORS = ["-", "", "."]


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _spread(df: DataFrame, **lists: list[str]) -> DataFrame:
    """Every row once per value of each fixed list."""
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(_words(values)))
    return df


def _one(spark: SparkSession) -> DataFrame:
    return spark.range(1).drop("id")


def _finish(df: DataFrame, technique: str) -> DataFrame:
    return df.select(
        F.lower("domain").alias("domain"), "brand", F.lit(technique).alias("technique")
    ).distinct()


def combosquat_candidates(spark: SparkSession) -> DataFrame:
    """Brand and keyword side by side, in both orders, with three separators."""
    wide = _spread(
        _one(spark), brand=K.WIDE_BRANDS, kw=K.WIDE_KEYWORDS, tld=K.WIDE_TLDS, sep=SEPARATORS
    ).withColumn(
        "domain",
        F.explode(
            F.array(
                F.concat("brand", "sep", "kw", F.lit("."), "tld"),
                F.concat("kw", "sep", "brand", F.lit("."), "tld"),
            )
        ),
    )
    small = _spread(
        _one(spark), brand=K.SQUAT_BRANDS, kw=K.SQUAT_KEYWORDS, tld=K.SQUAT_TLDS[:4]
    ).withColumn(
        "domain",
        F.explode(
            F.array(
                F.concat("brand", F.lit("-"), "kw", F.lit("."), "tld"),
                F.expr("concat(left(brand, length(brand) - 1), '1-', kw, '.', tld)"),
                F.concat(F.lit("secure-"), "brand", F.lit("-"), "kw", F.lit("."), "tld"),
            )
        ),
    )
    both = wide.select("brand", "domain").unionByName(small.select("brand", "domain"))
    return _finish(both, "combosquat")


def homoglyph_candidates(spark: SparkSession, max_subs: int = 2) -> DataFrame:
    """One to `max_subs` look-alike substitutions, one position at a time."""
    glyphs = F.create_map(
        *[x for ch, subs in K.HOMOGLYPHS.items() for x in (F.lit(ch), _words(subs))]
    )
    level = _spread(_one(spark), brand=K.WIDE_BRANDS).withColumn("label", F.col("brand"))
    levels = []
    for _ in range(max_subs):
        level = (
            level.select("brand", "label", F.posexplode(F.split("label", "")).alias("i", "ch"))
            .withColumn("sub", F.explode(F.try_element_at(glyphs, F.col("ch"))))
            .select("brand", F.overlay("label", "sub", F.col("i") + 1, F.lit(1)).alias("label"))
            .distinct()
        )
        levels.append(level)
    names = _spread(reduce(DataFrame.unionByName, levels), tld=K.WIDE_TLDS)
    return _finish(
        names.withColumn("domain", F.concat("label", F.lit("."), "tld")), "homoglyph"
    )


def typo_candidates(spark: SparkSession) -> DataFrame:
    """Adjacent swaps, inner drops, duplications and inserts of the neighbouring code points."""
    at = _spread(_one(spark), brand=K.WIDE_BRANDS).select(
        "brand", F.posexplode(F.split("brand", "")).alias("i", "ch")
    )
    n, i = F.length("brand"), F.col("i")

    def text(start: Column, length: Column) -> Column:
        return F.substring("brand", start, length)

    head, tail = text(F.lit(1), i), text(i + 2, n)
    swap = F.concat(head, text(i + 2, F.lit(1)), "ch", text(i + 3, n))
    edits = F.array_compact(
        F.array(
            F.when((n > 3) & (i < n - 1), swap),
            F.when((n > 4) & (i >= 1) & (i < n - 1), F.concat(head, tail)),
            F.concat(head, "ch", "ch", tail),
            F.concat(head, "ch", F.chr(F.ascii("ch") - 1), tail),
            F.concat(head, "ch", F.chr(F.ascii("ch") + 1), tail),
        )
    )
    names = _spread(at.select("brand", F.explode(edits).alias("label")), tld=K.WIDE_TLDS)
    return _finish(names.withColumn("domain", F.concat("label", F.lit("."), "tld")), "typo")


def subdomain_abuse_candidates(spark: SparkSession) -> DataFrame:
    """The brand's own name as a sub-domain of something else."""
    names = _spread(
        _one(spark), brand=K.WIDE_BRANDS, word=K.SUBDOMAIN_WORDS, tld=K.WIDE_TLDS
    ).withColumn("domain", F.concat("brand", F.lit(".com."), "word", F.lit("."), "tld"))
    return _finish(names, "subdomain")


def digit_swap_candidates(spark: SparkSession) -> DataFrame:
    """First occurrence of one letter replaced by a digit, followed by a keyword."""
    swaps = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("brand").contains(old),
                    F.regexp_replace("brand", f"^([^{old}]*){old}", f"$1{new}"),
                )
                for old, new in K.DIGIT_SWAPS
            ]
        )
    )
    labels = _spread(_one(spark), brand=K.WIDE_BRANDS).withColumn("label", F.explode(swaps))
    names = _spread(labels, kw=K.WIDE_KEYWORDS, tld=K.WIDE_TLDS).withColumn(
        "domain", F.concat("label", F.lit("-"), "kw", F.lit("."), "tld")
    )
    return _finish(names, "digit_swap")


CANDIDATES = {
    "combosquat": combosquat_candidates,
    "homoglyph": homoglyph_candidates,
    "typo": typo_candidates,
    "subdomain": subdomain_abuse_candidates,
    "digit_swap": digit_swap_candidates,
}


def squat_candidates(spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, [make(spark) for make in CANDIDATES.values()])


def observed_squats(observed: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Distinct observed domains that are candidates: (domain, brand, technique, sightings).

    Observations collapse to one row per name before the join, so a hot name costs one row.
    """
    if candidates is None:
        candidates = squat_candidates(observed.sparkSession)
    names = (
        observed.groupBy(F.lower("domain").alias("domain"))
        .agg(F.count(F.lit(1)).alias("sightings"))
    )
    return names.join(candidates, "domain")


def keyword_chain_match(df: DataFrame) -> DataFrame:
    """Domains whose hyphenated first label holds a brand and two or three phishing keywords."""
    tokens = F.split(F.col("sld"), "-")
    return (
        host_columns(df)
        .withColumn("brands", F.array_intersect(tokens, _words(K.WIDE_BRANDS)))
        .withColumn("keywords", F.array_intersect(tokens, _words(K.WIDE_KEYWORDS)))
        .filter((F.size("brands") >= 1) & F.size("keywords").between(2, 3))
        .select(
            *df.columns,
            F.array_join(F.array_sort("brands"), ",").alias("brands"),
            F.array_join(F.array_sort("keywords"), ",").alias("keywords"),
        )
    )


def encoded_labels(df: DataFrame) -> DataFrame:
    """Rows whose first label looks like an encoded payload, with `kind` and `base`.

    hex: 16-48 hex digits. base64: 14-60 characters of the (lower-cased) alphabet with more than
    three bits of entropy per character.
    """
    sld = F.col("sld")
    is_hex = sld.rlike("^[0-9a-f]{16,48}$")
    return (
        host_columns(df)
        .filter(sld.rlike("^([0-9a-f]{16,48}|[a-z0-9+/]{14,60}=*)$"))
        .withColumn("kind", F.when(is_hex, "hex").when(let(sld, L.shannon_bits) > 3, "base64"))
        .filter("kind is not null")
        .withColumn("base", F.expr("substr(host, length(sld) + 2)"))
    )


def encoded_label_report(df: DataFrame) -> DataFrame:
    """Encoded labels per parent domain and kind."""
    return (
        encoded_labels(df)
        .groupBy("base", "kind")
        .agg(
            F.count_distinct("sld").alias("n_labels"),
            F.count(F.lit(1)).alias("n_rows"),
            F.max(F.length("sld")).alias("longest"),
        )
    )
