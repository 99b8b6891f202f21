"""Threat-feed readers: text lines in, normalised (domain, label | category, source, family) out.

Every reader is a `parse_*` over a DataFrame of lines (`value`); `read_feed` applies one to landed
text files. Downloads and unpacking happen before: land plain or gzip text.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domainlake.constants import HOSTS_LOCAL_NAMES, HOSTS_SINKS
from domainlake.functions import urls as U
from domainlake.functions.text import WHITESPACE_RUN, strip


def _value() -> Column:
    return F.col("value")


def _content(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments, stripped."""
    text = lines.withColumn("value", strip(_value()))
    return text.filter((_value() != "") & ~_value().startswith("#"))


def _unstripped(lines: DataFrame) -> DataFrame:
    """Like `_content`, but a comment must start in the first column; lines stay as they are."""
    return lines.filter((strip(_value()) != "") & ~_value().startswith("#"))


def _unquote(c: Column) -> Column:
    return F.btrim(strip(c), F.lit('"'))


def _field(sep: str, i: int) -> Column:
    """i-th field (0-based) of a naive split on a literal separator, NULL past the end."""
    return F.get(F.split(_value(), sep, -1), F.lit(i))


def training_rows(df: DataFrame, label: int, source: str, family: Column | str) -> DataFrame:
    family = F.lit(family) if isinstance(family, str) else family
    return df.select(
        "domain", F.lit(label).alias("label"), F.lit(source).alias("source"),
        family.alias("family"),
    )


def blocklist_rows(df: DataFrame, category: str, source: str) -> DataFrame:
    return df.select(
        "domain", F.lit(category).alias("category"), F.lit(source).alias("source")
    )


def parse_hosts_tokens(lines: DataFrame, source: str = "hosts") -> DataFrame:
    """`0.0.0.0 name ...` or `127.0.0.1 name ...`; local machine names are dropped."""
    words = F.split(_value(), WHITESPACE_RUN)
    rows = (
        _content(lines)
        .withColumn("sink", F.get(words, F.lit(0)))
        .withColumn("domain", F.get(words, F.lit(1)))
        .filter(F.col("sink").isin(HOSTS_SINKS) & ~F.col("domain").isin(HOSTS_LOCAL_NAMES))
    )
    return blocklist_rows(rows, "Malware/Ads", source)


def parse_hosts_prefix(lines: DataFrame, source: str = "hosts") -> DataFrame:
    """Lines starting with `0.0.0.0 `: the rest of the line, trailing comments included."""
    rows = (
        lines.withColumn("value", strip(_value()))
        .filter(_value().startswith("0.0.0.0 "))
        .withColumn("domain", strip(F.replace(_value(), F.lit("0.0.0.0 "), F.lit(""))))
        .filter(~F.col("domain").isin("", "0.0.0.0"))
    )
    return blocklist_rows(rows, "Malware/Ads", source)


def parse_hosts_last_token(lines: DataFrame, source: str = "malware_hosts") -> DataFrame:
    """Last of at least two tokens when it has a dot."""
    words = F.split(strip(_value()), WHITESPACE_RUN)
    rows = (
        _unstripped(lines)
        .filter(F.size(words) >= 2)
        .withColumn("domain", F.lower(F.element_at(words, -1)))
        .filter(F.col("domain").contains("."))
    )
    return training_rows(rows, 1, source, "malware")


def parse_url_list(lines: DataFrame, source: str = "url_list") -> DataFrame:
    """One URL per line, fully normalised, each host once."""
    rows = _content(lines).withColumn("domain", U.host_of_url(_value()))
    rows = rows.filter(F.length("domain") > 3).select("domain").distinct()
    return training_rows(rows, 1, source, "phishing")


def parse_url_blocklist(lines: DataFrame, source: str = "url_list") -> DataFrame:
    """One URL per line for the blocklist; only blank lines are skipped."""
    rows = lines.filter(strip(_value()) != "").withColumn("domain", U.host_of_feed_line(_value()))
    rows = rows.filter("domain <> ''").select("domain").distinct()
    return blocklist_rows(rows, "Phishing", source)


def parse_url_training(lines: DataFrame, source: str = "url_list") -> DataFrame:
    """One URL or name per line; hosts without a dot or shorter than four are dropped."""
    rows = lines.withColumn("domain", U.host_of_training_line(_value()))
    return training_rows(rows.filter("domain is not null"), 1, source, "phishing")


def parse_quoted_csv_urls(lines: DataFrame, source: str = "quoted_csv") -> DataFrame:
    """Third field of `"a","b","url",...`; addresses are dropped, each host once."""
    rows = (
        _unstripped(lines)
        .withColumn("domain", U.host_of_url(_unquote(_field('","', 2))))
        .filter((F.length("domain") > 3) & ~U.is_dotted_quad(F.col("domain")))
        .select("domain")
        .distinct()
    )
    return training_rows(rows, 1, source, "malware")


def parse_quoted_csv_blocklist(lines: DataFrame, source: str = "quoted_csv") -> DataFrame:
    """The same file read for the blocklist with the simpler host rule."""
    host = F.replace(U.host_of_feed_line(_field('","', 2)), F.lit('"'), F.lit(""))
    rows = _content(lines).withColumn("domain", host).filter("domain <> ''")
    return blocklist_rows(rows.select("domain").distinct(), "Malware", source)


def parse_scored_csv_urls(lines: DataFrame, source: str = "scored_csv") -> DataFrame:
    """Third comma field of a scored feed, each host once."""
    rows = (
        lines.filter(~_value().startswith("#") & ~_value().startswith('"date'))
        .withColumn("domain", U.host_of_url(_unquote(_field(",", 2))))
        .filter(F.length("domain") > 3)
        .select("domain")
        .distinct()
    )
    return training_rows(rows, 1, source, "phishing")


def parse_verified_csv_urls(lines: DataFrame, source: str = "verified_csv") -> DataFrame:
    """Second comma field; a line whose first five characters hold 'url' is a header."""
    header = F.substring(F.lower(_value()), 1, 5).contains("url")
    url = F.replace(_field(",", 1), F.lit('"'), F.lit(""))
    rows = (
        lines.filter(~_value().startswith("#") & ~header)
        .withColumn("domain", U.host_of_training_line(url))
        .filter("domain is not null")
    )
    return training_rows(rows, 1, source, "phishing")


def _family_rows(df: DataFrame, source: str) -> DataFrame:
    good = df.filter((F.length("domain") > 3) & F.col("domain").contains("."))
    return training_rows(good, 1, source, F.col("family"))


def parse_family_tsv(lines: DataFrame, source: str = "family_tsv") -> DataFrame:
    """`family<TAB>domain`, or a bare domain of unknown family."""
    first, second = (F.lower(strip(_field("\t", i))) for i in (0, 1))
    rows = (
        _content(lines)
        .withColumn("family", F.when(second.isNotNull(), first).otherwise("unknown_dga"))
        .withColumn("domain", F.coalesce(second, first))
    )
    return _family_rows(rows, source)


def parse_family_csv(lines: DataFrame, source: str = "family_csv") -> DataFrame:
    """`domain,family,...` with the family optional."""
    rows = (
        _content(lines)
        .withColumn("domain", F.lower(strip(_field(",", 0))))
        .withColumn("family", F.coalesce(F.lower(strip(_field(",", 1))), F.lit("unknown")))
    )
    return _family_rows(rows, source)


def _csv(columns: list[str]) -> Column:
    schema = ", ".join(f"{c} string" for c in columns)
    return F.from_csv(_value(), F.lit(schema), {"quote": '"', "escape": '"'})


def parse_ranked_csv(lines: DataFrame, source: str = "ranked_csv") -> DataFrame:
    """`rank,domain` without a header."""
    rows = (
        lines.withColumn("row", _csv(["rank", "name"]))
        .withColumn("domain", strip(F.col("row.name")))
        .filter("domain <> ''")
    )
    return training_rows(rows, 0, source, "legitimate")


def parse_ranked_csv_with_header(
    lines: DataFrame, header: str, source: str = "ranked_csv"
) -> DataFrame:
    """`global rank,tld rank,domain,...` where lines equal to `header` are headers."""
    rows = (
        lines.filter(_value() != header)
        .withColumn("row", _csv(["global_rank", "tld_rank", "name"]))
        .withColumn("domain", F.lower(strip(F.col("row.name"))))
        .filter(F.length("domain") > 3)
    )
    return training_rows(rows, 0, source, "legitimate")


def parse_labelled_csv(lines: DataFrame, source: str = "labelled_csv") -> DataFrame:
    """`domain,dga|legit,family`: only the dga rows."""
    rows = (
        lines.withColumn("row", _csv(["name", "kind", "family"]))
        .filter(F.lower(strip(F.col("row.kind"))) == "dga")
        .withColumn("domain", strip(F.col("row.name")))
        .filter("domain <> ''")
    )
    return training_rows(
        rows, 1, source, F.coalesce(strip(F.col("row.family")), F.lit("unknown"))
    )


def parse_domain_list(
    lines: DataFrame, source: str = "domain_list", comments: bool = True
) -> DataFrame:
    """One domain per line; with `comments`, lines starting with '#' are skipped."""
    kept = _unstripped(lines) if comments else lines.filter(strip(_value()) != "")
    return training_rows(kept.withColumn("domain", strip(_value())), 1, source, "unknown")


def parse_mixed_list(lines: DataFrame, source: str = "mixed_list") -> DataFrame:
    """URL or bare name; a name the host rule rejects stays raw when it has a dot."""
    raw = F.when(_value().contains(".") & ~_value().startswith("#"), strip(_value()))
    rows = (
        lines.filter(strip(_value()) != "")
        .withColumn("domain", F.coalesce(U.host_of_training_line(_value()), raw))
        .filter("domain is not null")
    )
    return training_rows(rows, 1, source, "phishing")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed text files; splits are read in parallel."""
    return spark.read.text(path)


def read_feed(
    spark: SparkSession, path: str, parse: Callable[..., DataFrame], **options
) -> DataFrame:
    """Parse landed files, e.g. `read_feed(spark, path, parse_hosts_tokens)`."""
    return parse(read_lines(spark, path), **options)


def read_ranked_csv(spark: SparkSession, path: str, source: str = "ranked_csv") -> DataFrame:
    """Ranked file with a header row: the third column, whatever its name."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    named = rows.withColumn("domain", F.lower(strip(F.col(f"`{rows.columns[2]}`"))))
    return training_rows(named.filter(F.length("domain") > 3), 0, source, "legitimate")
