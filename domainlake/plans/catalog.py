"""Registry of runnable queries: a Spark job per operator and, where SQL can say it, its check."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainlake.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: list[str] = (), ctes: list = ()):
    """Register `job(views)` under `name`, with its SQL check over the given views."""

    def add(job: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, path: job(Views(spark, path))
        if sql is not None:
            ORACLES[name] = with_views(list(views), sql, list(ctes))
        return job

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column, as the SQL checks do."""
    return df.select(
        *[
            F.round(F.col(n), places).alias(n) if t == "double" else F.col(n)
            for n, t in df.dtypes
        ]
    )


def ts_text(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as 'YYYY-MM-DD HH:MM:SS' text."""
    for name in names:
        df = df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))
    return df
