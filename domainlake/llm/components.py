"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlake.session import written

#: Links that a task writes at the end of a round.
LINKS = 50_000


def _towards_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of every node to the least of them and the node itself."""
    if larger_only:  # neighbours on both sides, but only larger ones are linked anew
        near = links.union(links.select("v", "u"))
    else:  # links point from the larger to the smaller node
        near = links
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if larger_only:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the least node it can reach.

    `links` holds two columns of one integer type, in any order and direction, repeats allowed; rows
    with a null are ignored. Each round writes its links to the shared folder, so that a lost executor
    repeats one round only, and the number of rounds grows with the logarithm of the longest chain.
    """
    a, b = links.columns
    now = written(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        stats = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(stats) == seen or not stats[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = tuple(stats)
        # A round makes no more links than it got, so their number says how many files they need.
        round_links = _towards_least(_towards_least(now, True), False)
        now = written(round_links.coalesce(-(-stats[0] // LINKS)), "links")
