"""Exact seeded ranks of huge groups without sorting a group in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domainlake.operators.behaviour import first_k
from domainlake.operators.joins import lookup


def shuffle_key(seed: int, *cols: str) -> Column:
    """Seeded pseudo-random sort key: independent of partitioning and of row order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def seeded_rank(
    df: DataFrame,
    by: list[str],
    id_cols: list[str],
    seed: int = 42,
    limit: Column | int | None = None,
    digits: int = 3,
) -> DataFrame:
    """Add `rank` (1..n in seeded random order inside each `by` group) and `group_size`.

    The first `digits` hex digits of the key cut every group into 16**digits even slices. Slice
    counts give each slice its starting rank, and rows are numbered inside their slice only, so the
    two-class case still uses thousands of tasks. `id_cols` must identify a row.

    With `limit` only ranks up to it are returned, and slices that start beyond it are dropped
    before the shuffle: a small sample of a huge table moves few rows. A limit column is computed
    on the slice counts, where it can use `group_size`. `by` must be a column with few values (a
    class label), because the broadcast slice counts have 16**digits rows for each.
    """
    keyed = df.withColumn("_key", shuffle_key(seed, *id_cols)).withColumn(
        "_slice", F.substring("_key", 1, digits)
    )
    group = Window.partitionBy(*by)
    counts = (
        keyed.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("group_size", F.sum("_n").over(group))
        .withColumn("_before", F.sum("_n").over(group.orderBy("_slice")) - F.col("_n"))
        .drop("_n")
    )
    if limit is not None:
        cap = F.lit(limit) if isinstance(limit, int) else limit
        counts = counts.withColumn("_cap", cap).filter(F.col("_before") < F.col("_cap"))
    inside = Window.partitionBy(*by, "_slice").orderBy("_key", *id_cols)
    names = {c: f"_of_{c}" for c in [*by, "_slice"]}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]  # a null is a group like any other
    ranked = (
        keyed.join(F.broadcast(counts.withColumnsRenamed(names)), same)
        .select(*by, "_slice", *[c for c in keyed.columns if c not in names], *[c for c in counts.columns if c not in names])
        .withColumn("rank", F.col("_before") + F.row_number().over(inside))
        .drop("_key", "_slice", "_before")
    )
    return ranked if limit is None else ranked.filter(F.col("rank") <= F.col("_cap")).drop("_cap")


def first_n_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, id_cols: list[str]) -> DataFrame:
    """First n rows of each group in the given ascending order, ties by `id_cols`, which identify a row.

    The n-th place of every group comes from bounded heaps that are merged across tasks; rows up to it are
    then kept where they are. A group of any size is never sorted, and only sort keys are shuffled.
    """
    place = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *[F.col(c).alias(f"i{k}") for k, c in enumerate(id_cols)])
    group = F.struct(*[F.col(c) for c in by])  # as one key, a null is a group like any other
    placed = df.withColumn("_place", place).withColumn("_group", group)
    last = placed.groupBy("_group").agg(F.array_max(first_k("_place", n)).alias("_last"))
    return lookup(placed, last, "_group").filter(F.col("_place") <= F.col("_last")).drop("_place", "_group", "_last")
