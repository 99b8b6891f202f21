"""Join helper for lookups by a key that may be heavily skewed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(facts: DataFrame, dim: DataFrame, on: str, salts: int | None = None) -> DataFrame:
    """Left join `facts` to `dim`, which holds one row per key.

    With adaptive execution Spark broadcasts `dim` when its measured size allows, and otherwise
    splits oversized partitions of `facts`. Without it, the rows of `facts` are spread over `salts`
    copies of `dim`, so that a hot key is never handled by one task.
    """
    if salts is None:
        spark = facts.sparkSession
        adaptive = (
            spark.conf.get("spark.sql.adaptive.enabled") == "true"
            and spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
        )
        salts = 1 if adaptive else 16
    if salts == 1:
        return facts.join(dim, on, "left")
    # The partition id spreads rows that are equal in every column.
    hashable = [name for name, kind in facts.dtypes if "map<" not in kind]
    spread = F.xxhash64(*hashable, F.spark_partition_id())
    salted_facts = facts.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_facts.join(salted_dim, [on, "_salt"], "left").drop("_salt")
