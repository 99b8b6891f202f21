"""Isolation forest (Liu, Ting and Zhou, 2008): trees grow in parallel, one group per tree.

A tree only ever sees `psi` sampled rows, and the fitted forest is a table of at most
trees * (2 * psi - 1) nodes: both sizes are parameters and do not grow with the data.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from domainlake.constants import FEATURE_COLUMNS
from domainlake.session import written

# Forest variants (trees, rows per tree, share of training rows flagged).
VARIANTS = {
    "balanced": {"trees": 200, "psi": 256, "contamination": 0.01},
    "enhanced": {"trees": 300, "psi": 512, "contamination": 0.008},
    "legacy": {"trees": 100, "psi": 256, "contamination": 0.05},
}
MAX_NODES = 2_000_000
EULER = 0.5772156649015329
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
)


def average_path(n):
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype="float64")
    many = np.maximum(n, 3)
    full = 2.0 * (np.log(many - 1.0) + EULER) - 2.0 * (many - 1.0) / many
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def grow_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """Random splits on the sample of one tree down to single rows or the depth limit."""
    tree = int(pdf["tree"].iloc[0])
    rows = pdf.sort_values("_order")[FEATURE_COLUMNS].to_numpy("float64")
    rng = np.random.default_rng([int(pdf["_seed"].iloc[0]), tree])
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes, todo = [], [(np.arange(len(rows)), 0, None, None)]
    while todo:
        members, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(members), depth])
        if parent is not None:
            nodes[parent][side] = me
        low, high = rows[members].min(axis=0), rows[members].max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(splittable) == 0:
            continue
        feature = int(rng.choice(splittable))
        below_max = np.nextafter(high[feature], low[feature])  # both sides get a row
        cut = float(min(rng.uniform(low[feature], high[feature]), below_max))
        below = rows[members, feature] <= cut
        nodes[me][2:4] = [feature, cut]
        todo.append((members[~below], depth + 1, me, 5))
        todo.append((members[below], depth + 1, me, 4))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


@dataclass(frozen=True)
class IsolationForest:
    nodes: DataFrame
    psi: int
    offset: float
    _shared: dict = field(default_factory=dict, compare=False, repr=False)

    def broadcast(self):
        """The trees as arrays on every executor, sent once however often the forest scores."""
        if "trees" not in self._shared:
            nodes = self.nodes.limit(MAX_NODES + 1).toPandas()
            if len(nodes) > MAX_NODES:
                raise ValueError("the forest has more than MAX_NODES nodes, the limit of a broadcast forest")
            self._shared["trees"] = self.nodes.sparkSession.sparkContext.broadcast(_node_arrays(nodes))
        return self._shared["trees"]

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        meta = spark.createDataFrame([(self.psi, self.offset)], "psi int, offset double")
        meta.write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        meta = spark.read.parquet(f"{path}/meta").first()
        return IsolationForest(spark.read.parquet(f"{path}/nodes"), meta["psi"], meta["offset"])


def _drawn(rows: DataFrame, trees: int, share: float) -> DataFrame:
    """`rows(_hash, ...)` with `tree`: each row with every tree independently at probability `share`.

    A row jumps from one of its trees to the next by geometric steps of a sequence seeded with its hash, so
    the work is one pass over the rows plus what is drawn, and doesn't depend on how rows are partitioned.
    """
    if share >= 1.0:
        return rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).drop("_hash")
    names = [c for c in rows.columns if c != "_hash"]

    def uniform(hashes: np.ndarray, step: int) -> np.ndarray:
        x = hashes + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x >> np.uint64(11)) + np.uint64(1)) * (1.0 / ((1 << 53) + 1))

    def draw(batches):
        for batch in batches:
            hashes = batch.column("_hash").to_numpy().view(np.uint64)
            at, step = np.full(len(hashes), -1, dtype=np.int64), 1
            rows, numbers = [], []
            live = np.arange(len(hashes))
            while len(live):
                jumps = np.floor(np.log(uniform(hashes[live], step)) / math.log1p(-share))
                at[live] += 1 + np.minimum(jumps, trees).astype(np.int64)
                live = live[at[live] < trees]
                rows.append(live)
                numbers.append(at[live])
                step += 1
            own = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            tree = pa.array(np.concatenate(numbers) if rows else [], pa.int32())
            columns = [batch.column(n).take(own) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, tree], names=[*names, "tree"])

    schema = ", ".join([*[f"`{n}` {t}" for n, t in rows.dtypes if n != "_hash"], "tree int"])
    return rows.mapInArrow(draw, schema)


def tree_samples(legit: DataFrame, trees: int, psi: int, seed: int, id_col: str) -> DataFrame:
    """`psi` rows (all, if fewer) for every tree, drawn without replacement inside a tree, in one pass.

    Every tree draws a few rows more than it needs and keeps the first of them in a seeded order, which is
    an even draw; should one draw too few, all draw again with more to spare. Which rows are drawn depends
    on row ids only, never on partitioning.
    """
    keyed = legit.select(id_col, *FEATURE_COLUMNS).withColumn("_hash", F.xxhash64(F.lit(seed), id_col))
    n = legit.count()
    spare = 6.0
    while True:
        share = min(1.0, (psi + spare * (math.sqrt(psi) + 2)) / max(n, 1))
        drawn = _drawn(keyed, trees, share).withColumn("_order", F.xxhash64(F.lit(seed), "tree", id_col))
        first = Window.partitionBy("tree").orderBy("_order", id_col)  # little more than psi rows
        kept = drawn.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= psi).drop("_rank")
        kept = written(kept, "tree-samples")
        held = kept.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(psi, n)).count()
        if share >= 1.0 or held == trees:
            return kept
        spare *= 2


def train_isolation_forest(
    legit: DataFrame,
    variant: str = "enhanced",
    seed: int = 42,
    id_col: str = "id",
    **params,
) -> IsolationForest:
    """Fit on legitimate rows only; the offset makes `contamination` of them negative."""
    settings = {**VARIANTS[variant], **params}
    trees, psi = settings["trees"], settings["psi"]
    if trees * (2 * psi - 1) > MAX_NODES:
        raise ValueError("trees * (2 * psi - 1) exceeds MAX_NODES, the limit of a broadcast forest")
    sample = tree_samples(legit, trees, psi, seed, id_col).withColumn("_seed", F.lit(seed))
    columns = ["tree", "_order", "_seed", *FEATURE_COLUMNS]
    grown = sample.select(*columns).groupBy("tree").applyInPandas(grow_tree, NODE_SCHEMA)
    nodes = written(grown, "isolation-nodes")
    # Fewer rows than psi make smaller trees; scores are normalised by the rows a tree holds.
    held = nodes.where("node = 0").agg(F.max("size").alias("n")).first()["n"]
    psi = min(psi, held or psi)
    forest = IsolationForest(nodes, psi, 0.0)
    scores = legit.select(score_column(forest).alias("score"))
    offset = scores.agg(
        F.percentile_approx("score", settings["contamination"], 100_000).alias("q")
    ).first()["q"]
    return IsolationForest(forest.nodes, psi, offset, forest._shared)


def _node_arrays(nodes: pd.DataFrame) -> list[tuple]:
    """Per tree: feature, threshold, left, right and the path length credited at each node."""
    arrays = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        arrays.append(
            (
                t["feature"].to_numpy("int32"),
                t["threshold"].to_numpy("float64"),
                t["left"].to_numpy("int32"),
                t["right"].to_numpy("int32"),
                t["depth"].to_numpy("float64") + average_path(t["size"].to_numpy()),
            )
        )
    return arrays


def score_column(forest: IsolationForest) -> Column:
    """Score -2^(-E[path] / c(psi)): near -1 is anomalous, near 0 ordinary."""
    forest_arrays = forest.broadcast()
    normal = float(average_path(forest.psi))

    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        x = np.column_stack([f.to_numpy("float64") for f in features])
        total = np.zeros(len(x))
        for feature, threshold, left, right, path in forest_arrays.value:
            at = np.zeros(len(x), dtype="int32")
            open_rows = np.flatnonzero(feature[at] >= 0)
            while len(open_rows):
                node = at[open_rows]
                below = x[open_rows, feature[node]] <= threshold[node]
                at[open_rows] = np.where(below, left[node], right[node])
                open_rows = open_rows[feature[at[open_rows]] >= 0]
            total += path[at]
        return pd.Series(-np.exp2(-total / len(forest_arrays.value) / normal))

    return score(*[F.col(c) for c in FEATURE_COLUMNS])


def isolation_score(forest: IsolationForest, df: DataFrame) -> DataFrame:
    """Add `anomaly_score` and `decision` = score - offset (negative means anomaly)."""
    return df.withColumn("anomaly_score", score_column(forest)).withColumn(
        "decision", F.col("anomaly_score") - forest.offset
    )


def walked_scores(forest: IsolationForest, df: DataFrame, id_col: str) -> DataFrame:
    """(id, walked): scores by joining every row with the node table, one level of all trees at a time.

    A plain statement of `isolation_score` without arrays, for checks. The node table has MAX_NODES rows at
    most, so it goes to every task.
    """
    nodes = forest.nodes.select("tree", "node", "feature", "threshold", "left", "right", "size", "depth")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    feature = F.array(*[F.col(c) for c in FEATURE_COLUMNS])
    trees = [r["tree"] for r in nodes.select("tree").distinct().collect()]
    at = df.select(id_col, feature.alias("x"), F.explode(F.array(*[F.lit(t) for t in trees])).alias("tree"))
    at = at.withColumn("node", F.lit(0))
    for _ in range(deepest + 1):
        here = at.join(nodes.hint("broadcast"), ["tree", "node"])
        below = F.element_at("x", F.col("feature") + 1) <= F.col("threshold")
        following = F.when(F.col("feature") >= 0, F.when(below, F.col("left")).otherwise(F.col("right")))
        at = here.select(id_col, "x", "tree", F.coalesce(following, "node").alias("node"))
    ended = at.join(nodes.hint("broadcast"), ["tree", "node"])
    many = F.greatest(F.col("size"), F.lit(3)).cast("double")
    rest = 2.0 * (F.ln(many - 1.0) + EULER) - 2.0 * (many - 1.0) / many
    path = F.col("depth") + F.when(F.col("size") > 2, rest).when(F.col("size") == 2, 1.0).otherwise(0.0)
    mean = F.avg(path) / float(average_path(forest.psi))
    return ended.groupBy(id_col).agg((-F.pow(F.lit(2.0), -mean)).alias("walked"))


def anomaly_rates(scored: DataFrame) -> DataFrame:
    """Share of flagged rows and mean score per class, over all rows."""
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("decision") < 0).cast("int")).alias("flagged"),
        F.avg("anomaly_score").alias("mean_score"),
    )
