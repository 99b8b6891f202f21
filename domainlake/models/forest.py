"""Random forest on the domain features, its evaluation and storage."""

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainlake.constants import FEATURE_COLUMNS

# Forest variants (trees, depth, rows per leaf). Spark limits the depth to 30.
VARIANTS = {
    "balanced": {"numTrees": 200, "maxDepth": 20, "minInstancesPerNode": 2},
    "enhanced": {"numTrees": 300, "maxDepth": 25, "minInstancesPerNode": 2},
    "legacy": {"numTrees": 100, "maxDepth": 30, "minInstancesPerNode": 1},
}


def assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features").transform(df)


def train_dga_forest(
    df: DataFrame, variant: str = "enhanced", seed: int = 42, **params
) -> RandomForestClassificationModel:
    """Fit on feature columns, `label` and, when present, `weight`."""
    settings = {**VARIANTS[variant], "featureSubsetStrategy": "sqrt", "seed": seed, **params}
    if "weight" in df.columns:
        settings["weightCol"] = "weight"
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", **settings)
    return forest.fit(assemble(df))


def predict_dga(model: RandomForestClassificationModel, df: DataFrame) -> DataFrame:
    """Add `dga_prob` and `prediction`."""
    return (
        model.transform(assemble(df))
        .withColumn("dga_prob", vector_to_array("probability")[1])
        .withColumn("prediction", F.col("prediction").cast("int"))
        .drop("features", "rawPrediction", "probability")
    )


def feature_importance(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """(feature, importance), highest first; one row per feature column."""
    values = [float(v) for v in model.featureImportances.toArray()]
    rows = list(zip(FEATURE_COLUMNS, values))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def cross_validate(df: DataFrame, k: int = 5, variant: str = "enhanced", **params) -> DataFrame:
    """F1 per fold for rows with a `fold` column (see `stratified_folds`).

    Predictions of the k held-out folds are one table, so the scores come from one aggregation.
    """
    held_out = None
    for fold in range(k):
        model = train_dga_forest(df.filter(F.col("fold") != fold), variant, **params)
        part = predict_dga(model, df.filter(F.col("fold") == fold)).select(
            "fold", "label", "prediction"
        )
        held_out = part if held_out is None else held_out.unionByName(part)
    return binary_metrics(held_out, by=["fold"]).select("fold", "f1")


def cross_validation_summary(scores: DataFrame) -> DataFrame:
    """Mean F1 and twice its (population) standard deviation."""
    return scores.agg(F.avg("f1").alias("mean_f1"), (F.stddev_pop("f1") * 2).alias("spread"))


def confusion_matrix(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row tn, fp, fn, tp in a single pass."""
    y, p = F.col("label"), F.col("prediction")
    return df.groupBy(*(by or [])).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def binary_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall and F1 of the positive class; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion_matrix(df, by).select(
        *(by or []),
        (tn + fp + fn + tp).alias("n"),
        _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def class_report(df: DataFrame) -> DataFrame:
    """precision, recall, F1 and support per class."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def row(label: int, hit, wrong, missed):
        return F.struct(
            F.lit(label).alias("label"),
            _ratio(hit, hit + wrong).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"),
            _ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    rows = F.explode(F.array(row(0, tn, fn, fp), row(1, tp, fp, fn)))
    return confusion_matrix(df).select(rows.alias("r")).select("r.*")


def labelled_accuracy(scored: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of the curated domains whose verdict matches: SAFE passes, MALICIOUS is blocked.

    REVIEW rows accept either outcome.
    """
    blocked, want = F.col("blocked"), F.col("expected")
    ok = (want == "REVIEW") | ((want == "MALICIOUS") & blocked) | ((want == "SAFE") & ~blocked)
    return (
        expected.join(scored.select("domain", "blocked"), "domain")
        .groupBy("expected")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("n"))
    )


def save_forest(model: RandomForestClassificationModel, path: str) -> None:
    PipelineModel([model]).write().overwrite().save(path)


def load_forest(path: str) -> RandomForestClassificationModel:
    return PipelineModel.load(path).stages[0]


def stored_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(tree, node, left, right) of a saved forest; a leaf has children -1."""
    nodes = spark.read.parquet(f"{path}/stages/*/data")
    return nodes.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
    )
