"""Model training, scoring and evaluation on the corpus.

The registered jobs fit the whole variants: trees, depth and sample sizes as fixed there.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlake.models import forest, isolation
from domainlake.models.training import Training
from domainlake.operators import corpus, scoring
from domainlake.operators.features import domain_features
from domainlake.plans.catalog import QUERIES, query, rounded
from domainlake.plans.corpus import TRAINING
from domainlake.plans.views import Views
from domainlake.session import fresh_dir, written

FOREST = {"variant": "enhanced"}
_fitted: dict[tuple, object] = {}


def _once(v: Views, name: str, make):
    """Fit or write something once per session and data folder."""
    key = (v.spark.sparkContext.applicationId, v.path, name)
    if key not in _fitted:
        _fitted[key] = make()
    return _fitted[key]


def training(v: Views) -> Training:
    """The whole training of the corpus; its steps are made once, every model job reads them."""
    return _once(v, "training", lambda: Training(v.domain_corpus))


def training_table(v: Views) -> DataFrame:
    return training(v).table


def fitted_forest(v: Views):
    return training(v).forest


def fitted_isolation(v: Views):
    return training(v).isolation


@query("h1_train_dga_forest")
def train_dga_forest(v: Views):
    """Hold-out metrics of the trained forest."""
    return training(v).metrics()


@query("h2_predict_dga")
def predict_dga(v: Views):
    return forest.predict_dga(fitted_forest(v), training_table(v)).select(
        "id", "domain", "label", "dga_prob", "prediction"
    )


@query("h3_train_isolation_forest")
def train_isolation_forest(v: Views):
    """Node table of the fitted forest."""
    return fitted_isolation(v).nodes


@query("h4_isolation_score")
def isolation_score(v: Views):
    scored = isolation.isolation_score(fitted_isolation(v), training_table(v))
    return scored.select("id", "domain", "anomaly_score", "decision")


# A rule instead of a model, so that the metrics have an exact expectation.
RULED = (
    "select label, case when domain like '%.com' and not regexp_matches(domain, '[0-9][0-9][0-9]') "
    "then 0 else 1 end as prediction from domain_corpus"
)
CELLS = (
    "select count(*) filter (where label = 0 and prediction = 0) as tn, "
    "count(*) filter (where label = 0 and prediction = 1) as fp, "
    "count(*) filter (where label = 1 and prediction = 0) as fn, "
    f"count(*) filter (where label = 1 and prediction = 1) as tp from ({RULED}) r"
)


def _ruled(v: Views) -> DataFrame:
    clean = F.col("domain").endswith(".com") & ~F.col("domain").rlike("[0-9]{3}")
    return v.domain_corpus.select("label", F.when(clean, 0).otherwise(1).alias("prediction"))


@query(
    "h5_binary_metrics",
    "select tn + fp + fn + tp as n, round((tp + tn) / (tn + fp + fn + tp), 6) as accuracy, "
    "round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, "
    f"round(2 * tp / (2 * tp + fp + fn), 6) as f1 from ({CELLS}) c",
    ["domain_corpus"],
)
def binary_metrics(v: Views):
    return rounded(forest.binary_metrics(_ruled(v)))


@query(
    "h5_class_report",
    "select label, round(hit / (hit + wrong), 6) as precision, round(hit / (hit + missed), 6) as "
    "recall, round(2 * hit / (2 * hit + wrong + missed), 6) as f1, hit + missed as support from ("
    f"select 0 as label, tn as hit, fn as wrong, fp as missed from ({CELLS}) a union all "
    f"select 1, tp, fp, fn from ({CELLS}) b) t",
    ["domain_corpus"],
)
def class_report(v: Views):
    return rounded(forest.class_report(_ruled(v)))


@query("h6_confusion_matrix", CELLS, ["domain_corpus"])
def confusion_matrix(v: Views):
    return forest.confusion_matrix(_ruled(v))


@query("h7_cross_validate_f1")
def cross_validate_f1(v: Views):
    folded = corpus.stratified_folds(corpus.balance_classes(training_table(v)))
    scores = forest.cross_validate(written(folded, "folds"), **FOREST)
    return forest.cross_validation_summary(scores)


@query("h8_feature_importance")
def feature_importance(v: Views):
    return forest.feature_importance(v.spark, fitted_forest(v))


@query("h9_anomaly_rates")
def anomaly_rates(v: Views):
    return training(v).anomaly_rates()


@query("h10_save_load_model")
def save_load_model(v: Views):
    """Scores of the reloaded models."""
    path = fresh_dir(v.spark, "models")
    forest.save_forest(fitted_forest(v), f"{path}/forest")
    fitted_isolation(v).save(f"{path}/isolation")
    table = forest.predict_dga(forest.load_forest(f"{path}/forest"), training_table(v))
    again = isolation.IsolationForest.load(v.spark, f"{path}/isolation")
    return isolation.isolation_score(again, table).select("id", "dga_prob", "decision")


def add_probabilities(v: Views, df: DataFrame) -> DataFrame:
    """Model outputs per distinct domain, joined back to the rows."""
    table = domain_features(df.select("domain").distinct())
    table = forest.predict_dga(fitted_forest(v), table)
    table = isolation.isolation_score(fitted_isolation(v), table)
    return scoring.lookup(df, table.select("domain", "dga_prob", "decision"), "domain")


@query("h11_labelled_regression")
def labelled_regression(v: Views):
    """Accuracy of full verdicts over observed names with a known expectation."""
    names = v.squat_input.select("domain").distinct()
    expected = names.withColumn(
        "expected",
        F.when(F.col("domain").rlike("paypal|paypa1|netflix|google\\."), "MALICIOUS")
        .when(F.col("domain").endswith(".com"), "SAFE")
        .otherwise("REVIEW"),
    )
    scored = scoring.score_domains(add_probabilities(v, names))
    return forest.labelled_accuracy(scored, expected)


@query("score_with_models")
def score_with_models(v: Views):
    """Verdict counts of the query log scored by both models."""
    log = v.client_traffic.drop("dga_prob", "decision")
    scored = scoring.score_queries(add_probabilities(v, log), v.blocklist)
    return scored.groupBy("threat_type", "blocked").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")
    )


def checked(name: str, sql: str):
    """Register what must hold of a model whatever it has learnt, with its SQL check over the training rows."""
    return query(name, sql, ["domain_corpus"], TRAINING)


@checked(
    "h1_forest_nodes",
    "select t::int as tree, 1::bigint as roots, 1::bigint as leaves_over_splits, true as linked_once, true as deep_enough "
    f"from range({forest.VARIANTS['enhanced']['numTrees']}) r(t)",
)
def forest_nodes(v: Views):
    """The stored trees are trees: one root, a leaf more than splits, each node the child of one, bounded depth."""
    path = fresh_dir(v.spark, "forest-nodes")
    forest.save_forest(fitted_forest(v), path)
    nodes = forest.stored_nodes(v.spark, path)
    linked = nodes.filter("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
    once = linked.groupBy("tree").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("node").alias("children"))
    return nodes.groupBy("tree").agg(
        F.count_if(F.col("node") == 0).alias("roots"),
        (F.count_if(F.col("left") < 0) - F.count_if(F.col("left") >= 0)).alias("leaves_over_splits"),
        F.count(F.lit(1)).alias("n"),
    ).join(once, "tree", "left").select(
        "tree", "roots", "leaves_over_splits",
        ((F.coalesce("links", F.lit(0)) == F.col("n") - 1) & (F.coalesce("children", F.lit(0)) == F.col("n") - 1)).alias("linked_once"),
        (F.ceil(F.log2(F.col("n") + 1)) <= forest.VARIANTS["enhanced"]["maxDepth"] + 1).alias("deep_enough"),
    )


@checked("h2_votes", "select id, label, true as is_probability, true as follows_votes from training_clean")
def votes(v: Views):
    """A prediction is the side that the probability is on."""
    p = F.col("dga_prob")
    return forest.predict_dga(fitted_forest(v), training_table(v)).select(
        "id", "label", p.between(0, 1).alias("is_probability"), ((p == 0.5) | ((p > 0.5) == (F.col("prediction") == 1))).alias("follows_votes")
    )


@checked(
    "h3_isolation_nodes",
    "select t::int as tree, 1::bigint as roots, least(512, n)::bigint as root_rows, least(512, n)::bigint as leaf_rows, "
    "true as shallow from range(300) r(t), (select count(*) as n from training_clean where label = 0) c",
)
def isolation_nodes(v: Views):
    """Every tree has one root, and its leaves share out the rows that it drew."""
    leaf = F.col("feature") < 0
    return fitted_isolation(v).nodes.groupBy("tree").agg(
        F.count_if(F.col("node") == 0).alias("roots"),
        F.sum(F.when(F.col("node") == 0, F.col("size"))).alias("root_rows"),
        F.sum(F.when(leaf, F.col("size"))).alias("leaf_rows"),
        (F.max("depth") <= F.ceil(F.log2(F.max("size")))).alias("shallow"),
    )


@checked("h4_isolation_paths", "select id, true as same_score, true as same_decision from training_clean")
def isolation_paths(v: Views):
    """Scores equal those of walking the stored node table, a level of all trees at a time."""
    fitted = fitted_isolation(v)
    walked = isolation.walked_scores(fitted, training_table(v), "id")
    scored = isolation.isolation_score(fitted, training_table(v))
    return scored.join(walked, "id").select(
        "id",
        (F.abs(F.col("anomaly_score") - F.col("walked")) < 1e-9).alias("same_score"),
        (F.abs(F.col("decision") - (F.col("walked") - fitted.offset)) < 1e-9).alias("same_decision"),
    )


@checked("h7_fold_scores", "select f::int as fold, true as is_share from range(5) r(f)")
def fold_scores(v: Views):
    """An F1 score for every fold."""
    folded = corpus.stratified_folds(corpus.balance_classes(training_table(v)))
    scores = forest.cross_validate(written(folded, "folds"), **FOREST)
    return scores.select(F.col("fold").cast("int").alias("fold"), F.col("f1").between(0, 1).alias("is_share"))


@checked("h8_importances", "select 17::bigint as features, 1.0::double as total, true as none_negative")
def importances(v: Views):
    found = forest.feature_importance(v.spark, fitted_forest(v))
    return found.agg(
        F.count_distinct("feature").alias("features"), F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("none_negative")
    )


@checked(
    "h9_anomaly_targets",
    "select label::int as label, count(*) as n, true as score_in_range, case label when 0 then true end as below_three_percent "
    "from training_clean group by label",
)
def anomaly_targets(v: Views):
    """Rows of each class and whether the flagged share of legitimate names stays below 3 %."""
    rates = isolation.anomaly_rates(isolation.isolation_score(fitted_isolation(v), training_table(v)))
    return rates.select(
        "label", "n", F.col("mean_score").between(-1, 0).alias("score_in_range"),
        F.when(F.col("label") == 0, F.col("flagged") < 0.03).alias("below_three_percent"),
    )


@checked("h10_same_after_reload", "select id, true as same_probability, true as same_decision from training_clean")
def same_after_reload(v: Views):
    """Outputs of the reloaded models equal those of the fitted ones."""
    path = fresh_dir(v.spark, "models")
    forest.save_forest(fitted_forest(v), f"{path}/forest")
    fitted_isolation(v).save(f"{path}/isolation")

    def outputs(model, trees, names):
        rows = isolation.isolation_score(trees, forest.predict_dga(model, training_table(v)))
        return rows.select("id", F.col("dga_prob").alias(names[0]), F.col("decision").alias(names[1]))

    again = isolation.IsolationForest.load(v.spark, f"{path}/isolation")
    before = outputs(fitted_forest(v), fitted_isolation(v), ("p", "d"))
    after = outputs(forest.load_forest(f"{path}/forest"), again, ("q", "e"))
    return before.join(after, "id").select("id", F.expr("p = q").alias("same_probability"), F.expr("d = e").alias("same_decision"))


@query(
    "h11_expected_names",
    "select expected, count(*) as n, true as is_share from (select case when regexp_matches(domain, "
    "'paypal|paypa1|netflix|google\\.') then 'MALICIOUS' when domain like '%.com' then 'SAFE' else 'REVIEW' end as expected "
    "from (select distinct domain from squat_input) d) e group by 1",
    ["squat_input"],
)
def expected_names(v: Views):
    """Curated names by expectation, each with a verdict."""
    return QUERIES["h11_labelled_regression"](v.spark, v.path).select("expected", "n", F.col("accuracy").between(0, 1).alias("is_share"))
