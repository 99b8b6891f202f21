import pytest
from pyspark.sql import functions as F

from domainlake.models import forest, isolation
from domainlake.operators import corpus
from domainlake.operators.features import domain_features
from domainlake.session import written

SMALL = {"trees": 40, "psi": 64, "contamination": 0.05}


@pytest.fixture(scope="module")
def table(spark):
    words = "alpha river stone light forest garden silver bridge market window".split()
    ordinary = [(i, f"{words[i % 10]}{words[i // 10 % 10]}{'s' * (i // 100)}.com", 0) for i in range(400)]
    generated = spark.range(400).select(
        (F.col("id") + 1000).alias("id"),
        F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 18), F.lit(".xyz")).alias("domain"),
        F.lit(1).alias("label"),
    )
    named = spark.createDataFrame(ordinary, "id long, domain string, label int")
    return written(domain_features(named.unionByName(generated)), "model-test")


def test_forest_separates_the_classes(spark, table):
    split = corpus.stratified_split(table)
    train = corpus.with_class_weights(split.filter("is_train"))
    model = forest.train_dga_forest(train, "balanced", numTrees=10, maxDepth=6)
    scored = forest.predict_dga(model, split.filter("not is_train"))
    metrics = forest.binary_metrics(scored).first()
    assert metrics["n"] == 160 and metrics["f1"] > 0.95
    top = forest.feature_importance(spark, model).collect()
    assert len(top) == 17 and sum(r["importance"] for r in top) == pytest.approx(1.0)
    assert [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True)


def test_cross_validation(table):
    folds = written(corpus.stratified_folds(table, k=3), "folds")
    scores = forest.cross_validate(folds, k=3, numTrees=5, maxDepth=4)
    assert scores.count() == 3
    summary = forest.cross_validation_summary(scores).first()
    assert summary["mean_f1"] > 0.9 and summary["spread"] >= 0


def test_metrics_by_hand(spark):
    pairs = [(1, 1)] * 5 + [(1, 0)] * 2 + [(0, 0)] * 6 + [(0, 1)] * 3
    df = spark.createDataFrame(pairs, "label int, prediction int")
    m = forest.binary_metrics(df).first()
    assert (m["accuracy"], m["precision"], m["recall"]) == (11 / 16, 5 / 8, 5 / 7)
    assert m["f1"] == pytest.approx(2 / (8 / 5 + 7 / 5))
    nothing = forest.binary_metrics(df.filter("label = 0 and prediction = 0")).first()
    assert (nothing["precision"], nothing["recall"], nothing["f1"]) == (0.0, 0.0, 0.0)


def test_isolation_forest_flags_generated_names(table):
    fitted = isolation.train_isolation_forest(table.filter("label = 0"), **SMALL)
    scored = isolation.isolation_score(fitted, table)
    rates = {r["label"]: r for r in isolation.anomaly_rates(scored).collect()}
    assert rates[0]["flagged"] <= 0.06
    assert rates[1]["flagged"] > 0.6
    assert rates[1]["mean_score"] < rates[0]["mean_score"] < 0


def test_isolation_trees_are_well_formed_and_repeatable(table):
    legit = table.filter("label = 0")
    first = isolation.train_isolation_forest(legit, **SMALL)
    again = isolation.train_isolation_forest(legit.repartition(7, "domain"), **SMALL)
    key = ["tree", "node"]
    assert first.nodes.orderBy(key).collect() == again.nodes.orderBy(key).collect()
    assert first.offset == again.offset
    nodes = first.nodes.collect()
    by_id = {(n["tree"], n["node"]): n for n in nodes}
    assert {n["tree"] for n in nodes} == set(range(40))
    for n in nodes:
        if n["node"] == 0:
            assert n["size"] == 64 and n["depth"] == 0
        if n["feature"] >= 0:
            parts = [by_id[n["tree"], n[side]] for side in ("left", "right")]
            assert sum(p["size"] for p in parts) == n["size"]
            assert all(p["depth"] == n["depth"] + 1 <= 6 for p in parts)


def test_oversized_forests_are_refused(table):
    with pytest.raises(ValueError):
        isolation.train_isolation_forest(table, trees=100_000, psi=512)


def test_models_survive_storage(spark, table, tmp_path):
    model = forest.train_dga_forest(table, "legacy", numTrees=4, maxDepth=4)
    forest.save_forest(model, str(tmp_path / "forest"))
    fitted = isolation.train_isolation_forest(table.filter("label = 0"), **SMALL)
    fitted.save(str(tmp_path / "isolation"))
    back = isolation.IsolationForest.load(spark, str(tmp_path / "isolation"))

    def outputs(m, iso):
        scored = isolation.isolation_score(iso, forest.predict_dga(m, table))
        return sorted(map(tuple, scored.select("id", "dga_prob", "decision").collect()))

    assert outputs(model, fitted) == outputs(forest.load_forest(str(tmp_path / "forest")), back)


def test_labelled_accuracy(spark):
    scored = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "domain string, blocked boolean")
    want = spark.createDataFrame([("a", "SAFE"), ("b", "SAFE"), ("c", "REVIEW")], "domain string, expected string")
    got = {r["expected"]: r["accuracy"] for r in forest.labelled_accuracy(scored, want).collect()}
    assert got == {"SAFE": 0.5, "REVIEW": 1.0}


def test_training_from_corpus_to_stored_models(spark, table, tmp_path):
    from domainlake.models.training import Training

    rows = table.select("id", "domain", "label", F.lit("s").alias("source"), F.lit("f").alias("family"))
    small = {"numTrees": 10, "maxDepth": 8}
    made = Training(rows, "balanced", lookalikes=300, forest_params=small, isolation_params=SMALL)
    assert made.table.filter("source = 'lookalike'").count() > 290 and made.table.filter("label = 0").count() == 400
    assert made.metrics().first()["f1"] > 0.9
    rates = {r["label"]: r["flagged"] for r in made.anomaly_rates().collect()}
    assert rates[0] <= 0.06 < rates[1]
    made.save(str(tmp_path))
    back = isolation.IsolationForest.load(spark, str(tmp_path / "isolation"))
    assert back.offset == made.isolation.offset and back.broadcast() is back.broadcast()
    assert forest.load_forest(str(tmp_path / "forest")).getNumTrees == 10
    # Brand look-alikes are malicious names to a forest that has seen some.
    names = spark.createDataFrame([("paypa1-secure.tk",), ("secure-netflix-login.xyz",), ("marketgardens.com",)], "domain string")
    scored = forest.predict_dga(made.forest, domain_features(names))
    p = {r["domain"]: r["dga_prob"] for r in scored.collect()}
    assert min(p["paypa1-secure.tk"], p["secure-netflix-login.xyz"]) > 0.5 > p["marketgardens.com"]


def test_bagging_draws_evenly_and_without_replacement(spark):
    rows = spark.range(5000).select("id", *[F.rand(k).alias(c) for k, c in enumerate(isolation.FEATURE_COLUMNS)])
    drawn = isolation.tree_samples(rows, 60, 100, 1, "id")
    assert drawn.count() == 6000 and drawn.select("tree", "id").distinct().count() == 6000
    often = {r["id"]: r["count"] for r in drawn.groupBy("id").count().collect()}
    mean = 6000 / 5000
    spread = sum((often.get(k, 0) - mean) ** 2 for k in range(5000)) / 5000
    assert abs(spread - mean) < 0.15  # as if each tree drew on its own
    assert drawn.filter("id < 2500").count() == pytest.approx(3000, abs=200)
    few = isolation.tree_samples(rows.limit(30), 7, 100, 1, "id")
    assert {r["count"] for r in few.groupBy("tree").count().collect()} == {30}
    again = isolation.tree_samples(rows.repartition(9, "id"), 60, 100, 1, "id")
    assert sorted(map(tuple, again.select("tree", "id").collect())) == sorted(map(tuple, drawn.select("tree", "id").collect()))
