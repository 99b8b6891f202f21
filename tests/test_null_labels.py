from collections import Counter

from domainlake.operators import corpus


def test_rows_without_a_label_stay(spark):
    rows = [(k, f"d{k}.com", 0 if k < 60 else 1 if k < 100 else None) for k in range(110)]
    df = spark.createDataFrame(rows, "id long, domain string, label int")
    split = corpus.stratified_split(df).collect()
    assert Counter((r["label"], r["is_train"]) for r in split) == {
        (0, True): 48, (0, False): 12, (1, True): 32, (1, False): 8, (None, True): 8, (None, False): 2
    }
    folds = corpus.stratified_folds(df).collect()
    assert Counter(r["fold"] for r in folds if r["label"] is None) == {k: 2 for k in range(5)} and len(folds) == 110
    assert Counter(r["label"] for r in corpus.balance_classes(df).collect()) == {0: 40, 1: 40, None: 10}
    weighted = corpus.with_class_weights(df)
    assert weighted.columns == ["label", "id", "domain", "weight"] and weighted.count() == 110
    assert {r["label"]: r["weight"] for r in weighted.collect()} == {0: 100 / 120, 1: 100 / 80, None: None}
