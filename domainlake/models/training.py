"""Training of both models from a labelled corpus, as one job whose steps are made when asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame

from domainlake.models import forest, isolation
from domainlake.operators import corpus
from domainlake.operators.features import domain_features
from domainlake.session import written


class Training:
    """Models of `rows(id, domain, label, source, family)` and of a sample of brand look-alikes.

    The corpus is cleaned, its features are computed and written once; the random forest learns from 80 % of
    the balanced classes and is tested on the rest; the isolation forest learns from all legitimate names.
    `forest_params` and `isolation_params` override those of the variant.
    """

    def __init__(
        self, rows: DataFrame, variant: str = "enhanced", lookalikes: int = 2000, limit: int | None = None, seed: int = 42,
        forest_params: dict | None = None, isolation_params: dict | None = None,
    ):
        self.rows, self.variant, self.lookalikes, self.limit, self.seed = rows, variant, lookalikes, limit, seed
        self.forest_params, self.isolation_params = forest_params or {}, isolation_params or {}

    @cached_property
    def table(self) -> DataFrame:
        """Clean names of both classes with their features."""
        names = corpus.with_lookalikes(self.rows, self.lookalikes, self.seed) if self.lookalikes else self.rows
        return written(domain_features(corpus.clean_corpus(names)), "corpus")

    @cached_property
    def balanced(self) -> DataFrame:
        """Classes of equal size with their split: fitting reads them several times."""
        return written(corpus.stratified_split(corpus.balance_classes(self.table, self.limit, self.seed), seed=self.seed), "balanced")

    @cached_property
    def forest(self) -> RandomForestClassificationModel:
        train = corpus.with_class_weights(self.balanced.filter("is_train"))
        return forest.train_dga_forest(train, self.variant, self.seed, **self.forest_params)

    @cached_property
    def isolation(self) -> isolation.IsolationForest:
        legitimate = self.table.filter("label = 0")
        return isolation.train_isolation_forest(legitimate, self.variant, self.seed, **self.isolation_params)

    def tested(self) -> DataFrame:
        """Predictions of the names that the forest hasn't seen."""
        return forest.predict_dga(self.forest, self.balanced.filter("not is_train"))

    def metrics(self) -> DataFrame:
        return forest.binary_metrics(self.tested())

    def anomaly_rates(self) -> DataFrame:
        """Share of names of each class that the isolation forest flags."""
        return isolation.anomaly_rates(isolation.isolation_score(self.isolation, self.table))

    def save(self, path: str) -> None:
        forest.save_forest(self.forest, f"{path}/forest")
        self.isolation.save(f"{path}/isolation")
