import numpy as np

from domainlake.llm import mixing


def test_domains_without_a_target_keep_their_share(spark):
    names, counts = ["en", "fr", "it"], (60, 20, 20)
    rows = [(10.0, [float(k == d) for k in range(3)]) for d, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "tokens double, p array<double>")
    rates = mixing.fit_rates(df, names, {"en": 0.5, "fr": 0.5}, least=0.0)
    total = np.array(counts) * rates.of(np.eye(3))
    assert np.abs(total / total.sum() - [0.4, 0.4, 0.2]).max() < 0.01
