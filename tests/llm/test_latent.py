"""The classifiers' latent space against one made in memory; mixing where the least rate binds."""

import random

import numpy as np

from domainlake.llm import mixing, quality


def texts(n, rng):
    words = [f"w{k}" for k in range(300)]
    return [" ".join(rng.choices(words, weights=[1 + (k % 7 == j % 7) * 5 for k in range(300)], k=rng.randrange(0, 400))) for j in range(n)]


def test_latent_space_equals_one_made_in_memory(spark):
    rng = random.Random(4)
    rows = [(k, t, k % 2) for k, t in enumerate([*texts(120, rng), "", "many " * 70000])]
    weights, axes, vectors, labels = quality.latent_space(spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(5), 0.2, 12)
    counts = quality.term_counts([t.encode() for _, t, _ in rows])
    assert counts.max() == 70000
    seen = (counts > 0).sum(axis=0)
    want = np.where(seen > 0, np.log((1 + len(rows)) / (1 + seen)) + 0.3, 0)
    want[: quality.WORDS] *= 0.2
    assert np.allclose(weights, want, rtol=1e-5)
    plain = quality.weighted(counts, want.astype(np.float32)).astype(float)
    values, directions = np.linalg.eigh(plain.T @ plain)
    assert np.allclose(axes.T @ axes, np.eye(12), atol=1e-4)
    assert np.trace(axes.T @ (plain.T @ plain) @ axes) >= 0.999 * values[-12:].sum()
    assert np.allclose(vectors, plain @ axes, atol=1e-3) and labels == [k % 2 for k in range(len(rows))]


def least_squares(p, tokens, want, scale, least):
    """Nonnegative rates by very many small projected steps."""
    rates = np.full(len(p), max(least, 1.0))
    for _ in range(20000):
        rates = np.maximum(least, rates - p @ ((((tokens * rates) @ p) - want) / scale))
    return rates


def test_rates_where_the_least_one_binds(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.15, 0.15, 0.15], 300)
    tokens = rng.integers(1, 500, 300)
    targets = {"a": 0.9, "b": 0.09, "c": 0.01}
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens long, p array<double>")
    now = tokens @ p
    for least, budget in ((0.0, 0.5 * now.sum()), (1.0, 0.8 * now.sum())):
        found = mixing.fit_rates(rows, ["a", "b", "c"], targets, least, budget)
        rates = found.of(p)
        want = np.array(list(targets.values())) * budget
        best = least_squares(p, tokens, want, now, least)
        cost = [((((tokens * r) @ p) - want) ** 2 / now).sum() for r in (rates, best)]
        assert (rates >= least).all() and (rates == least).any()  # the projection binds
        assert cost[0] <= 1.001 * cost[1] + 1e-6 * (want**2 / now).sum()
        assert np.allclose([found.gap[n] for n in "abc"], want - (tokens * rates) @ p)


def test_without_labels_every_score_is_a_half(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(docs, quality.fit_neighbours(docs, none)).collect()
    assert [r["score"] for r in rows] == [0.5, 0.5]
