"""Mixing of documents to target weights of domains that a classifier predicts softly."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domainlake.llm.common import labelled_sample, map_slices, text_bytes
from domainlake.llm.quality import latent_space, term_counts, weighted
from domainlake.session import written

#: Labelled documents of each quality label to learn from, at most.
SAMPLE = {0: 1500, 1: 4500}
#: Target share of the tokens of each domain: documents of low quality, the others by language.
TARGETS = {"de": 0.13, "en": 0.5, "es": 0.1, "fr": 0.13, "low": 0.14}


@dataclass
class Domains:
    """Classifier of texts into domains: softmax on latent features."""

    names: list[str]
    weights: np.ndarray
    axes: np.ndarray
    slopes: np.ndarray

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        vectors = weighted(term_counts(texts), self.weights) @ self.axes
        return softmax(with_constant(vectors).astype(float) @ self.slopes)


def with_constant(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, np.ones((len(vectors), 1), dtype=vectors.dtype)], axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, axes: int = 64):
    """Domains from the labelled documents: "low" where quality is 0, else the document's language.

    Only up to `sample` documents of each quality, by a hash of the id, are learnt from; rows without a
    language and held-out ids are left out. None without labelled documents.
    """
    rows = labelled_sample(docs, labels, "quality", sample or SAMPLE, ("lang",)).where(
        "label = 0 or lang is not null"
    )
    rows = rows.withColumn("label", F.when(F.col("label") == 0, "low").otherwise(F.col("lang")))
    space = latent_space(rows, 1.0, axes)
    if space is None:
        return None
    weights, directions, vectors, truth = space
    names = sorted(set(truth))
    target = np.array([[t == n for n in names] for t in truth], dtype=float)
    x = with_constant(vectors).astype(float)
    # Accelerated gradient steps on the mean log loss; rows have unit length at most, so the step is safe.
    slopes = ahead = np.zeros((x.shape[1], len(names)))
    for k in range(400):
        slope = x.T @ (softmax(x @ ahead) - target) / len(x) + 1e-5 * ahead
        new = ahead - slope
        ahead, slopes = new + k / (k + 3) * (new - slopes), new
    return Domains(names, weights, directions, slopes)


def with_posteriors(docs: DataFrame, model: Domains, text: str = "text") -> DataFrame:
    """`docs` with tokens (words of the whole text) and p, the domains' posteriors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the documents

    def work(batch):
        texts = text_bytes(batch.column(text))
        tokens = pa.array([len(t.split()) for t in texts], pa.int64())
        p = shared.value.posteriors(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, tokens, lists], names=[*batch.schema.names, "tokens", "p"])

    fields = [T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]
    return map_slices(docs, text, work, T.StructType([*docs.schema.fields, *fields]), tidy=True)


@dataclass
class Rates:
    """Rates by posterior: the path of the accelerated projected gradient steps so far, from rate `start`.

    A document's rate depends on its posteriors alone, so rates need no table of their own: every task
    repeats the steps for its rows, and a lost executor loses nothing. A step is (momentum, direction): the
    rates move on by the momentum's share of their last move, then against the direction.
    """

    start: float
    least: float
    steps: list[tuple[float, np.ndarray]] = field(default_factory=list)
    #: What the domains' expected tokens still miss of their targets, by name.
    gap: dict[str, float] = field(default_factory=dict)

    def of(self, p: np.ndarray) -> np.ndarray:
        rates = before = np.full(len(p), self.start)
        for momentum, step in self.steps:
            ahead = rates + momentum * (rates - before)
            before, rates = rates, np.maximum(self.least, ahead - p @ step)
        return rates


def _totals(rows: DataFrame, rates: Rates, domains: int) -> np.ndarray:
    """Expected tokens of every domain at the given rates, summed where the documents are."""

    def work(batches):
        total = np.zeros(domains)
        for batch in batches:
            p = batch.column("p").flatten().to_numpy().reshape(-1, domains)
            total += (batch.column("tokens").to_numpy() * rates.of(p)) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(domains)), pa.array(total)], names=["d", "total"])

    parts = rows.select("tokens", "p").mapInArrow(work, "d long, total double")
    sums = {r["d"]: r["total"] for r in parts.groupBy("d").agg(F.sum("total").alias("total")).collect()}
    return np.array([sums.get(d, 0.0) for d in range(domains)])


def fit_rates(
    rows: DataFrame, names: list[str], targets: dict[str, float], least: float = 0.0, budget: float | None = None,
    close: float = 1e-4,
) -> Rates:
    """Rates, at least `least`, whose expected domain tokens come nearest to the targets.

    `rows` holds tokens and p. A domain that the targets don't name keeps its own share of the tokens, and the
    named ones share the rest by their weights. The targets' shares (of the domains that have tokens) times `budget` are the
    wanted totals; without a budget it is the smallest one that thins no domain below one copy. Least
    squares, each domain scaled by its tokens, by projected gradient steps; every step sums the domains'
    totals over all documents and brings one number for each domain to the driver. It goes on until all totals
    are within `close` of the targets or move by less than half of that, which they do once the least rate
    holds back what is left; `gap` of the result says how far each domain's total is from its target.
    """
    now = _totals(rows, Rates(1.0, 0.0), len(names))
    share = np.array([targets.get(n, 0.0) for n in names]) * (now > 0)
    if not share.sum():
        return Rates(1.0, least)
    own = np.array([0.0 if n in targets else 1.0 for n in names]) * now / now.sum()
    share = share / share.sum() * (1 - own.sum()) + own
    if budget is None:
        budget = float((now[share > 0] / share[share > 0]).max())
    want = share * budget
    scale = np.maximum(now, 1e-9)
    rates = Rates(max(least, 1.0), least)
    near = close * np.maximum(want, budget * 1e-3)
    before, age = now, 0
    while (np.abs(now - want) > near).any():
        momentum = age / (age + 3)
        ahead = now + momentum * (now - before)  # totals are linear in the rates
        rates.steps.append((momentum, (ahead - want) / scale))
        cost = ((now - want) ** 2 / scale).sum()
        before, now = now, _totals(rows, rates, len(names))
        # Momentum that leads uphill starts anew; without any, a step that moves little is at the optimum.
        stands = (np.abs(now - before) <= near / 2).all()
        if stands and not age:
            break
        age = 0 if stands or ((now - want) ** 2 / scale).sum() > cost else age + 1
    rates.gap = {n: float(x) for n, x in zip(names, want - now)}
    return rates


def document_rates(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, least: float = 0.0
) -> DataFrame:
    """`docs(doc_id, text, lang)` with tokens, domains, p, rate, and copies, a whole number that keeps the rate.

    copies is rate rounded up or down by a hash of doc_id and text, up as often as its fraction says. A null
    text is empty; an empty text has no tokens and a rate all the same. Rows with equal or null doc_id are
    treated one by one. Without labelled documents every rate is 1. An empty table gives an empty table.
    """
    model = fit_domains(docs, labels)
    rows = docs.select("doc_id", "text")
    return _rated(rows, model, "doc_id", "text", targets or TARGETS, least).drop("text")


def _rated(rows, model, doc_id, text, targets, least):
    if model is None:
        return rows.selectExpr(
            "*", "0L as tokens", "cast(null as array<string>) as domains", "cast(null as array<double>) as p",
            "1.0D as rate", "1 as copies",
        )
    known = written(with_posteriors(rows, model, text), "posteriors")
    rates = fit_rates(known, model.names, targets, least)
    count = len(model.names)

    @F.pandas_udf("double")
    def evaluated(p):
        return pd.Series(rates.of(np.stack(p.to_list()).reshape(-1, count)) if len(p) else [])

    # Else filters on copies evaluate it again, each time in a worker of its own.
    rate = evaluated.asNondeterministic()

    even = (F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 20)) + 0.5) / (1 << 20)
    out = known.withColumn("domains", F.array(*[F.lit(n) for n in model.names])).withColumn("rate", rate("p"))
    return out.withColumn("copies", F.floor(F.col("rate") + even).cast("int"))


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, least: float = 1.0
) -> DataFrame:
    """`docs` with every row as often as its rate says, so that domains' tokens come near to the targets.

    With `least` 1 every document stays at least once. All columns are returned unchanged. A null text is
    empty; rows with equal or null doc_id are treated one by one, and rows equal in id and text are repeated
    equally often; without labelled documents every row stays once; an empty table gives an empty table.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rated = _rated(plain, fit_domains(docs, labels), doc_id, text, targets or TARGETS, least)
    repeated = rated.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return repeated.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
