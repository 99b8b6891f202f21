"""Quality of texts by votes of their nearest labelled neighbours in a latent semantic space."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlake.llm.common import labelled_sample, map_slices, text_bytes, word_hashes, words_of
from domainlake.session import written

#: Labelled documents of each label that vote, at most, and numbers of hashed word and shape terms.
SAMPLE = {0: 1500, 1: 3500}
WORDS, SHAPES, FORMS = 2048, 512, 64
TERMS = WORDS + SHAPES + FORMS
#: Tasks that each sum up a matrix of the sample's term products.
MATRICES = 8
_CLASSES = bytes(
    65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> int:
    """Number of a word's form: runs of small letters, capitals and digits, and its punctuation."""
    return zlib.crc32(_RUNS.sub(rb"\1", word.translate(_CLASSES))) % SHAPES


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of all terms (columns) of every text (rows).

    Terms are hashed words, word shapes, and forms: repeats of the word before or of a word on the same
    line, word lengths, and line lengths in words.
    """
    data, starts, ends, first = words_of(texts)
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    if not len(starts):
        return out
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    hashes = word_hashes(data, starts, ends)
    _, once, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    shapes = [shape(raw[a:b]) for a, b in zip(starts[once].tolist(), ends[once].tolist())]
    flat = out.ravel()
    columns = [
        (hashes % np.uint64(WORDS)).astype(np.int64),
        WORDS + np.array(shapes)[which],
        WORDS + SHAPES + np.minimum(ends - starts, 31),
    ]
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])])
    columns.append(np.where(same, WORDS + SHAPES + 32, WORDS + SHAPES + 33))
    for column in columns:
        flat += np.bincount(doc * TERMS + column, minlength=len(flat)).astype(np.float32)
    closes = data[np.minimum(ends, len(data) - 1)] == 10
    last = np.flatnonzero(closes | np.concatenate([doc[1:] != doc[:-1], [True]]))
    words = np.diff(np.concatenate([[-1], last]))
    line = WORDS + SHAPES + 40 + np.minimum(np.log2(words).astype(np.int64) * 2, 22)
    flat += np.bincount(doc[last] * TERMS + line, minlength=len(flat)).astype(np.float32)
    return out


@dataclass
class Neighbours:
    """Labelled documents as unit vectors in the latent space."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    nearest: int = 25

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.weights) @ self.axes)

    def scores(self, texts: list[bytes], block: int = 512) -> np.ndarray:
        """Of every text, the share of label 1 among its nearest neighbours, weighted by similarity.

        Cosines with all labelled vectors are exact products, a block of texts at a time. A text without
        terms is equally near to all and gets their share.
        """
        out = np.full(len(texts), float(self.labels.mean()))
        for a in range(0, len(texts), block):
            own = self.project(term_counts(texts[a : a + block]))
            cosines = own @ self.vectors.T
            k = min(self.nearest, len(self.labels))
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(float) ** 4
            total = votes.sum(axis=1)
            share = (votes * self.labels[near]).sum(axis=1)
            some = total > 0
            out[a : a + block][some] = share[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit rows of term weights: logarithm of a term's share in its family, times its weight."""
    total = np.maximum(1.0, counts[:, WORDS : WORDS + SHAPES].sum(axis=1, keepdims=True))
    rows = np.log1p(counts * (100.0 / total)) * weights
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0).astype(np.float32)


def counted_sample(rows: DataFrame) -> DataFrame:
    """(doc_id, label, raw): term counts of a bounded sample `rows(doc_id, text, label)`, written."""

    def work(batch):
        raw = pa.array([c.tobytes() for c in term_counts(text_bytes(batch.column("text")))], pa.binary())
        columns = [batch.column("doc_id"), batch.column("label"), raw]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "raw"])

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    kind = rows.schema["label"].dataType.simpleString()
    return written(map_slices(rows, "text", work, f"doc_id long, label {kind}, raw binary"), "counts")


def _blocks(batches, size: int = 512):
    """Batches in slices of at most `size` rows, each with its matrix of term counts."""
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            part = batch.slice(k, size)
            yield part, np.frombuffer(b"".join(part.column("raw").to_pylist()), dtype=np.float32).reshape(-1, TERMS)


def term_weights(counted: DataFrame, words: float) -> np.ndarray:
    """Inverse document frequencies, summed in the tasks; hashed words count `words` times as much as forms."""

    def work(batches):
        seen = np.zeros(TERMS + 1, dtype=np.int64)
        for _, counts in _blocks(batches):
            seen[:TERMS] += (counts > 0).sum(axis=0)
            seen[TERMS] += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(seen)], names=["term", "n"])

    sums = counted.select("raw").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    seen = np.zeros(TERMS + 1)
    for r in sums.collect():  # TERMS rows, whatever the sample
        seen[r["term"]] = r["n"]
    seen, n = seen[:TERMS], seen[TERMS]
    weights = np.where(seen > 0, np.log((1 + n) / (1 + seen)) + 0.3, 0).astype(np.float32)
    weights[:WORDS] *= words
    return weights


def gram_matrix(counted: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Products of all pairs of weighted terms, summed over the sample: a matrix in each task, added up by
    rows in others, so that the driver holds one matrix, whatever the sample."""

    def partial(batches):
        total = None
        for _, counts in _blocks(batches):
            rows = weighted(counts, weights)
            total = rows.T @ rows if total is None else np.add(total, rows.T @ rows, out=total)
        for k in range(0, TERMS if total is not None else 0, 128):
            terms = np.arange(k, min(k + 128, TERMS))
            raw = pa.array([total[t, t:].tobytes() for t in terms], pa.binary())  # the other half is the same
            yield pa.RecordBatch.from_arrays([pa.array(terms), raw], names=["term", "products"])

    def summed(batches):
        term, total = None, None
        for batch in batches:
            for t, raw in zip(batch.column("term").to_pylist(), batch.column("products").to_pylist()):
                if t != term:
                    if total is not None:
                        yield _row(term, total)
                    term, total = t, np.zeros(TERMS - t)
                total += np.frombuffer(raw, dtype=np.float32)
        if total is not None:
            yield _row(term, total)

    def _row(term, total):
        raw = pa.array([total.astype(np.float32).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([term], pa.int64()), raw], names=["term", "products"])

    schema = "term long, products binary"
    # The sample is bounded, so a few tasks do, however many files or partitions it comes in.
    parts = counted.select("raw").coalesce(MATRICES).mapInArrow(partial, schema)
    rows = parts.repartition("term").sortWithinPartitions("term").mapInArrow(summed, schema)
    out = np.zeros((TERMS, TERMS), dtype=np.float32)
    for r in written(rows, "products").toLocalIterator():  # a part at a time
        t = r["term"]
        out[t, t:] = out[t:, t] = np.frombuffer(r["products"], dtype=np.float32)
    return out


def latent_axes(products: np.ndarray, axes: int, most: int = 200, close: float = 1e-4) -> np.ndarray:
    """The `axes` leading eigenvectors of a Gram matrix, by subspace iteration until they stand still.

    Some more directions than asked for are carried along, which the leading ones settle in. Unlike a full
    decomposition it needs little more memory than the matrix.
    """
    wide = min(len(products), axes + 32)
    basis = np.linalg.qr(np.random.default_rng(7).normal(size=(len(products), wide)))[0].astype(np.float32)
    before = np.zeros(wide)
    for _ in range(most):
        basis = np.linalg.qr(products @ basis)[0]
        values, turn = np.linalg.eigh((basis.T @ (products @ basis)).astype(np.float64))
        if np.abs(values - before).max() <= close * max(values[-1], 1e-9):
            break
        before = values
    return (basis @ turn[:, ::-1][:, :axes].astype(np.float32)).astype(np.float32)


def sample_vectors(counted: DataFrame, weights: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, list]:
    """Latent vectors (not scaled) and labels of the sample by doc_id; the tasks project the counts."""

    def work(batches):
        for part, counts in _blocks(batches):
            raw = pa.array([v.tobytes() for v in (weighted(counts, weights) @ axes).astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), raw], names=["doc_id", "label", "raw"])

    found = sorted(counted.mapInArrow(work, counted.schema).collect(), key=lambda r: r["doc_id"])
    vectors = [np.frombuffer(r["raw"], dtype=np.float32) for r in found]
    return np.array(vectors, dtype=np.float32).reshape(-1, axes.shape[1]), [r["label"] for r in found]


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 1e-6)


def latent_space(rows: DataFrame, words: float, axes: int):
    """(weights, axes, vectors, labels) of a bounded sample `rows(doc_id, text, label)`; None if it is empty.

    All sums over the sample are made in tasks: the driver gets document frequencies, one Gram matrix of the
    terms (TERMS squared, 28 MB), which it frees again, and the projected vectors.
    """
    counted = counted_sample(rows)
    if counted.isEmpty():
        return None
    weights = term_weights(counted, words)
    directions = latent_axes(gram_matrix(counted, weights), axes)
    return weights, directions, *sample_vectors(counted, weights, directions)


def fit_neighbours(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, axes: int = 48):
    """Neighbours from the labelled documents that are not held out, up to `sample` of each label.

    Term weights are inverse document frequencies in the sample; the latent space has the sample's `axes`
    largest singular directions. Single words tell less about quality than form does and count a fifth.
    None without labelled documents.
    """
    space = latent_space(labelled_sample(docs, labels, "quality", sample or SAMPLE), 0.2, axes)
    if space is None:
        return None
    weights, directions, vectors, truth = space
    return Neighbours(weights, directions, unit(vectors), np.array(truth, dtype=float))


def score_quality(docs: DataFrame, model: Neighbours | None, name: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of every whole text; without a model every score is 0.5.

    A null text is empty; a text without words gets the share of label 1 in the sample. All rows and
    columns are kept; a column of that name is replaced. An empty table gives an empty table.
    """
    rows = docs.drop(name)
    if model is None:
        return rows.withColumn(name, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: about 2 MB

    def work(batch):
        scores = shared.value.scores(text_bytes(batch.column("text")))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return map_slices(rows, "text", work, rows.withColumn(name, F.lit(0.0)).schema)
