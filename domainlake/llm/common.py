"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multiplier of the rolling hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id as text is divisible by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def pieces(batches: Iterable[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `size` bytes of `column`, or of one row, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        begin, total = 0, 0
        for end, n in enumerate(lengths.tolist()):
            if total and total + n > size:
                yield batch.slice(begin, end - begin)
                begin, total = end, 0
            total += n + 16
        yield batch.slice(begin)


def give_back() -> None:
    """Return a worker's free memory to the machine: workers outlive their task and serve other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


#: What workers keep between tasks, by the kind of work that it serves.
_REMEMBERED: dict[str, tuple[dict, ...]] = {}


def remembered(kind: str, *stores: dict) -> None:
    """These dictionaries of a module are kept between tasks of one kind of work only."""
    _REMEMBERED[kind] = stores


def forget_others(kind: str | None) -> None:
    """Empty what this worker keeps for other kinds of work: workers outlive their stage."""
    others = [s for k, stores in _REMEMBERED.items() if k != kind for s in stores if s]
    for store in others:
        store.clear()
    if others:
        give_back()


def map_slices(
    df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, size: int = 2 << 20,
    tidy: bool = False, kind: str | None = None,
) -> DataFrame:
    """Apply `work` to bounded slices of `df`; `column` is the one with the long texts.

    With `tidy` a task gives its worker's free memory back at its end. A worker forgets at its beginning what
    is `remembered` for another `kind` of work.
    """

    def run(batches):
        forget_others(kind)
        for piece in pieces(batches, column, size):
            out = work(piece)
            if out is not None and out.num_rows:
                yield out
        if tidy:
            give_back()

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def cached_powers(n: int, base: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(max(n, 1 << 16), base)
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing of every value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of every span [start, end) of 64-bit values: equal spans have equal hashes."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * cached_powers(len(values), base), out=sums[1:])
    inverse = cached_powers(len(values) + 1, pow(base, -1, 1 << 64))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Hash of every word of UTF-8 bytes, some words at a time so that memory stays near the text's."""
    out = np.empty(len(starts), dtype=np.uint64)
    for a in range(0, len(starts), step):
        own, begin = slice(a, a + step), starts[a]
        part = data[begin : ends[own][-1]]
        out[own] = spans_hash(BYTE_CODES[part], starts[own] - begin, ends[own] - begin)
    return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts: joined bytes, word starts, word ends, and the first word of each text.

    The last array has one entry more than there are texts.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts, ends = word_spans(data)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return data, starts, ends, first


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], extra: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, text, *extra, label) of up to `most[value]` documents for each label value, by a hash of the id.

    Held-out ids are left out, and so are null labels and ids with two labels; of documents with equal
    doc_id the one with the smallest text is taken. The result is bounded by `most` whatever the tables' sizes.
    """
    rows = (
        labels.where(~held_out("doc_id") & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other")
    )
    taken = [
        rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "label")
        for value, n in most.items()
    ]
    chosen = taken[0]
    for part in taken[1:]:
        chosen = chosen.union(part)
    # The ids are bounded by `most`, 16 bytes each, so they go to every task.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra).join(F.broadcast(chosen), "doc_id")
    least = F.min(F.struct("text", *extra)).alias("least")
    return rows.groupBy("doc_id", "label").agg(least).select("doc_id", "label", "least.*")


def logistic_scale(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) of the sigmoid 1 / (1 + exp(-(a * margin + b))) that fits the labels best, by Newton steps."""
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    w = np.array([1.0, 0.0])
    positive, negative = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + 1e-3 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(curve, slope)
    return float(w[0]), float(w[1])
