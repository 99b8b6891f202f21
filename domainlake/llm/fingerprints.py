"""Document fingerprints by order MinHash, which react to moved text as well as to changed text."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domainlake.llm.common import mix, word_hashes, word_spans

#: Hash functions, words in a k-mer, and k-mers in a tuple.
FUNCTIONS, KMER, TUPLE = 64, 2, 2
_SEEDS = mix(np.arange(1, 2 * FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_MULTIPLIERS, _SHIFTS = _SEEDS[:FUNCTIONS] | np.uint64(1), _SEEDS[FUNCTIONS:]
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def kmer_hashes(text: bytes) -> np.ndarray:
    """Hash of every occurrence-numbered k-mer of words, in text order.

    The i-th occurrence of a k-mer has a hash of its own, so that repeats count. A text of fewer words
    has one k-mer, all its words; a text without words has none.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    words = word_hashes(data, starts, ends)
    k = min(KMER, len(words))
    hashes = mix(sum(words[i : len(words) - k + 1 + i] * _SEEDS[i] for i in range(k)))
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.arange(len(order))
    number = np.empty(len(order), dtype=np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return mix(hashes + number * _SEEDS[KMER])


def order_minhash(text: bytes) -> np.ndarray:
    """FUNCTIONS 16-bit hashes of the tuples of least k-mers, each tuple in text order.

    Equal texts have equal signatures; a text without words has zeros only, a text with fewer k-mers than
    a tuple takes repeats its last. Memory is bounded by the text and one hash function.
    """
    hashes = kmer_hashes(text)
    n = len(hashes)
    if not n:
        return np.zeros(FUNCTIONS, dtype=np.uint16)
    at_once = max(1, min(FUNCTIONS, (1 << 19) // n))
    least = np.empty((FUNCTIONS, TUPLE), dtype=np.int64)
    for a in range(0, FUNCTIONS, at_once):
        b = min(FUNCTIONS, a + at_once)
        values = (hashes ^ _SHIFTS[a:b, None]) * _MULTIPLIERS[a:b, None]
        rows = np.arange(b - a)
        for j in range(min(TUPLE, n)):
            least[a:b, j] = values.argmin(axis=1)
            values[rows, least[a:b, j]] = _MOST
    for j in range(n, TUPLE):
        least[:, j] = least[:, j - 1]
    least.sort(axis=1)  # text order
    out = np.zeros(FUNCTIONS, dtype=np.uint64)
    for j in range(TUPLE):
        out = mix(out * np.uint64(31) + hashes[least[:, j]])
    return (out >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of hash functions on which two signatures agree."""
    return float((a == b).mean())


def signature_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by as many characters from the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _with_followers(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (key, doc_id, text, bucket, tail) such that each bucket, sorted, holds consecutive documents
    and, as tail, the first document of the next bucket (of the first, after the last)."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select("key").repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("p"))
    heads = np.sort(np.array([r["k"] for r in ranges.agg(F.min("key").alias("k")).collect()], dtype=np.int64))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def buckets(keys: pd.Series) -> pd.Series:
        own = np.searchsorted(heads, keys.to_numpy(), side="right") - 1
        head = heads[own] == keys.to_numpy()
        return pd.Series([[b, -1 - (b - 1) % len(heads)] if h else [b] for b, h in zip(own.tolist(), head)])

    rows = rows.withColumn("at", F.explode(buckets("key"))) if len(heads) else rows.withColumn("at", F.lit(0))
    tail = F.col("at") < 0
    return rows.select(
        "key", "doc_id", "text", F.when(tail, -1 - F.col("at")).otherwise(F.col("at")).alias("bucket"), tail.alias("tail")
    ), max(1, len(heads))


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of `docs(doc_id, text)` and of its edited text.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): the edited
    text takes its last half from the start of the next document by ascending doc_id; after the last comes
    the first. near_edited and near_next are the likeness of the fingerprint to the edited text's and to
    the next document's. A null text is empty; null doc_ids (as the least) and equal ones come in the
    order of their texts. A single document follows itself; an empty table gives an empty table; other
    columns are ignored. Documents are dealt by ranges of doc_id and read in order, two at a time.
    """
    rows, count = _with_followers(docs)
    ordered = rows.repartitionById(count, F.col("bucket")).sortWithinPartitions("bucket", "tail", "key", "text")

    def work(batches):
        held, ended = None, False
        for batch in batches:
            out = []
            ids, tails = batch.column("doc_id").to_pylist(), batch.column("tail").to_pylist()
            for doc_id, text, tail in zip(ids, batch.column("text"), tails):
                if ended:  # further rows with the id of the next bucket's first
                    break
                text = text.as_py()
                own = order_minhash(text.encode())
                if held is not None:
                    out.append(_result(*held, text, own))
                held, ended = (doc_id, text, own), tail
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names=names
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(rows.schema["doc_id"].dataType), pa.int64()] + [pa.string()] * 3 + [pa.float64()] * 2
    return ordered.select("doc_id", "text", "tail").mapInArrow(
        work,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _result(doc_id, text, own, following, following_print):
    changed = edited(text, following)
    other = order_minhash(changed.encode()) if changed != text else own
    digest = hashlib.sha256(changed.encode()).hexdigest()
    prints = signature_text(own), signature_text(other)
    return doc_id, len(text), digest, *prints, likeness(own, other), likeness(own, following_print)
