"""Packing of tokenised documents into sequences of fixed length, by patterns of few lengths."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domainlake.llm.common import map_slices, remembered, text_bytes
from domainlake.session import written

_TOKENIZERS: dict = {}
_KNOWN: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
_SIZES: dict[str, np.ndarray] = {}
remembered("tokens", _TOKENIZERS, _KNOWN, _SIZES)
#: Bytes that may begin a white-space character beyond ASCII.
_WIDE_SPACE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker; special tokens in a text are ordinary text."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


def _encoded(chunks: list[str], path: str, most: int = 600_000) -> list[bytes]:
    """Ids of every chunk as little-endian 32-bit numbers.

    A worker remembers up to `most` chunks, half of them from the time before the newer half was begun, so
    that frequent ones are never forgotten.
    """
    known, before = _KNOWN.get(path, ({}, {}))
    if len(known) > most // 2:
        known, before = {}, known
    _KNOWN[path] = known, before
    new = []
    for c in {c for c in chunks if c not in known}:
        if c in before:
            known[c] = before[c]
        else:
            new.append(c)
    # A chunk that begins with a space and a word keeps its ids behind any other, so these go in one call;
    # every token stands for a fixed number of bytes, which tells where the chunks end.
    inner = [c for c in new if c[:1] == " " and c[1:2] > " "]
    for k in range(0, len(inner), 4000):
        part = inner[k : k + 4000]
        joined = "".join(part)
        # The batch call keeps no offsets, which saves a fifth of the time.
        ids = np.array(tokenizer(path).encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum(pc.binary_length(pa.array(part, pa.string())).to_numpy(zero_copy_only=False))
        at = 4 * np.searchsorted(np.cumsum(_token_sizes(path)[ids]), ends, side="right")
        raw, last = ids.tobytes(), 0
        for c, end in zip(part, at.tolist()):
            known[c] = raw[last:end]
            last = end
    other = [c for c in new if not (c[:1] == " " and c[1:2] > " ")]
    for c, got in zip(other, tokenizer(path).encode_batch_fast(other, add_special_tokens=False)):
        known[c] = np.array(got.ids, dtype="<u4").tobytes()
    return [known[c] for c in chunks]


def _token_sizes(path: str) -> np.ndarray:
    """Bytes of every token; in a byte-level vocabulary a character stands for a byte."""
    if path not in _SIZES:
        vocabulary = tokenizer(path).get_vocab()
        _SIZES[path] = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            _SIZES[path][k] = len(token)
    return _SIZES[path]


def token_ids(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text begins in them (one entry more than texts).

    Byte-level BPE never joins a space before a word to what stands in front of it, so texts are cut
    there, and each different chunk is encoded once.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    begin = np.concatenate([[0], ends])
    ahead = np.append(data[1:], 0).astype(np.uint8)
    cuts = np.zeros(len(data) + 1, dtype=bool)
    cuts[:-1] = (data == 32) & (ahead > 32) & ~_WIDE_SPACE[ahead]
    cuts[begin] = True
    cuts[len(data)] = True
    bounds = np.flatnonzero(cuts).astype(np.int32)
    if not len(data):
        return np.zeros(0, dtype="<u4"), np.zeros(len(texts) + 1, dtype=np.int64)
    chunks = pa.Array.from_buffers(
        pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    ).dictionary_encode()
    codes = chunks.indices.to_numpy()
    found = _encoded(chunks.dictionary.to_pylist(), path)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    flat = np.frombuffer(b"".join(found), dtype="<u4")
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ns = lengths[codes]
    place = np.concatenate([[0], np.cumsum(ns)])
    at = np.repeat(firsts[codes] - place[:-1], ns) + np.arange(place[-1])
    return flat[at], place[np.searchsorted(bounds, begin)]


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): pieces of at most `capacity` ids of every row.

    A document is its ids and then `end_id`. Longer ones are cut so that only the first piece is shorter.
    """

    def work(batch):
        ids, begin = token_ids(text_bytes(batch.column("text")), path)
        tail = np.array([end_id], dtype="<u4")
        rows: list[tuple[int, int, int, int, int]] = []
        for k in range(batch.num_rows):
            own = np.concatenate([ids[begin[k] : begin[k + 1]], tail])
            cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
            if len(own) <= capacity:
                cuts = [0, len(own)]
            rows += [(k, n, a, b - a, zlib.crc32(own[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        table = np.array(rows, dtype=np.int64).T
        columns = [batch.column("doc_id").take(pa.array(table[0])), pa.array(table[1].astype(np.int32))]
        columns += [pa.array(x) for x in table[2:]]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return map_slices(docs.select("doc_id", "text"), "text", work, schema, 4 << 20, tidy=True, kind="tokens")


def patterns(lengths: np.ndarray, capacity: int, grid: int = 128) -> np.ndarray:
    """Rows of up to three of the given lengths that fill a sequence exactly, padded with zeros.

    The shortest of three is one of `grid` lengths at most, so that the count grows with the capacity.
    """
    there = np.zeros(capacity + 1, dtype=bool)
    there[lengths] = True
    some = np.arange(1, capacity // 2 + 1)
    pairs = np.stack([capacity - some, some, np.zeros_like(some)], axis=1)
    least = np.unique(np.linspace(1, capacity // 3, min(grid, capacity // 3)).astype(int)) if capacity > 2 else []
    triples = [
        np.stack([capacity - c - b, b, np.full_like(b, c)], axis=1)
        for c in least
        for b in [np.arange(c, (capacity - c) // 2 + 1)]
    ]
    rows = np.concatenate([pairs, *triples, [[capacity, 0, 0]]])
    return rows[(there[rows] | (rows == 0)).all(axis=1)]


def fit_repeats(rows: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Nonnegative repeat counts of patterns whose lengths come nearest to the histogram.

    Least squares by accelerated projected gradient steps; every step is linear in the patterns.
    """
    size = len(histogram)
    used = (rows > 0).astype(float)

    def lengths_of(x):
        return np.bincount(rows.ravel(), weights=(used * x[:, None]).ravel(), minlength=size)

    probe = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue, for the step
        probe = (used * lengths_of(probe)[rows]).sum(axis=1)
        scale = np.linalg.norm(probe)
        probe /= scale
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        gap = histogram - lengths_of(y)
        gap[0] = 0
        new = np.maximum(0, y + (used * gap[rows]).sum(axis=1) / (1.05 * scale))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences), best fit with the longest first."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for copies, times in ((each, full), (rest, min(rest, 1))):
                    if copies and times:
                        open_.setdefault(capacity - copies * length, []).append(((length,) * copies, times))
                break
            held, times = open_[room].pop()
            now = min(times, left)
            if times > now:
                open_[room].append((held, times - now))
            if not open_[room]:
                del open_[room]
            open_.setdefault(room - length, []).append(((*held, length), now))
            left -= now
    return [group for groups in open_.values() for group in groups]


def plan(histogram: dict[int, int], capacity: int, rounds: int = 2) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences) that hold every piece of the histogram.

    In each round the patterns' repeat counts are fitted to what is left of the histogram and rounded down;
    the residual is packed by best fit. Time and memory depend on the capacity, not on the documents.
    """
    left = np.zeros(capacity + 1)
    for length, n in histogram.items():
        left[length] = n
    groups: list[tuple[tuple[int, ...], int]] = []
    for _ in range(rounds):
        rows = patterns(np.flatnonzero(left), capacity)
        if not len(rows):
            break
        repeats = fit_repeats(rows, left)
        placed = 0
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k] < 0.9:
                break
            own, each = np.unique(rows[k][rows[k] > 0], return_counts=True)
            n = int(min(repeats[k] + 0.1, (left[own] // each).min()))
            if n > 0:
                left[own] -= n * each
                groups.append((tuple(int(x) for x in rows[k] if x), n))
                placed += n
        if not placed:
            break
    return groups + best_fit({int(k): int(left[k]) for k in np.flatnonzero(left)}, capacity)


def slots(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in groups:
        offset = 0
        for length in lengths:
            out.setdefault(length, []).append((taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + times
            offset += length
        sequence += times
    return {k: np.array(v, dtype=np.int64).T for k, v in out.items()}


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Where every piece of `docs(doc_id, text)` goes: token_pieces with sequence_id and offset.

    A sequence holds at most `capacity` ids, its pieces without gaps from offset 0; sequences are numbered
    from 0. The histogram of piece lengths (at most `capacity` rows) is the only thing the driver sees; the
    plan made from it is broadcast and depends on the capacity alone. Pieces are numbered within their
    length by task and then by the tasks' counts, so a length that most pieces share needs no common task.
    A null text is empty and has one piece, `end_id`. Rows with equal or null doc_id are packed one by
    one; an empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, path, capacity, end_id).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = written(pieces.withColumn("within", F.row_number().over(within)), "pieces")
    counts = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placing = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))

    def work(batches):
        for batch in batches:
            lengths, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows):
                    first, seq, off = placing.value[int(lengths[rows[0]])]
                    at = np.searchsorted(first, rank[rows], side="right") - 1
                    sequence[rows] = seq[at] + rank[rows] - first[at]
                    offset[rows] = off[at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=names)

    rows = ranked.join(counts.select("length", "part", "before"), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank")
    )
    fields = [f for f in rows.schema.fields if f.name != "rank"]
    new = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return rows.mapInArrow(work, T.StructType([*fields, *new]))
