"""Removal of long word spans that an earlier document holds, on a compacted de Bruijn graph of windows.

The graph's edges are the windows of `window` consecutive words. Windows are not shuffled one by one. Each
belongs to its anchor, the least k-mer in it; the windows of one anchor in one document form a path without
branches, and paths with the same words are the same path of the graph, found with one row. Only where
paths differ are their edges compared. What is repeated is joined to long spans, which are verified at
their coordinates in the source document before words go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domainlake.llm.common import map_slices, mix, spans_hash, text_bytes, word_hashes, words_of
from domainlake.session import written

KMER = 16
# Joins by a word sequence or a document are merge joins: adaptive execution splits their hot keys.
#: Low bits of an anchor's number; no text that fits into a row has as many words.
_POSITION = np.uint64((1 << 32) - 1)
_EDGE_BASE, _KMER_BASE, _PATH_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


class Words:
    """The words of some texts with their hashes; windows that cross texts are left out."""

    def __init__(self, texts: list[bytes]):
        self.data, self.starts, self.ends, self.first = words_of(texts)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def paths(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First windows of all paths, how many windows each has, and the k-mer hash of its anchor."""
        n, k = len(self.hashes), min(KMER, window)
        none = np.zeros(0, dtype=np.int64)
        if n < window:
            return none, none, none.astype(np.uint64)
        at = np.arange(n - k + 1)
        kmers = spans_hash(self.hashes, at, at + k, _KMER_BASE)
        # The least k-mer of every window, the first of equal ones: position in the low bits.
        least = (kmers & ~_POSITION) | at.astype(np.uint64)
        size, width = 1, window - k + 1
        while size < width:
            step = min(size, width - size)
            least = np.minimum(least[: len(least) - step], least[step:])
            size += step
        windows = np.arange(n - window + 1)
        windows = windows[self.doc[windows] == self.doc[windows + window - 1]]
        if not len(windows):
            return none, none, none.astype(np.uint64)
        anchor = (least[windows] & _POSITION).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(windows) != 1)]))
        counts = np.diff(np.append(new, len(windows)))
        return windows[new], counts, kmers[anchor[new]]

    def joined(self, k: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text k, or those that `keep` marks, joined by one space."""
        own = slice(self.first[k], self.first[k + 1])
        starts, ends = self.starts[own], self.ends[own]
        if not len(starts):
            return b""
        at = starts[0]
        raw = self.data[at : ends[-1]].tobytes()
        if keep is not None:
            starts, ends = starts[keep], ends[keep]
        return b" ".join([raw[a:b] for a, b in zip((starts - at).tolist(), (ends - at).tolist())])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _lists(values: np.ndarray, owner: np.ndarray, count: int) -> pa.Array:
    """Values by owner (ascending) as one list for each of `count` rows."""
    offsets = np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def _counted(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, uid, n_words, digest, anchors) of every row: the different anchors' hashes."""

    def work(batch):
        texts = text_bytes(batch.column("text"))
        words = Words(texts)
        first, _, kmers = words.paths(window)
        pairs = np.unique(np.stack([words.doc[first].astype(np.uint64), kmers]), axis=1)
        digests = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
        columns = [batch.column("doc_id"), batch.column("uid"), pa.array(np.diff(words.first)), pa.array(digests)]
        columns.append(_lists(_signed(pairs[1]), pairs[0].astype(np.int64), len(texts)))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "n_words", "digest", "anchors"])

    schema = "doc_id long, uid long, n_words long, digest string, anchors array<long>"
    return map_slices(rows, "text", work, schema)


def _packed(rows: DataFrame) -> DataFrame:
    """(doc_id, uid, z): texts compressed, for a smaller shuffle."""

    def work(batch):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        z = pa.array([squeeze(t) for t in text_bytes(batch.column("text"))], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), z], names=["doc_id", "uid", "z"])

    return map_slices(rows, "text", work, "doc_id long, uid long, z binary")


def _unpacked(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(z) for z in column.to_pylist()]


def _over_texts(texts: DataFrame, asked: DataFrame, column: str, work, schema: str) -> DataFrame:
    """Apply `work(words, k, doc_id, uid, asked values)` to every text that something is asked of.

    `asked(doc_id, uid, column)` is gathered by text; it yields a list of rows for the schema.
    """
    gathered = asked.groupBy("doc_id", "uid").agg(F.collect_set(column).alias("asked"))
    rows = texts.select("doc_id", "uid", "z").join(gathered.hint("merge"), ["doc_id", "uid"])
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batch):
        words = Words(_unpacked(batch.column("z")))
        ids, uids, wanted = (batch.column(c).to_pylist() for c in ("doc_id", "uid", "asked"))
        out = [r for k in range(len(ids)) for r in work(words, k, ids[k], uids[k], wanted[k])]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    return map_slices(rows, "z", run, schema, 1 << 20)


def _paths(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, uid, start, count, path): paths with a repeated anchor, path being the hash of the words."""

    def work(batch):
        words = Words(_unpacked(batch.column("z")))
        first, counts, kmers = words.paths(window)
        anchors = batch.column("anchors")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(anchors.offsets.to_numpy()))
        known = anchors.flatten().to_numpy().view(np.uint64)
        doc = words.doc[first]
        # Anchor and document in one number, to look all up at once; a clash only adds work.
        asked, given = (mix(h + d.astype(np.uint64)) for h, d in ((kmers, doc), (known, owner)))
        there = np.isin(asked, given)
        first, counts, doc = first[there], counts[there], doc[there]
        path = spans_hash(words.hashes, first, first + counts + window - 1, _PATH_BASE)
        columns = [batch.column(c).take(pa.array(doc)) for c in ("doc_id", "uid")]
        columns += [pa.array((first - words.first[doc]).astype(np.int32)), pa.array(counts.astype(np.int32)), _signed(path)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "start", "count", "path"])

    return map_slices(texts, "z", work, "doc_id long, uid long, start int, count int, path long", 1 << 20)


def _edges(texts: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """(doc_id, uid, start, edge): every window of the given paths, edge being the hash of its words."""
    schema = "doc_id long, uid long, start int, edge long"
    gathered = paths.groupBy("doc_id", "uid").agg(F.collect_set(F.struct("start", "count")).alias("asked"))
    rows = texts.select("doc_id", "uid", "z").join(gathered.hint("merge"), ["doc_id", "uid"])

    def work(batch):
        words = Words(_unpacked(batch.column("z")))
        asked = batch.column("asked")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
        start, count = (x.to_numpy().astype(np.int64) for x in asked.flatten().flatten())
        doc = np.repeat(owner, count)
        at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        place = at + words.first[doc]
        edge = spans_hash(words.hashes, place, place + window, _EDGE_BASE)
        columns = [batch.column(c).take(pa.array(doc)) for c in ("doc_id", "uid")]
        columns += [pa.array(at.astype(np.int32)), _signed(edge)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "start", "edge"])

    return map_slices(rows, "z", work, schema, 1 << 20)


def _repeats(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, uid, a, b, src_id, src_uid, src_a): stretches of words that a smaller doc_id holds too."""
    paths = written(_paths(texts, window), "paths")
    place = F.struct("doc_id", "uid", "start")
    # Written, so that the join is one of two exchanges: only then does adaptive execution split a hot path.
    source = written(paths.groupBy("path").agg(F.min(place).alias("src")), "first-paths")
    joined = paths.join(source.hint("merge"), "path")
    whole = joined.where("doc_id > src.doc_id").select(
        "doc_id", "uid", F.col("start").alias("a"), (F.col("start") + F.col("count") + window - 1).alias("b"), "src"
    )
    first = joined.where("doc_id = src.doc_id").select("doc_id", "uid", "start", "count")
    edges = written(_edges(texts, first, window), "edges")
    least = edges.groupBy("edge").agg(F.min(place).alias("src"), F.max("doc_id").alias("last")).where("last > src.doc_id")
    least = written(least, "first-edges")
    parts = (
        edges.join(least.hint("merge"), "edge")
        .where("doc_id > src.doc_id")
        .select("doc_id", "uid", F.col("start").alias("a"), (F.col("start") + window).alias("b"), "src")
    )
    return whole.union(parts).select(
        "doc_id", "uid", "a", "b", F.col("src.doc_id").alias("src_id"), F.col("src.uid").alias("src_uid"),
        F.col("src.start").alias("src_a"),
    )


def _long_spans(repeats: DataFrame) -> DataFrame:
    """Stretches that continue each other in both documents, joined to one span each."""
    line = ["doc_id", "uid", "src_id", "src_uid", "diagonal"]
    order = Window.partitionBy(*line).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = repeats.withColumn("diagonal", F.col("a") - F.col("src_a")).withColumn(
        "new", F.when(F.col("a") <= before, 0).otherwise(1)
    )
    rows = rows.withColumn("span", F.sum("new").over(order))
    return (
        rows.groupBy(*line, "span")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .select("doc_id", "uid", "a", "b", "src_id", "src_uid", (F.col("a") - F.col("diagonal")).alias("src_a"))
    )


def _verified(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans whose words are the same at both coordinates."""
    spans = spans.withColumn("src_b", F.col("src_a") + F.col("b") - F.col("a"))
    there = spans.select(F.col("src_id").alias("doc_id"), F.col("src_uid").alias("uid"), F.col("src_a").alias("a"), F.col("src_b").alias("b"))
    asked = spans.select("doc_id", "uid", "a", "b").union(there).select("doc_id", "uid", F.struct("a", "b").alias("s"))

    def work(words, k, doc_id, uid, asked):
        base = int(words.first[k])
        raw, starts, ends = words.data, words.starts, words.ends
        for s in asked:
            text = raw[starts[base + s["a"]] : ends[base + s["b"] - 1]].tobytes()
            yield doc_id, uid, s["a"], s["b"], hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()

    schema = "doc_id long, uid long, a long, b long, words binary"
    found = written(_over_texts(texts, asked, "s", work, schema), "span-words")
    source = found.select(
        F.col("doc_id").alias("src_id"), F.col("uid").alias("src_uid"), F.col("a").alias("src_a"),
        F.col("b").alias("src_b"), F.col("words").alias("src_words"),
    )
    return (
        spans.join(found.hint("merge"), ["doc_id", "uid", "a", "b"])
        .join(source.hint("merge"), ["src_id", "src_uid", "src_a", "src_b"])
        .where("words = src_words")
        .select("doc_id", "uid", "a", "b")
    )


def _kept(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, uid, n_removed, kept): how many words go, and the others joined by one space."""

    def work(words, k, doc_id, uid, asked):
        keep = np.ones(words.first[k + 1] - words.first[k], dtype=bool)
        for s in asked:
            keep[s["a"] : s["b"]] = False
        yield doc_id, uid, int((~keep).sum()), words.joined(k, keep).decode("utf-8", "replace")

    asked = spans.select("doc_id", "uid", F.struct("a", "b").alias("s"))
    return _over_texts(texts, asked, "s", work, "doc_id long, uid long, n_removed long, kept string")


def remove_repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of every row of `docs(doc_id, text)`.

    A word goes if a window of `window` words over it also starts in a document with a smaller doc_id;
    windows are judged on the input. kept is the text of the other words, joined by one space, where some
    went, else null; kept_sha256 covers the kept words of every row. A null text has no words. Rows with
    equal doc_id are documents of their own, none smaller than another; a null doc_id is neither smaller
    nor larger than any, so nothing goes from it or because of it. An empty table gives an empty table;
    other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", F.xxhash64("text"))
    counted = written(_counted(rows, window), "anchors")
    anchors = counted.where("doc_id is not null").select("doc_id", "uid", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = shared.where("least < most").select("anchor")
    marked = anchors.join(shared.hint("merge"), "anchor").groupBy("doc_id", "uid")
    marked = marked.agg(F.collect_set("anchor").alias("anchors"))
    texts = written(_packed(rows.where("doc_id is not null")).join(marked.hint("merge"), ["doc_id", "uid"]), "texts")
    spans = written(_long_spans(_repeats(texts, window)), "spans")
    kept = _kept(texts, _verified(texts, spans)).dropDuplicates(["doc_id", "uid"])
    all_rows = counted.select("doc_id", "uid", "n_words", "digest")
    return all_rows.join(kept.hint("merge"), ["doc_id", "uid"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        "kept",
        F.coalesce(F.sha2("kept", 256), "digest").alias("kept_sha256"),
    )
