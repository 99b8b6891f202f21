"""Near-duplicate documents by SimHash, found through one-wildcard variants of fingerprint segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domainlake.llm.common import map_slices, text_bytes
from domainlake.llm.components import connected_components
from domainlake.operators.joins import lookup
from domainlake.session import written

BITS = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text: bit b is set if it is set in over half of the hashes of its shingles."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 4096):  # bounded memory for very long texts
        part = hashes[k : k + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, shingle: int = 3, name: str = "fp") -> DataFrame:
    """`docs` with the fingerprint of column `text` as a signed long with the 64 bits."""

    def work(batch):
        prints = [fingerprint(t, shingle) for t in text_bytes(batch.column(text))]
        fps = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*batch.schema.names, name])

    return map_slices(docs, text, work, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]), tidy=True)


def segment_masks(differences: int) -> list[int]:
    """Masks of all one-wildcard variants, as signed longs.

    With differences // 2 + 1 segments, one segment of two fingerprints with at most that many differing
    bits differs by at most one bit, so that the two agree under one of the masks.
    """
    count = differences // 2 + 1
    edges = [BITS * k // count for k in range(count + 1)]
    masks = []
    for a, b in zip(edges, edges[1:]):
        whole = ((1 << b) - 1) ^ ((1 << a) - 1)
        masks += [whole & ~(1 << bit) for bit in range(a, b)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def forest(values: np.ndarray, differences: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the graph of values with at most so many differing bits."""
    links, rest = [], np.unique(values)
    while rest.size > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and rest.size:
            at = stack.pop()
            near = np.bitwise_count(rest ^ at) <= differences
            if near.any():
                found, rest = rest[near], rest[~near]
                links += [(int(at), int(x)) for x in found]
                stack.extend(found)
    return links


def _forests(differences: int):
    """mapInArrow over rows sorted by group (all columns but fp): the forest of each group."""

    def work(batches):
        held_key, held = None, []
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            keys = np.stack([batch.column(c).to_numpy() for c in batch.schema.names if c != "fp"], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            links = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)]):
                if a == b:
                    continue
                key = tuple(keys[a])
                if key != held_key and held:
                    links += forest(np.concatenate(held), differences)
                    held = []
                held_key = key
                held.append(fps[a:b])
            if links:
                yield _link_batch(links)
        if held:
            yield _link_batch(forest(np.concatenate(held), differences))

    return work


def _link_batch(links):
    pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def fingerprint_links(prints: DataFrame, differences: int = 3, block: int = 4096) -> DataFrame:
    """Links (a, b) that join all distinct values of `prints(fp)` within `differences` bits of each other.

    Fingerprints that share a variant are compared. One with more than `block` is cut into blocks, and
    every two blocks are compared in a task of their own, which returns a spanning forest of the links it
    finds instead of all pairs. So no connection is lost and no task holds more than two blocks, however
    many fingerprints share a variant. The variants are shuffled once.
    """
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masks = F.array(*[F.lit(m) for m in segment_masks(differences)])
    # Few bytes make many variants, so the fingerprints are spread over all tasks first.
    variants = prints.repartition(parts, "fp").select("fp", F.posexplode(masks).alias("v", "mask"))
    variants = variants.select("fp", F.col("v").cast("byte"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sharing = F.count("*").over(Window.partitionBy("v", "key"))
    blocks = (
        variants.withColumn("n", sharing)
        .where("n > 1")
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("v", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        .repartition("v", "key", "i", "j")
        .sortWithinPartitions("v", "key", "i", "j")
    )
    return blocks.mapInArrow(_forests(differences), "a long, b long").distinct()


def components(rows: DataFrame, differences: int = 3) -> DataFrame:
    """`rows(doc_id, fp)` with component_id, the smallest doc_id that can be reached over links."""
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = connected_components(fingerprint_links(first.select("fp"), differences))
    first = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    least = first.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    component = first.join(least, "root", "left").select(
        "fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "fp").alias("class")
    )
    return lookup(rows, component, "fp")


def near_duplicate_components(docs: DataFrame, shingle: int = 3, differences: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs(doc_id, text)`.

    A fingerprint is the SimHash of the word shingles of the whole text, repeats included, with ASCII
    letters in lower case. Documents whose fingerprints differ in at most `differences` bits are linked;
    component_id is the smallest doc_id that can be reached over links. A null or empty text has
    fingerprint zero and links like any other. Rows with equal doc_id are separate documents; a null
    doc_id is never the smallest unless a component has no other, and component_id is null then. An empty
    table gives an empty table; other columns are ignored.
    """
    prints = with_fingerprints(docs.select("doc_id", "text"), "text", shingle).drop("text")
    return components(written(prints, "fingerprints"), differences).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, differences: int = 3) -> DataFrame:
    """`docs` with one row of each component of near duplicates, a row with its smallest doc_id.

    Of several rows with that doc_id the one with the smallest fingerprint and text stays (nulls first).
    All columns are returned unchanged, whatever their names.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # no clash with columns added here
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    keyed = written(with_fingerprints(plain, text, shingle, "fp"), "fingerprinted")
    kept = (
        components(keyed.select(F.col(doc_id).alias("doc_id"), "fp"), differences)
        .groupBy("class")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("best"))
        .select(F.col("best.doc_id").alias("kept_id"), F.col("best.fp").alias("kept_fp"))
    )
    rows = keyed.join(kept, (F.col("fp") == F.col("kept_fp")) & F.col(doc_id).eqNullSafe(F.col("kept_id")), "left_semi")
    order = Window.partitionBy(doc_id, "fp").orderBy(text)
    rows = rows.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
