"""Pairs that share several keys, and rounds over few links."""

import zstandard
from pyspark.sql import functions as F

from domainlake.llm.components import connected_components
from domainlake.llm.minhash import confirmed_links, shingle_sets, signatures


def test_pair_of_several_keys_is_confirmed_once(spark):
    texts = [" ".join(f"w{k}" for k in range(100)).encode(), " ".join(f"w{k}" for k in range(101)).encode()]
    sig = signatures(*shingle_sets(texts, 3))
    z = [zstandard.ZstdCompressor().compress(t) for t in texts]
    rows = [(v, 7, 0, 0, k, k, k, bytearray(sig[k].tobytes()), bytearray(z[k])) for v in range(64) for k in (0, 1)]
    kinds = "v byte, key long, i long, j long, side int, cls long, comp long, sig binary, z binary"
    assert [tuple(r) for r in confirmed_links(spark.createDataFrame(rows, kinds), 3, 85, 23).collect()] == [(1, 0)]


def test_star_is_confirmed_whatever_keys_are_shared(spark):
    texts = [" ".join(f"w{k}" for k in range(100)).encode(), " ".join(f"w{k}" for k in range(101)).encode()]
    sig = signatures(*shingle_sets(texts, 3))
    z = [zstandard.ZstdCompressor().compress(t) for t in texts]
    rows = [(-1, 0, 0, 0, k, k, k, bytearray(sig[k].tobytes()), bytearray(z[k])) for k in (0, 1)]
    kinds = "v byte, key long, i long, j long, side int, cls long, comp long, sig binary, z binary"
    assert [tuple(r) for r in confirmed_links(spark.createDataFrame(rows, kinds), 3, 85, 23).collect()] == [(1, 0)]


def test_few_links_make_few_files(spark):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "20"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = connected_components(spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        assert {(r["node"], r["root"]) for r in found.collect()} == {(k, 0) for k in range(41)}
        assert len(set(found.inputFiles())) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
