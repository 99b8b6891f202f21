import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from domainlake.operators import behaviour as B
from domainlake.operators import corpus, kpis, ranking

START = datetime(2024, 1, 1)


def make_log(spark, n=3000, seed=1):
    """A third of all queries come from one client and hit one base domain; ties included."""
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 250_000, 999_999, 1_000_000, 5_000_000])
        hot = rng.random() < 0.34
        client = "hot" if hot else f"c{rng.randrange(20)}"
        base = "big.com" if hot else f"b{rng.randrange(15)}.org"
        domain = base if rng.random() < 0.2 else f"s{rng.randrange(80)}.x.{base}"
        rows.append((i, START + timedelta(microseconds=at), client, domain, f"ip{rng.randrange(9)}"))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(
        rows, "id long, ts timestamp, client_ip string, domain string, ip string"
    )


@pytest.mark.parametrize("seconds", [1.0, 3.0, 600.0])
def test_rate_limit_equals_counting(spark, seconds):
    rows, log = make_log(spark)
    got = {r["id"]: r["recent"] for r in B.rate_limit_flags(log, seconds, 3).collect()}
    assert len(got) == len(rows)
    per_client = defaultdict(list)
    for i, ts, client, *_ in rows:
        per_client[client].append(ts)
    for i, ts, client, *_ in rows:
        low = ts - timedelta(seconds=seconds)
        assert got[i] == sum(low <= t <= ts for t in per_client[client]), i


def test_one_client_with_all_queries_uses_many_tasks(spark):
    log = spark.range(0, 40_000, 1, 4).select(
        "id", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 10).alias("ts"), F.lit("only").alias("client_ip")
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        width = 1000
        timed = log.withColumn("_t", B.micros())
        marks = B._arrivals_and_departures(timed, width).repartitionByRange("client_ip", "at")
        sizes = [r["count"] for r in marks.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 3 * 80_000 / 16
        got = B.rate_limit_flags(log, width / 1e6, 100)
        assert got.filter(F.col("recent") != F.least(F.col("id") + 1, F.lit(width // 10 + 1))).count() == 0
        assert got.count() == 40_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("limit", [50, 1_000, 10_000])
def test_crossings_at_any_limit_pass_on_bounded_heaps(spark, limit):
    """Four tasks read one base with all labels; each passes on one row with limit + 1 sightings at most."""
    n = 24_000
    events = spark.range(0, n, 1, 4).select(
        (F.col("id") * 7919 % n).alias("id"), F.lit(START).alias("ts"), F.lit("hot").alias("key"), F.col("id").cast("string").alias("member")
    )
    (row,) = B.crossing_points(events, "key", "member", limit).collect()
    assert (row["key"], row["crossing"]["id"]) == ("hot", limit)
    plan = B.crossing_points(events, "key", "member", limit)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("collect_top_k") >= 2


@pytest.mark.parametrize("n", [50, 1_000, 10_000])
def test_first_rows_of_a_hot_group(spark, n):
    df = spark.range(0, 30_000, 1, 5).select("id", F.when(F.col("id") % 3 > 0, "hot").alias("source"))
    got = ranking.first_n_per_group(df, ["source"], [(-F.col("id")).alias("newest")], n, ["id"])
    groups = {r["source"]: (r["n"], r["least"]) for r in got.groupBy("source").agg(F.count("*").alias("n"), F.min("id").alias("least")).collect()}
    assert groups["hot"] == (n, 30_000 - n // 2 * 3 + 1) and groups[None][0] == n


def test_stored_sketches_merge_to_the_bases(spark):
    rows, log = make_log(spark)
    days = [B.base_sketches(log.filter(F.col("id") % 3 == k)) for k in range(3)]
    merged = B.bases_from_sketches(days[0].unionByName(days[1]).unionByName(days[2]), 10)
    exact = {r["base"]: r for r in B.shadowing_bases(log, 10).collect()}
    for r in merged.collect():
        want = exact[r["base"]]
        assert r["requests"] == want["requests"] and abs(r["sub_labels"] - want["sub_labels"]) <= 2
        assert abs(r["clients"] - want["clients"]) <= 1
    assert merged.count() == len(exact)
    plan = B.shadowing_bases(log, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def running_sets(rows, key, member, limit):
    seen, flags = defaultdict(set), {}
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        k = key(row)
        if k is not None:
            seen[k].add(member(row))
        flags[row[0]] = k is not None and len(seen[k]) > limit
    return flags


def base_of(row):
    labels = row[3].split(".")
    return ".".join(labels[-2:]) if len(labels) >= 3 else None


def test_shadowing_equals_running_sets(spark):
    rows, log = make_log(spark)
    got = {r["id"]: r["shadowing"] for r in B.shadowing_flags(log, 10).collect()}
    want = running_sets(rows, base_of, lambda r: r[3].split(".")[0], 10)
    assert got == want and any(want.values()) and not all(want.values())


def test_fast_flux_equals_running_sets(spark):
    rows, log = make_log(spark)
    got = {r["id"]: r["fast_flux"] for r in B.fast_flux_flags(log, 3).collect()}
    want = running_sets(rows, lambda r: r[3], lambda r: r[4], 3)
    assert got == want and any(want.values())


def test_flags_do_not_depend_on_partitioning(spark):
    _, log = make_log(spark)
    first = sorted(map(tuple, B.shadowing_flags(log.repartition(1), 10).collect()))
    assert sorted(map(tuple, B.shadowing_flags(log.repartition(7, "ip"), 10).collect())) == first


def test_rate_limited_queries_feed_no_state(spark):
    rows = [(i, START + timedelta(milliseconds=i), "c", f"s{i}.x.base.com") for i in range(10)]
    log = spark.createDataFrame(rows, "id long, ts timestamp, client_ip string, domain string")
    none = spark.createDataFrame([], "id long, ts timestamp, domain string, ip string, ttl int")
    out = B.behaviour_join(log, none, seconds=1.0, rate_limit=4, shadow_limit=3)
    assert sorted((r["id"], r["shadowing"]) for r in out.collect()) == [
        (0, False), (1, False), (2, False), (3, True)
    ]


def test_shadowing_bases_and_profiles(spark):
    rows, log = make_log(spark)
    got = {r["base"]: tuple(r)[1:] for r in B.shadowing_bases(log, 10).collect()}
    for base, (labels, requests, clients) in got.items():
        mine = [r for r in rows if base_of(r) == base]
        assert labels == len({r[3].split(".")[0] for r in mine}) > 10
        assert requests == len(mine) and clients == len({r[2] for r in mine})
    profile = B.resolution_profile(log.withColumn("ttl", F.lit(None).cast("int"))).collect()
    assert all(r["min_ttl"] == 60 for r in profile)


def test_seeded_rank_is_exact_and_stable(spark):
    df = spark.range(5000).withColumn("label", F.when(F.col("id") % 5 == 0, 1).otherwise(0))
    out = ranking.seeded_rank(df, ["label"], ["id"]).collect()
    for label, size in ((0, 4000), (1, 1000)):
        ranks = sorted(r["rank"] for r in out if r["label"] == label)
        assert ranks == list(range(1, size + 1))
    again = {
        r["id"]: r["rank"] for r in ranking.seeded_rank(df.repartition(13), ["label"], ["id"]).collect()
    }
    assert again == {r["id"]: r["rank"] for r in out}
    some = ranking.seeded_rank(df, ["label"], ["id"], limit=37).collect()
    assert {(r["id"], r["rank"]) for r in some} == {
        (r["id"], r["rank"]) for r in out if r["rank"] <= 37
    }
    other = {r["id"]: r["rank"] for r in ranking.seeded_rank(df, ["label"], ["id"], seed=7).collect()}
    assert other != again


def test_balanced_sample_and_caps(spark):
    df = spark.range(2000).selectExpr(
        "id", "concat('d', id, '.com') as domain", "int(id % 4 = 0) as label",
        "if(id < 1500, 'big', 'small') as source",
    )
    sizes = {r["label"]: r["count"] for r in corpus.balance_classes(df).groupBy("label").count().collect()}
    assert sizes == {0: 500, 1: 500}
    assert corpus.sample_n(df, 123).count() == 123
    assert corpus.sample_n(df, 10_000).count() == 2000
    capped = corpus.cap_per_source(df, 600)
    ids = sorted(r["id"] for r in capped.collect())
    assert ids == list(range(600)) + list(range(1500, 2000))
    few = corpus.cap_per_source(df, 3)
    assert sorted(r["id"] for r in few.collect()) == [0, 1, 2, 1500, 1501, 1502]
    folds = {r["fold"]: r["count"] for r in corpus.stratified_folds(df).groupBy("fold").count().collect()}
    assert folds == dict.fromkeys(range(5), 400)


def test_clean_corpus_keeps_the_first_row(spark):
    rows = [(3, " A.com", 1), (1, "a.COM ", 0), (2, None, 0), (4, "ab", 0), (5, ".c", 1), (6, "nodot", 1), (7, "b.c", 1)]
    out = corpus.clean_corpus(spark.createDataFrame(rows, "id int, domain string, label int"))
    assert sorted(map(tuple, out.collect())) == [(1, "a.com", 0), (7, "b.c", 1)]


LOG = "id long, ts timestamp, client_ip string, domain string, blocked boolean, threat_type string, threat_score double"


def test_queries_without_a_timestamp_are_kept(spark):
    rows = [(i, None if i % 2 else START, "c", "a.b.com") for i in range(80)]
    log = spark.createDataFrame(rows, "id long, ts timestamp, client_ip string, domain string")
    got = {r["id"]: (r["recent"], r["rate_limited"]) for r in B.rate_limit_flags(log, limit=30).collect()}
    assert got == {i: (0, False) if i % 2 else (40, True) for i in range(80)}


def test_kpis_on_an_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    assert kpis.block_rate(empty).first()["block_rate"] == 0.0
    assert kpis.kpi_stats(empty, empty.select("id")).first()["total"] == 0
    assert kpis.timeline_recent(empty).count() == 0
    assert {r["n"] for r in kpis.engine_share(empty).collect()} == {0}


def test_newest_rows_break_ties_by_id(spark):
    rows = [(i, START, "c", "d", i % 2 == 0, "DGA", float(i)) for i in range(10)]
    log = spark.createDataFrame(rows, LOG)
    assert [r["id"] for r in kpis.latest(log, 3).collect()] == [9, 8, 7]
    page = kpis.paged_log(log, 2, size=4).collect()
    assert [r["id"] for r in page] == [5, 4, 3, 2] and page[0]["total_pages"] == 3
    after = kpis.paged_log_after(log, str(START), 6, size=4).collect()
    assert [r["id"] for r in after] == [5, 4, 3, 2]


def test_query_rate_crosses_midnight(spark):
    minutes = [0, 1, 1, 24 * 60 - 1, 24 * 60 + 1, 24 * 60 + 1, 3 * 24 * 60]
    rows = [(i, START + timedelta(minutes=m), "c", "d", False, "None", 0.0) for i, m in enumerate(minutes)]
    got = kpis.query_rate(spark.createDataFrame(rows, LOG)).orderBy("minute").collect()
    assert [(r["total"], r["minutes"], r["per_minute"]) for r in got] == [
        (2, 1.0, 2), (1, 1438.0, 0), (2, 2.0, 1), (1, 2879.0, 0)
    ]
