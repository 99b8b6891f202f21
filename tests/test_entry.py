"""The entry without its optional part, and stored settings, pages and files."""

import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from domainlake.operators import kpis, scoring
from domainlake.session import fresh_dir
from domainlake.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDING = """
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.startswith({hidden!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
assert len(e.queries()) > 150 and not any(n.startswith("op1") for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


@pytest.mark.parametrize("hidden", ["corpus_pipeline", "domainlake.llm", "xxhash", "zstandard", "public_tokenizers"])
def test_entry_without_its_optional_part(hidden):
    subprocess.run([sys.executable, "-c", HIDING.format(hidden=hidden)], cwd=ROOT, check=True, timeout=120)


def test_other_missing_modules_are_errors():
    run = subprocess.run([sys.executable, "-c", HIDING.format(hidden="numpy")], cwd=ROOT, capture_output=True, timeout=120)
    assert run.returncode and b"ModuleNotFoundError" in run.stderr


def test_settings_from_a_stored_table(spark):
    path = fresh_dir(spark, "settings")
    rows = [(2, 1, 1, 10.0), (1, 0, 1, 75.5)]
    spark.createDataFrame(rows, tables.SCHEMAS["system_settings"]).write.parquet(path)
    stored = scoring.Settings.from_table(tables.read_table(spark, "system_settings", path), strict=True)
    assert (stored.dga_enabled, stored.tunnel_enabled, stored.threshold, stored.strict) == (False, True, 75.5, True)
    none = spark.createDataFrame([], tables.SCHEMAS["system_settings"])
    assert scoring.Settings.from_table(none) == scoring.Settings()


def scored_log(spark, n=4000, days=4):
    start = datetime(2024, 3, 1, 22)
    ts = F.timestamp_micros(F.lit(int((start - datetime(1970, 1, 1)).total_seconds() * 1e6)) + F.floor(F.col("id") / 3) * (days * 86_400_000_000 * 3 // n))
    return spark.range(0, n, 1, 16).select(
        "id", ts.alias("ts"), F.lit("c").alias("client_ip"), F.lit("a.com").alias("domain"), (F.col("id") % 2 == 0).alias("blocked"),
        F.lit("DGA").alias("threat_type"), F.lit(70).alias("score"), F.lit("r").alias("reason"),
    )


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_are_in_utc_and_have_few_files(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    log, path = scored_log(spark), fresh_dir(spark, "few-files")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        tables.write_query_log(log, f"{path}/log")
        tables.write_alerts(log, f"{path}/alerts")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for name, n in (("log", 4000), ("alerts", 2000)):
        stored = spark.read.parquet(f"{path}/{name}")
        assert stored.count() == n and stored.filter(F.col("dt") != F.to_date("ts")).count() == 0
        days = [d for d in os.listdir(f"{path}/{name}") if d.startswith("dt=")]
        files = [f for d in days for f in os.listdir(f"{path}/{name}/{d}") if f.endswith(".parquet")]
        assert len(days) == 5 and len(files) <= 2 * len(days)  # sixteen tasks saw each day


def test_deep_pages_read_the_days_they_touch(spark):
    path = fresh_dir(spark, "pages")
    tables.write_query_log(scored_log(spark), path)
    log = spark.read.parquet(path)
    want = [r["id"] for r in log.orderBy(F.desc("ts"), F.desc("id")).collect()]
    days = kpis.day_counts(log)
    assert sum(n for _, n in days) == 4000
    for page in (1, 2, 13, 40, 41):
        found = kpis.paged_stored_log(log, page, 100, days)
        assert [r["id"] for r in found.collect()] == want[100 * (page - 1) : 100 * page]
        if page == 13:
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [" in plan and "dt#" in plan.split("PartitionFilters: [")[1][:40]
    for k in (0, 1, 2, 777, 1500, 3950, 3999):  # rows in threes have equal times
        row = log.filter(F.col("id") == want[k]).first()
        found = kpis.paged_log_after(log, str(row["ts"]), row["id"], 100, days)
        assert [r["id"] for r in found.collect()] == want[k + 1 : k + 101]


def test_one_scan_serves_the_dashboard(spark):
    path = fresh_dir(spark, "dashboard")
    rows = scored_log(spark).withColumns({"query_type": F.lit("A"), "threat_score": F.col("id").cast("double"), "confidence": F.lit(0.5)})
    rows.write.parquet(path)
    log, blocklist = spark.read.parquet(path), spark.createDataFrame([("x",)], "domain string")
    parts = kpis.kpi_summary(log, log.filter("blocked"), blocklist)
    read = [p for p, df in parts.items() if path.rsplit("/", 1)[1] in df._jdf.queryExecution().optimizedPlan().toString() or any(path in f for f in df.inputFiles())]
    assert sorted(read) == ["alerts", "queries"]
    assert "isnotnull(ts" in parts["queries"]._jdf.queryExecution().optimizedPlan().toString()
    assert parts["stats"].first()["total"] == 4000 and parts["stats"].first()["dga"] == 4000
    assert [r["id"] for r in parts["queries"].collect()] == list(range(3999, 3949, -1))
    assert parts["clients"].first()["blocked"] == 2000 and parts["timeline"].count() == 30
    timeline = {r["minute"]: r["total"] for r in kpis.timeline_recent(log).collect()}
    assert {r["minute"]: r["total"] for r in parts["timeline"].collect()} == timeline
    assert max(timeline) - min(timeline) < timedelta(days=1)


def test_good_and_failed_rows_share_out_a_log(spark):
    rows = [("a.com", 0.1, 0.2), (None, 0.1, 0.2), ("b.com", None, 0.2), ("c.com", 0.3, float("nan")), ("d.com", 0.0, -1.0)]
    good, failed = scoring.error_quarantine(spark.createDataFrame(rows, "domain string, dga_prob double, decision double"))
    assert sorted(map(tuple, good.collect())) == [("a.com", 0.1, 0.2), ("d.com", 0.0, -1.0)]
    assert good.columns == ["domain", "dga_prob", "decision"] and failed.count() == 3
