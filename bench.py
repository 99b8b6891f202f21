"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import time

from pyspark.sql import functions as F

from domainlake.operators import behaviour, features, kpis, scoring, squats
from domainlake.plans import QUERIES
from domainlake.plans.views import Views
from domainlake.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REGISTERED = [
    "a5_quoted_csv_urls", "b2_url_to_domain", "b3_unmask_urls", "crawl_risk_report",
    "score_domains", "d11_doh_bypass", "e2_shadowing_flags", "e4_fast_flux_flags",
    "e6_behaviour_join", "e6_score_log", "f1_kpi_stats", "f2_client_risk", "f5_timeline_recent", "f8_paged_log",
    "f14_kpi_summary", "g3_clean_corpus", "g4_balance_classes", "g7_stratified_split",
    "h1_train_dga_forest", "h3_train_isolation_forest", "h9_anomaly_rates", "i6_observed_squats",
    "i8_encoded_label_report", "j1_page_evidence", "j3_assessment_text", "k1_append_blocklist",
    "l2_stream_rate_windows", "l5_stream_timeline",
]


def naive_scores(log):
    """Signals on every row instead of every distinct domain, for comparison."""
    rows = scoring.domain_signals(log).withColumn(
        "tunnel_prob", scoring.tunnel_probability(F.col("decision"))
    )
    return scoring.threat_score(rows)


def main():
    spark = local_session(cores=CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    v = Views(spark, SF_DIR)
    jobs = {
        "domain_features": lambda: features.domain_features(v.names),
        "jaro_winkler": lambda: features.domain_features(v.names).select("jaro_winkler_score"),
        "score_log_distinct": lambda: scoring.score_queries(v.client_traffic, v.blocklist),
        "score_log_every_row": lambda: naive_scores(v.client_traffic),
        "rate_limit_1h": lambda: behaviour.rate_limit_flags(v.dns_log, 3600, 2),
        "observed_squats": lambda: squats.observed_squats(v.names),
        "kpi_timeline": lambda: kpis.timeline_minutes(v.dns_log),
    }
    jobs |= {name: (lambda name=name: QUERIES[name](spark, SF_DIR)) for name in REGISTERED}
    QUERIES["f1_kpi_stats"](spark, SF_DIR).collect()  # start the JVM's code paths
    timings = {}
    for name, job in jobs.items():
        begin = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline jobs",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
