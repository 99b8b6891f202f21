import pytest
from pyspark.sql import functions as F

from domainlake.functions.text import round_exact
from domainlake.operators import joins, lists, pages
from domainlake.operators import kpis
from domainlake.operators import scoring as O

ROWS = [
    ("google.com", 0.0, 0.5), ("paypa1-secure-login.xyz", 0.9, -0.3), ("xkqzr7abmncvpq.com", 0.97, 0.1),
    ("amaz0n.top", 0.1, 0.4), ("mail.example.org", 0.2, 0.45), ("update-now.tk", 0.55, 0.2),
    ("http://Paypal.com/login", 0.4, -1.0), ("YWRtaW4.c2.attacker.net", 0.56, -0.2), ("", 0.5, 0.0),
]


# For each row: score, type, reason, blocked; and the score with both models off.
WORKED = [
    (13, "CLEAN", "No threats detected", False, 13),
    (90, "DGA", "DGA probability 90% | High entropy (3.8) | Phishing keywords found | High-risk TLD", True, 38),
    (61, "DGA", "DGA probability 97% | High entropy (3.7)", True, 14),
    (52, "PHISHING", "Brand lookalike detected | High-risk TLD", False, 46),
    (22, "CLEAN", "No threats detected", False, 13),
    (57, "SUSPICIOUS", "High entropy (3.3) | Phishing keywords found | High-risk TLD", False, 29),
    (57, "TUNNELING", "Phishing keywords found", False, 21),
    (46, "DGA", "DGA probability 56%", False, 10),
    (36, "SUSPICIOUS", "No threats detected", False, 6),
]


@pytest.fixture(scope="module")
def inputs(spark):
    return spark.createDataFrame(ROWS, "domain string, dga_prob double, decision double")


def test_scores_types_and_reasons(inputs):
    got = {r["domain"]: r for r in O.score_domains(inputs).collect()}
    for row, want in zip(ROWS, WORKED):
        r = got[row[0]]
        assert (r["score"], r["threat_type"], r["reason"], r["blocked"]) == want[:4], row


def test_lists_and_errors_decide_before_the_score(spark, inputs):
    blocked = spark.createDataFrame([("GOOGLE.com",)], "domain string")
    allowed = spark.createDataFrame([(" Amaz0n.TOP",)], "domain string")
    broken = spark.createDataFrame(
        [(None, 0.1, 0.1), ("x.com", None, 0.1), ("y.com", 0.1, float("nan"))], inputs.schema
    )
    out = O.score_domains(inputs.unionByName(broken), blocked, allowed).collect()
    got = {r["domain"]: r for r in out}
    assert len(out) == len(ROWS) + 3
    listed = got["google.com"]
    assert (listed["score"], listed["threat_type"], listed["blocked"]) == (100, "THREAT_INTEL", True)
    assert (listed["dga_prob"], listed["tunnel_score"], listed["entropy"], listed["tld_risk"]) == (1, 1, 0, 1)
    assert (got["amaz0n.top"]["score"], got["amaz0n.top"]["blocked"]) == (0, False)
    for name in (None, "x.com", "y.com"):
        assert (got[name]["threat_type"], got[name]["score"], got[name]["blocked"]) == ("ERROR", 0, False)
        assert "missing" in got[name]["reason"]


def test_a_listed_name_needs_no_model_output(spark, inputs):
    rows = [("evil.com", None, 0.1), ("worse.com", 0.1, float("nan")), ("mine.com", None, None), ("x.com", None, 0.1)]
    listed = spark.createDataFrame([("evil.com",), ("WORSE.com",), ("mine.com",)], "domain string")
    allowed = spark.createDataFrame([("mine.com",)], "domain string")
    out = O.score_domains(spark.createDataFrame(rows, inputs.schema), listed, allowed)
    got = {r["domain"]: (r["score"], r["threat_type"], r["blocked"], r["in_static_blocklist"]) for r in out.collect()}
    assert got["evil.com"] == got["worse.com"] == (100, "THREAT_INTEL", True, True)
    assert got["mine.com"][:3] == (0, "None", False)
    assert got["x.com"] == (0, "ERROR", False, False)


def test_counters_read_the_engines_vocabulary(spark):
    kinds = ["THREAT_INTEL", "Blocklist", "TUNNELING", "PHISHING", "DGA", None]
    log = spark.createDataFrame([(k, True) for k in kinds], "threat_type string, blocked boolean")
    r = kpis.kpi_stats(log, log).first()
    assert (r["blocklist_hits"], r["tunnel"], r["phishing"], r["dga"], r["total"]) == (2, 1, 1, 1, 6)


def test_behaviour_overrides(spark, inputs):
    names = inputs.select("domain").distinct()
    rows = joins.lookup(inputs, O.domain_signals(names), "domain").filter("domain = 'mail.example.org'")
    seen = {}
    for shadow in (False, True):
        for flux in (False, True):
            flagged = rows.withColumn("shadowing", F.lit(shadow)).withColumn("fast_flux", F.lit(flux))
            r = O.verdicts(flagged).first()
            seen[shadow, flux] = (r["score"], r["threat_type"], r["reason"])
    base = seen[False, False][0]
    assert seen[True, False][:2] == (base + 30, "DNS_SHADOWING")
    assert seen[False, True][:2] == (base + 25, "FAST_FLUX")
    assert seen[True, True][:2] == (base + 55, "FAST_FLUX")
    assert seen[True, True][2].startswith("Fast Flux") and "Shadowing" not in seen[True, True][2]
    assert seen[True, False][2].startswith("DNS Shadowing detected")


def test_threshold_and_toggles(inputs):
    exact = {r["domain"]: r["score"] for r in O.score_domains(inputs).collect()}
    at = exact["paypa1-secure-login.xyz"]
    for strict, want in ((False, True), (True, False)):
        out = O.score_domains(inputs, settings=O.Settings(threshold=at, strict=strict))
        got = out.filter("domain = 'paypa1-secure-login.xyz'").first()
        assert got["blocked"] is want
    off = O.Settings(dga_enabled=False, tunnel_enabled=False)
    quiet = {r["domain"]: r["score"] for r in O.score_domains(inputs, settings=off).collect()}
    for row, want in zip(ROWS, WORKED):
        assert quiet[row[0]] == want[4]


def test_queries_gate_safe_list_and_resolvers(spark):
    rows = [
        (1, "10.0.0.1", "google.com", "A"), (2, "10.0.0.1", "Google.com", "A"),
        (3, "8.8.8.8", "google.com", "AAAA"), (4, "10.0.0.1", "x.com", "MX"),
    ]
    log = spark.createDataFrame(rows, "id int, client_ip string, domain string, query_type string")
    log = log.withColumn("dga_prob", F.lit(0.0)).withColumn("decision", F.lit(0.5))
    got = {r["id"]: r for r in O.score_queries(log).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["threat_type"], got[1]["score"]) == ("None", 0)
    assert got[2]["threat_type"] == "CLEAN"
    assert (got[3]["threat_type"], got[3]["score"], got[3]["blocked"]) == ("DOH_BYPASS", 100, True)


def test_rounding_ties(spark):
    values = [0.0625, 0.125, 0.0015, 0.9995, 0.4445, 0.12345, 0.0, 1.0, 0.3335]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for r in df.withColumn("r", round_exact(F.col("x"), 3)).collect():
        assert r["r"] == round(r["x"], 3), r
    bits = [3.25, 3.15, 3.75, 3.45, 3.05, 4.0]
    df = spark.createDataFrame([(x,) for x in bits], "x double")
    for r in df.withColumn("t", F.format_number("x", 1)).collect():
        assert r["t"] == f"{r['x']:.1f}", r
    halves = spark.createDataFrame([(12.25,), (12.75,), (3.15,), (12.35,)], "x double")
    got = [r[0] for r in halves.select(kpis.one_decimal(F.col("x"))).collect()]
    assert got == [12.3, 12.8, 3.1, 12.3]


def test_vocabulary(spark):
    kinds = ["CLEAN", "DGA", "TUNNELING", "PHISHING", "SUSPICIOUS", "THREAT_INTEL", "DNS_SHADOWING",
             "FAST_FLUX", "DOH_BYPASS", "ERROR"]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    got = [r[0] for r in df.select(O.canonical_threat_type(F.col("k"))).collect()]
    assert got == ["None", "DGA", "Tunneling", "Phishing", "Suspicious", "Blocklist", "SHADOWING",
                   "FAST_FLUX", "DOH_BYPASS", "ERROR"]


def test_contributions_add_up(spark, inputs):
    rows = joins.lookup(inputs, O.domain_signals(inputs.select("domain").distinct()), "domain")
    rows = rows.withColumn("tunnel_prob", O.tunnel_probability(F.col("decision")))
    for r in O.score_contributions(O.threat_score(rows)).collect():
        assert min(int(sum(r["contributions"].values()) + 1e-9), 100) == r["score"]
        assert r["contributions"][r["top_signal"]] == max(r["contributions"].values())


def test_salted_lookup_equals_plain_join(spark):
    facts = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 7)) as key")
    dim = facts.select("key").distinct().withColumn("v", F.length("key"))
    plain_join = sorted(map(tuple, joins.lookup(facts, dim, "key", salts=1).collect()))
    assert sorted(map(tuple, joins.lookup(facts, dim, "key", salts=8).collect())) == plain_join


def test_page_evidence(spark):
    html = [
        (1, "<TITLE> Sign in </TITLE> <input type=Password> LOGIN", "Sign in", True, True),
        (2, "<title>a\nb</title>", "Unknown", False, False),
        (3, "<title></title>", "", False, False),
        (4, "no title", "Unknown", False, False),
        (5, "<title>a\rb</title><title>c</title>", "a\rb", False, False),
    ]
    df = spark.createDataFrame([(i, "http://x.com", h) for i, h, *_ in html], "page_id int, url string, html string")
    got = {r["page_id"]: r for r in pages.page_evidence(df).collect()}
    for i, _, title, password, login in html:
        r = got[i]
        assert (r["title"], r["password_field"], r["login_form"]) == (title, password, login)
    assert got[1]["summary"] == "Title: 'Sign in'. Suspicious forms found: password_field, login_form."


def test_list_maintenance(spark):
    current = spark.createDataFrame([(1, "a.com", "x", "s")], "id long, domain string, category string, source string")
    entries = spark.createDataFrame(
        [("b.com", "late", "f", 9), ("b.com", "early", "f", 2), ("a.com", "y", "f", 1), ("", "z", "f", 1)],
        "domain string, category string, source string, seq int",
    )
    got = sorted((r["domain"], r["category"]) for r in lists.append_blocklist(current, entries).collect())
    assert got == [("a.com", "x"), ("b.com", "early")]
    names = spark.createDataFrame([(" C.com ",), ("a.com",)], "domain string")
    assert sorted(r[0] for r in lists.add_to_list(current, names).collect()) == ["a.com", "c.com"]
    assert lists.remove_from_list(current, names).count() == 0
