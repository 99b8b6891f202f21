"""The whole query-log path against a sequential simulation, one query at a time."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

from domainlake import constants as K
from domainlake.operators import detection
from tests import plain

START = datetime(2024, 1, 1)
LISTED = {"bad.evil.org"}


def make_rows(n=600):
    rng = random.Random(3)
    rows, answers, at = [], [], 0
    for i in range(n):
        at += rng.choice([50_000, 300_000, 900_000])
        client = rng.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2", "8.8.8.8"])
        domain = rng.choice(
            [f"s{rng.randrange(12)}.x.tunnel.com", "google.com", "bad.evil.org", "paypa1-login.xyz",
             f"h{rng.randrange(30)}.flux.net", "plain.org"]
        )
        kind = rng.choice(["A", "A", "AAAA", "MX"])
        ts = START + timedelta(microseconds=at)
        rows.append((i, ts, client, domain, kind, rng.randrange(101) / 100, rng.randrange(41) / 20 - 1))
        answers.append((i, ts, domain, f"10.9.0.{rng.randrange(5)}", 60))
    return rows, answers


def simulate(rows, answers, rate_limit, shadow_limit, flux_limit):
    recent, subs, ips = defaultdict(deque), defaultdict(set), defaultdict(set)
    verdicts = {}
    for (i, ts, client, domain, kind, dga, decision), answer in zip(rows, answers):
        ips[answer[2]].add(answer[3])
        window = recent[client]
        while window and (ts - window[0]).total_seconds() > 1.0:
            window.popleft()
        window.append(ts)
        if len(window) > rate_limit or kind not in K.ANALYSED_QUERY_TYPES:
            continue
        if domain in K.SAFE_DOMAINS:
            score, threat = 0, "None"
        elif domain in LISTED:
            score, threat = 100, "THREAT_INTEL"
        else:
            labels = domain.split(".")
            base = ".".join(labels[-2:])
            if len(labels) >= 3:
                subs[base].add(labels[0])
            shadow = len(labels) >= 3 and len(subs[base]) > shadow_limit
            flux = len(ips[domain]) > flux_limit
            plain_total = total_points(domain, dga, decision)
            score = min(int(plain_total + 30 * shadow + 25 * flux), 100)
            threat = "FAST_FLUX" if flux else "DNS_SHADOWING" if shadow else plain_type(domain, plain_total, dga, decision)
        if client in K.DOH_RESOLVERS:
            score, threat = 100, "DOH_BYPASS"
        verdicts[i] = (score, threat)
    return verdicts


def plain_type(domain, points, dga, decision):
    """Type of a name without behavioural findings: the first finding that holds, from 30 points on."""
    near = min(plain.edit_distance(domain.split(".")[0], b) for b in K.BRANDS)
    findings = {
        "DGA": dga > 0.55,
        "TUNNELING": 0.5 - decision > 0.6,
        "PHISHING": near <= 2 or plain.features(domain)["lookalike_score"] > 0.5,
        "SUSPICIOUS": True,
    }
    return "CLEAN" if points < 30 else next(kind for kind, holds in findings.items() if holds)


def total_points(domain, dga, decision):
    """The unrounded score, from the pieces of the plain statement."""
    f = plain.features(domain)
    hits = sum(w in domain for w in K.PHISH_KEYWORDS)
    near = min(plain.edit_distance(domain.split(".")[0], b) for b in K.BRANDS)
    tunnel = max(0, min(1, -decision + 0.5))
    return (
        dga * 40 + tunnel * 20 + f["entropy"] * 15 + f["lookalike_score"] * 10
        + f["tld_risk"] * 10 + f["jaro_winkler_score"] * 5 + min(hits * 8, 20) + 15 * (near in (1, 2))
    )


def test_score_log_equals_sequential_processing(spark):
    rows, answers = make_rows()
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    log = spark.createDataFrame(
        shuffled,
        "id long, ts timestamp, client_ip string, domain string, query_type string, "
        "dga_prob double, decision double",
    )
    resolutions = spark.createDataFrame(answers, "id long, ts timestamp, domain string, ip string, ttl int")
    listed = spark.createDataFrame([(d.upper(),) for d in LISTED], "domain string")
    limits = {"rate_limit": 4, "shadow_limit": 6, "flux_limit": 3}
    out = detection.score_log(log, resolutions, listed, **limits).collect()
    got = {r["id"]: (r["score"], r["threat_type"]) for r in out}
    want = simulate(rows, answers, 4, 6, 3)
    assert got == want
    kinds = {threat for _, threat in want.values()}
    assert {"None", "THREAT_INTEL", "DOH_BYPASS", "FAST_FLUX", "DNS_SHADOWING"} <= kinds
    assert len(want) < sum(r[4] in K.ANALYSED_QUERY_TYPES for r in rows)
