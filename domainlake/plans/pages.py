"""Page evidence, page verdicts and narratives."""

from pyspark.sql import functions as F

from domainlake.operators import pages as P
from domainlake.operators import scoring as O
from domainlake.plans.catalog import query
from domainlake.plans.scoring import BAND, CRAWL, CRAWL_HOSTS, LISTED, POINTS, TERMS, _long, _signals
from domainlake.plans.sqltext import REASON, host_full
from domainlake.plans.views import Views

EVIDENCE = (
    "select page_id, url, case when regexp_matches(html, '(?i)<title>.*?</title>') then "
    "trim(regexp_extract(html, '(?i)<title>(.*?)</title>', 1)) else 'Unknown' end as title, "
    "contains(lower(html), 'password') as password_field, "
    "contains(lower(html), 'login') as login_form from pages"
)
SUMMARY = (
    "'Title: ''' || title || '''. ' || case when password_field and login_form then "
    "'Suspicious forms found: password_field, login_form.' when password_field then "
    "'Suspicious forms found: password_field.' when login_form then "
    "'Suspicious forms found: login_form.' else 'No login/password forms detected directly.' end"
)


@query("j1_page_evidence", f"select *, {SUMMARY} as summary from ({EVIDENCE}) e")
def page_evidence(v: Views):
    return P.page_evidence(v.pages)


@query(
    "j2_page_verdicts",
    "select page_id, title, domain, final::bigint as score, kind as threat_type, "
    f"{BAND.replace('score', 'final')} as risk, case when final >= 50 then kind || ' (Malicious)' "
    f"else 'Legitimate' end as ml_verdict from (select *, {host_full('url')} as domain "
    f"from ({EVIDENCE}) e) p join (select domain, case when {LISTED} then 100 else score end as "
    f"final, case when {LISTED} then 'THREAT_INTEL' else threat_type end as kind from typed) s "
    "using (domain)",
    ["blocklist"],
    [("crawl", CRAWL_HOSTS), *CRAWL],
)
def page_verdicts(v: Views):
    evidence = P.page_evidence(v.pages)
    hosts = evidence.select(P.host_of_url(F.col("url")).alias("domain")).distinct()
    models_off = hosts.withColumn("dga_prob", F.lit(0.0)).withColumn("decision", F.lit(0.5))
    scored = O.score_domains(models_off, v.blocklist)
    out = P.page_verdicts(evidence, scored)
    return _long(
        out.select("page_id", "title", "domain", "score", "threat_type", "risk", "ml_verdict"),
        "score",
    )


TAG = f"'[' || ({BAND}) || '] '"
LOOK = "lookalike_score > 0.5"


def _largest() -> str:
    return "greatest(" + ", ".join(f"({t})::double" for t in TERMS.values()) + ")"


TOP_TITLE = "case " + " ".join(
    f"when ({t})::double = {_largest()} then '{n.replace('_', ' ').title()}'"
    for n, t in TERMS.items()
) + " end"


@query(
    "j3_assessment_text",
    f"select id, domain, {TAG} || 'Domain ''' || domain || ''' scores ' || score || "
    "'/100 on the threat model. ' || case when dga_prob > 0.4 then 'DGA characteristics detected "
    "with ' || printf('%.1f', dga_prob * 100) || '% probability, consistent with algorithmic domain "
    "generation. ' else 'DGA engine returned low risk. ' end || case when " + LOOK + " then "
    "'Brand impersonation of Yes detected. ' else '' end || case when score >= 60 then "
    "'Immediate blocking recommended.' else 'Monitor passively.' end as assessment, "
    f"{TAG} || 'Threat Score: ' || score || '/100. Primary detection signal: ' || {TOP_TITLE} || "
    f"' (contributing ' || printf('%.1f', {_largest()}) || 'pts). ' || case when dga_prob > 0.4 "
    "then 'Lexical analysis confirms algorithmically-generated domain pattern. ' else "
    "'Domain follows human-readable naming conventions. ' end || case when " + LOOK + " then "
    "'Phishing vector targeting Yes. ' else '' end || 'Behavioral Risk: ' || printf('%.0f', id % 5 / 4.0 * 100) || '%.' as signal, "
    f"{TAG} || 'Comprehensive analysis: ' || {REASON} || '. The weighted threat score of ' || score "
    "|| '/100 was computed from DGA=' || printf('%.1f', dga_prob * 40) || 'pts, Anomaly=' || "
    "printf('%.1f', tunnel_prob * 20) || 'pts, Lookalike=' || printf('%.1f', lookalike_score * 10) "
    "|| 'pts, Entropy=' || printf('%.1f', entropy * 15) || 'pts. ' || case when score >= 60 then "
    "'BLOCK and isolate source host immediately.' else 'Allow with passive monitoring.' end "
    "as analysis from typed",
    ["scoring_input"],
    POINTS,
)
def assessment_text(v: Views):
    explained = O.score_contributions(O.reason(_signals(v)))
    final = O.verdict_flags(explained).withColumn("in_static_blocklist", F.lit(False))
    final = final.withColumn("behavioral_score", F.col("id") % 5 / 4.0)
    return P.assessment_text(final).select("id", "domain", "assessment", "signal", "analysis")
