"""Page evidence, page verdicts and the written assessment."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlake.functions.text import strip
from domainlake.functions.urls import host_of_url
from domainlake.operators.joins import lookup
from domainlake.operators.scoring import ml_verdict, risk_band

# (?d): only a line feed ends a line, so '.' matches carriage returns as it must here.
TITLE = "(?idu)<title>(.*?)</title>"


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, password_field, login_form, summary) from the whole page text."""
    html = F.col("html")
    lowered = F.lower(html)
    forms = F.concat_ws(
        ", ",
        F.when(F.col("password_field"), "password_field"),
        F.when(F.col("login_form"), "login_form"),
    )
    found = F.concat(F.lit("Suspicious forms found: "), forms, F.lit("."))
    return (
        pages.withColumn("_has_title", html.rlike(TITLE))
        .withColumn(
            "title",
            F.when(F.col("_has_title"), strip(F.regexp_extract(html, TITLE, 1))).otherwise(
                "Unknown"
            ),
        )
        .withColumn("password_field", lowered.contains("password"))
        .withColumn("login_form", lowered.contains("login"))
        .withColumn(
            "summary",
            F.concat(
                F.lit("Title: '"), "title", F.lit("'. "),
                F.when(forms == "", "No login/password forms detected directly.").otherwise(found),
            ),
        )
        .select("page_id", "url", "title", "password_field", "login_form", "summary")
    )


def page_verdicts(evidence: DataFrame, scored: DataFrame) -> DataFrame:
    """Evidence joined to the verdict of the page's host, with risk band and model verdict.

    `scored` holds one row per domain.
    """
    joined = lookup(evidence.withColumn("domain", host_of_url(F.col("url"))), scored, "domain")
    return joined.withColumn("risk", risk_band(F.col("score"))).withColumn(
        "ml_verdict", ml_verdict(F.col("score"), F.col("threat_type"))
    )


def assessment_text(df: DataFrame) -> DataFrame:
    """Add three templated narratives per scored domain: assessment, signal and analysis.

    The signal closes with `behavioral_score`, a share, where `df` has it, else with 0 %.
    """
    score = F.col("score").cast("string")
    tag = F.concat(F.lit("["), risk_band(F.col("score")), F.lit("] "))
    generated = F.col("dga_prob") > 0.4
    target = F.col("lookalike")
    severe = F.col("score") >= 60
    behavioural = F.coalesce("behavioral_score", F.lit(0.0)) if "behavioral_score" in df.columns else F.lit(0.0)

    def points(name: str):
        return F.format_number(F.coalesce(F.col("contributions")[name], F.lit(0.0)), 1)

    def named_target(before: str, after: str):
        text = F.concat(F.lit(before), target, F.lit(after))
        return F.when(target.isNotNull(), text).otherwise("")

    assessment = F.concat(
        tag, F.lit("Domain '"), "domain", F.lit("' scores "), score,
        F.lit("/100 on the threat model. "),
        F.when(
            generated,
            F.concat(
                F.lit("DGA characteristics detected with "),
                F.format_number(F.col("dga_prob") * 100, 1),
                F.lit("% probability, consistent with algorithmic domain generation. "),
            ),
        ).otherwise("DGA engine returned low risk. "),
        named_target("Brand impersonation of ", " detected. "),
        F.when(F.col("in_static_blocklist"), "Found in the threat blocklist. ").otherwise(""),
        F.when(severe, "Immediate blocking recommended.").otherwise("Monitor passively."),
    )
    signal = F.concat(
        tag, F.lit("Threat Score: "), score, F.lit("/100. Primary detection signal: "),
        F.initcap(F.replace(F.col("top_signal"), F.lit("_"), F.lit(" "))),
        F.lit(" (contributing "), F.format_number("top_points", 1), F.lit("pts). "),
        F.when(
            generated, "Lexical analysis confirms algorithmically-generated domain pattern. "
        ).otherwise("Domain follows human-readable naming conventions. "),
        named_target("Phishing vector targeting ", ". "),
        F.lit("Behavioral Risk: "), F.format_number(behavioural * 100, 0), F.lit("%."),
    )
    analysis = F.concat(
        tag, F.lit("Comprehensive analysis: "), "reason",
        F.lit(". The weighted threat score of "), score, F.lit("/100 was computed from DGA="),
        points("dga_probability"), F.lit("pts, Anomaly="), points("anomaly_score"),
        F.lit("pts, Lookalike="), points("lookalike_score"), F.lit("pts, Entropy="),
        points("entropy_score"), F.lit("pts. "),
        F.when(severe, "BLOCK and isolate source host immediately.").otherwise(
            "Allow with passive monitoring."
        ),
    )
    return df.select(
        "*",
        assessment.alias("assessment"),
        signal.alias("signal"),
        analysis.alias("analysis"),
    )
