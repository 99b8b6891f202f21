import gzip

import pytest

from domainlake import constants as K
from domainlake.operators import squats
from domainlake.sources import feeds, tables


def domains(df):
    return sorted(r["domain"] for r in df.collect())


def land(tmp_path, text, name="feed.txt"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_hosts_variants(spark, tmp_path):
    text = (
        "# comment\n\n127.0.0.1 localhost\n0.0.0.0 0.0.0.0\n0.0.0.0 ads.example.com # why\n"
        "  127.0.0.1\ttrack.example.net\textra.example.org\n0.0.0.0  two.spaces.com\n::1 v6.example\n"
        "0.0.0.0\n"
    )
    path = land(tmp_path, text)
    assert domains(feeds.read_feed(spark, path, feeds.parse_hosts_tokens)) == [
        "ads.example.com", "track.example.net", "two.spaces.com"
    ]
    assert domains(feeds.read_feed(spark, path, feeds.parse_hosts_prefix)) == [
        "ads.example.com # why", "two.spaces.com"
    ]
    assert domains(feeds.read_feed(spark, path, feeds.parse_hosts_last_token)) == [
        "0.0.0.0", "extra.example.org", "two.spaces.com", "v6.example"
    ]


def test_gzip_files_and_folders(spark, tmp_path):
    for i in range(3):
        with gzip.open(tmp_path / f"part{i}.txt.gz", "wt") as f:
            f.write(f"http://host{i}.com/a\nhttp://host{i}.com/b\nhttp://all.com\n")
    rows = feeds.read_feed(spark, str(tmp_path), feeds.parse_url_list, source="landed").collect()
    assert sorted(r["domain"] for r in rows) == ["all.com", "host0.com", "host1.com", "host2.com"]
    assert {(r["label"], r["source"], r["family"]) for r in rows} == {(1, "landed", "phishing")}


def test_url_list_variants(spark, tmp_path):
    path = land(tmp_path, "http://u:p@a.com/x\n#http://b.com\nab\nhttp://A.com:80/\nbare.org/path\n")
    assert domains(feeds.read_feed(spark, path, feeds.parse_url_list)) == ["a.com", "bare.org"]
    assert domains(feeds.read_feed(spark, path, feeds.parse_url_blocklist)) == [
        "a.com", "ab", "b.com", "bare.org", "u"
    ]
    assert domains(feeds.read_feed(spark, path, feeds.parse_url_training)) == [
        "a.com:80", "bare.org", "u:p@a.com"
    ]


def test_csv_feeds(spark, tmp_path):
    quoted = land(
        tmp_path,
        '# head\n"1","d","http://m.com/a,b","x"\n"2","d","http://1.2.3.4/x","x"\n"3","d"\n"4","d","http://M.com"\n',
    )
    assert domains(feeds.read_feed(spark, quoted, feeds.parse_quoted_csv_urls)) == ["m.com"]
    assert domains(feeds.read_feed(spark, quoted, feeds.parse_quoted_csv_blocklist)) == ["1.2.3.4", "m.com"]
    scored = land(tmp_path, '"date","score","url","ip"\n#c\n"d","5", "http://s.com/x","1.1.1.1"\n"d","5"\n', "s.csv")
    assert domains(feeds.read_feed(spark, scored, feeds.parse_scored_csv_urls)) == ["s.com"]
    verified = land(tmp_path, 'id,url,x\n7,"https://v.com/a",yes\nalone\n', "v.csv")
    assert domains(feeds.read_feed(spark, verified, feeds.parse_verified_csv_urls)) == ["v.com"]


def test_family_feeds(spark, tmp_path):
    tsv = land(tmp_path, "# c\nNecurs\tAbc.COM\nplain.net\nx\ty\n\n")
    rows = feeds.read_feed(spark, tsv, feeds.parse_family_tsv).collect()
    assert sorted((r["domain"], r["family"]) for r in rows) == [
        ("abc.com", "necurs"), ("plain.net", "unknown_dga")
    ]
    csv = land(tmp_path, "a.com, Tinba ,2024\nB.net\nnodot,x\n", "f.csv")
    rows = feeds.read_feed(spark, csv, feeds.parse_family_csv).collect()
    assert sorted((r["domain"], r["family"]) for r in rows) == [("a.com", "tinba"), ("b.net", "unknown")]


def test_ranked_and_labelled_csv(spark, tmp_path):
    ranked = land(tmp_path, '1,google.com\n2,"quoted.com"\n3\n')
    assert domains(feeds.read_feed(spark, ranked, feeds.parse_ranked_csv)) == ["google.com", "quoted.com"]
    headed = land(tmp_path, "GlobalRank,TldRank,Domain,TLD\n1,1,Google.com,com\n2,2,a.b,b\n", "m.csv")
    assert domains(feeds.read_ranked_csv(spark, headed)) == ["google.com"]
    labelled = land(tmp_path, "x.com,dga,conficker\ny.com,legit,alexa\nz.com, DGA\n", "l.csv")
    rows = feeds.read_feed(spark, labelled, feeds.parse_labelled_csv).collect()
    assert sorted((r["domain"], r["family"]) for r in rows) == [("x.com", "conficker"), ("z.com", "unknown")]


def test_plain_and_mixed_lists(spark, tmp_path):
    path = land(tmp_path, " a.com \n#b.com\n\nhttp://c.com/x\n #d.com\nabc\na.b\n")
    assert domains(feeds.read_feed(spark, path, feeds.parse_domain_list)) == [
        "#d.com", "a.b", "a.com", "abc", "http://c.com/x"
    ]
    assert "#b.com" in domains(feeds.read_feed(spark, path, feeds.parse_domain_list, comments=False))
    assert domains(feeds.read_feed(spark, path, feeds.parse_mixed_list)) == ["#d.com", "a.b", "a.com", "c.com"]


def test_stored_tables(spark, tmp_path):
    rows = [(1, "a.com", "x", "s")]
    df = spark.createDataFrame(rows, tables.SCHEMAS["static_blocklist"])
    tables.write_list(df, str(tmp_path / "list"))
    assert tables.read_table(spark, "static_blocklist", str(tmp_path / "list")).collect() == df.collect()
    df.createOrReplaceTempView("static_blocklist")
    assert tables.read_table(spark, "static_blocklist").count() == 1


def expected_typos():
    names = set()
    for b in K.WIDE_BRANDS:
        n = len(b)
        for i, ch in enumerate(b):
            edits = [b[: i + 1] + c + b[i + 1 :] for c in (ch, chr(ord(ch) - 1), chr(ord(ch) + 1))]
            if i < n - 1 and n > 3:
                edits.append(b[:i] + b[i + 1] + ch + b[i + 2 :])
            if 0 < i < n - 1 and n > 4:
                edits.append(b[:i] + b[i + 1 :])
            names.update((e + "." + t, b) for e in edits for t in K.WIDE_TLDS)
    return names


def expected_homoglyphs():
    def one(label):
        return {
            label[:i] + s + label[i + 1 :]
            for i, ch in enumerate(label)
            for s in K.HOMOGLYPHS.get(ch, [])
        }

    names = set()
    for b in K.WIDE_BRANDS:
        first = one(b)
        second = set().union(*map(one, first)) if first else set()
        names.update(((label + "." + t).lower(), b) for label in first | second for t in K.WIDE_TLDS)
    return names


@pytest.mark.parametrize(
    "make, expected",
    [(squats.typo_candidates, expected_typos), (squats.homoglyph_candidates, expected_homoglyphs)],
)
def test_candidate_sets(spark, make, expected):
    got = {(r["domain"], r["brand"]) for r in make(spark).collect()}
    assert got == expected()


def test_digit_swaps_replace_the_first_letter(spark):
    got = {r["domain"] for r in squats.digit_swap_candidates(spark).filter("brand = 'google'").collect()}
    assert {"g0ogle-login.xyz", "goog1e-kyc.tk", "googl3-otp.top"} <= got
    assert "go0gle-login.xyz" not in got and len(got) == 3 * len(K.WIDE_KEYWORDS) * len(K.WIDE_TLDS)


def test_observed_squats_and_chains(spark):
    rows = ["PayPal-login.xyz", "paypal-login.xyz", "fine.org", "google.com.verify.tk", "netflx.site"]
    out = squats.observed_squats(spark.createDataFrame([(d,) for d in rows], "domain string")).collect()
    got = {(r["domain"], r["technique"], r["sightings"]) for r in out}
    assert got == {
        ("paypal-login.xyz", "combosquat", 2), ("google.com.verify.tk", "subdomain", 1),
        ("netflx.site", "typo", 1),
    }
    chains = ["secure-netflix-verify.xyz", "netflix-verify.xyz", "a-netflix-login-verify-otp-kyc.tk"]
    found = squats.keyword_chain_match(spark.createDataFrame([(d,) for d in chains], "domain string"))
    assert [(r["domain"], r["brands"], r["keywords"]) for r in found.collect()] == [
        ("secure-netflix-verify.xyz", "netflix", "secure,verify")
    ]


def test_encoded_labels(spark):
    names = ["00112233445566778899.evil.com", "zg9nc2fuzgnhdhm12.c2.net", "aaaaaaaaaaaaaaaa.b.com", "short.b.com"]
    rows = squats.encoded_labels(spark.createDataFrame([(n,) for n in names], "domain string")).collect()
    assert {(r["domain"], r["kind"], r["base"]) for r in rows} == {
        (names[0], "hex", "evil.com"), (names[1], "base64", "c2.net"), (names[2], "hex", "b.com")
    }
