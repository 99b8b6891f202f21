import random
import string
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from domainlake import constants as K
from domainlake.functions import lexical as L
from domainlake.functions import similarity as S
from domainlake.operators import features as O
from tests import plain

CURATED = [
    "google.com", "github.com", "mail.google.com", "login.microsoftonline.com",
    "paypa1-secure-login.xyz", "sbi-netbanking-verify.top", "amazon-login-help.ru",
    "faceb00k-account.club", "xkj234kjdfs.net", "m7v8x2pqh3.com", "vncxm9823kzxy.info",
    "cD93ZXJzaGVsbCBoYWNrZXI.evil.com", "YWRtaW4=.c2.attacker.net", "update-now.tk",
    "secure.banking.co.in", "xkqzr7abmncvpq.com", "aGVsbG8KdG9rZW4uZXZpbA.c2.ml",
]
EDGES = [
    "", ".", "a", ".com", "sbi", "sbi.co.in", "sb.com", "pyapal.com", "paypal.com", "apple",
    "aaaa.com", "aabbaa.tk", "HTTP://Paypal.com/login", "https://a.b/c", "x://y://z", "a/b://c/d",
    "under_score.com", "  spaced.com\t", "\u00a0nbsp.com\u3000", "g\u00f6\u00f6gle.com",
    "\u00e1bc\u0663\u00b2.com", "\u4e2d\u6587.tk", "a\U0001f600b\U00010a40.com", "qxqz.xyz",
    "theinerthe.com", "-" * 12 + ".com", "x" * 70 + ".gq", "i\u0307stanbul.com", "a b.com",
    "bankofamerica1.com", "office365.com", "0ffice365.com", "microsfot.com", "netfilx.com",
]


def random_names(n: int) -> list[str]:
    rng = random.Random(7)
    names = []
    for _ in range(n):
        brand = rng.choice(K.BRANDS)
        chars = list(brand)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(chars) + 1)
            chars[i : i + rng.randint(0, 2)] = rng.choice(string.ascii_lowercase + "01-")
        names.append("".join(chars) + rng.choice([".com", ".xyz", ".top", ""]))
        size = rng.randint(1, 25)
        names.append("".join(rng.choices(string.ascii_letters + string.digits + "-.", k=size)))
    return names


@pytest.fixture(scope="module")
def names():
    return sorted(set(CURATED + EDGES + random_names(150)))


def test_every_feature_equals_the_plain_statement(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "domain string")
    rows = {r["domain"]: r.asDict() for r in O.domain_features(df).collect()}
    for name in names:
        for column, value in plain.features(name).items():
            assert rows[name][column] == pytest.approx(value, abs=1e-12), (name, column)


def test_repeated_domains_get_the_same_features(spark):
    df = spark.createDataFrame([(i, n) for i in range(5) for n in CURATED], "id int, domain string")
    out = O.with_features(df)
    assert out.count() == 5 * len(CURATED)
    assert out.select("domain", "entropy", "jaro_winkler_score").distinct().count() == len(CURATED)


def test_jaro_winkler_on_all_pairs(spark, names):
    labels = sorted({plain.host_of(n).split(".")[0] for n in names})
    pairs = [(a, b) for a in labels for b in K.BRANDS[:12] + ["", "a"]]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("s", F.expr(S.jaro_winkler("a", "b"))).collect():
        assert r["s"] == pytest.approx(plain.similarity(r["a"], r["b"]), abs=1e-12), r


def test_prefix_bonus_counts_any_equal_position(spark):
    df = spark.createDataFrame([("pyapal", "paypal")], "a string, b string")
    assert df.select(F.expr(S.jaro_winkler("a", "b"))).first()[0] == pytest.approx(0.9556, abs=1e-4)


@pytest.mark.parametrize(
    "label, score",
    [("google", 0.5), ("googl", 1.0), ("g0ogel", 0.5), ("sbi", 0.5), ("zzzz", 0.5), ("qqqqqqqqq", 0.0)],
)
def test_lookalike_score(spark, label, score):
    df = spark.createDataFrame([(label,)], "sld string")
    df = df.withColumn("d", S.min_distance("sld", K.BRANDS))
    assert df.select(S.lookalike_score(F.col("d"))).first()[0] == score


def test_brand_match(spark):
    df = spark.createDataFrame([("amaz0n.top",), ("paypal.com",), ("googel.click",)], "domain string")
    got = {r["domain"]: (r["brand"], r["distance"]) for r in O.brand_match(df).collect()}
    assert got == {
        "amaz0n.top": ("amazon", 1), "paypal.com": ("paypal", 0), "googel.click": ("google", 2)
    }


def test_character_classes_over_all_code_points(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c)) for c in points if c < 0x30000], "c int, ch string")
    ch = F.col("ch")
    tested = df.select(
        "ch",
        L.count_of(ch, L.CONSONANT).alias("consonant"),
        L.count_of(ch, L.DIGIT).alias("digit"),
        L.count_of(ch, L.NOT_ALPHA_NUMERIC).alias("special"),
    ).collect()
    wrong = [
        r["ch"]
        for r in tested
        if (r["consonant"], r["digit"], r["special"])
        != (plain.consonant(r["ch"]), r["ch"].isdigit(), not r["ch"].isalnum())
    ]
    # The two runtimes know different Unicode versions: letters added in between differ.
    assert all(unicodedata.ucd_3_2_0.category(c) == "Cn" for c in wrong)
    assert len(wrong) < 2000


def test_legacy_features(spark):
    df = spark.createDataFrame([("paypa1.com",), ("Secure-Login.XYZ",), ("",)], "domain string")
    rows = {r["domain"]: r for r in O.legacy_features(df).collect()}
    assert rows["paypa1.com"]["lookalike_score"] == 1.0
    assert rows["paypa1.com"]["length"] == 10.0
    assert rows["Secure-Login.XYZ"]["tld_risk"] == 1.0
    assert rows["Secure-Login.XYZ"]["suspicious_keyword_score"] == pytest.approx(0.2)
    assert rows["Secure-Login.XYZ"]["special_char_count"] == 1.0
    assert rows[""]["ngram_randomness"] == 1.0
