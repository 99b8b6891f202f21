"""Lexical features of one host label, each a native column expression.

`host` is the normalised host and `sld` its left-most label. Ratios divide by max(length, 1).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from domainlake import constants as K
from domainlake.functions.text import any_of, part

NOT_ALPHA_NUMERIC = "[^\\p{L}\\p{N}]"
CONSONANT = "[\\p{L}&&[^aeiou]]"
# Decimal digits plus the superscript, circled and similar digits.
DIGIT = (
    "[\\p{Nd}\u00b2\u00b3\u00b9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089"
    "\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff\u2776-\u277e"
    "\u2780-\u2788\u278a-\u2792\\x{10a40}-\\x{10a43}\\x{10e60}-\\x{10e68}"
    "\\x{11052}-\\x{1105a}\\x{1f100}-\\x{1f10a}]"
)


def sld_of(host: Column) -> Column:
    return part(host, ".", 1)


def tld_of(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def labels(host: Column) -> Column:
    """Number of dot-separated labels."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _size(sld: Column) -> Column:
    return F.greatest(F.length(sld), F.lit(1))


def _pairs(sld: Column) -> Column:
    return F.greatest(F.length(sld) - 1, F.lit(1))


def count_of(sld: Column, char_class: str) -> Column:
    """Characters of `sld` inside a character class, counted by deletion (no arrays)."""
    return F.length(sld) - F.length(F.regexp_replace(sld, char_class, ""))


def share_of_chars(sld: Column, chars: str) -> Column:
    """Share of characters from a plain list."""
    return (F.length(sld) - F.length(F.translate(sld, chars, ""))) / _size(sld)


def share_of(sld: Column, char_class: str) -> Column:
    return count_of(sld, char_class) / _size(sld)


def special_chars(sld: Column) -> Column:
    return count_of(sld, NOT_ALPHA_NUMERIC)


def shannon_bits(sld: Column) -> Column:
    """Shannon entropy in bits, summed in order of first appearance; `sld` must be a plain column."""
    n = F.length(sld)

    def add(total: Column, ch: Column) -> Column:
        p = (n - F.length(F.replace(sld, ch, F.lit("")))) / n
        return total - p * F.log2(p)

    distinct = F.array_distinct(F.split(sld, ""))
    return F.when(sld == "", F.lit(0.0)).otherwise(F.aggregate(distinct, F.lit(0.0), add))


def bigram_hits(sld: Column, bigrams: list[str]) -> Column:
    """Positions at which one of the pairs starts; look-ahead counts overlapping pairs."""
    return F.regexp_count(sld, F.lit(f"(?={any_of(bigrams)})"))


def ngram_randomness(sld: Column, bigrams: list[str]) -> Column:
    return 1 - bigram_hits(sld, bigrams) / _pairs(sld)


def char_continuity(sld: Column) -> Column:
    return bigram_hits(sld, K.IMPOSSIBLE_BIGRAMS) / _pairs(sld)


def repeated_chars(sld: Column) -> Column:
    return F.regexp_count(sld, F.lit("(?s)(.)(?=\\1)")) / _size(sld)


def longest_consonant_run(sld: Column) -> Column:
    runs = F.regexp_extract_all(sld, F.lit(f"({CONSONANT}+)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def distinct_chars(sld: Column) -> Column:
    return F.when(sld == "", F.lit(0)).otherwise(F.size(F.array_distinct(F.split(sld, ""))))


def tld_risk(host: Column) -> Column:
    pairs = [F.lit(x) for kv in K.TLD_RISK.items() for x in kv]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), tld_of(host)), F.lit(K.DEFAULT_TLD_RISK)
    )


def keyword_hits(text: str, words: list[str]) -> Column:
    """How many of the listed words occur in the text, a column name or SQL (each counts once)."""
    return F.expr(" + ".join(f"int(contains({text}, '{w}'))" for w in words))


def feature_columns() -> dict[str, Column]:
    """Features over columns `host` and `sld`, without entropy and the two brand similarities."""
    host, sld = F.col("host"), F.col("sld")
    return {
        "length": F.least(F.length(host) / 63, F.lit(1.0)),
        "num_subdomains": F.least((labels(host) - 1) / 5, F.lit(1.0)),
        "vowel_ratio": share_of_chars(sld, "aeiou"),
        "consonant_ratio": share_of(sld, CONSONANT),
        "digit_ratio": share_of(sld, DIGIT),
        "special_char_count": F.least(special_chars(sld) / 10, F.lit(1.0)),
        "ngram_randomness": ngram_randomness(sld, K.COMMON_BIGRAMS),
        "repeated_char_score": repeated_chars(sld),
        "tld_risk": tld_risk(host),
        "suspicious_keyword_score": keyword_hits("host", K.PHISH_KEYWORDS) / len(K.PHISH_KEYWORDS),
        "max_consec_cons": F.least(longest_consonant_run(sld) / 8, F.lit(1.0)),
        "unique_char_ratio": distinct_chars(sld) / _size(sld),
        "hex_char_ratio": share_of_chars(sld, "0123456789abcdef"),
        "char_continuity": char_continuity(sld),
    }
