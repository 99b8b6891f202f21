"""URL and host normalisation as native column expressions.

None of these use `parse_url`: it rejects hosts with underscores, which are common in DNS names.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from domainlake.constants import REDIRECT_PARAMS, ZERO_WIDTH
from domainlake.functions.text import after_last, blank_to_null, let, part, strip

# Characters whose compatibility form contains one of / ? # @ : make an authority invalid, and so
# does a bracket without its partner.
CONFUSABLE_DELIMITERS = (
    "\\u2047-\\u2049\\u2100\\u2101\\u2105\\u2106\\u2a74\\ufe13\\ufe16\\ufe55\\ufe56\\ufe5f\\ufe6b"
    "\\uff03\\uff0f\\uff1a\\uff1f\\uff20"
)
END = "(?:[/?#]|\\z)"
AUTHORITY = (
    "^[A-Za-z][A-Za-z0-9+.-]*://"
    f"(?![^/?#]*[{CONFUSABLE_DELIMITERS}])"
    f"(?![^/?#\\]]*\\[[^/?#\\]]*{END})(?![^/?#\\[]*\\][^/?#\\[]*{END})"
    "([^/?#]*)"
)
QUERY = "^[^?#]*\\?([^#]*)"
# Text after the first '://' (or all of it), up to the next '://' or '/'.
NAMED_HOST = "(?:.*?://)?((?:(?!://)[^/])*)"
CONTROL_OR_SPACE = "".join(map(chr, range(0x21)))


def percent_decode(c: Column) -> Column:
    """Decode %XX as UTF-8; keeps '+' and malformed escapes as they are."""
    well_formed = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(well_formed, F.lit("+"), F.lit("%2B")))


def authority(url: Column) -> Column:
    """The text between '://' and the first of / ? #, '' when it cannot be a host."""
    cleaned = F.translate(F.ltrim(url, F.lit(CONTROL_OR_SPACE)), "\t\r\n", "")
    return F.regexp_extract(cleaned, AUTHORITY, 1)


def _host_in(url: Column) -> Column:
    return part(after_last(authority(url), "@"), ":", 1)


def host_of_url(c: Column) -> Column:
    """Full normalisation of a feed URL: decode, drop user info, port and outer dots."""
    url = F.regexp_replace(percent_decode(strip(c)), "^(?!http)", "http://")
    return F.btrim(F.lower(_host_in(url)), F.lit("."))


def host_of_feed_line(c: Column) -> Column:
    """Blocklist-feed variant: keeps user info, so `http://u:p@h/` gives `u`."""
    host = F.regexp_extract(strip(c), "(?s)^(?:(?=.*://)[^/]*/[^/]*/)?([^/]*)", 1)
    return F.lower(part(host, ":", 1))


def host_of_domain(c: Column) -> Column:
    """Feature variant: lower, strip, text after the first '://' and before '/'."""
    return F.regexp_extract(strip(F.lower(c)), f"(?s)^{NAMED_HOST}", 1)


def host_of_training_line(c: Column) -> Column:
    """Training variant: NULL unless the host has a dot and more than three characters."""
    host = F.regexp_extract(strip(c), f"(?s)^(?!#){NAMED_HOST}", 1)
    return blank_to_null(F.lower(F.regexp_extract(host, "(?s)^(?=.*\\.).{4,}$", 0)))


def clean_host(c: Column) -> Column:
    """Strip masking tricks from a host: zero-width characters, user info, dots, scheme, port."""
    host = F.translate(F.lower(strip(c)), ZERO_WIDTH, "")
    host = F.rtrim(after_last(host, "@"), F.lit("."))
    host = F.regexp_replace(host, "^https?://", "")
    return part(part(host, "/", 1), ":", 1)


def _embedded_redirect(url: Column) -> Column:
    """First redirect target in the query by parameter precedence, NULL without one."""
    query = F.regexp_extract(url, QUERY, 1)
    return F.coalesce(
        *[
            blank_to_null(
                F.regexp_extract(
                    query, f"(?iu)(?:^|&){name}=(https?%3A%2F%2F[^&]+|https?://[^&]+)", 1
                )
            )
            for name in REDIRECT_PARAMS
        ]
    )


def unmask(c: Column) -> Column:
    """struct(final_domain, redirect_chain_length) after following embedded redirects.

    Every hop consumes one '=' of the current URL, and each such '=' was an '=' or part of a '%XX'
    escape in the raw text. The number of '=' and '%' therefore bounds the hops exactly, so the
    whole chain is followed without a fixed limit.
    """
    raw = strip(c)
    start = F.regexp_replace(percent_decode(raw), "^(?!https?://)", "http://")
    steps = F.length(raw) - F.length(F.translate(raw, "=%", ""))

    def state(url: Column, hops: Column, done: bool) -> Column:
        return F.struct(url.alias("url"), hops.alias("hops"), F.lit(done).alias("done"))

    def hop(now: Column, _: Column) -> Column:
        stay = state(now["url"], now["hops"], True)

        def follow(target: Column) -> Column:
            url = F.regexp_replace(percent_decode(target), "^(?!http)", "http://")
            return F.when(target.isNull(), stay).otherwise(state(url, now["hops"] + 1, False))

        return F.when(now["done"], now).otherwise(let(_embedded_redirect(now["url"]), follow))

    def result(last: Column) -> Column:
        return F.struct(
            F.lower(_host_in(last["url"])).alias("final_domain"),
            last["hops"].alias("redirect_chain_length"),
        )

    rounds = F.filter(F.sequence(F.lit(0), steps), lambda i: i > 0)
    return F.aggregate(rounds, state(start, F.lit(0), False), hop, result)


def visible_host(c: Column) -> Column:
    """What a reader takes for the host: the first characters after the scheme."""
    shown = F.regexp_replace(F.lower(strip(c)), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_extract(shown, "^([^@:/?#]*)", 1)


def is_punycode(c: Column) -> Column:
    return c.startswith("xn--")


def is_dotted_quad(c: Column) -> Column:
    """Four dot-separated digit groups; digits of any script, and one trailing line feed allowed."""
    return c.rlike("^\\p{Nd}+\\.\\p{Nd}+\\.\\p{Nd}+\\.\\p{Nd}+\\n?$")
