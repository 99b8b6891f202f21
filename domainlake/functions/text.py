"""String helpers shared by the column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point with the Unicode White_Space property plus the four ASCII separators.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
WHITESPACE_RUN = (
    "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
)


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends (`trim` alone only removes spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def part(c: Column, sep: str, n: int) -> Column:
    """n-th piece (1-based) of `c` split on a literal separator, '' when there is none."""
    return F.split_part(c, F.lit(sep), F.lit(n))


def after_last(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, -1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def round_exact(c: Column, places: int) -> Column:
    """Round on the exact binary value, ties to even; safe for values below 1000."""
    return F.format_number(c, places).cast("double")


def let(value: Column, body) -> Column:
    """Bind `value` once and use it in `body` without repeating its evaluation."""
    return F.transform(F.array(value), body)[0]


def any_of(words: list[str]) -> str:
    return "|".join(words)
