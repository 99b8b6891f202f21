"""Brand similarity: edit distance and Jaro-Winkler as native expressions.

Brands are a short fixed list, so all comparisons of a label stay inside its own row: no
explode, no join and no shuffle. The longer formulas are SQL text over named columns.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from domainlake.constants import BRANDS

FAR = 99
LETTERS = "abcdefghijklmnopqrstuvwxyz"
TAKEN = chr(0xFFFF)  # a noncharacter: marks positions of the brand that are already matched


def min_distance(label: str, brands: list[str], within: int = 4) -> Column:
    """Smallest edit distance to any brand, FAR (99) when it exceeds `within`.

    The bounded distance stops early and gives -1 beyond the bound, which pmod turns into FAR.
    """
    bounded = [f"pmod(levenshtein({label}, '{b}', {within}), {FAR + 1})" for b in brands]
    return F.expr(f"least({', '.join(bounded)})")


def lookalike_score(distance: Column) -> Column:
    """1.0 for distance 1-2; 0.5 for 3-4 and also for an exact brand; else 0."""
    return (
        F.when((distance > 0) & (distance <= 2), 1.0).when(distance <= 4, 0.5).otherwise(0.0)
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL text that evaluates `value` once and uses it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def jaro_winkler(label: str, brand: str) -> str:
    """SQL text: Jaro-Winkler similarity of two named columns or variables.

    Walk over the label; each character takes the first equal, untaken brand character inside the
    matching window. Taken brand characters are overwritten, so the state is two strings: what is
    left of the brand, and the matched label characters in order. The bonus counts equal positions
    among the first four, not only the contiguous common prefix.
    """
    n, m = f"length({label})", f"length({brand})"
    reach = f"cast(greatest(greatest({n}, {m}) div 2 - 1, 0) as int)"
    low = f"greatest(i - {reach}, 1)"
    width = f"greatest(least(i + {reach}, {m}) - {low} + 1, 0)"
    taken = (
        f"named_struct('rest', overlay(s.rest placing '{TAKEN}' from {low} + at - 1 for 1), "
        f"'hit', concat(s.hit, substring({label}, i, 1)))"
    )
    step = _let(
        "at",
        f"instr(substring(s.rest, {low}, {width}), substring({label}, i, 1))",
        f"if(at > 0, {taken}, s)",
    )
    theirs = (
        f"array_join(transform(sequence(1, {m}), j -> if(substring(s.rest, j, 1) = '{TAKEN}', "
        f"substring({brand}, j, 1), '')), '')"
    )
    swaps = (
        "size(filter(sequence(1, length(s.hit)), "
        "j -> substring(s.hit, j, 1) <> substring(theirs, j, 1)))"
    )
    jaro = (
        f"(length(s.hit) / {n} + length(s.hit) / {m} + "
        f"(length(s.hit) - {swaps} / 2) / length(s.hit)) / 3"
    )
    same = " + ".join(
        f"if({m} >= {i} and substring({label}, {i}, 1) = substring({brand}, {i}, 1), 1, 0)"
        for i in range(1, 5)
    )
    bonus = _let("jaro", _let("theirs", theirs, jaro), f"jaro + ({same}) * 0.1D * (1 - jaro)")
    walk = (
        f"aggregate(sequence(1, {n}), named_struct('rest', {brand}, 'hit', ''), (s, i) -> {step}, "
        f"s -> if(s.hit = '', 0.0D, {bonus}))"
    )
    return f"case when {label} = {brand} then 1.0D when '' in ({label}, {brand}) then 0.0D else {walk} end"


def letter_mask(label: str) -> Column:
    """One bit per letter a-z that occurs in the label."""
    bits = [f"if(contains({label}, '{ch}'), {1 << i}, 0)" for i, ch in enumerate(LETTERS)]
    return F.expr(" + ".join(bits))


def _may_exceed(label: str, size: str, mask: str, brand: str, floor: float) -> str:
    """SQL text: cheap necessary condition for a similarity above `floor`.

    A letter that occurs on one side only matches nothing, so the letter masks bound the number k of
    matches on both sides. The Jaro part is then at most J = (k / n + k / m + 1) / 3, and the result
    at most 1 - (1 - bonus) * (1 - J) with a bonus of 0.1 per equal leading character. The first test
    assumes all four and needs no division; the slack keeps rounding from excluding a match.
    """
    m = len(brand)
    theirs = sum(1 << LETTERS.index(ch) for ch in set(brand) if ch in LETTERS)
    k = f"least({size} - bit_count({mask} & {~theirs}), {m} - bit_count(~{mask} & {theirs}))"
    least_jaro = 1 - (1 - floor) / 0.6 - 1e-9
    same = " + ".join(
        f"if(substring({label}, {i}, 1) = '{ch}', 1, 0)" for i, ch in enumerate(brand[:4], 1)
    )
    bound = f"({k} * (1.0D / {size} + {1 / m!r}D) + 1) / 3"
    return (
        f"{k} * ({size} + {m}) > {(3 * least_jaro - 1) * m!r}D * {size} "
        f"and (1 - 0.1D * ({same})) * (1 - {bound}) < {1 - floor + 1e-9!r}D"
    )


def near_brands(
    label: str, size: str, mask: str, brands: list[str] = BRANDS, floor: float = 0.85
) -> Column:
    """Comma-separated brands that may be more similar than `floor`; '' for almost every label.

    `size` and `mask` are columns with the label's length and `letter_mask`. Compiled throughout.
    """
    tests = ", ".join(
        f"if({_may_exceed(label, size, mask, b, floor)}, '{b}', null)" for b in brands
    )
    return F.expr(f"concat_ws(',', {tests})")


def jaro_winkler_score(
    label: str, near: str, brands: list[str] = BRANDS, floor: float = 0.85
) -> Column:
    """Best similarity over the brands when it exceeds `floor` and the label is no brand, else 0.

    `near` is a column with the label's `near_brands`; only those are compared exactly.
    """
    exact = f"transform(split({near}, ','), b -> {jaro_winkler(label, 'b')})"
    best = F.expr(f"array_max(filter({exact}, s -> s > {floor!r}D))")
    skip = (F.col(near) == "") | F.col(label).isin(brands)
    return F.when(skip, 0.0).otherwise(F.coalesce(best, F.lit(0.0)))


def nearest_brand(label: Column, brands: list[str] = BRANDS) -> Column:
    """struct(distance, position, brand) of the closest brand; ties go to the earlier one."""
    return F.array_min(
        F.array(
            *[
                F.struct(
                    F.levenshtein(label, F.lit(b)).alias("distance"),
                    F.lit(i).alias("position"),
                    F.lit(b).alias("brand"),
                )
                for i, b in enumerate(brands)
            ]
        )
    )
