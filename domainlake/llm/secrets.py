"""Secrets in texts: fixed patterns, and tokens that a battery of tests can't tell from random ones."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domainlake.llm.common import map_slices, text_bytes, words_of
from domainlake.session import written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
TOKEN = re.compile(rb"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Shortest token any of the patterns within a word can match.
LEAST = 20
#: Alphabets by size, the first that holds every character of a token is its encoding.
ALPHABETS = (
    b"0123456789abcdef",
    b"0123456789ABCDEF",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    b"0123456789abcdefghijklmnopqrstuvwxyz",
    b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_",
)
_CODES = np.full((len(ALPHABETS), 256), -1, dtype=np.int64)
for _k, _letters in enumerate(ALPHABETS):
    _CODES[_k, list(_letters)] = np.arange(len(_letters))
#: Steps of a p-value's level for each halving, and the highest level.
STEPS, TOP = 8, 512


def encoding(token: bytes) -> tuple[int, np.ndarray] | None:
    """Number of the token's alphabet and its symbols; None for words and numbers.

    A token in an encoding has digits and letters both, which prose words and plain numbers have not.
    """
    body = token.rstrip(b"=")
    if not (any(48 <= c <= 57 for c in body) and any(c >= 65 and c not in b"_" for c in body)):
        return None
    raw = np.frombuffer(body, dtype=np.uint8)
    for k, codes in enumerate(_CODES):
        symbols = codes[raw]
        if symbols.min() >= 0:
            return k, symbols
    return None


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity_p(symbols: np.ndarray, letters: int) -> float:
    """Chi-squared test of equal use of all letters, upper tail by the cube-root approximation.

    A token has fewer symbols than letters at times, so the statistic's own variance for the length is
    matched by scaling its degrees of freedom.
    """
    n = len(symbols)
    counts = np.bincount(symbols, minlength=letters)
    chi2 = float(((counts - n / letters) ** 2).sum() * letters / n)
    mean, variance = letters - 1, 2 * (letters - 1) * (n - 1) / n
    scale = variance / (2 * mean)
    degrees = mean / scale
    z = ((chi2 / scale / degrees) ** (1 / 3) - (1 - 2 / (9 * degrees))) / math.sqrt(2 / (9 * degrees))
    return _upper_tail(z)


def runs_p(symbols: np.ndarray) -> float:
    """Two-sided test of the number of runs above and below the median."""
    above = symbols > np.median(symbols)
    a, n = int(above.sum()), len(symbols)
    b = n - a
    if not a or not b:
        return 0.0
    mean = 1 + 2 * a * b / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    if variance <= 0:
        return 0.0
    runs = 1 + int((above[1:] != above[:-1]).sum())
    return min(1.0, 2 * _upper_tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(variance)))


def serial_p(symbols: np.ndarray) -> float:
    """Two-sided test of the correlation of neighbouring symbols."""
    x = symbols - symbols.mean()
    total = float((x * x).sum())
    if not total:
        return 0.0
    n = len(x)
    r = float((x[1:] * x[:-1]).sum()) / total
    return min(1.0, 2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n)))


def randomness_p(symbols: np.ndarray, letters: int) -> float:
    """p-value of the battery for "random over its alphabet": the least of three, times three."""
    least = min(uniformity_p(symbols, letters), runs_p(symbols), serial_p(symbols))
    return min(1.0, 3 * least)


def level(p: float) -> int:
    """Step of a p-value on the grid that false-discovery counts are kept by; higher is less random."""
    return min(TOP, int(-math.log2(p) * STEPS)) if p > 0 else TOP


def scan(text: bytes, words: list[tuple[int, int]]):
    """(base spans, candidate tokens) of one text; `words` are the spans of its words of LEAST bytes or more.

    Base spans are (start, kind, end), candidates (start, end, band, level, covered), all in bytes.
    """
    base = []
    if b"=" in text or b":" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    tokens = []
    for a, b in words:
        word = text[a:b]
        base += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(word) if len(m[0]) >= 20]
        base += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(word)]
        for m in TOKEN.finditer(word):
            if found := encoding(m[0]):
                tokens.append((a + m.start(), a + m.end(), *found))
    base.sort()
    candidates = []
    for a, b, kind, symbols in tokens:
        grade = level(randomness_p(symbols, len(ALPHABETS[kind])))
        band = kind * 32 + int(math.log2(len(symbols)))
        candidates.append((a, b, band, grade, any(a < end and start < b for start, _, end in base)))
    return base, candidates


def scan_all(texts: list[bytes]):
    """`scan` of every text, with spans in code points."""
    _, starts, ends, first = words_of(texts)
    begin = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))])
    long_ = np.flatnonzero(ends - starts >= LEAST)
    cut = np.searchsorted(long_, first)
    for k, text in enumerate(texts):
        own = long_[cut[k] : cut[k + 1]]
        words = list(zip((starts[own] - begin[k]).tolist(), (ends[own] - begin[k]).tolist()))
        base, candidates = scan(text, words)
        if (base or candidates) and not text.isascii():
            point = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)]).tolist()
            base = [(point[a], kind, point[b]) for a, kind, b in base]
            candidates = [(point[a], point[b], *rest) for a, b, *rest in candidates]
        yield base, candidates


def thresholds(levels: DataFrame, alpha: float) -> dict[int, int]:
    """Of each band of `levels(band, level)`, the least level that counts as not random.

    Benjamini-Hochberg within each band (an encoding and a doubling of the length), so that long tokens,
    whose tests are sharp, don't decide about short ones. Counts cover every token of every document; the
    driver sees one row for each band.
    """
    counts = levels.groupBy("band", "level").agg(F.count("*").alias("n"))
    from_here = Window.partitionBy("band").orderBy(F.col("level").desc())
    counts = counts.withColumn("up", F.sum("n").over(from_here)).withColumn(
        "all", F.sum("n").over(Window.partitionBy("band"))
    )
    passed = F.pow(F.lit(2.0), -F.col("level") / STEPS) <= alpha * F.col("up") / F.col("all")
    least = counts.groupBy("band").agg(F.min(F.when(passed, F.col("level"))).alias("least"))
    return {r["band"]: TOP + 1 if r["least"] is None else r["least"] for r in least.collect()}


def _candidates(docs: DataFrame) -> DataFrame:
    """(band, level) of every candidate token of every document."""

    def work(batch):
        found = [c for _, cs in scan_all(text_bytes(batch.column("text"))) for c in cs]
        columns = [pa.array([c[k] for c in found], pa.int32()) for k in (2, 3)]
        return pa.RecordBatch.from_arrays(columns, names=["band", "level"])

    return map_slices(docs.select("text"), "text", work, "band int, level int")


def secret_spans(docs: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(doc_id, base, added) of every row of `docs(doc_id, text)`: arrays of (start, kind, end).

    base holds the matches of the three fixed patterns, added the tokens that overlap none of them and
    that the battery takes for random at false-discovery rate `alpha`. Kinds are indexes into KINDS.
    Offsets are code points. A null text is empty; empty arrays mean no secrets. Rows with equal or null
    doc_id are scanned one by one; other columns are ignored; an empty table gives an empty table.
    """
    span = "array<struct<start: int, kind: int, end: int>>"
    token = "array<struct<start: int, end: int, band: int, level: int, covered: boolean>>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    token_type = pa.list_(
        pa.struct(
            [("start", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("level", pa.int32())]
            + [("covered", pa.bool_())]
        )
    )

    def work(batch):
        found = list(scan_all(text_bytes(batch.column("text"))))
        base = pa.array([[dict(zip(("start", "kind", "end"), s)) for s in b] for b, _ in found], span_type)
        names = ("start", "end", "band", "level", "covered")
        tokens = pa.array([[dict(zip(names, c)) for c in cs] for _, cs in found], token_type)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), base, tokens], names=["doc_id", "base", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, base {span}, tokens {token}"
    rows = written(map_slices(docs.select("doc_id", "text"), "text", work, schema), "secrets")
    limits = thresholds(rows.select(F.explode("tokens").alias("t")).select("t.band", "t.level"), alpha)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else None
    added = F.expr("filter(tokens, t -> false)") if limit is None else F.filter(
        "tokens", lambda t: ~t["covered"] & (t["level"] < limit[t["band"]])
    )
    added = F.transform(
        added, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"))
    )
    return rows.select("doc_id", "base", added.alias("added"))


def spans_column(spans) -> F.Column:
    """Spans as text kind:start:end by start, then kind."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"]),
        ),
        ",",
    )


def redact_secrets(docs: DataFrame, alpha: float = 0.01, mask: str = "<secret>") -> DataFrame:
    """`docs` with every secret span of `text` replaced by `mask`; n_chars, where there, is counted anew.

    Overlapping spans are replaced together; of an assignment only the value goes. A null text stays
    null, and a text without secrets stays as it is. All rows and columns are kept.
    """
    limits = thresholds(_candidates(docs), alpha)
    names = docs.columns

    def work(batch):
        texts = batch.column("text").to_pylist()
        found = scan_all([(t or "").encode() for t in texts])
        for k, (base, candidates) in enumerate(found):
            spans = [(a, b) for a, _, b in base]
            spans += [(a, b) for a, b, band, grade, _ in candidates if grade < limits.get(band, TOP + 1)]
            if spans:
                texts[k] = _masked(texts[k], sorted(spans), mask)
        columns = dict(zip(names, batch.columns))
        if "n_chars" in columns:
            counts = [None if t is None else len(t) for t in texts]
            columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
        columns["text"] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return map_slices(docs, "text", work, docs.schema, tidy=True)


def _masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    parts, at = [], 0
    for a, b in spans:
        name = ASSIGN.match(text[a:b].encode())
        if name and len(name[2]) >= 6:
            a = b - len(name[2])
        if b > at:
            if a >= at:
                parts += [text[at:a], mask]
            at = b
    return "".join([*parts, text[at:]])
