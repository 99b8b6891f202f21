"""Toxicity of texts by a support vector machine on a gapped subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlake.llm.common import BASE, labelled_sample, logistic_scale, map_slices, text_bytes, word_hashes, words_of
from domainlake.session import written

#: Decay of the kernel for each character a subsequence spans, and the longest span.
DECAY, SPAN = 0.6, 9
#: Longer words are read by windows of a landmark with so many gaps, one every STEP, in sections of SECTION
#: bytes that count as sentences.
LONG, GAPS, STEP, SECTION = 32, 4, 4, 64
#: Documents of each label to learn from, at most.
SAMPLE = {1: 4000, 0: 8000}
LANDMARKS, CANDIDATES = 64, 600
_LETTERS = re.compile(r"[^\W\d_]+")


def _alphabet() -> np.ndarray:
    """Code of every byte: letters without case, digits as the letters they are written for, others."""
    codes = np.zeros(256, dtype=np.int64)
    for c in range(26):
        codes[[97 + c, 65 + c]] = c + 1
    for digit, letter in zip(b"0134578@", b"oieastba"):
        codes[digit] = letter - 96
    codes[0x80:] = 27 + np.arange(128) % 37
    return codes


CODES = _alphabet()


def folded(data: np.ndarray) -> np.ndarray:
    """Codes of UTF-8 bytes; Latin capitals with accents count as small ones."""
    data = data.copy()
    capital = np.zeros(len(data), dtype=bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    data[capital] += 0x20
    return CODES[data]


def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j < k within SPAN of each other, and the decayed weight of each triple."""
    i, j, k = (x.ravel() for x in np.meshgrid(np.arange(length), np.arange(SPAN), np.arange(SPAN), indexing="ij"))
    fits = (j > 0) & (k > j) & (i + k < length)
    at = np.stack([i, i + j, i + k])[:, fits]
    return at, (DECAY ** (at[2] - at[0] - 2)).astype(np.float32)


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def coded_triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all subsequences of three characters of each row, and their weights (by column).

    A code of zero (punctuation) is a gap, never a member; its number is zero.
    """
    length = codes.shape[1]
    if length not in _TRIPLES:
        if len(_TRIPLES) > 200:
            _TRIPLES.clear()
        _TRIPLES[length] = triples(length)
    at, weights = _TRIPLES[length]
    a, b, c = codes[:, at[0]], codes[:, at[1]], codes[:, at[2]]
    return np.where((a > 0) & (b > 0) & (c > 0), (a << 12) | (b << 6) | c, 0), weights


def windows(lengths: np.ndarray, reach: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, begin within it, and length of every window of at most `reach` over words of these lengths.

    A word of up to `reach` is one window. The windows of a longer one begin every `step`, and the last
    one ends with the word.
    """
    more = np.maximum(0, -(-(lengths - reach) // step))
    word = np.repeat(np.arange(len(lengths)), more + 1)
    begins = (np.arange(len(word)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)) * step
    begins = np.minimum(begins, np.maximum(0, lengths[word] - reach))
    return word, begins, np.minimum(lengths[word], reach)


@dataclass
class Kernel:
    """Kernel values of words against fixed landmark strings, relative to each landmark's own."""

    landmarks: list[str]

    def __post_init__(self):
        maps = []
        for t in self.landmarks:
            numbers, weights = coded_triples(folded(np.frombuffer(t.encode(), dtype=np.uint8))[None, :])
            found: Counter = Counter()
            for n, w in zip(numbers[0].tolist(), weights.tolist()):
                if n:
                    found[n] += w
            maps.append(found)
        known = sorted({n for m in maps for n in m})
        sizes = np.array([len(t.encode()) for t in self.landmarks])
        bounds = zip((0, 5, 7, 10, 16), (5, 7, 10, 16, 1 << 30))
        groups = [np.flatnonzero((sizes > a) & (sizes <= b)) for a, b in bounds]
        #: Landmarks of about one size, and the window that holds them with gaps at any place between two steps.
        self.groups = [(g, int(sizes[g].max()) + GAPS + STEP - 1) for g in groups if len(g)]
        self.index = np.full(1 << 18, -1, dtype=np.int32)
        self.index[known] = np.arange(len(known))
        self.rows = np.zeros((len(known), len(maps)), dtype=np.float32)
        self.held = np.zeros_like(self.rows)
        for k, m in enumerate(maps):
            own = sum(w * w for w in m.values()) or 1.0
            for n, w in m.items():
                self.rows[self.index[n], k] = w / own
                self.held[self.index[n], k] = w

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Kernel of every word with every landmark, at most 1, squared to part matches from chance.

        A word longer than LONG has the largest kernel of its windows, each as long as a landmark with gaps,
        so that chance triples don't add up over its length.
        """
        out = np.zeros((len(starts), len(self.landmarks)), dtype=np.float32)
        sizes = ends - starts
        short, long = np.flatnonzero(sizes <= LONG), np.flatnonzero(sizes > LONG)
        self._windows(out, data, short, starts[short], sizes[short], np.arange(len(self.landmarks)))
        for columns, reach in self.groups:
            word, begins, lengths = windows(sizes[long], reach, STEP)
            self._windows(out, data, long[word], starts[long[word]] + begins, lengths, columns, capped=True)
        return np.minimum(out, 1.0) ** 2

    def _windows(self, out, data, word, begins, lengths, columns, capped=False):
        """Raise the kernels of words (ascending) with some landmarks to the largest of their windows.

        If `capped`, a triple counts at most as much as the landmark itself holds of it.
        """
        rows, held = self.rows[:, columns], self.held[:, columns]
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            m = int(lengths[group[0]]) if len(group) else 0
            if m < 3:
                continue
            per = max(1, (1 << 17) // (m * SPAN * SPAN // 2))
            for a in range(0, len(group), per):
                part = group[a : a + per]
                numbers, weights = coded_triples(data[begins[part][:, None] + np.arange(m)])
                found = self.index[numbers]
                window, triple = np.nonzero(found >= 0)
                if not len(window):
                    continue
                number, weight = found[window, triple], weights[triple]
                if capped:
                    both, which = np.unique(window * len(rows) + number, return_inverse=True)
                    window, number = np.divmod(both, len(rows))
                    weight = np.bincount(which, weight).astype(np.float32)
                    terms = rows[number] * np.minimum(weight[:, None], held[number])
                else:
                    terms = rows[number] * weight[:, None]
                first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
                sums, of = np.add.reduceat(terms, first, axis=0), word[part][window[first]]
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                at = np.ix_(of[first], columns)
                out[at] = np.maximum(out[at], np.maximum.reduceat(sums, first, axis=0))

    def sentences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and features of every sentence that has a word near a landmark.

        A feature is the largest kernel of the sentence's words with a landmark. Characters that are no
        letters don't separate letters of a word, and words of one letter in a row count as one word
        besides, so that marked or spaced-out words are seen. Sections of a long word without spaces count
        as sentences: it is as long as many words, and its matches don't stand together.
        """
        data, starts, ends, first = words_of(_spaced_joined(texts))
        none = np.zeros(0, dtype=np.int64), np.zeros((0, len(self.landmarks)), dtype=np.float32)
        if not len(starts):
            return none
        codes = folded(data)
        letters = np.concatenate([[0], np.cumsum(codes > 0)])
        begins, ends_in = letters[starts], letters[ends]
        # Long words go by sections, which overlap by half so that no landmark is cut.
        word, at, sizes = windows(ends_in - begins, SECTION, SECTION // 2)
        hashes = word_hashes(data, starts, ends)[word] + at.astype(np.uint64) * np.uint64(BASE)
        _, once, which = np.unique(hashes, return_index=True, return_inverse=True)
        own = begins[word[once]] + at[once]
        values = self.words(codes[codes > 0], own, own + sizes[once])
        strong = values.max(axis=1) > 0.05
        hits = np.flatnonzero(strong[which])
        if not len(hits):
            return none
        closes = np.isin(data[ends - 1], np.frombuffer(b".!?", dtype=np.uint8)) | (data[np.minimum(ends, len(data) - 1)] == 10)
        closes = closes[word] | np.concatenate([word[1:] == word[:-1], [False]])
        sentence = np.concatenate([[0], np.cumsum(closes)])[hits]
        doc = np.searchsorted(first, word[hits], side="right") - 1
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])]))
        return doc[new], np.maximum.reduceat(values[which[hits]], new, axis=0)


_SINGLES = re.compile(rb"(?<![^\s])[^\s\x80-\xff](?:[\x20\t][^\s\x80-\xff](?![^\s])){2,}")


def _spaced_joined(texts: list[bytes]) -> list[bytes]:
    out = []
    for text in texts:
        joined = [m[0].replace(b" ", b"").replace(b"\t", b"") for m in _SINGLES.finditer(text)]
        out.append(b" ".join([text, *joined]) if joined else text)
    return out


def substrings_of(text: str) -> set[str]:
    """Words and beginnings of words, in small letters: what landmarks are chosen from."""
    words = set(_LETTERS.findall(text.lower()))
    out = {w for w in words if 4 <= len(w) <= 16}
    for n in (4, 5, 6, 7):
        out |= {w[:n] for w in words if len(w) > n}
    return out


def candidate_landmarks(sample: DataFrame, most: int) -> list[str]:
    """The strings that tell toxic from other documents best, by their document counts in the sample."""

    def work(batch):
        counts: dict[str, list[int]] = {}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            for s in substrings_of(text):
                counts.setdefault(s, [0, 0])[1 if label else 0] += 1
        columns = [list(counts), [c[1] for c in counts.values()], [c[0] for c in counts.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["s", "toxic", "clean"])

    counts = map_slices(sample.select("text", "label"), "text", work, "s string, toxic long, clean long", 16 << 20, tidy=True)
    totals = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    positive, negative = (max(1, t or 0) for t in totals)
    rows = counts.groupBy("s").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t >= 2")
    # Lower end of the share among toxic documents against the upper end among the others.
    share = lambda n, total, sign: (F.col(n) + sign * F.sqrt(F.col(n) + 0.5)) / total
    score = share("t", positive, -1) - 3 * share("c", negative, 1)
    top = rows.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), "s").limit(most)
    return [r["s"] for r in top.collect()]


def covering(held: np.ndarray, labels: np.ndarray, strings: list[str], most: int) -> list[int]:
    """Columns of a document-by-string table that together cover the toxic documents, each several times.

    Of strings that cover as much, longer ones are taken: chance matches them less.
    """
    longer = 1 + 0.03 * np.array([len(s) for s in strings])
    need = np.where(labels > 0, 4.0, 0.0)
    clean = held[labels == 0].sum(axis=0) * (need.sum() / max(1.0, (labels == 0).sum() * 4.0))
    chosen: list[int] = []
    for _ in range(min(most, held.shape[1])):
        gain = (need @ held - 2 * clean) * longer
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        chosen.append(best)
        need = np.maximum(0, need - held[:, best])
    return chosen


@dataclass
class Model:
    kernel: Kernel
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    scale: tuple[float, float]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Score of every text: that of its worst sentence."""
        margins = np.full(len(texts), self.bias)
        doc, z = self.kernel.sentences(texts)
        if len(doc):
            np.maximum.at(margins, doc, z @ self.whiten @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * margins + self.scale[1], -30, 30)))


def fit_svm(x: np.ndarray, labels: np.ndarray, penalty: float = 10.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss and balanced classes, by Newton steps."""
    y = np.where(labels > 0, 1.0, -1.0)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * penalty * 100
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    active = None
    for _ in range(steps):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        xa, ca = x[active], cost[active]
        w = np.linalg.solve((xa * ca[:, None]).T @ xa + ridge, xa.T @ (ca * y[active]))
    return w[:-1], float(w[-1])


def _features(sample: DataFrame, kernel: Kernel, most: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, label and features of the `most` strongest sentences of every document of the sample.

    A document without such sentences has one of zeros. The sample and `most` bound what the driver gets.
    """
    zeros = np.zeros((1, len(kernel.landmarks)), dtype=np.float32)

    def work(batch):
        doc, z = kernel.sentences(text_bytes(batch.column("text")))
        rows = []
        for k in range(batch.num_rows):
            own = z[doc == k]
            own = own[np.argsort(-own.max(axis=1), kind="stable")[:most]] if len(own) else zeros
            rows += [(k, v.tobytes()) for v in own]
        at = pa.array([k for k, _ in rows])
        raw = pa.array([v for _, v in rows], pa.binary())
        columns = [batch.column("doc_id").take(at), batch.column("label").take(at), raw]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "raw"])

    rows = map_slices(sample, "text", work, "doc_id long, label int, raw binary", tidy=True)
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["raw"]))
    values = np.stack([np.frombuffer(r["raw"], dtype=np.float32) for r in rows]).astype(float)
    return np.array([r["doc_id"] for r in rows]), np.array([r["label"] for r in rows]), values


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, landmarks: int = LANDMARKS):
    """Model from the labelled documents that are not held out, up to `sample` of each label.

    Landmarks are the words and beginnings of words that cover the sample's toxic documents best. None if
    the sample has no toxic document or nothing tells them apart.
    """
    rows = labelled_sample(docs, labels, "toxic", sample or SAMPLE)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    chosen = written(rows, "toxicity-sample")
    strings = candidate_landmarks(chosen, CANDIDATES)
    if not strings:
        return None
    held, truth = _held(chosen, strings)
    kernel = Kernel([strings[k] for k in covering(held, truth, strings, landmarks)] or strings[:landmarks])
    doc, truth, z = _features(chosen, kernel)
    gram = _word_features(kernel, kernel.landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 0.1 * np.eye(len(gram)))
    whiten = vectors @ np.diag(np.maximum(values, 0.05) ** -0.5) @ vectors.T
    x = z @ whiten
    # A toxic document has a toxic sentence, but which one is learnt: first the one nearest to a landmark,
    # then the one that the machine fitted so far finds worst. All sentences of other documents are clean.
    strength = z.max(axis=1)
    for _ in range(4):
        worst = np.lexsort((-strength, doc))
        worst = worst[np.concatenate([[True], doc[worst][1:] != doc[worst][:-1]])]
        used = np.concatenate([worst[truth[worst] > 0], np.flatnonzero(truth == 0)])
        weights, bias = fit_svm(x[used], truth[used])
        strength = x @ weights + bias
    worst = np.lexsort((-strength, doc))
    worst = worst[np.concatenate([[True], doc[worst][1:] != doc[worst][:-1]])]
    return Model(kernel, whiten, weights, bias, logistic_scale(strength[worst], truth[worst]))


def _word_features(kernel: Kernel, words: list[str]) -> np.ndarray:
    """Kernel of some words with every landmark."""
    raw = "\n".join(words).encode()
    _, starts, ends, _ = words_of([raw])
    return kernel.words(folded(np.frombuffer(raw, dtype=np.uint8)), starts, ends).astype(float)


def _held(sample: DataFrame, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the strings every document of the sample holds, and the labels; bounded by both."""
    place = {s: k for k, s in enumerate(strings)}

    def work(batch):
        found = [[place[s] for s in substrings_of(t) if s in place] for t in batch.column("text").to_pylist()]
        names = ["doc_id", "label", "found"]
        columns = [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = map_slices(sample, "text", work, "doc_id long, label int, found array<int>", tidy=True)
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    held = np.zeros((len(rows), len(strings)))
    for k, r in enumerate(rows):
        held[k, r["found"]] = 1
    return held, np.array([r["label"] for r in rows])


def score_toxicity(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of every whole text; without a model every score is 0.

    A null text is empty, and an empty text scores like one without any match. All rows and columns are
    kept; a column of that name is replaced. An empty table gives an empty table.
    """
    rows = docs.drop(name)
    if model is None:
        return rows.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and weights: a few hundred KB

    def work(batch):
        scores = shared.value.scores(text_bytes(batch.column("text"))).astype(float)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return map_slices(rows, "text", work, rows.withColumn(name, F.lit(0.0)).schema, 1 << 20, tidy=True)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows whose text scores `threshold` or more, learnt from `labels(doc_id, toxic)`."""
    plain = docs.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)])
    kept = score_toxicity(plain, fit_toxicity(docs, labels)).where(F.col("score") < threshold).drop("score")
    return kept.toDF(*docs.columns)
