"""Fingerprints and neighbour votes against versions in plain Python, one item at a time."""

import random
import re
from collections import Counter

import numpy as np
import xxhash

from domainlake.llm import fingerprints, quality, simhash
from domainlake.llm.common import mix, word_hashes, word_spans

WRAP = (1 << 64) - 1
EDGES = ["", " \t\n", "one", "One Two", "a b c", "A b C", "É é ç", "x" * 5000, "word " * 3000, "tab\tline\nfeed\x0b\x0c\rend", "non breaking space"]


def some_texts(n=60, seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgÀé-.,Z", k=rng.randrange(1, 9))) for _ in range(40)]
    return [rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randrange(0, 90))) for _ in range(n)] + EDGES


def plain_simhash(text):
    lowered = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    spans = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_of_plain_shingles():
    for text in some_texts():
        assert simhash.fingerprint(text.encode()) == plain_simhash(text), text[:40]


def one(x):
    return int(mix(np.array([x & WRAP], dtype=np.uint64))[0])


def plain_order_minhash(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = [int(h) for h in word_hashes(data, *word_spans(data))] if text.split() else []
    if not words:
        return [0] * fingerprints.FUNCTIONS
    seeds = [int(s) for s in fingerprints._SEEDS]
    k = min(fingerprints.KMER, len(words))
    seen, kmers = Counter(), []
    for a in range(len(words) - k + 1):
        h = one(sum(words[a + i] * seeds[i] for i in range(k)))
        kmers.append(one(h + seen[h] * seeds[fingerprints.KMER]))
        seen[h] += 1
    out = []
    for f in range(fingerprints.FUNCTIONS):
        order = sorted(range(len(kmers)), key=lambda i: ((kmers[i] ^ seeds[fingerprints.FUNCTIONS + f]) * (seeds[f] | 1) & WRAP, i))
        least = (order[: fingerprints.TUPLE] + [order[min(len(order), fingerprints.TUPLE) - 1]] * fingerprints.TUPLE)[: fingerprints.TUPLE]
        value = 0
        for i in sorted(least):
            value = one(value * 31 + kmers[i])
        out.append(value >> 48)
    return out


def test_order_minhash_of_plain_kmers():
    for text in some_texts(20):
        if len(text) < 4000:
            assert fingerprints.order_minhash(text.encode()).tolist() == plain_order_minhash(text), text[:40]


def test_order_minhash_reacts_to_order():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    moved = words[100:] + words[:100]
    shuffled = rng.sample(words, 200)
    likeness = [fingerprints.likeness(*(fingerprints.order_minhash(" ".join(w).encode()) for w in (words, x))) for x in (words, moved, shuffled)]
    assert likeness[0] == 1 and 0.2 < likeness[1] < 0.95 and likeness[2] < 0.1


def test_votes_of_plain_neighbours():
    rng = np.random.default_rng(5)
    texts = [t.encode() for t in some_texts(40)]
    weights = rng.random(quality.TERMS).astype(np.float32)
    axes = np.linalg.qr(rng.normal(size=(quality.TERMS, 6)))[0].astype(np.float32)
    labels = rng.integers(0, 2, 30).astype(float)
    vectors = quality.unit(rng.normal(size=(30, 6)).astype(np.float32))
    model = quality.Neighbours(weights, axes, vectors, labels, nearest=7)
    got = model.scores(texts, block=11)
    for text, score in zip(texts, got):
        own = model.project(quality.term_counts([text]))[0].astype(float)
        if not np.linalg.norm(own):
            assert score == labels.mean()
            continue
        cosines = [float(own @ v) for v in vectors.astype(float)]
        nearest = sorted(range(30), key=lambda k: -cosines[k])[:7]
        votes = {k: max(0.0, cosines[k]) ** 4 for k in nearest}
        assert abs(score - sum(v for k, v in votes.items() if labels[k]) / sum(votes.values())) < 1e-4
