"""Min-hash near duplicates, spelling variants and conversation tries against brute force."""

import binascii
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from domainlake.llm import minhash, spelling, tries

NOISE = "doc_id long, text string, cls string, sig string, word string, n string, comp string"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "c", "s", "w", "n", "p") for k, t in rows], NOISE)


# ---------------------------------------------------------------- min-hash near duplicates


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2)))


def components(sets, percent=85):
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [top(k) for k in range(len(sets))]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.getrandbits(30)}"
    return out


def near_texts(rng):
    texts = []
    for k in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(words))
        for share in (0.003, 0.01, 0.02, 0.025, 0.03, 0.04):
            text = " ".join(edited(rng, words, round(share * len(words)) + 1))
            texts.append(text.upper() if k % 2 else text.replace(" ", " \t\n", 3))
    chain = [f"c{k}" for k in range(150)]
    for _ in range(30):  # each near the one before, not near the first
        chain = edited(rng, chain, 2)
        texts.append(" ".join(chain))
    hot = [f"h{k}" for k in range(120)]
    texts += [" ".join(edited(rng, hot, rng.randrange(1, 6))) for _ in range(80)] + [" ".join(hot)] * 20
    return texts + ["", None, " \n", "one", "ONE", "one two", "one  two", "ÉÀ " * 3, "éà " * 3, "x" * 200000, "word " * 30000, "word " * 3]


@pytest.mark.parametrize("small", [False, True])
def test_min_hash_components_equal_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, many tiles
        monkeypatch.setattr(minhash, "SIGNED", 7)
        monkeypatch.setattr(minhash, "LOADED", 3)
    texts = near_texts(random.Random(8))
    sets = [shingles(t) for t in texts]
    want = {k: (len(s), r, k == r) for k, (s, r) in enumerate(zip(sets, components(sets)))}
    rows = minhash.min_hash_components(documents(spark, enumerate(texts)).repartition(5))
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows.collect()}
    assert got == want
    assert len({r for _, r, _ in want.values()}) < len(texts) - 150


def test_min_hash_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (5, "q r s"), (3, "q r s"), (None, "alone here now"), (None, None), (9, "")]
    found = minhash.min_hash_components(documents(spark, rows)).collect()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found)
    assert got == Counter(
        [(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (5, 1, 3, False), (3, 1, 3, True), (None, 1, None, True), (None, 0, None, True), (9, 0, 9, True)]
    )
    assert minhash.min_hash_components(documents(spark, []).limit(0)).count() == 0


def test_close_signatures_share_a_key(spark):
    """The pigeonhole bound: any signatures within the threshold agree in a key, whatever slots differ."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, (300, minhash.SLOTS), dtype=np.uint16)
    other = base.copy()
    for row in other:
        at = rng.choice(minhash.SLOTS, 23, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, 23, dtype=np.uint16)
    rows = [(k, s.tobytes()) for k, s in enumerate(np.concatenate([base, other]))]
    found = minhash.keys(spark.createDataFrame(rows, "cls long, sig binary"), 23).collect()
    held = defaultdict(dict)
    for r in found:
        held[r["cls"]][r["v"]] = r["key"]
    first = minhash.first_shared(base != other, 23)
    for k in range(300):
        assert len(held[k]) == minhash.SLOTS
        assert min(v for v in held[k] if held[k][v] == held[k + 300][v]) == first[k]


# ---------------------------------------------------------------- spelling variants


def brute_spelling(rows, every=199, shortest=6, least=5, times=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = binascii.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}

    def edits(w):
        letters = {c for x in words for c in x}
        out = {w[:k] + w[k + 1 :] for k in range(len(w))}
        out |= {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}
        return (out | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}) - {w}

    near = {w: edits(w) & set(words) for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x.encode()), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcé", k=rng.randrange(5, 11))) for _ in range(60)] + ["abcabc", "aaaaaaa", "aaaaaa", "ababab", "Übérall", "straße"]
    words = []
    for w in base:
        n = rng.choice([6, 30, 200])
        words += [w] * n
        for _ in range(6):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:]])
            words += [v.upper() if rng.random() < 0.3 else v] * rng.randrange(3, 12)
    rng.shuffle(words)
    texts = ["-".join(words[k : k + 25]) for k in range(0, len(words), 25)]
    rows = [*enumerate(texts), (3, "abcabc×÷ " * 9), (None, "abcabcd " * 8), (7, None), (8, ""), (9, "abcabce " * 20000), (10, "z" * 50000)]
    for every in (199, 2):
        found = spelling.spelling_variants(documents(spark, rows).repartition(3), every=every)
        assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
        got = {r["word"]: tuple(r)[1:] for r in found.collect()}
        want = brute_spelling(rows, every)
        assert got == want
        if every == 199:
            assert any(v[2] and v[4] != v[2] for v in want.values()) or sum(v[2] is not None for v in want.values()) > 20
    assert spelling.spelling_variants(documents(spark, []).limit(0)).count() == 0


def test_long_chains_of_forms(spark):
    rows = [(f"w{k}", f"w{k + 1}") for k in range(26)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {f"w{k}": "w26" for k in range(26)}


# ---------------------------------------------------------------- conversation tries


def brute_trie(spark, rows):
    keyed = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "conv_id", "turn", "coalesce(role, '') role", "coalesce(text, '') text",
        "xxhash64(coalesce(role, ''), coalesce(text, '')) h1", "xxhash64(1, coalesce(text, ''), coalesce(role, '')) h2",
    )
    own = defaultdict(list)
    for r in keyed.collect():
        if r["conv_id"] is not None:
            own[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0), r["h1"], r["h2"], (r["role"], r["text"])))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = binascii.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1]) if p else 0
    out = {}
    for p, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out[min(convs), len(p)] = (parent, len(convs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def said(rng, k):
    return rng.choice(["user", "assistant", None]), rng.choice([f"text {k}", "yes", "nö", "", None])


@pytest.mark.parametrize("parts, block", [(1, 1 << 19), (4, 1 << 19), (13, 700), (5, 4)])
def test_trie_equals_brute_force(spark, monkeypatch, parts, block):
    monkeypatch.setattr(tries, "BLOCK", block)
    monkeypatch.setattr(tries, "PIECE", 40)
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 140), *range(300, 320), *range(777, 790)]:  # some families lack their opener
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn if rng.random() < 0.9 else None, *said(rng, turn % 3)))
    rows += [(200, k, "user", f"step {k % 7}") for k in range(400)]  # one long conversation
    rows += [(205, None, "user", "same")] * 300  # equal rows without a turn
    rows += [(c, k, "user", "hello") for c in range(1000, 1090) for k in range(7)]  # one end for very many
    rows += [(None, 1, "user", "nobody"), (5000, 1, None, None), (-7, 2, "user", "x" * 100000), (-7, 2, "user", "x" * 100000)]
    rng.shuffle(rows)
    want = brute_trie(spark, [r for r in rows if r[0] is None or r[0] >= 0])
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame([(*r, "p", "q") for r in rows if r[0] is None or r[0] >= 0], "conv_id long, turn long, role string, text string, parent string, part string")
        found = tries.conversation_trie(table.repartition(6)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in found}
    assert len(got) == len(found) and got == want
    positions = sorted(r["position"] for r in found)
    assert len(set(positions)) == len(found) and positions[0] == 0 and positions[-1] < 2 * len(found)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert tries.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    # The opener is absent and the only turn is among the first h: the conversation ends at the root.
    c = next(c for c in range(5001, 5100) if binascii.crc32(str(c).encode()) % 6)
    (root,) = tries.conversation_trie(spark.createDataFrame([(c, 1, "user", "hi")], schema)).collect()
    assert root["conv_id"] == c and root["depth"] == 0 and root["parent_conv_id"] is None
    assert (root["n_convs"], root["n_children"], root["n_leaves"], root["saved_tokens"]) == (1, 0, 1, 0)
    assert root["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()
    only_null = tries.conversation_trie(spark.createDataFrame([(None, 1, "user", "hi")], schema))
    assert only_null.count() == 0
