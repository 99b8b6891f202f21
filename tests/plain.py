"""Expected values of the column functions, stated in plain Python for tests."""

import math
import re
from functools import lru_cache
from itertools import groupby
from urllib.parse import unquote, urlsplit

from domainlake import constants as K


@lru_cache(maxsize=None)
def edit_distance(a: str, b: str) -> int:
    if not a or not b:
        return len(a) + len(b)
    if a[-1] == b[-1]:
        return edit_distance(a[:-1], b[:-1])
    return 1 + min(
        edit_distance(a[:-1], b), edit_distance(a, b[:-1]), edit_distance(a[:-1], b[:-1])
    )


def similarity(label: str, brand: str) -> float:
    if label == brand:
        return 1.0
    if not label or not brand:
        return 0.0
    reach = max(max(len(label), len(brand)) // 2 - 1, 0)
    free = set(range(len(brand)))
    pairs = []
    for i, ch in enumerate(label):
        options = [j for j in sorted(free) if abs(i - j) <= reach and brand[j] == ch]
        if options:
            free.discard(options[0])
            pairs.append((i, options[0]))
    k = len(pairs)
    if k == 0:
        return 0.0
    in_brand_order = sorted(j for _, j in pairs)
    moved = sum(label[i] != brand[j] for (i, _), j in zip(pairs, in_brand_order))
    jaro = (k / len(label) + k / len(brand) + (k - moved / 2) / k) / 3
    same = sum(x == y for x, y in zip(label[:4], brand[:4]))
    return jaro + same * 0.1 * (1 - jaro)


def host_of(domain: str) -> str:
    name = domain.lower().strip()
    pieces = name.split("://")
    return (pieces[1] if len(pieces) > 1 else name).split("/")[0]


def entropy(label: str) -> float:
    counts = {ch: label.count(ch) for ch in label}
    return -sum(n / len(label) * math.log2(n / len(label)) for n in counts.values())


def consonant(ch: str) -> bool:
    return ch.isalpha() and ch not in "aeiou"


def features(domain: str) -> dict[str, float]:
    host = host_of(domain)
    labels = host.split(".")
    sld = labels[0]
    tld = labels[-1] if len(labels) > 1 else ""
    n = max(len(sld), 1)
    pairs = [sld[i : i + 2] for i in range(len(sld) - 1)]
    runs = [len(list(g)) for is_c, g in groupby(sld, consonant) if is_c]
    nearest = min(edit_distance(sld, b) for b in K.BRANDS)
    best = max(similarity(sld, b) for b in K.BRANDS)

    def share(test):
        return sum(map(bool, map(test, sld))) / n

    return {
        "length": min(len(host) / 63, 1),
        "num_subdomains": min((len(labels) - 1) / 5, 1),
        "vowel_ratio": share(lambda c: c in "aeiou"),
        "consonant_ratio": share(consonant),
        "digit_ratio": share(str.isdigit),
        "special_char_count": min(sum(not c.isalnum() for c in sld) / 10, 1),
        "entropy": min(entropy(sld) / 4, 1),
        "ngram_randomness": 1 - sum(p in K.COMMON_BIGRAMS for p in pairs) / max(len(pairs), 1),
        "repeated_char_score": sum(p[0] == p[1] for p in pairs) / n,
        "tld_risk": K.TLD_RISK.get(tld, 0.1),
        "suspicious_keyword_score": sum(w in host for w in K.PHISH_KEYWORDS)
        / len(K.PHISH_KEYWORDS),
        "lookalike_score": {0: 0.5, 1: 1.0, 2: 1.0, 3: 0.5, 4: 0.5}.get(nearest, 0.0),
        "max_consec_cons": min(max(runs, default=0) / 8, 1),
        "unique_char_ratio": len(set(sld)) / n,
        "hex_char_ratio": share(lambda c: c in "0123456789abcdef"),
        "jaro_winkler_score": best if best > 0.85 and sld not in K.BRANDS else 0.0,
        "char_continuity": sum(p in K.IMPOSSIBLE_BIGRAMS for p in pairs) / max(len(pairs), 1),
    }


def feed_host(url: str) -> str:
    text = unquote(url.strip())
    text = text if text.startswith("http") else "http://" + text
    try:
        netloc = urlsplit(text).netloc
    except ValueError:
        return ""
    return netloc.rpartition("@")[2].partition(":")[0].lower().strip(".")


def line_host(line: str) -> str:
    pieces = line.strip().split("/")
    return pieces[2 if "://" in line else 0].split(":")[0].lower()


def training_host(line: str) -> str | None:
    line = line.strip()
    if not line or line[0] == "#":
        return None
    pieces = line.split("://")
    host = (pieces[1] if len(pieces) > 1 else line).split("/")[0]
    return host.lower() if "." in host and len(host) > 3 else None


def unmasked(url: str) -> tuple[str, int]:
    current, hops = unquote(url.strip()), 0
    if not re.match("https?://", current):
        current = "http://" + current
    while True:
        parts = urlsplit(current)
        found = [
            m[1]
            for p in K.REDIRECT_PARAMS
            if (m := re.search(f"(?i)(?:^|&){p}=(https?(?:%3A%2F%2F|://)[^&]+)", parts.query))
        ]
        if not found:
            return parts.netloc.split("@")[-1].split(":")[0].lower(), hops
        current, hops = unquote(found[0]), hops + 1
        if not current.startswith("http"):
            current = "http://" + current


def cleaned_host(host: str) -> str:
    text = "".join(c for c in host.strip().lower() if c not in K.ZERO_WIDTH)
    text = re.sub("^https?://", "", text.split("@")[-1].rstrip("."))
    return text.split("/")[0].split(":")[0]
