import base64
import random

import numpy as np

from domainlake.llm import toxicity

LANDMARKS = ["stupid", "worthless", "garbage", "idiot", "morons", "trash", "pathetic", "loser"]


def strongest(kernel, text):
    _, z = kernel.sentences([text.encode()])
    return z.max(axis=0) if len(z) else np.zeros(len(kernel.landmarks))


def test_long_clean_words_are_no_match():
    rng = random.Random(3)
    kernel = toxicity.Kernel(LANDMARKS)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    for n in (600, 2000, 6000):
        code = base64.b64encode(rng.randbytes(n)).decode()[:n]
        run = "".join(rng.choices(syllables, k=n // 2))
        for text in (code, f"see https://example.org/{code} for it", "var " + code.replace("a", ";")):
            assert strongest(kernel, text).max() < 0.3, (n, text[:40])
        # Syllables do spell parts of landmarks, but not all of them as their number grows.
        assert strongest(kernel, run).mean() < 0.25, n


def test_landmarks_are_found_wherever_they_stand_in_a_long_word():
    rng = random.Random(4)
    kernel = toxicity.Kernel(LANDMARKS)
    for k, landmark in enumerate(LANDMARKS):
        for at in range(0, 40):
            noise = "".join(rng.choices("qxzjkvw", k=80))
            assert strongest(kernel, noise[:at] + landmark + noise[at:])[k] >= 0.99
        gapped = landmark[:2] + "q" + landmark[2:]
        assert abs(strongest(kernel, "x" * 300 + gapped)[k] - strongest(kernel, gapped)[k]) < 1e-5


def test_windows():
    word, begins, lengths = toxicity.windows(np.array([0, 5, 30, 31, 47]), 30, 8)
    assert word.tolist() == [0, 1, 2, 3, 3, 4, 4, 4, 4]
    assert begins.tolist() == [0, 0, 0, 0, 1, 0, 8, 16, 17] and lengths.tolist() == [0, 5, *[30] * 7]
