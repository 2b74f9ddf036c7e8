"""The quality classifier's features and scores against a plain version that looks at one line at a time."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np

from inkglass.llm import quality_crf

BLANKS, STOPS = b" \t\n\x0b\x0c\r", b".,;:!?'\"()-"


def kind(b):
    if chr(b).isalpha() and b < 0x80 or b >= 0x80:
        return "letter"
    if b in b"0123456789":
        return "digit"
    if b in BLANKS:
        return "blank"
    return "stop" if b in STOPS else "bar" if b == ord("|") else "symbol"


def plain_features(line, lines):
    words, kinds, n = line.split(), Counter(map(kind, line)), max(1, len(line))
    alike = line.lower().split()  # repeats count in either case
    w = max(1, len(words))
    share = lambda test: sum(map(test, words)) / w
    capitals = sum(0x41 <= b <= 0x5A for b in line)
    return [
        1.0,
        math.log1p(len(line)) / 5,
        math.log1p(len(words)) / 4,
        min(sum(map(len, words)) / w, 40) / 10,
        share(lambda x: len(x) > 20),
        kinds["letter"] / n,
        capitals / n * 5,
        kinds["digit"] / n,
        kinds["blank"] / n,
        kinds["stop"] / n * 5,
        kinds["symbol"] / n * 5,
        kinds["bar"] / n * 5,
        share(lambda x: len(x) > 1 and kind(x[-1]) == "symbol"),
        sum(a == b for a, b in zip(alike, alike[1:])) / w,
        max(Counter(alike).values(), default=0) / w,
        len(set(alike)) / w,
        float(bool(line) and lines.count(line) > 1),
        float(line[:1].isupper() and line[0] < 0x80 if line else 0),
        float(bool(line) and line[-1] in STOPS),
        share(lambda x: len(x) == 1 and kind(x[0]) not in ("letter", "digit")),
    ]


def plain_score(text, chain):
    """All labellings of a text's lines, weighed by their potentials."""
    lines = (text or "").encode().split(b"\n")
    own = [plain_features(x, lines) for x in lines]
    n = len(own[0])
    here, before, after = chain.weights[:n], chain.weights[n : 2 * n - 1], chain.weights[2 * n - 1 : 3 * n - 2]
    good = []
    for i, f in enumerate(own):
        back = np.dot(before, own[i - 1][1:]) if i else chain.weights[-2]
        ahead = np.dot(after, own[i + 1][1:]) if i + 1 < len(own) else chain.weights[-1]
        good.append(np.dot(here, f) + back + ahead)
    weigh = {}
    for labels in product((0, 1), repeat=len(lines)):
        at = sum(g for g, y in zip(good, labels) if y) + sum(chain.pairs[a][b] for a, b in zip(labels, labels[1:]))
        weigh[labels] = math.exp(at)
    total = sum(weigh.values())
    sizes = [max(1, len(x)) for x in lines]
    marginal = [sum(p for labels, p in weigh.items() if labels[i]) / total for i in range(len(lines))]
    return sum(m * s for m, s in zip(marginal, sizes)) / sum(sizes)


def texts():
    r = random.Random(4)
    words = ["the", "The", "WORD", "x", "|", "|", "$$", "a$", "12", "3.5", "é", "日本語", "no.", "(yes)", "-", "w" * 25, "ok!", "ok!"]
    for _ in range(150):
        lines = [r.choice([" ", "  ", "\t"]).join(r.choice(words) for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 7))]
        yield "\n".join(lines + r.choice([[], lines[:1]]))
    yield from ("", "\n", None, " \n\t", "A", "same\nsame\n\n")


def test_features_equal_a_plain_version():
    data = [(t or "").encode() for t in texts()]
    own, size, per_doc = quality_crf._own_features(data)
    expected = [plain_features(line, d.split(b"\n")) for d in data for line in d.split(b"\n")]
    assert own.shape == (len(expected), len(quality_crf.FEATURES)) and per_doc.tolist() == [len(d.split(b"\n")) for d in data]
    assert np.allclose(own, expected, atol=1e-12), np.argwhere(~np.isclose(own, expected))[:5]
    assert size.tolist() == [max(1, len(line)) for d in data for line in d.split(b"\n")]


def test_scores_equal_a_plain_version():
    rng = np.random.default_rng(3)
    n = len(quality_crf.FEATURES)
    for _ in range(3):
        chain = quality_crf.Chain(rng.normal(size=3 * n), rng.normal(size=(2, 2)))
        some = list(texts())
        assert np.allclose(quality_crf.score_texts(some, chain), [plain_score(t, chain) for t in some], atol=1e-9)
