"""Quality scores against a plain computation: features character by character, tables entry by entry."""

import bisect
import math
import random
from collections import Counter

import pytest

from veritick.llm import quality


def plain_features(text):
    """The features by their definitions, on bytes."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 20
    words, lines = raw.split(), raw.split(b"\n")
    count = lambda f: sum(1 for b in raw if f(b))
    upper, lower, digit = (count(lambda b, lo=lo, hi=hi: lo <= b <= hi) for lo, hi in ((65, 90), (97, 122), (48, 57)))
    stop, bar, high = count(lambda b: b in b",."), count(lambda b: b == 124), count(lambda b: b >= 128)
    symbol = count(lambda b: 33 <= b < 127) - upper - lower - digit - stop - bar
    shown, n = upper + lower + digit + stop + bar + symbol + high + 1e-9, max(1, len(words))
    is_symbol = lambda b: 33 <= b < 127 and not chr(b).isalnum() and b not in b",.|"
    seen, freq = Counter(words), Counter(raw)
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / len(words) if words else 0.0, upper / shown, lower / shown, digit / shown, symbol / shown, stop / n, bar / n, high / shown,
        len(lines) / n, len(seen) / n, len(set(lines)) / len(lines), max(seen.values(), default=0) / n, sum(len(w) >= 12 for w in words) / n, sum(len(w) <= 2 for w in words) / n,
        sum(65 <= w[0] <= 90 for w in words) / n, sum(is_symbol(w[-1]) for w in words) / n, count(lambda b: b in b"!?") / n, -sum(c / len(raw) * math.log2(c / len(raw)) for c in freq.values()),
    ]


def plain_score(m, text):
    x = plain_features(text)
    total = m.base + sum(float(t[bisect.bisect_left(list(c), v)]) for v, c, t in zip(x, m.cuts, m.tables, strict=True))
    for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
        total += float(t[bisect.bisect_left(list(m.pair_cuts[i]), x[i]), bisect.bisect_left(list(m.pair_cuts[j]), x[j])])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_scores_equal_a_plain_computation(spark):
    rnd = random.Random(4)
    parts = ["the", "Reading", "BUY!!", "é", "12", "a|b", "\n", "slow.", "extraordinarily", "x,", "%%"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, "", "\n\n", "| |"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int((texts[i] or "").count("!") < 3)) for i in range(300)] + [(3, 1)] * 5, "doc_id long, quality int")
    model = quality.train(df, labels)
    assert model.pairs and any(t.any() for t in model.tables)
    for r in quality.score(df, model).collect():
        assert quality.features(texts[r["doc_id"]]) == pytest.approx(plain_features(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]]), abs=1e-6)


def test_one_document_of_an_id_is_learned_from(spark):
    rows = [(1, f"copy {i}") for i in range(500)] + [(2, "other text"), (3, "third")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "doc_id long, quality int")
    assert quality.train(df, labels).base < 0  # one positive, not five hundred
