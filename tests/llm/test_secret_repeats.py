"""Repeats of assigned values, and the models against a plain computation."""

import math
import random
import re

from pyspark.sql import functions as F

from veritick.llm import secrets, spans


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bare_repeat_of_an_assigned_value_is_a_secret(spark):
    rnd = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rand = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    plain = lambda: "".join(rnd.choice(["internal", "ization", "measure", "ment", "transform", "ation", "work", "flow"]) for _ in range(4))
    texts = [f"{plain()} and {plain()} token = {rand(32)}" for _ in range(300)]
    value = rand(32)
    texts += [f"token = {value} again {value}", f"secret: abcdef stray {rand(20)}abcdef{rand(14)}"]
    rows = {r["doc_id"]: r["a"] for r in secrets.scan(docs_of(spark, texts)).select("doc_id", spans.joined(F.col("__found.all")).alias("a")).collect()}
    assert rows[300] == "assign:0:40,markov:47:79"
    assert rows[301] == "assign:0:14,markov:21:61"


def brute(texts, backoff=500.0, least=0.3):
    """Added spans of every text, from character pairs counted in plain Python."""
    place = {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}
    bases, tokens = [], []
    for t in texts:
        found = [(m.start(), m.end(), m[2]) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6]
        found += [(m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]{16,}", t)] + [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]{24,}", t)]
        bases.append(found)
        own = re.finditer("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", t)
        tokens.append([(m.start(), m.end(), m[0]) for m in own if not any(a < m.end() and m.start() < b for a, b, _ in found)])
    samples = [[x for own in tokens for _, _, x in own], [x for found in bases for x in {v for _, _, v in found}]]
    steps = lambda x: [(place.get(a, 0), place.get(b, 0)) for a, b in zip(x, x[1:])]
    size, logs = secrets.SIZE, []
    for sample in samples:
        n = {}
        for x in sample:
            for ab in steps(x):
                n[ab] = n.get(ab, 0) + 1
        total, row, column = sum(n.values()), [0] * size, [0] * size
        for (a, b), k in n.items():
            row[a] += k
            column[b] += k
        logs.append({(a, b): math.log((n.get((a, b), 0) + backoff * (column[b] + 0.5) / (total + 0.5 * size)) / (row[a] + backoff)) for a in range(size) for b in range(size)})
    score = lambda x: sum(logs[1][ab] - logs[0][ab] for ab in steps(x)) / len(x)
    means = [sum(map(score, sample)) / len(sample) for sample in samples]
    limit = max(least, sum(means) / 2)
    return [{f"markov:{a}:{b}" for a, b, x in own if score(x) > limit} for own in tokens], limit, {x: score(x) for own in tokens for _, _, x in own}


def test_markov_spans_equal_a_plain_computation(spark):
    rnd = random.Random(14)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rand = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    plain = lambda: "".join(rnd.choice(["internal", "ization", "measure", "ment", "_", "ation", "work", "9"]) for _ in range(5))
    parts = [plain, lambda: f"token = {rand(24)}", lambda: rand(30), lambda: "AKIA" + "Z7" * 9, lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(30)), lambda: "é", lambda: "x" + "0a1b" * 8, lambda: "short"]
    texts = [" ".join(rnd.choice(parts)() for _ in range(rnd.randint(1, 12))) for _ in range(200)] + ["token: " + rand(20) + " " + (rand(20) + " ") * 3000]
    want, limit, scores = brute(texts)
    assert not any(abs(v - limit) < 1e-5 for v in scores.values()) and sum(map(len, want)) > 80
    got = {r["doc_id"]: r["a"] for r in secrets.scan(docs_of(spark, texts)).select("doc_id", spans.joined(F.col("__found.all")).alias("a")).collect()}
    for i, added in enumerate(want):
        assert {x for x in got[i].split(",") if x.startswith("markov")} == added
