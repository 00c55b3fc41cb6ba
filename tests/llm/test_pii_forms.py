"""Forms of personal data that no base pattern takes."""

import random

from veritick.llm import pii, spans


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_national_phones_and_obfuscated_mails_are_added(spark):
    rnd = random.Random(6)
    texts = []
    for i in range(60):
        texts.append(f"word +1 ({rnd.randrange(200, 999)}) {rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)} and user{i}@mail.example.com said {rnd.randrange(100)} of 12.5")
    more = ["reach (555) 123 4567 now", "name (at) site.org or other", "call me 030 1234 5678 today", "meet (at) noon.then go", "10.20.30.400 and 2024 1200 3300 4400", "name @ site.org", "on 2024-01-15 at home", "or 555-723-4567 too"]
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs_of(spark, texts + more)).collect()}
    assert [got[60 + i] for i in range(len(more))] == ["reach [PHONE] now", "[EMAIL] or other", "call me [PHONE] today", *more[3:5], "[EMAIL]", more[6], "or [PHONE] too"]


def test_cards_and_addresses_in_other_forms_are_judged_by_the_model(spark):
    rnd = random.Random(9)

    def luhn_ok(d):
        total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d))))
        return total % 10 == 0

    def card(n, good):
        while True:
            d = rnd.choice("45") + "".join(rnd.choice("0123456789") for _ in range(n - 1))
            if luhn_ok(d) == good:
                return d

    ip = lambda top: ".".join(str(rnd.randrange(top)) for _ in range(3))
    texts = [f"paid {card(16, True)} order {card(16, False)} from {ip(256)}.{rnd.randrange(256)} build {ip(256)}.{rnd.randrange(300, 999)}" for _ in range(120)]
    old, dotted, bad = card(13, True), card(16, True), card(13, False)
    dotted = ".".join(dotted[i : i + 4] for i in range(0, 16, 4))
    more = [f"with {old} now", f"with {dotted} now", f"with {bad} now", "host 10[.]20[.]30[.]40 up", "host 10[.]20[.]30[.]400 up"]
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs_of(spark, texts + more)).collect()}
    assert [got[120 + i] for i in range(len(more))] == ["with [CARD] now", "with [CARD] now", more[2], "host [IP] up", more[4]]


def test_model_scores_equal_a_plain_computation(spark):
    """Added spans against a separate reading of candidates, features and trees of one fitted model."""
    import re

    from pyspark.sql import functions as F

    from veritick.llm import boosting, spans

    rnd = random.Random(3)
    forms = ["+1 (555) 123-4567", "(555) 123 4567", "call 030 1234 5678", "12 34 56 78", "a@b.com", "a (at) b.org", "x @ y.zz1", "4111111111111111", "4111111111111112", "1.2.3.4", "1[.]2[.]3[.]4", "2024-01-02", "word"]
    texts = [" ".join(rnd.choice(forms) for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    df = docs_of(spark, texts)
    prior, trees, limits = model = pii.train(df)
    described = pii.with_candidates(pii.with_base(df)).select("doc_id", F.explode("__cand").alias("c")).select("doc_id", "c.*").collect()
    base = {r["doc_id"]: r["b"] for r in pii.detect(df, model=model).select("doc_id", F.col("__found.base").alias("b")).collect()}
    want = {i: set() for i in range(len(texts))}
    span = lambda code: re.fullmatch(r"\d+\|\d\|(\w+):(\d+):(\d+)", code).groups()
    for r in described:
        kind, a, b = span(r["code"])
        score = prior + sum(boosting.value_at(t, tuple(r[n] for n in pii.FEATURES)) for t in trees)
        clash = any(k == kind and int(x) < int(b) and int(a) < int(y) for k, x, y in map(span, base[r["doc_id"]]))
        if score >= limits[r["kind"]] and not clash:
            want[r["doc_id"]].add(f"{kind}:{a}:{b}")
    got = pii.detect(df, model=model).select("doc_id", spans.joined(F.col("__found.all")).alias("a"), spans.joined(F.col("__found.base")).alias("b")).collect()
    assert sum(map(len, want.values())) > 100
    for r in got:
        assert set(filter(None, r["a"].split(","))) - set(filter(None, r["b"].split(","))) == want[r["doc_id"]]


def test_many_spans_of_one_text_are_linear(spark):
    """50,000 addresses and 50,000 national numbers in one text: detected and masked within half a minute each."""
    import time

    from pyspark.sql import functions as F

    one = "".join(f"name{i}@site{i % 97}.example.org and call (555) {i % 900 + 100:03d}-{i % 9000 + 1000:04d} é, " for i in range(50_000))
    few = "write to ann@site.org or call (555) 123-4567 or phone (555) 765-4321"
    docs = spark.createDataFrame([(1, one), (2, few), (3, None)], "doc_id long, text string")
    model = pii.train(spark.createDataFrame([(few,)] * 40, "text string"))
    start = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.detect(docs, model=model).select("doc_id", F.col("__found.n_email").alias("n"), F.size("__found.all").alias("all")).collect()}
    assert time.perf_counter() - start < 30 and got[1]["n"] == 50_000 and got[1]["all"] >= 50_000 and got[3]["all"] == 0
    start = time.perf_counter()
    masked = {r["doc_id"]: r["text"] for r in docs.transform(lambda d: pii.detect(d, model=model)).select("doc_id", spans.masked(F.col("text"), F.col("__found.all")).alias("text")).collect()}
    assert time.perf_counter() - start < 30 and masked[1].count("[EMAIL]") == 50_000 and "@" not in masked[1] and masked[1].count("é") == 50_000 and masked[3] is None


def test_members_by_sorting(spark):
    from pyspark.sql import functions as F

    rows = [(["a", "c", "d"], ["c", "b"]), ([], ["a"]), (["a"], []), ([], []), (["b", "x"], ["x", "b"])]
    df = spark.createDataFrame(rows, "codes array<string>, among array<string>")
    got = [r[0] for r in df.select(spans.member(F.col("codes"), F.col("among"))).collect()]
    assert got == [[c in b for c in a] for a, b in rows]
