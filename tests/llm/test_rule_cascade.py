"""The rule cascade against a plain count of every text, and its order against a plain greedy choice."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veritick.llm import rules


def plain(text):
    """The counts by the words of the contract, without short cuts."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def plain_kept(text):
    n, chars, symbols, dup, repeat = plain(text)
    text = text or ""
    if n < 50 or 100 * repeat > 50 * n:
        return False
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    shown = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    return not (
        symbols / n > 0.1 or not 2 <= chars / n <= 15 or dup / len(lines) > 0.5 or len(re.findall("[A-Z]", text)) > len(re.findall("[a-z]", text))
        or sum(bool(re.search(r"[A-Za-z\u0080-\U0010ffff]", w)) for w in words) < 0.6 * n or sum(x[0] in "*-•" for x in shown) > 0.9 * len(lines)
        or sum(x.endswith(("...", "…")) for x in shown) > 0.3 * len(lines) or max(Counter(words).values()) > 0.3 * n or len(zlib.compress(text.encode(), 1)) * 12 < len(text.encode())
    )


def texts():
    rng = np.random.default_rng(4)
    word = lambda k: "".join(chr(97 + x) for x in rng.integers(0, 26, k))
    clean = [" ".join(word(int(k)) for k in rng.integers(2, 9, n)) for n in (49, 50, 60, 300, 4000)]
    lines = [word(5) + " " + word(4) for _ in range(40)]
    return [
        None, "", " \t\n\x0b ", "a", "a a a a", "a a a", " " * 60, "  x " * 60, *clean, *clean[:2], clean[3].upper(), clean[3].replace(" ", "## "), "\n".join(lines + lines[:3]),
        "\n".join(lines * 3), "\n".join("- " + x for x in lines), "\n".join("•" + x for x in lines), "\n".join(x + "..." for x in lines), " ".join(str(x) for x in range(100, 200)),
        " ".join(f"the {w}" for w in clean[2].split()), "x" * 5000 + " " + clean[3], "é" * 30 + " " + " ".join(["üß"] * 30 + clean[2].split()), "a b c " * 30 + clean[2], "|" + clean[2], "line\r\nline\r\n \n \n" + clean[2],
    ]


def test_cascade_equals_plain_counts(spark):
    rows = [(i, t, "k", "n", "r") for i, t in enumerate(texts())] + [(None, texts()[10], "k", "n", "r")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words string, row string")
    for got in (rules.apply_rules(docs, counts=True), rules.cascade(docs, rules.RULES[::-1], counts=True), rules.apply_rules(docs, counts=True, sample_docs=3)):
        found = got.collect()
        assert len(found) == len(rows)
        assert all(tuple(r[c] for c in rules.COUNTS) == plain(r["text"]) and r["kept"] == plain_kept(r["text"]) for r in found)
        assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and (r["rejected_by"] is None) == r["kept"] and r["row"] == "r" for r in found)
    assert {r["rejected_by"] for r in rules.cascade(docs, rules.BASE[:1] + rules.MORE).collect()} >= {"few_words", "symbols", "shouting", "dup_lines", "bullets", "unfinished", "no_letters", None}


def test_many_kinds_of_words():
    """More kinds of words than fit three to a number of 64 bits."""
    words = [f"w{i}" for i in range(1 << 20)]
    m = rules.Measures(" ".join(words + words[5:9]))
    assert m.n_repeat_words == 8


def test_cascade_stops_at_the_first_rejection():
    asked = []
    chain = tuple(rules.Rule(str(k), lambda m, k=k: asked.append(k) or k == 1) for k in range(4))
    assert next(r.name for r in chain if r.rejects(rules.Measures("x"))) == "1" and asked == [0, 1]


def test_order_by_rejection_per_cost():
    gone = np.array([[1, 1, 0, 0], [1, 1, 0, 0], [1, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 0]], dtype=bool)
    assert rules.ordered(np.array([2.0, 1.0, 1.5, 1.0]), gone) == [1, 2, 0, 3]  # 0 and 3 reject nothing that 1 leaves
    assert rules.ordered(np.ones(4), np.zeros((0, 4), bool)) == [0, 1, 2, 3]


def test_cascade_empty_and_query(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rules.apply_rules(none, counts=True).count() == 0
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in rules.op11_quality_rules(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert tuple(got[r["doc_id"]][c] for c in rules.COUNTS) == plain(r["text"]) and got[r["doc_id"]]["kept"] == plain_kept(r["text"])
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(rules.op11_quality_rules(spark, sf), "doc_id")
    assert good.where(~F.col("base_failed") & ~F.col("kept")).count() == 0
