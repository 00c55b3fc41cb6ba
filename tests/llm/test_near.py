"""The pipeline's near-duplicate stage: five words and an exact similarity of 0.8."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from veritick.llm import simhash


def shingles(text):
    return set(simhash.shingle_hashes(text, 5))


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_stage_takes_near_copies_beyond_four_bits(spark):
    rng = random.Random(3)
    texts, copies, others = [], 0, 0
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        at = rng.sample(range(5, 195, 10), 3 if i % 2 else 8)
        new = list(words)
        for k in at:
            new[k] = f"new{k}"
        texts.append(" ".join(new))
        if similarity(texts[-2], texts[-1]) >= 0.8:
            copies += 1
            others += bin(simhash.fingerprint(texts[-2]) ^ simhash.fingerprint(texts[-1])).count("1") > 4
        else:
            assert i % 2 == 0
    assert copies == 30 and others > 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["text"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert {texts[i] for i in range(0, 120, 2)} <= kept
    assert {texts[i] for i in range(1, 120, 4)} <= kept
    lost = [i for i in range(3, 120, 4) if texts[i] in kept]
    assert len(lost) <= 1  # a radius of 14 bits; 4 bits found nearly none


def test_dense_cluster_of_near_copies_is_one_group(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(500):
        new = list(words)
        new[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(new))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_groups(docs).collect()} == {0}
    empty = simhash.near_groups(docs.limit(0))
    assert empty.count() == 0


def test_run_pairs_is_complete_on_short_runs_and_bounded_on_long_ones():
    rng = np.random.default_rng(5)
    key, fp, other = np.sort(rng.integers(0, 40, 400)), rng.integers(0, 2**16, 400), rng.integers(0, 2**16, 400)
    size = rng.integers(80, 120, 400)
    i, j = simhash.run_pairs(key, fp, other, size, 5, 7, 800)
    off = lambda x, a, b: bin(int(x[a] ^ x[b])).count("1")
    want = {(x, y) for x in range(400) for y in range(x + 1, 400) if key[x] == key[y] and off(fp, x, y) <= 5 and off(other, x, y) <= 7 and 10 * min(size[x], size[y]) >= 8 * max(size[x], size[y])}
    assert want and set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
    i, j = simhash.run_pairs(np.zeros(300, np.int64), np.zeros(300, np.int64), np.zeros(300, np.int64), np.full(300, 9), 5, 7, 800)
    assert set(i[i == j].tolist()) == set(range(300))  # all have more partners than are listed, and are marked
    assert np.bincount(i[i != j]).max() == 4 and len(set(i[i != j].tolist())) == 299


def test_either_fingerprint_finds_a_pair():
    """Pairs of a similarity of 0.8 to 0.85: their distances, and how many are candidates."""
    rng = random.Random(8)
    found = total = 0
    for _ in range(300):
        n = rng.randrange(40, 400)
        base = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        drop = int(n * rng.uniform(0.08, 0.105))
        a = base
        b = np.concatenate([base[drop:], np.array([rng.getrandbits(64) for _ in range(drop)], np.uint64)])
        if not 0.8 <= len(set(a) & set(b)) / len(set(a) | set(b)) < 0.86:
            continue
        d = [bin(simhash.majority(f(a)) ^ simhash.majority(f(b))).count("1") for f in (lambda x: x, simhash.second)]
        total += 1
        found += min(d) <= 14 and max(d) <= 24
    assert total > 200 and found >= 0.99 * total


def dense_corpus(share, change, pairs, seed, n=400):
    """Texts of one template, each with words of its own; every second one a near copy of the one before. (texts, similarities)"""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(n)]
    texts = []
    for _ in range(pairs):
        words = list(template)
        for k in range(int(n * share) // 20):
            at = rng.randrange(0, n - 20)
            words[at : at + 20] = [f"u{rng.randrange(10**9)}" for _ in range(20)]
        other = list(words)
        at = rng.randrange(0, n - 20)
        other[at : at + change] = [f"v{rng.randrange(10**9)}" for _ in range(change)]
        texts += [" ".join(words), " ".join(other)]
    return texts


def test_dense_places_lose_no_links(spark):
    """A thousand pairs of 0.9 and over among texts of 0.6 to 0.79 to each other, all of one template: links as by an exact join."""
    for share, change, seed, count in ((0.05, 12, 1, 1000), (0.10, 14, 2, 200)):
        texts = dense_corpus(share, change, count, seed)
        sets = [shingles(t) for t in texts]
        pair = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)]
        rng = random.Random(7)
        apart = sorted(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in ((rng.randrange(2 * count), rng.randrange(2 * count)) for _ in range(300)) if i // 2 != j // 2)
        assert min(pair) >= 0.89 and 0.5 < apart[150] < 0.8
        print("similarity", min(pair), "among", apart[150])
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
        linked = sum(found[i] == found[i + 1] for i in range(0, len(texts), 2))
        print("linked", linked)
        assert linked >= 0.99 * count, (share, linked)
        # no text is linked to a group without a similar one: components by brute force over rare shingles
        for c in set(found.values()):
            members = [i for i in found if found[i] == c]
            if len(members) > 2:
                for i in members:
                    assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in members if j != i)


def test_prefix_pairs_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    key = np.sort(np.r_[np.zeros(100, np.int64), rng.integers(1, 40, 300)])
    x = np.stack([np.arange(400), rng.integers(0, 2**10, 400), rng.integers(0, 2**10, 400), rng.integers(80, 120, 400), rng.integers(0, 5, 400), rng.integers(0, 2, 400)], axis=1)
    order = np.lexsort((x[:, 0], x[:, 3], key))
    key, x = key[order], x[order]
    off = lambda a, b, c: bin(int(x[a, c] ^ x[b, c])).count("1")
    want = set()
    for i in range(400):
        for j in range(i + 1, 400):
            d = sorted((off(i, j, 1), off(i, j, 2)))
            small = min((x[i, 3], i), (x[j, 3], j))[1]
            if key[i] == key[j] and d[0] <= 4 and d[1] <= 6 and 10 * min(x[i, 3], x[j, 3]) >= 8 * max(x[i, 3], x[j, 3]) and x[i, 4] != x[j, 4] and x[small, 5]:
                want.add((i, j))
    i, j = simhash.prefix_pairs(key, x, 4, 6, 800)
    assert want and set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_half_similar_sets_give_few_pairs_and_similar_ones_all():
    """300 sets of a template, 0.6 to 0.75 to each other but for 20 pairs of copies, all at one key: what they cannot share is told from parities."""
    rng = np.random.default_rng(5)
    base, sets = rng.integers(0, 2**62, 300), []
    for i in range(300):
        own = np.r_[rng.choice(base, 250, replace=False), rng.integers(0, 2**62, 30)]
        sets.append(np.unique(own if i % 15 else np.r_[sets[-1][:-8], own[:4]] if sets else own))
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sets.sort(key=len)
    x = np.stack([np.arange(300), np.zeros(300, np.int64), np.zeros(300, np.int64), [len(s) for s in sets], np.arange(300), np.ones(300, np.int64), [len(s) for s in sets]], axis=1)
    odd = np.frombuffer(b"".join(simhash.parities(s) for s in sets), np.uint64).reshape(300, -1)
    every = {(i, j) for i in range(300) for j in range(i + 1, 300)}
    similar = {(i, j) for i, j in every if jaccard(sets[i], sets[j]) >= 0.8}
    got = lambda *a: {p for i, j in simhash.pairs_at_once(np.zeros(300, np.int64), x, 14, 24, 800, *a) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert similar and got() > got(odd) >= similar and 10 * len(got(odd)) < len(got())
    assert max(np.unique([i for i, _ in got(odd, 1)], return_counts=True)[1]) == 1


def test_links_of_a_dense_group_are_walked_once(spark, monkeypatch):
    """Later rounds take one edge a node of what is linked, and new links; components are the same."""
    rng, real, walked = random.Random(6), simhash.components, []

    def counted(edges):
        walked.append((edges.count(), edges.select("a").union(edges.select("b")).distinct().count()))
        return real(edges)

    monkeypatch.setattr(simhash, "components", counted)
    n, words = 150, [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:k] + [f"x{rng.randrange(10**9)}"] + words[k + 1 :]) for k in (rng.randrange(200) for _ in range(n))]
    docs = spark.createDataFrame([*enumerate(texts), (n, "quite another text")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()} == {i: 0 for i in range(n)} | {n: n}
    (first, nodes), *later = walked
    assert first > 3 * nodes and later and all(edges < nodes for edges, _ in later)


def test_sets_meet_at_first_shingles_whatever_their_number(spark, monkeypatch):
    """Similar texts of two line-sharing families meet, all others do not; no text sends more than a fifth of its shingles, and none probes places that depend on how many texts there are."""
    rng, texts = random.Random(9), []
    line = [f"line{i}" for i in range(12)]
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 160))]
        texts.append(" ".join(words + line))
        if i % 3 == 0:
            at = rng.randrange(len(words) - 1)
            texts.append(" ".join(words[:at] + [f"new{i}"] + words[at + 1 :] + line))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    usual = simhash.frequent(docs, 5, "text")
    assert set(usual.view(np.uint64).tolist()) == shingles(" ".join(line))  # all that three texts share
    own = simhash.shingle_sets(docs, 5, 800, usual, "doc_id", "text").cache()
    sets = {r["doc_id"]: r for r in own.collect()}
    assert all(len(r["tokens"]) == r["size"] - -(-4 * r["size"] // 5) + 1 for r in sets.values())
    rows = simhash.meeting_rows(own.select("node", F.col("node").alias("comp"), "size", "tokens"), 800).collect()
    at = {}
    for r in rows:
        at.setdefault(r["node"], set()).add(r["value"])
    node = {i: r["node"] for i, r in sets.items()}
    similar = {(i, j) for i in sets for j in sets if i < j and similarity(texts[i], texts[j]) >= 0.8}
    assert len(similar) > 40 and set(at) == {node[i] for p in similar for i in p}
    assert all(at[node[i]] & at[node[j]] for i, j in similar)
    assert not simhash.meeting_rows(own.select("node", F.lit(1).alias("comp"), "size", "tokens"), 800).count()  # linked already

    def no_probes(*_, **__):
        raise AssertionError("probes")

    monkeypatch.setattr(simhash, "meetings", no_probes)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert {(i, j) for i in found for j in found if i < j and found[i] == found[j]} == similar


def test_texts_are_not_shuffled_to_find_few(spark, monkeypatch):
    rng, plans, real = random.Random(2), [], simhash.cut

    def seen(df):
        if "hashes" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(simhash, "cut", seen)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate([" ".join(words), " ".join(words[:-1]), "other words"])), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()} == {0: 0, 1: 0, 2: 2}
    assert plans and all("BroadcastHashJoin" in p for p in plans)
