"""SimHash fingerprints and their near-duplicate groups by generalised pigeonhole.

Fingerprint: bit i is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles, repeats
included.  Two fingerprints are linked if at most ``radius`` of their 64 bits differ.

Links are found among *distinct* fingerprints.  The bits are grouped in m parts, correlated bits together, and part i
gets a threshold t_i >= -1 with ``sum(t_i) = radius - m + 1``: any linked pair lies within t_i in at least one part i.
Widths m and thresholds are chosen by dynamic programming on estimated costs (probes sent plus candidate pairs), from
bit and part-value statistics over all fingerprints.  Each fingerprint is indexed under its own value of every part
used and probes the values within t_i (of the two that differ in a given mask, only the one with the mask's top bit
set probes).  What meets under one value is verified on all 64 bits.  A meeting place returns the edges of a spanning
forest, found by breadth-first search, never all pairs; one of over ``block`` fingerprints is first split in blocks,
each pair of blocks being a meeting place of its own.  Components then come from ``components``.

``near_groups`` works on sets of word shingles: a pair is linked if the exact Jaccard similarity of its sets suffices.  Pairs
meet at shingles: similar sets share one that is early in both, in any order that all sets have in common (prefix filter).
The order is that of hashes, with shingles last that are frequent in a sample; it decides how many meet, not what is found,
so that rows grow with the words and not with the square of the sets.  Fingerprints then decide: as the distance of two
scatters (at a similarity of 0.8 about 10 bits, give or take 3), each set has two independent ones; a pair is a candidate
if either is within ``radius`` and the other within ``wide``, which spares most chance pairs their exact check.  Sets are
compared with few neighbours at their least hashes first, which links near copies; what is linked does not meet again.

Edge cases: a null or empty text, or one without words, has fingerprint zero, linked like any other. A text of fewer
than ``shingle`` words has one shingle, its whole sequence. Rows with a null id are kept and link like any other; a
component without any id is null. Repeated ids share their component. ``near_groups`` wants ids that are neither null
nor repeated (row numbers). Empty tables give empty results. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritick.llm.components import components
from veritick.session import cut

SEED = 42


def shingle_hashes(text: str | None, shingle: int = 4) -> list[int]:
    """The hashes of the word shingles of one text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[: len(words) - shingle]]]
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without any."""
    if not len(hashes):
        return 0
    bits = np.array(hashes, dtype="<u8").view(np.uint8).reshape(len(hashes), 8)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(bits), 65536):
        ones += np.unpackbits(bits[lo : lo + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of one text, as an unsigned 64-bit number."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, one row per row of ``docs``."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(np.fromiter((fingerprint(x, shingle) for x in t), np.uint64, len(t)).view(np.int64))

    fp = F.pandas_udf(work, "long")(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), fp.alias("fp"))


@dataclass(frozen=True)
class Parts:
    """Bits of each part and its threshold (-1: unused)."""

    bits: tuple[tuple[int, ...], ...]
    limits: tuple[int, ...]


def group_bits(corr: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """m parts of near-equal width; each grows by the bit most correlated with it on average."""
    left, out = list(range(64)), []
    strength = np.abs(corr) - np.eye(64)
    for p in range(m):
        width = 64 // m + (p < 64 % m)
        sub = strength[np.ix_(left, left)]
        part = [left[int(sub.max(axis=1).argmax())]]
        left.remove(part[0])
        while len(part) < width:
            part.append(left.pop(int(strength[np.ix_(part, left)].mean(axis=0).argmax())))
        out.append(tuple(sorted(part)))
    return tuple(out)


def within(match: np.ndarray, limit: int) -> np.ndarray:
    """P(at most t of the bits differ), t = 0..limit, for independent bits that agree with these probabilities."""
    p = np.zeros(limit + 1)
    p[0] = 1
    for a in match:
        p[1:] = p[1:] * a + p[:-1] * (1 - a)
        p[0] *= a
    return np.cumsum(p)


def allocate(costs: list[np.ndarray], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds >= -1 with the given sum and least cost; costs[i][t + 1] is that of t in part i."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for cost in costs:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (c, chosen) in best.items():
            for t1, extra in enumerate(cost):
                s = used + t1 - 1
                if s not in after or c + extra < after[s][0]:
                    after[s] = (c + extra, (*chosen, t1 - 1))
        best = after
    return best[total]


def value_of(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The part's bits, packed."""
    u, v = fp.view(np.uint64), np.zeros(len(fp), dtype=np.uint64)
    for k, b in enumerate(bits):
        v |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return v


def masks(width: int, limit: int) -> np.ndarray:
    """All masks of 1 to ``limit`` bits."""
    import itertools

    return np.array([sum(1 << b for b in c) for t in range(1, limit + 1) for c in itertools.combinations(range(width), t)], dtype=np.uint64)


def plan_parts(fps: DataFrame, radius: int, probe_cost: float = 200.0, counts_of_parts: tuple[int, ...] = (2, 3, 4)) -> Parts | None:
    """Parts and thresholds from statistics over all distinct fingerprints; ``probe_cost``: one probe in pair checks."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((65, 64), dtype=np.int64)
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            for lo in range(0, len(fp), 65536):
                x = np.unpackbits(fp[lo : lo + 65536].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[:64] += (x.T @ x).astype(np.int64)
                total[64, 0] += len(x)
        yield pd.DataFrame({"at": np.arange(65 * 64), "n": total.ravel()})

    sums = np.zeros(65 * 64)
    for r in fps.select("fp").mapInPandas(gram, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[r["at"]] = r["n"]
    both, n = sums[: 64 * 64].reshape(64, 64), sums[64 * 64]
    if n < 2:
        return None
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = (both / n - np.outer(p, p)) / np.outer(spread, spread)
    agree = np.clip(p * p + (1 - p) ** 2, 1e-6, 1 - 1e-6)
    layouts = [group_bits(corr, m) for m in counts_of_parts]

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp, at = pdf["fp"].to_numpy(), 0
            for layout in layouts:
                for bits in layout:
                    yield pd.DataFrame({"part": np.full(len(fp), at, np.int32), "value": value_of(fp, bits).view(np.int64)})
                    at += 1

    counts = fps.select("fp").mapInPandas(values, "part int, value long").groupBy("part", "value").agg(F.count("*").alias("n"))
    alike = {r["part"]: r["s"] for r in counts.groupBy("part").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("s")).collect()}
    best, at = None, 0
    for layout in layouts:
        costs = []
        for bits in layout:
            w, near = len(bits), within(agree[list(bits)], radius)
            skew = max(1.0, alike[at] / n**2 / max(near[0], 1e-30))
            balls = np.cumsum([math.comb(w, t) for t in range(radius + 1)])
            limit = max(t for t in range(radius + 1) if balls[t] <= 20_000)
            # the more bits may differ, the less the skew of exact matches matters
            costs.append(np.array([0.0] + [n * (1 + (balls[t] - 1) / 2) * probe_cost + n * n / 2 * near[t] * skew ** (1 / (1 + t)) for t in range(limit + 1)]))
            at += 1
        if sum(len(c) - 2 for c in costs) < radius - len(layout) + 1:
            continue  # too many probes
        cost, limits = allocate(costs, radius - len(layout) + 1)
        if best is None or cost < best[0]:
            best = (cost, Parts(layout, limits))
    return best[1]


def forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among these fingerprints, by breadth-first search."""
    left, edges = np.unique(fp), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= radius
            if near.any():
                edges += [(at, x) for x in left[near]]
                front += list(left[near])
                left = left[~near]
    return edges


def run_edges(key: np.ndarray, fp: np.ndarray, radius: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Edges among rows of equal key (sorted): all links of short runs by shifted comparison, forests of longer ones."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    a, b = [], []
    for s, n in zip(start[size > small], size[size > small], strict=True):
        for x, y in forest(fp[s : s + n], radius):
            a.append(np.array([x]))
            b.append(np.array([y]))
    keep = np.repeat((size > 1) & (size <= small), size)
    key, fp = key[keep], fp[keep]
    for d in range(1, small):
        same = key[d:] == key[:-d]
        if not same.any():
            break
        at = np.flatnonzero(same)
        near = np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= radius
        a.append(fp[at[near]])
        b.append(fp[at[near] + d])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def meetings(rows: DataFrame, parts: Parts, block: int) -> DataFrame:
    """(key, columns of ``rows``): every row at its own values and those it probes; rows have ``fp`` and are distinct."""
    used = [(i, bits, masks(len(bits), t)) for i, (bits, t) in enumerate(zip(parts.bits, parts.limits, strict=True)) if t >= 0]
    columns = rows.columns

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 4_000):
                some = {c: pdf[c].to_numpy()[lo : lo + 4_000] for c in columns}
                for i, bits, flips in used:
                    v = value_of(some["fp"], bits)
                    values, who = [v], [np.arange(len(v))]
                    for mask in flips:
                        top = np.uint64(1 << (int(mask).bit_length() - 1))
                        probe = (v & top) != 0
                        values.append(v[probe] ^ mask)
                        who.append(np.flatnonzero(probe))
                    at = np.concatenate(who)
                    yield pd.DataFrame({"part": np.int32(i), "value": np.concatenate(values).view(np.int64)} | {c: x[at] for c, x in some.items()})

    met = rows.mapInPandas(meet, "part int, value long, " + ", ".join(f"{c} long" for c in columns))
    return in_blocks(met, columns, block)


def in_blocks(met: DataFrame, columns: list[str], block: int) -> DataFrame:
    """(key, ``columns``) of rows that meet at (part, value); places of over ``block`` rows are dealt as pairs of blocks."""
    hot = met.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = cut(hot.select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    at = F.col("part"), F.col("value")
    if hot.isEmpty():
        return met.select(F.xxhash64(*at, F.lit(-1), F.lit(-1)).alias("key"), *columns)
    mine = F.pmod(F.xxhash64(*columns), F.coalesce("blocks", F.lit(1))).cast("int")
    split = met.join(hot, ["part", "value"], "left").withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
    split = split.select(*at, *columns, "mine", other)
    return split.select(F.xxhash64(*at, F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), *columns)


def links(fps: DataFrame, radius: int = 4, block: int = 20_000) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``fps`` (fp) that give the components of all links."""
    parts = plan_parts(fps, radius)
    if parts is None:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    placed = meetings(fps.select("fp"), parts, block)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            key, fp = pdf["key"].to_numpy(), pdf["fp"].to_numpy()
            if not len(key):
                continue
            if last is not None:
                key, fp = np.r_[last[0], key], np.r_[last[1], fp]
            end = np.searchsorted(key, key[-1])
            last = (key[end:], fp[end:])
            a, b = run_edges(key[:end], fp[:end], radius)
            yield pd.DataFrame({"a": a, "b": b})
        if last is not None:
            a, b = run_edges(*last, radius)
            yield pd.DataFrame({"a": a, "b": b})

    dealt = placed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(verify, "a long, b long").where("a <> b")


def groups(docs: DataFrame, shingle: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least id reachable over links, the row's own included."""
    own = cut(fingerprints(docs, shingle, doc_id, text))
    by_fp = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    root = components(links(by_fp.select("fp"), radius))
    linked = by_fp.join(root.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(least, "root").select("fp", "least")
    # only fingerprints of several rows or with links differ from their own id
    named = by_fp.where("n > 1").select("fp", "first").join(moved, "fp", "full").select("fp", F.coalesce("least", "first").alias("component"))
    joined = own.join(named, "fp", "left")
    return joined.select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


ROWS = 128


def second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, by a multiply and xor-shift mix of the first ones."""
    h = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


LEAST = 4  # shingles of the least hashes at which sets meet first
ONE_IN, SAMPLED, OFTEN, FREQUENT = 64, 1 << 12, 3, 1 << 17


def frequent(docs: DataFrame, shingle: int, text: str) -> np.ndarray:
    """Hashes of shingles that come often (in ``OFTEN`` or more distinct texts of a sample), the rarest first, at most ``FREQUENT``.

    The sample is one text in 64, or more where there are few. It only orders shingles: any order finds the same pairs.
    """
    one_in = min(ONE_IN, max(1, docs.count() // SAMPLED))
    some = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                found = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for t in batch.column(0).slice(lo, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    counts = cut(some.mapInArrow(work, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN))
    least, total = OFTEN, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).collect():
        total += r["m"]
        if total > FREQUENT:
            least = r["n"] + 1
            break
    found = counts.where(F.col("n") >= least).toArrow()
    token, n = (found.column(c).to_numpy() for c in ("token", "n"))
    return token[np.lexsort((token, n))]


def lengths(size: np.ndarray | int, per_mille: int):
    """How many of a set's first shingles the larger set of a similar pair must look at, and how many the smaller one."""
    return size - -(-per_mille * size // 1000) + 1, size - -(-2 * per_mille * size // (1000 + per_mille)) + 1


def shingle_sets(docs: DataFrame, shingle: int, per_mille: int, usual: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(doc_id, node, fp, fp2, size, odd, least0.., tokens): the row's set of shingles by its hash, with its two fingerprints, size, parities, least hashes and first shingles.

    ``tokens`` are those at which a similar set is met: in the order of hashes, those of ``usual`` (``frequent``) last.
    """
    by_hash = np.argsort(usual.view(np.uint64))
    sorted_usual = usual.view(np.uint64)[by_hash]
    many = pa.list_(pa.field("element", pa.int64()))

    def first(x: np.ndarray) -> np.ndarray:
        some = x
        if len(sorted_usual):
            at = np.minimum(np.searchsorted(sorted_usual, x), len(sorted_usual) - 1)
            known = sorted_usual[at] == x
            if known.any():
                some = np.concatenate([x[~known], x[known][np.argsort(by_hash[at[known]])]])
        return some[: lengths(len(x), per_mille)[0]]

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):  # few texts at a time are Python objects
                found, odd, least, tokens = [], [], [], []
                for t in batch.slice(lo, ROWS).to_pylist():
                    x = np.unique(np.array(shingle_hashes(t, shingle), np.uint64))
                    found.append((xxhash.xxh3_64_intdigest(x.tobytes()), majority(x), majority(second(x)), len(x)))
                    odd.append(parities(x))
                    least.append([*x[:LEAST].view(np.int64).tolist(), *[None] * (LEAST - len(x))])
                    tokens.append(first(x).view(np.int64))
                ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                columns = [*(pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*found, strict=True)), pa.array(odd, pa.binary()), *(pa.array(c, pa.int64()) for c in zip(*least, strict=True))]
                yield pa.StructArray.from_arrays([*columns, pa.ListArray.from_arrays(ends, np.concatenate(tokens), type=many)], names)

    names = ["node", "fp", "fp2", "size", "odd", *(f"least{k}" for k in range(LEAST)), "tokens"]
    kinds = ", ".join(f"{c} {'binary' if c == 'odd' else 'array<long>' if c == 'tokens' else 'long'}" for c in names)
    one = F.arrow_udf(work, kinds)(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), one.alias("s")).select("doc_id", "s.*")


def run_pairs(key: np.ndarray, fp: np.ndarray, other: np.ndarray, size: np.ndarray, radius: int, wide: int, per_mille: int, small: int = 64, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Places of candidate pairs of equal key (sorted) whose sizes allow the similarity.

    Of runs over ``small``, each row's ``most`` nearest later ones; a row that has more, and all of them, are paired with
    themselves, so that it is known where pairs are missing.
    """
    fp, other, size = (np.ascontiguousarray(c) for c in (fp, other, size))
    own, far = fp.view(np.uint64), other.view(np.uint64)

    def fits(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        return 1000 * np.minimum(size[i], size[j]) >= per_mille * np.maximum(size[i], size[j])

    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(key)])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cut_off = np.zeros(len(key), bool)
    for s, n in zip(start[count > small].tolist(), count[count > small].tolist(), strict=True):
        for i in range(s, s + n - 1):
            one = np.bitwise_count(own[i + 1 : s + n] ^ own[i])
            near = np.flatnonzero(one <= radius)
            if not len(near):
                continue
            two = np.bitwise_count(far[i + 1 + near] ^ far[i])
            ok = (two <= wide) & fits(i, i + 1 + near)
            near, apart = near[ok], (one[near] + two)[ok]
            if len(near) > most:
                cut_off[i] = True
                cut_off[i + 1 + near] = True
                rank = apart.astype(np.int64) * n + np.arange(len(near))  # of equal distances the first
                near = near[np.argpartition(rank, most - 1)[:most]]
            a.append(np.full(len(near), i))
            b.append(i + 1 + near)
    a.append(np.flatnonzero(cut_off))
    b.append(a[-1])
    short = np.flatnonzero(np.repeat((count > 1) & (count <= small), count))
    key = key[short]
    for d in range(1, small):
        at = np.flatnonzero(key[d:] == key[:-d])
        if not len(at):
            break
        i, j = short[at], short[at + d]
        ok = (np.bitwise_count(own[i] ^ own[j]) <= radius) & (np.bitwise_count(far[i] ^ far[j]) <= wide) & fits(i, j)
        a.append(i[ok])
        b.append(j[ok])
    return np.concatenate(a), np.concatenate(b)


AHEAD = 8


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of whole keys, keys being the first of the columns (longs) and sorted."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        x = x if held is None else np.concatenate([held, x])
        end = np.searchsorted(x[:, 0], x[-1, 0])
        if end:
            yield x[:end]
        held = x[end:]
    if held is not None:
        yield held


def neighbours(sets: DataFrame, radius: int, wide: int, per_mille: int) -> DataFrame:
    """Distinct pairs (a, b) of ``sets`` (node, fp, fp2, size, least0..) that may be similar, of those that meet at a least hash.

    In the order of size each set is paired with the ``AHEAD`` next ones at most, so that pairs grow with the sets; what is
    missing is for ``dense_candidates`` to find.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_key(batches):
            for d in range(1, AHEAD + 1):
                i = np.flatnonzero(x[d:, 0] == x[:-d, 0])
                if not len(i):
                    break
                j = i + d
                one, two = (np.bitwise_count((x[i, c] ^ x[j, c]).view(np.uint64)) for c in (3, 4))
                ok = (np.minimum(one, two) <= radius) & (np.maximum(one, two) <= wide) & (1000 * x[i, 1] >= per_mille * x[j, 1])
                a, b = x[i[ok], 2], x[j[ok], 2]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    met = sets.select(F.explode(F.array_compact(F.array(*[f"least{k}" for k in range(LEAST)]))).alias("key"), "size", "node", "fp", "fp2")
    return met.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(compare, "a long, b long").where("a <> b").distinct()


BITS, MOST = 1024, 4  # of a set's parities; partners that a set is compared with first


def parities(hashes: np.ndarray) -> bytes:
    """For each value of a shingle's low ten bits, whether an odd number of the set's shingles have it.

    Of two sets, every bit that differs is a shingle that only one of them has: no fewer than so many are not shared.
    """
    odd = np.bincount((hashes.view(np.uint64) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


PAIRS_AT_ONCE = 1 << 18


def pairs_at_once(key: np.ndarray, x: np.ndarray, radius: int, wide: int, per_mille: int, odd: np.ndarray | None = None, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of equal key, some at a time; columns of ``x``: node, fp, fp2, size, component, whether the key is early in the set, and with ``odd``, the set's shingles from the key on.

    Rows are sorted by key, size and node. The smaller set of a pair must hold the key early, so that only such rows look for
    partners, and only among the sizes that the similarity allows; both fingerprints and the components decide. Then come
    bounds that no similar pair misses: the first shingle that both have leaves enough of both, and the parities (``odd``) do
    not differ in more places than the sets may. With ``most``, a row is paired with so many of those of the nearest parities.
    """
    node, fp, fp2, size, comp, early = x.T[:6]
    largest = size * 1000 // per_mille  # of a partner that is no smaller
    end = np.searchsorted(key, key, side="right")
    a, b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i in np.flatnonzero((early == 1) & (end - np.arange(len(key)) > 1)).tolist():
        last = i + 1 + int(np.searchsorted(size[i + 1 : end[i]], largest[i], side="right"))
        j = i + 1 + np.flatnonzero(comp[i + 1 : last] != comp[i])
        if not len(j):
            continue
        one = np.bitwise_count((fp[j] ^ fp[i]).view(np.uint64))
        two = np.bitwise_count((fp2[j] ^ fp2[i]).view(np.uint64))
        j = j[(np.minimum(one, two) <= radius) & (np.maximum(one, two) <= wide)]
        if odd is not None and len(j):
            rest, both = x[:, 6], size[j] + size[i]
            shared = -(-per_mille * both // (1000 + per_mille))  # at least, of similar sets
            enough = np.minimum(rest[j], rest[i]) >= shared
            j, apart = j[enough], (both - 2 * shared)[enough]
            differ = np.bitwise_count(odd[j] ^ odd[i]).sum(axis=1, dtype=np.int64)
            j, differ = j[differ <= apart], differ[differ <= apart]
            if most is not None and len(j) > most:
                j = j[np.argsort(differ, kind="stable")[:most]]
        a.append(np.full(len(j), i))
        b.append(j)
        held += len(j)
        if held >= PAIRS_AT_ONCE:
            yield np.concatenate(a), np.concatenate(b)
            a, b, held = [], [], 0
    if a:
        yield np.concatenate(a), np.concatenate(b)


def prefix_pairs(key: np.ndarray, x: np.ndarray, radius: int, wide: int, per_mille: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``pairs_at_once``, all of them, without the bounds on what is shared."""
    a, b = zip(*pairs_at_once(key, x, radius, wide, per_mille), strict=True)
    return np.concatenate(a), np.concatenate(b)


def meeting_rows(sets: DataFrame, per_mille: int) -> DataFrame:
    """(value, node, size, early, rest): the shingles of ``sets`` (node, comp, size, tokens) at which another set of a fitting size and another component is met."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_key(batches):
            new = np.r_[True, x[1:, 0] != x[:-1, 0]]
            x = x[~(new & np.r_[new[1:], True])]  # a shingle of one set joins nothing
            if not len(x):
                continue
            value, place, node, comp = x.T
            size, at = place >> 32, place & 0xFFFFFFFF
            group = np.cumsum(np.r_[True, value[1:] != value[:-1]]) << 32
            last = np.searchsorted(group + size, group + size * 1000 // per_mille, side="right")
            changes = np.cumsum(np.r_[False, comp[1:] != comp[:-1]])
            here = np.arange(len(x))
            early = at < lengths(size, per_mille)[1]
            met = early & (changes[last - 1] > changes[here])
            within = np.zeros(len(x) + 1, np.int64)
            np.add.at(within, here[met], 1)
            np.add.at(within, last[met], -1)
            kept = np.cumsum(within[:-1]) > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[kept].astype(np.int64)) for c in (value, node, size, early, size - at)], ["value", "node", "size", "early", "rest"])

    n_tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # sorting small rows costs more per byte than merging partitions assumes
    rows = sets.select("node", "comp", "size", F.posexplode("tokens").alias("at", "value"))
    rows = rows.select("value", (F.shiftleft("size", 32) + F.col("at")).alias("place"), "node", "comp")
    return rows.repartition(n_tasks, "value").sortWithinPartitions("value", "place", "node").mapInArrow(work, "value long, node long, size long, early long, rest long")


def dense_candidates(rows: DataFrame, comps: DataFrame, radius: int, wide: int, per_mille: int, block: int = 20_000, most: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different components (``comps``: node, comp) that may be similar; ``rows``: part, value, node, fp, fp2, size, early, rest, odd.

    A prefix-filtered join of whole shingle sets: similar sets share a shingle that is early in both. The smaller
    set needs fewer of them than the larger, so that what a whole corpus shares (a template) meets no one. Shingles whose
    sets are linked already, such as those of a group of near copies, drop out before rows meet. ``most``: see ``pairs_at_once``.
    """
    rows = rows.join(comps, "node")
    live = rows.groupBy("value").agg(F.max("early").alias("e"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("e = 1 and lo < hi").select("value")
    columns = ["node", "fp", "fp2", "size", "comp", "early", "rest"]
    placed = in_blocks(rows.join(live, "value", "left_semi").select("part", "value", *columns, "odd"), [*columns, "odd"], block)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            key, x = pdf["key"].to_numpy(), pdf[columns].to_numpy()
            odd = np.frombuffer(b"".join(pdf["odd"]), np.uint64).reshape(len(pdf), -1)
            if last is not None:
                key, x, odd = np.r_[last[0], key], np.r_[last[1], x], np.r_[last[2], odd]
            end = np.searchsorted(key, key[-1])
            last = (key[end:], x[end:], odd[end:])
            yield from pairs(key[:end], x[:end], odd[:end])
        if last is not None:
            yield from pairs(*last)

    def pairs(key: np.ndarray, x: np.ndarray, odd: np.ndarray) -> Iterator[pd.DataFrame]:
        for i, j in pairs_at_once(key, x, radius, wide, per_mille, odd, most):
            yield pd.DataFrame({"a": np.minimum(x[i, 0], x[j, 0]), "b": np.maximum(x[i, 0], x[j, 0])}).drop_duplicates()

    # a fixed number of tasks: comparing costs far more per byte than merging small partitions assumes
    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n_tasks, "key").sortWithinPartitions("key", "size", "node").mapInPandas(compare, "a long, b long").where("a <> b").distinct()


WANTED = 1 << 19  # numbers of rows that are broadcast at most


def near_groups(docs: DataFrame, shingle: int = 5, per_mille: int = 800, radius: int = 14, wide: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id): components of texts whose shingle sets have a Jaccard similarity of ``per_mille``/1000 or more.

    Candidates are pairs that are near by one fingerprint and not far by the other. Sets are compared with a few neighbours
    first (``neighbours``), which links groups of near copies; then with all sets that they are not linked to, by their first
    shingles (``dense_candidates``): with the nearest of them, and once those are linked, with the rest.
    """
    own = cut(shingle_sets(docs, shingle, per_mille, frequent(docs, shingle, text), doc_id, text))
    same = [F.first(c).alias(c) for c in ("fp", "fp2", "size", *(f"least{k}" for k in range(LEAST)))]
    by_set = cut(own.groupBy("node").agg(F.min("doc_id").alias("first"), *same, F.count("*").alias("n")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                some = pdf.iloc[lo : lo + 500]
                sets = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)).view(np.int64) for t in some["text"]]
                yield pd.DataFrame({"node": some["node"].to_numpy(), "hashes": sets})

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        wanted = by_set.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", F.col("first").alias("doc_id"))
        wanted = cut(wanted)
        wanted = F.broadcast(wanted) if wanted.count() <= WANTED else wanted  # else all texts are shuffled to find some
        texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id").select("node", "text")
        sets = cut(texts.mapInPandas(work, "node long, hashes array<long>"))
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(1000 * shared >= per_mille * (F.size("x") + F.size("y") - shared)).select("a", "b")

    def apart(nodes: DataFrame, so_far: DataFrame) -> DataFrame:
        return nodes.join(so_far.toDF("node", "__root"), "node", "left").withColumn("comp", F.coalesce("__root", "node")).drop("__root")

    edges, rows = cut(similar(neighbours(by_set, radius, wide, per_mille))), None
    for most in (MOST, None):  # the nearest first, which joins groups of similar sets; then all that are still apart
        so_far = components(edges)
        if rows is None:
            once = apart(by_set.select("node", F.col("first").alias("doc_id")), so_far).select("doc_id", "comp")  # of equal sets the first alone
            met = cut(meeting_rows(own.join(once, "doc_id"), per_mille))
            nodes = cut(met.select("node").distinct())
            told = own.join(by_set.join(nodes, "node", "left_semi").select(F.col("first").alias("doc_id")), "doc_id", "left_semi").select("node", "fp", "fp2", "odd")
            rows = cut(met.join(told, "node").select(F.lit(0).alias("part"), "value", "node", "fp", "fp2", "size", "early", "rest", "odd"))
        # what is linked goes on as one edge a node: the many links of a group of near copies are walked once
        tree = so_far.where("node <> root").toDF("a", "b")
        edges = cut(tree.union(similar(dense_candidates(rows, cut(apart(nodes, so_far)), radius, wide, per_mille, most=most))))
    linked = by_set.join(components(edges), "node")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(least, "root").select("node", "least")
    named = by_set.where("n > 1").select("node", "first").join(moved, "node", "full").select("node", F.coalesce("least", "first").alias("component"))
    return own.join(named, "node", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def op2_simhash_groups(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
