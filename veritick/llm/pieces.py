"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant documents.

The segmentation of a text is its best path through pieces, the sum of the steps' weights.  A unigram model's step
weighs its piece's score.  A byte-pair model's segmentation is the one path in which every piece segments to itself and
every two neighbours segment to themselves when joined; a step weighs 0 then, and minus infinity otherwise.  Either way
a search over positions from left to right needs the last piece only.  No piece has a word start inside, so paths meet
at word starts and words are segmented independently; a worker keeps the segmentations of frequent words.  Within a
word, byte-pair paths also meet wherever no piece of the vocabulary has the two characters side by side.

A document longer than ``chunk`` characters is split in chunks.  A boundary's states are the pieces that may lie on or
end at it.  A chunk gives its transfer matrix (the best weight from each entry state to each exit state), matrices are
combined associatively, which gives the best weight up to every state of every boundary; the states are then fixed from
the last boundary back, and each chunk is traced back on its own between its two states.  Equal weights go to the
least state, the longer piece within a word.

Text is taken as the model does without normalisation: a space in front, spaces written as U+2581; characters without
a piece become UTF-8 byte pieces.  Decoding inverts this exactly, but that U+2581 itself comes back as a space.

Edge cases: a null text has null ids and decodes to null; the empty text has no ids. Repeated rows are encoded one by
one, null ids of documents are kept. An empty table gives an empty result. Extra columns pass through; one
named ``ids`` is replaced.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritick.session import cut

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GAP = "▁"
WORDS = re.compile(f"{GAP}*[^{GAP}]+|{GAP}+")
CHUNK = 65_536
ROWS = 512  # texts of an Arrow batch that are Python strings at one time
KEPT = 100_000  # segmentations in each of a worker's two generations
State = tuple[int, int]  # start and end of the piece on a boundary, relative to the boundary
Matrix = dict[tuple[State, State], float]
NONE = float("-inf")


class Memory(dict):
    """Results by text, made on demand, of bounded size: what was not asked for during a whole generation goes."""

    def __init__(self, make, most: int = KEPT) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) < 64:
            self[key] = got
        return got


@dataclass
class Vocabulary:
    """Pieces with ids and scores (byte-pair: ``ids`` has only those that segment to themselves), byte ids, bytes of each id."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_ids: list[int]
    as_bytes: list[bytes]
    longest: int
    unigram: bool = False

    def __post_init__(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.words = Memory(self.make_word)
        self.stretches = Memory(lambda x: array("i", self.codes(self.segment(x))).tobytes())
        self.reaches: dict[str, int] = {}  # by its first two characters, the longest piece
        for p in self.ids:
            if len(p) > 1:
                self.reaches[p[:2]] = max(self.reaches.get(p[:2], 1), len(p))
        self.side_by_side = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.unknown = min(self.scores.values(), default=0.0) - 10.0  # a character without a piece
        self.of_ids = np.array(self.as_bytes, dtype=object)

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging by definition: the best-scored neighbours first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, a: str, b: str) -> bool:
        """Whether two pieces may be neighbours."""
        i, j = self.ids.get(a), self.ids.get(b)
        if i is None or j is None:
            return self.merge(a + b) == [a, b]
        key = i << 20 | j
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            got = self.pairs[key] = self.merge(a + b) == [a, b]
        return got

    def codes(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [self.bytes_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def segment(self, word: str) -> list[str]:
        """The pieces of a stretch whose both ends are fixed."""
        return self.best(word) if self.unigram else self.only(word)

    def best(self, word: str) -> list[str]:
        """The path of the largest sum of scores."""
        top, cut = [0.0] + [NONE] * len(word), [0] * (len(word) + 1)
        for pos in range(len(word)):
            for end in range(min(len(word), pos + self.longest), pos, -1):
                w = self.scores.get(word[pos:end], self.unknown if end == pos + 1 else NONE)
                if top[pos] + w > top[end]:
                    top[end], cut[end] = top[pos] + w, pos
        out, end = [], len(word)
        while end:
            out.append(word[cut[end] : end])
            end = cut[end]
        return out[::-1]

    def only(self, word: str) -> list[str]:
        """The one valid path, found depth first, longest piece first.

        A valid path to a position is the only one, so a position that leads nowhere is given up for good.
        """
        ids, reaches, agree = self.ids, self.reaches, self.agree
        out: list[str] = []
        dead: set[int] = set()
        pos, n = 0, len(word)
        while pos < n:
            for end in range(min(n, pos + reaches.get(word[pos : pos + 2], 1)), pos, -1):
                t = word[pos:end]
                if (end == pos + 1 or t in ids) and end not in dead and (not out or agree(out[-1], t)):
                    out.append(t)
                    pos = end
                    break
            else:
                dead.add(pos)
                pos -= len(out.pop())
        return out

    def make_word(self, rest: str) -> bytes:
        """Ids, as packed 32-bit numbers, of a word whose first character is a word start, given without it."""
        word, near = GAP + rest, self.side_by_side
        at, out = 0, []
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in near:  # no piece reaches across
                out.append(self.stretches[word[at:i]])
                at = i
        return b"".join((*out, self.stretches[word[at:]]))

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if not text:
            return b""
        words = text.split(" ")
        if "" in words or GAP in text:
            words = [w[1:] for w in WORDS.findall(GAP + text.replace(" ", GAP))]
        return b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: np.ndarray) -> str:
        line = b"".join(self.of_ids[ids].tolist()).decode("utf-8", "replace").replace(GAP, " ")
        return line[1:] if line[:1] == " " else line

    # -- chunks -------------------------------------------------------------------------------------------------

    def states(self, x: str, at: int, last: bool) -> list[State]:
        """Pieces that start before position ``at`` and end there or later (exactly there at the end of a text)."""
        if at == 0:
            return [(0, 0)]
        out = []
        for a in range(max(0, at - self.longest), at):
            for b in range(at, min(len(x), a + self.longest) + 1):
                if (not last or b == at) and (b - a == 1 or x[a:b] in self.ids):
                    out.append((a - at, b - at))
        return out

    def weight(self, before: str | None, piece: str) -> float:
        """The weight of a piece after the one before it (None: at a word start)."""
        if self.unigram:
            return self.scores.get(piece, self.unknown)
        return 0.0 if before is None or self.agree(before, piece) else NONE

    def reach(self, x: str, start: int, at: int, stop: int) -> dict[State, tuple[float, State | None]]:
        """From the piece x[start:at], every (end, start) of a piece that a path leads to: best weight, the one before it."""
        back: dict[State, tuple[float, State | None]] = {(at, start): (0.0, None)}
        waiting = {at: [start]}
        for pos in range(at, stop):  # paths to a position are complete before any leads on from it
            for a in sorted(waiting.pop(pos, ())):
                so_far = back[pos, a][0]
                free = a == pos or x[pos] == GAP and x[pos - 1] != GAP
                for b in range(pos + 1, min(len(x), pos + self.longest) + 1):
                    t = x[pos:b]
                    if b > pos + 1 and t not in self.ids:
                        continue
                    got = so_far + self.weight(None if free else x[a:pos], t)
                    if got > back.get((b, pos), (NONE, None))[0]:
                        if (b, pos) not in back:
                            waiting.setdefault(b, []).append(pos)
                        back[b, pos] = got, (pos, a)
        return back

    def breaks(self, x: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last word start in [lo, hi]."""
        at = [m.start() + 1 for m in re.compile(f"[^{GAP}](?={GAP})").finditer(x, max(0, lo - 1), hi + 1) if lo <= m.start() + 1 <= hi and m.start() + 1 < len(x)]
        return (at[0], at[-1]) if at else None

    def between(self, x: str, lo: int, hi: int) -> float:
        """The weight of the words of x[lo:hi], which starts and ends at word starts."""
        return sum(sum(self.weight(None, p) for p in self.best(w)) for w in WORDS.findall(x[lo:hi])) if self.unigram else 0.0

    def transfer(self, x: str, lo: int, hi: int, last: bool) -> Matrix:
        """The finite entries of the transfer matrix of x[lo:hi]; x has the text around it."""
        leaving = {(a, b) for a, b in self.states(x, hi, last)}
        entering = self.states(x, lo, False)
        mid = self.breaks(x, lo + self.longest, hi)
        if mid is not None and mid[1] == hi:  # a word start on the boundary itself is no place to begin the last part
            inner = self.breaks(x, lo + self.longest, hi - 1)
            mid = (inner[0], inner[1]) if inner else None

        def exits(back: dict) -> list[tuple[State, float]]:
            return [((a - hi, b - hi), w) for (b, a), (w, _) in back.items() if b >= hi and a < hi and (a - hi, b - hi) in leaving]

        if mid is None:
            return {(e, z): w for e in entering for z, w in exits(self.reach(x, lo + e[0], lo + e[1], hi))}
        tail = exits(self.reach(x, mid[1], mid[1], hi))
        inner_weight, out = self.between(x, *mid), {}
        for e in entering:
            heads = [w for (b, _), (w, _) in self.reach(x, lo + e[0], lo + e[1], mid[0]).items() if b == mid[0]]
            if heads:
                best = max(heads) + inner_weight
                out |= {(e, z): best + w for z, w in tail}
        return out

    def trace(self, x: str, lo: int, hi: int, entry: State, leave: State) -> bytes:
        """Packed ids of the pieces after the entry piece up to the exit piece."""

        def path(start: int, at: int, end: int, first: int) -> list[str]:
            back, here, out = self.reach(x, start, at, min(hi, end)), (end, first), []
            if first < 0:
                here = max((k for k in back if k[0] == end), key=lambda k: (back[k][0], -k[1]))
            while back[here][1] is not None:
                out.append(x[here[1] : here[0]])
                here = back[here][1]
            return out[::-1]

        a, b, end, first = lo + entry[0], lo + entry[1], hi + leave[1], hi + leave[0]
        mid = self.breaks(x, b, first)
        if mid is None:
            return array("i", self.codes(path(a, b, end, first))).tobytes()
        head = array("i", self.codes(path(a, b, mid[0], -1) if mid[0] > b else [])).tobytes()
        inner = b"".join(self.words[w[1:]] for w in WORDS.findall(x[mid[0] : mid[1]]))
        return head + inner + array("i", self.codes(path(mid[1], mid[1], end, first))).tobytes()


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a byte-pair model file with byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    if any(re.search(f"[^{GAP}]{GAP}", p) for p in plain):
        raise ValueError("pieces with a word start inside are not supported")
    bytes_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    as_bytes = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode() for i in range(n)]
    v = Vocabulary(plain, {p: sp.get_score(i) for p, i in plain.items()}, bytes_ids, as_bytes, max(map(len, plain)))
    v.ids = {p: i for p, i in plain.items() if v.merge(p) == [p]}
    return v


_HERE: dict[str, Vocabulary] = {}
FIELDS = ("ids", "scores", "bytes_ids", "as_bytes", "longest", "unigram")


def _own(shared) -> Vocabulary:
    """This worker's copy, so that what it remembers of words lasts from task to task."""
    key = str(shared.value["key"])
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = Vocabulary(**shared.value["vocabulary"])
    return _HERE[key]


def share(spark: SparkSession, path: str = MODEL, vocabulary: Vocabulary | None = None):
    """The vocabulary (of the file, if none is given) as a broadcast; its size is that of the model file, some hundred kilobytes."""
    v = vocabulary or load(path)
    shared = spark.sparkContext.broadcast({"key": path if vocabulary is None else uuid.uuid4().hex, "vocabulary": {k: getattr(v, k) for k in FIELDS}})
    shared.longest = v.longest  # for the driver, which then need not load the broadcast
    return shared


def compose(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product of two matrices; absent entries are minus infinity."""
    by: dict = {}
    for (x, y), w in b.items():
        by.setdefault(x, []).append((y, w))
    out: Matrix = {}
    for (x, y), w in a.items():
        for z, more in by.get(y, ()):
            if w + more > out.get((x, z), NONE):
                out[x, z] = w + more
    return out


def scan(items: list[Matrix]) -> list[Matrix]:
    """All prefix products, by doubling."""
    out, step = list(items), 1
    while step < len(out):
        out = [compose(out[i - step], m) if i >= step else m for i, m in enumerate(out)]
        step *= 2
    return out


def settle(matrices: list[Matrix]) -> list[State]:
    """The states of the best path at every boundary, the first and last included."""
    ahead = scan(matrices)
    at_end = {z: w for (_, z), w in ahead[-1].items()}
    if not at_end:
        raise ValueError("no path through the text")
    out = [max(at_end, key=lambda z: (at_end[z], (-z[0], -z[1])))]
    for k in range(len(matrices) - 1, 0, -1):
        before = {y: w for (_, y), w in ahead[k - 1].items()}
        ways = {y: before[y] + w for (y, z), w in matrices[k].items() if z == out[-1] and y in before}
        out.append(max(ways, key=lambda y: (ways[y], (-y[0], -y[1]))))
    return [(0, 0), *out[::-1]]


def _giants(texts: DataFrame, shared, chunk: int) -> DataFrame:
    """(__row, ids) of long texts (__row, text)."""
    longest = shared.longest
    line = F.concat(F.lit(GAP), F.replace(F.col("text"), F.lit(" "), F.lit(GAP)))
    rows = texts.select("__row", line.alias("s"), F.ceil((F.length("text") + 1) / chunk).cast("int").alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")
    rows = rows.select("__row", "s", "n", k).withColumn("lo", F.least(F.col("k") * chunk, F.lit(longest)))
    around = F.substr("s", F.col("k") * chunk - F.col("lo") + 1, F.col("lo") + chunk + longest)
    pieces = cut(rows.select("__row", "k", "n", "lo", around.alias("x")).repartition("__row", "k"))
    spot = "__row long, k int"

    def ends(r) -> tuple[int, int, bool]:
        last = r.k == r.n - 1
        return r.lo, len(r.x) if last else r.lo + chunk, last

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = _own(shared)
        for pdf in batches:
            flat, weights = [], []
            for r in pdf.itertuples():
                lo, hi, last = ends(r)
                m = v.transfer(r.x, lo, hi, last)
                flat.append([i for e, z in m for i in (*e, *z)])
                weights.append(list(m.values()))
            yield pd.DataFrame({"__row": pdf["__row"], "k": pdf["k"], "m": flat, "w": weights})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        ends4 = [np.array(m, np.int64).reshape(-1, 4).tolist() for m in pdf["m"]]
        got = settle([{((a, b), (c, d)): w for (a, b, c, d), w in zip(m, ws, strict=True)} for m, ws in zip(ends4, pdf["w"], strict=True)])
        a = np.array(got[:-1]).reshape(-1, 2)
        z = np.array(got[1:]).reshape(-1, 2)
        return pd.DataFrame({"__row": pdf["__row"], "k": pdf["k"], "a0": a[:, 0], "a1": a[:, 1], "z0": z[:, 0], "z1": z[:, 1]})

    def traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = _own(shared)
        for pdf in batches:
            ids = [np.frombuffer(v.trace(r.x, *ends(r)[:2], (r.a0, r.a1), (r.z0, r.z1)), np.int32) for r in pdf.itertuples()]
            yield pd.DataFrame({"__row": pdf["__row"], "k": pdf["k"], "ids": ids})

    fixed = pieces.mapInPandas(matrices, f"{spot}, m array<int>, w array<double>").groupBy("__row").applyInPandas(combine, f"{spot}, a0 int, a1 int, z0 int, z1 int")
    traced = pieces.join(fixed, ["__row", "k"]).mapInPandas(traces, f"{spot}, ids array<int>")
    parts = F.array_sort(F.collect_list(F.struct("k", "ids")))
    return traced.groupBy("__row").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def packed_ids(packed: list[bytes | None]) -> pa.Array:
    """Packed ids of some texts as an Arrow list."""
    ends = np.cumsum([0] + [len(p or b"") // 4 for p in packed], dtype=np.int32)
    values = pa.array(np.frombuffer(b"".join(p for p in packed if p), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([p is None for p in packed]))


def encode(docs: DataFrame, shared, text: str = "text", chunk: int = CHUNK, back: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), and with ``back``, whether they decode to the text (null for a null text)."""
    kind = f"ids array<int>{', back boolean' if back else ''}"

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = _own(shared)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                texts = batch.slice(lo, ROWS).to_pylist()
                packed = [None if x is None else v.encode(x) for x in texts]
                found = [packed_ids(packed)]
                if back:
                    found.append(pa.array([None if x is None else v.decode(np.frombuffer(p, np.int32)) == x.replace(GAP, " ") for x, p in zip(texts, packed, strict=True)], pa.bool_()))
                yield pa.StructArray.from_arrays(found, ["ids", "back"][: len(found)])

    docs = docs.drop(*[c for c in ("ids", back) if c and c != text])
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    some = docs.where(size <= chunk).withColumn("__pieces", F.arrow_udf(work, kind)(F.col(text)))
    added = {"ids": F.col("__pieces.ids")} | ({back: F.col("__pieces.back")} if back else {})
    short = some.withColumns(added).drop("__pieces")
    giants = cut(docs.where(size > chunk).withColumn("__row", F.monotonically_increasing_id()))
    if giants.isEmpty():
        return short
    found = _giants(giants.select("__row", F.col(text).alias("text")), shared, chunk)
    long = giants.join(found, "__row").drop("__row")
    if back:
        long = decode(long, shared, into="__decoded").withColumn(back, F.col("__decoded") == F.replace(F.col(text), F.lit(GAP), F.lit(" "))).drop("__decoded")
    return short.unionByName(long)


def decode(df: DataFrame, shared, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids."""

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = _own(shared)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                some = batch.slice(lo, ROWS)
                values, ends = some.values.to_numpy(zero_copy_only=False), some.offsets.to_pylist()
                yield pa.array([v.decode(values[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], some.is_valid().to_pylist(), strict=False)], pa.string())

    return df.withColumn(into, F.arrow_udf(work, "string")(F.col(ids)))


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): round_trip tells whether decoding gives the text back."""
    both = encode(docs.select("doc_id", "text"), share(docs.sparkSession, path), back="back")
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", F.coalesce("back", F.lit(True)).alias("round_trip"))


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
