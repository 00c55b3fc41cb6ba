"""Personal data by candidate gradient boosting, with built-in functions only.

Base patterns give the spans that always stay.  High-recall generators propose further, possibly overlapping spans of
the same kinds, in forms that the base patterns do not take: an at sign or dots written out or set apart, numbers
without a plus, cards of 13 digits or with dots, addresses with bracketed dots.  Each candidate has binned format and
context features; candidates of all documents are counted by feature cell with a label, and boosted trees are fitted on the
counted cells.  Thresholds are calibrated on held-out scores: texts fall in three folds, each scored by trees fitted on
the other two, and per kind the lowest score at which the kept candidates reach ``precision`` is the threshold.
Candidates at or over it become spans unless they overlap a base span of their kind.

Labels are weak, and candidates without evidence either way stay out of the sample.  An e-mail is labelled by whether
it ends in a known domain ending, however its at sign and dots are written; the trees do not see that list, but length
and kind of the last part.  A card or an address is a positive if it is a base span, and a negative if it fails Luhn's
check or has a part over 255; other forms that pass are judged, not learned from.  A phone number has an area code in
brackets or of a valid first digit and the groups of a national number, or 9 to 15 digits after a cue such as "call".
No feature tells a plus, an at sign, a 13th digit or a bracketed dot from its plain form.

Edge cases: a null text counts as empty; empty texts have no spans. Rows with a null id are kept with null id. Repeated
rows are scored one by one. Where no candidate exists, the base spans are the result. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritick.llm import boosting, spans

KINDS = ("email", "ip", "card", "phone")
# A match may begin inside a run of its own first characters only where the previous match ended (\G): this keeps the
# leftmost matches and avoids trying every start of a long run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.-])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
OCTETS = r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}"
ENDINGS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|example|ac|ae|ai|ar|at|au|be|bg|br|ca|ch|cl|cn|co|cz|de|dk|ee|es|eu|fi|fr|gr|hk|hr|hu|id|ie|"
    "il|in|io|is|it|jp|ke|kr|lt|lu|lv|me|mx|my|ng|nl|no|nz|pe|ph|pk|pl|pt|ro|rs|ru|se|sg|si|sk|th|tr|tv|tw|ua|uk|us|vn|za"
)
NATIONAL = r"^(?:(?:\+|00)?[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)[\x20./-]?[0-9]{3}[\x20.-][0-9]{4}|[2-9][0-9]{2}([.-])[0-9]{3}\1[0-9]{4})$"
DATE = r"^(?:19|20)[0-9]{2}[./-][0-9]{2}[./-][0-9]{2}"
CUE = r"(?i)(?<![\p{L}0-9])(?:phone|tel|telephone|telefon|téléphone|teléfono|call|mobile|cell|fax|dial|sms|whatsapp)(?:[^\p{L}0-9]+\p{L}{1,8}){0,2}[^\p{L}0-9]{0,3}$"
FEATURES = ("kind", "valid", "luhn", "digits", "marks", "cue", "before", "after")  # format before context: equal gains go to the first
REACH = 32  # characters before a candidate that may hold a cue, or at its end that may hold a domain ending


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    doubled = F.split(F.lit("0,2,4,6,8,1,3,5,7,9"), ",").cast("array<int>")

    def at(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when((F.length(digits) - i) % 2 == 1, F.element_at(doubled, d + 1)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + at(i)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(OCTETS)
    if kind == "card":
        d = digits_of(hit)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(hit)).between(10, 15)
    return F.lit(True)


def _when(kind: str, text: Column) -> Column:
    """A cheap condition that every text with a match meets."""
    if kind == "email":
        return text.contains("@") | text.contains("(at)") | text.contains("[at]")
    return text.rlike("[0-9]")


def _char_class(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == "") | c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 4).when(c.rlike(r"^\p{L}"), 3).otherwise(2)
    )


def _features(order: int, hit: Column, side: Column) -> list[Column]:
    """Binned features of one candidate of ``KINDS[order]``; order as in ``FEATURES``."""
    kind, n = KINDS[order], F.length(digits_of(hit))
    return [
        F.lit(order),
        _form(kind, hit),
        F.when(n.between(13, 19) & luhn(digits_of(hit)), 1).otherwise(0) if kind in ("card", "phone") else F.lit(0),
        F.lit(0) if kind == "ip" else F.when(n < 7, 0).when(n < 10, 1).when(n < 13, 2).when(n < 17, 3).otherwise(4),
        F.when(hit.contains("("), 3).when(hit.rlike("[.-]"), 2).when(hit.contains(" "), 1).otherwise(0) if kind == "phone" else F.lit(0),
        F.when(side["before"].rlike(CUE), 1).otherwise(0) if kind == "phone" else F.lit(0),
        _char_class(F.right(side["before"], F.lit(1))),
        _char_class(side["after"]),
    ]


def _plain(hit: Column) -> Column:
    return F.regexp_replace(hit, r"[\[\]()]", "")


def _form(kind: str, hit: Column) -> Column:
    """Binned form, whether or not a base pattern takes it."""
    if kind == "email":
        last = F.regexp_extract(F.right(hit, F.lit(REACH)), "([A-Za-z0-9-]+)$", 1)
        return F.when(last.rlike("[0-9-]"), 0).when(F.length(last) == 2, 1).when(F.length(last) == 3, 2).otherwise(3)
    if kind == "phone":
        return F.when(hit.rlike(OCTETS) | hit.rlike(DATE), 0).when(hit.rlike(NATIONAL), 2).when(F.length(digits_of(hit)).between(9, 15), 1).otherwise(0)
    return F.when(_plain(hit).rlike(OCTETS), 2).otherwise(1)


def _evidence(kind: str, hit: Column, found: Column, features: list[Column]) -> tuple[Column, Column]:
    """Label, and whether the candidate is in the sample."""
    form, cue = features[FEATURES.index("valid")], features[FEATURES.index("cue")]
    if kind == "email":
        known = F.right(hit, F.lit(REACH)).rlike(rf"(?i)(?:\.|dot[)\]]\x20?)(?:{ENDINGS})$")
        return known, known | ~found
    if kind == "phone":
        known = (form == 2) | (form == 1) & (cue == 1)
        return known, known | ~found
    passes = features[FEATURES.index("luhn")] == 1 if kind == "card" else form == 2
    return found, found | ~passes


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__text`` (null as empty), ``__base_<kind>`` (encoded) per kind."""
    df = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("__text")
    df = df.withColumns({f"__raw_{k}": spans.gaps_and_hits(t, p, _when(k, t) & (t.contains("+") if k == "phone" else F.lit(True))) for k, p in BASE.items()})
    df = df.withColumns({f"__hits_{k}": spans.located(F.col(f"__raw_{k}")) for k in KINDS})

    def checked(k: str) -> Column:
        return F.filter(f"__hits_{k}", lambda s: _valid(k, s["hit"]))

    codes = {f"__base_{k}": spans.encoded(checked(k), k, i) for i, k in enumerate(KINDS)}
    return df.withColumns(codes).drop(*[f"__{x}_{k}" for k in KINDS for x in ("raw", "hits")])


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds ``__cand``: candidates of all kinds with their features and label."""
    t = F.col("__text")
    df = df.withColumns({f"__raw_{k}": spans.gaps_and_hits(t, p, _when(k, t)) for k, p in WIDE.items()} | {f"__side_{k}": spans.sides(t, p, _when(k, t), REACH) for k, p in WIDE.items()})
    df = df.withColumns({f"__hits_{k}": spans.located(F.col(f"__raw_{k}")) for k in KINDS})
    df = df.withColumns({f"__code_{k}": spans.encoded(F.col(f"__hits_{k}"), k, i) for i, k in enumerate(KINDS)})
    df = df.withColumns({f"__is_{k}": spans.member(F.col(f"__code_{k}"), F.col(f"__base_{k}")) for k in KINDS})
    df = df.withColumns({f"__both_{k}": F.arrays_zip(*[F.col(f"__{x}_{k}").alias(n) for x, n in (("hits", "c"), ("code", "code"), ("side", "side"), ("is", "found"))]) for k in KINDS})

    def described(i: int, k: str) -> Column:
        def one(x: Column) -> Column:
            found, features = x["found"], _features(i, x["c"]["hit"], x["side"])
            label, sample = _evidence(k, x["c"]["hit"], found, features)
            return F.struct(x["code"].alias("code"), label.alias("label"), sample.alias("sample"), *[f.alias(n) for n, f in zip(FEATURES, features, strict=True)])

        return F.transform(f"__both_{k}", one)

    every = [described(i, k) for i, k in enumerate(KINDS)]
    return df.withColumn("__cand", F.concat(*every)).drop(*[f"__{x}_{k}" for k in KINDS for x in ("raw", "hits", "side", "code", "is", "both")])


def train(docs: DataFrame, text: str = "text", precision: float = 0.9) -> tuple[float, list[boosting.Node], list[float]]:
    """Prior, trees and per-kind thresholds, from the counted feature cells of all candidates of all documents.

    The cells number at most 3 * 4 * 4 * 2 * 5 * 4 * 2 * 4 * 4; they are what comes to the driver.
    """
    df = with_candidates(with_base(docs.select(F.col(text).alias("text"))))
    fold = F.pmod(F.xxhash64("__text"), F.lit(3)).alias("fold")
    # an outer explode: an inner one would have its input computed once more, for a filter on its size
    one = df.select(fold, F.explode_outer("__cand").alias("c")).where("c is not null and c.sample")
    counts = one.groupBy("fold", *[F.col(f"c.{n}").alias(n) for n in FEATURES]).agg(F.count("*").alias("n"), F.count_if("c.label").alias("pos"))
    cells = sorted((r["fold"], tuple(r[n] for n in FEATURES), float(r["n"]), float(r["pos"])) for r in counts.collect())
    if not cells:
        return 0.0, [], [float("inf")] * len(KINDS)
    held: list[tuple[int, float, float, float]] = []  # kind, score, candidates, positives
    for f in range(3):
        rest = [c[1:] for c in cells if c[0] != f]
        if rest:
            model = boosting.fit(rest)
            held += [(x[0], boosting.total(*model, x), n, pos) for g, x, n, pos in cells if g == f]
    prior, trees = boosting.fit([c[1:] for c in cells])
    held = held or [(x[0], boosting.total(prior, trees, x), n, pos) for _, x, n, pos in cells]
    return prior, trees, [threshold([c[1:] for c in held if c[0] == i], precision) for i in range(len(KINDS))]


def threshold(cells: list[tuple[float, float, float]], precision: float) -> float:
    """The lowest score, even odds or more, from which up all (score, candidates, positives) together reach the precision."""
    scored = sorted(cells, reverse=True)
    limit, n, pos, k = float("inf"), 0.0, 0.0, 0
    while k < len(scored):
        s = scored[k][0]
        while k < len(scored) and scored[k][0] == s:  # cells of one score stand or fall together
            n, pos, k = n + scored[k][1], pos + scored[k][2], k + 1
        if pos >= precision * n:
            limit = s - 1e-9
    return max(limit, 0.0)


def detect(docs: DataFrame, text: str = "text", model: tuple | None = None) -> DataFrame:
    """``docs`` with ``__found``: struct of n_<kind> (base spans), ``base`` and ``all`` (encoded spans, see ``spans``)."""
    prior, trees, limits = model or train(docs, text)
    df = with_candidates(with_base(docs, text))

    def kept(c: Column) -> Column:
        limit = F.lit(limits[0])
        for i in range(1, len(KINDS)):
            limit = F.when(c["kind"] == i, F.lit(limits[i])).otherwise(limit)
        return boosting.score(prior, trees, [c[n] for n in FEATURES]) >= limit

    df = df.withColumn("__all_base", F.concat(*[F.col(f"__base_{k}") for k in KINDS]))
    added = F.transform(F.filter("__cand", kept), lambda c: c["code"])
    df = df.withColumns({"__added": spans.by_kind(F.array_except(added, F.col("__all_base"))), "__taken": spans.by_kind(F.col("__all_base"))})
    df = spans.with_free(df, "__added", "__taken", "__free")
    every = F.concat("__all_base", F.transform("__free", lambda x: x["hit"]))
    counts = [F.size(f"__base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select(*docs.columns, F.struct(*counts, F.col("__all_base").alias("base"), every.alias("all")).alias("__found"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[EMAIL]`` and so on; a null text stays null."""
    found = detect(docs, text).withColumn(text, spans.masked(F.col(text), F.col("__found.all")))
    return found.select(*docs.columns)


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    """Base counts, base digest and all spans of every document."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [f"__found.n_{k}" for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans.joined(F.col("__found.base")), 256).alias("base_sha256"), spans.joined(F.col("__found.all")).alias("spans"))
