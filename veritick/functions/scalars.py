"""Scalar rules as column expressions. Missing means null: NaN and infinities count as missing on input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of a value, the trust ceiling, ten-thousandths, money and quantity units.
LABELS = ("LIVE", "MEASURED", "REPORTED", "MODELED", "HEURISTIC", "DEMO", "UNAVAILABLE")
TRUST_CEILING = 0.97
MICRO = 1_000_000
QTY = 1_000_000_000
MONEY = "decimal(38,0)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """The number, or null where it is null, NaN or infinite."""
    c = col(x).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def cap_trust(x: Column | str) -> Column:
    return F.when(finite(x).isNotNull(), F.least(F.greatest(finite(x), F.lit(0.0)), F.lit(TRUST_CEILING)))


def lambda_bounded(x: Column | str) -> Column:
    return F.coalesce(finite(x).between(0, 1), F.lit(False))


def squash01(x: Column | str, k: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-k * finite(x)))


def hoeffding_confidence(n: Column | str, t: Column | float, a: Column | float, b: Column | float) -> Column:
    n, t, width = finite(n), finite(F.lit(t) if not isinstance(t, Column) else t), F.lit(b) - F.lit(a)
    return F.when((n > 0) & (t > 0) & (width > 0), cap_trust(1 - F.exp(-2 * n * t * t / (width * width))))


def lambda_aggregate(scores: Column | str, weights: Column | None = None) -> Column:
    """Weighted geometric mean of an array. The first score decides that is outside [0, 1] (null) or zero (0)."""
    s = F.transform(col(scores), finite)
    w = weights if weights is not None else F.transform(s, lambda _: F.lit(1.0) / F.size(s))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    bad = F.array_position(F.transform(s, lambda x: F.when(lambda_bounded(x), 0).otherwise(1)), 1)
    zero = F.array_position(F.transform(s, lambda x: F.when(x == 0, 1).otherwise(0)), 1)
    logs = F.aggregate(F.zip_with(s, w, lambda x, y: y / total * F.ln(x)), F.lit(0.0), lambda a, x: a + x)
    usable = (F.size(s) > 0) & (F.size(s) == F.size(w)) & (total > 0)
    return F.when(usable & (zero > 0) & ((bad == 0) | (zero < bad)), 0.0).when(usable & (bad == 0), F.exp(logs))


def to_micro_usd(x: Column | str, exact: bool = False) -> Column:
    """Integer millionths, half away from zero at the sixth decimal.

    Of the shortest text of the double, within expressions; or, ``exact``, of its binary value, by an Arrow helper, as
    books do.  They differ only where the shortest text lies half-way, such as 0.0000015.
    """
    if exact:
        from veritick.functions.helpers import to_micro_usd_exact

        return to_micro_usd_exact(finite(x)).cast(MONEY)
    return (F.round(finite(x).cast("decimal(38,18)"), 6) * MICRO).cast(MONEY)


def div(a: Column, b: Column) -> Column:
    """Truncating quotient of non-negative integers held as decimals; exact, unlike ``div`` and ``floor(a / b)``."""
    return ((a - a % b) / b).cast(MONEY)


def micro_to_usd(m: Column | str) -> Column:
    """Six-decimal text of integer millionths."""
    return (col(m).cast(MONEY) / MICRO).cast("decimal(38,6)").cast("string")


def usd(m: Column) -> Column:
    """The double nearest to integer millionths."""
    return (m.cast("decimal(32,0)") / MICRO).cast("decimal(38,6)").cast("double")


def labeled(value: Column, label: Column, note: Column | None = None) -> Column:
    """struct(value, label, note, error): UNAVAILABLE carries no value, every other known label needs one."""
    v = finite(value)
    error = (
        F.when(label.isNull() | ~label.isin(*LABELS), F.lit("unknown label"))
        .when((label == "UNAVAILABLE") & v.isNotNull(), F.lit("UNAVAILABLE must carry no value"))
        .when((label != "UNAVAILABLE") & v.isNull(), F.lit("value required"))
    )
    return F.struct(F.when(error.isNull(), v).alias("value"), label.alias("label"), (note if note is not None else F.lit(None).cast("string")).alias("note"), error.alias("error"))


def iso_millis(text: Column | str) -> Column:
    """Epoch milliseconds of an ISO-8601 text in UTC; null if it does not parse."""
    return F.unix_millis(F.try_to_timestamp(F.when(col(text).rlike(r"^\d{4}-\d{2}-\d{2}"), col(text))))


def signal_time(subject: Column | str, snapshot_iso: Column | str) -> Column:
    return F.coalesce(iso_millis(F.substring_index(col(subject), "/", -1)), iso_millis(snapshot_iso))


def key_id(spki_base64: Column | str) -> Column:
    return F.substring(F.sha2(F.unbase64(col(spki_base64)), 256), 1, 16)


def leaf_hash(data: Column | str) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), col(data)), 256)


def node_hash(left_hex: Column | str, right_hex: Column | str) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(col(left_hex)), F.unhex(col(right_hex))), 256)


HEADER = r"^([^\n]*)\n([^\n]*)\n([^\n]*)\n"


def parse_checkpoint(note: Column | str) -> Column:
    """struct(origin, tree_size, root_hex, n_signatures, reason) of a signed tree-head note.

    A note is a text of three header lines (origin, decimal size, base64 root) and optional others, an empty line, and
    signature lines.  ``reason`` is the code of the first rule that it breaks, null if it is sound: ``null``, ``gap`` (no
    empty line), ``header`` (under three lines), ``origin``, ``size``, ``size-range``, ``root``, ``signature``,
    ``signature-length`` (a key hash takes four bytes, and something must follow), ``unsigned``.
    """
    n = col(note)
    text, rest = F.split_part(n, F.lit("\n\n"), F.lit(1)), F.substr(n, F.instr(n, "\n\n") + 2, F.length(n))
    line = lambda k: F.regexp_extract(F.concat(text, F.lit("\n")), HEADER, k)
    origin, digits, root = line(1), line(2), F.unbase64(F.when(line(3).rlike("^[A-Za-z0-9+/]{43}=$"), line(3)))
    size = F.when(digits.rlike(r"^\d{1,18}$"), digits.cast("bigint"))
    lines = F.filter(F.split(rest, "\n"), lambda x: x != "")
    blob = lambda x: F.try_to_binary(F.regexp_extract(x, "([^ ]*)$", 1), F.lit("base64"))
    rules = (
        ("gap", F.instr(n, "\n\n") > 0), ("header", F.concat(text, F.lit("\n")).rlike(HEADER)), ("origin", origin.rlike(r"^\S+ - \d+$")), ("size", digits.rlike(r"^\d+$")),
        ("size-range", F.coalesce(size.between(1, 2**53 - 1), F.lit(False))), ("root", F.coalesce(F.base64(root) == line(3), F.lit(False))), ("signature", F.forall(lines, lambda x: x.rlike("^— \\S+ \\S+$"))),
        ("signature-length", F.forall(lines, lambda x: F.coalesce(F.length(blob(x)) >= 5, F.lit(True)))), ("unsigned", F.size(lines) > 0),
    )
    reason = F.when(n.isNull(), "null").otherwise(F.coalesce(*[F.when(~ok, F.lit(code)) for code, ok in rules]))
    sound = lambda c: F.when(reason.isNull(), c)
    return F.struct(sound(origin).alias("origin"), sound(size).alias("tree_size"), sound(F.lower(F.hex(root))).alias("root_hex"), sound(F.size(lines)).alias("n_signatures"), reason.alias("reason"))


ENTRY = "kind string, spec struct<data:struct<hash:struct<algorithm:string,value:string>>,signature:struct<content:string,format:string,publicKey:struct<content:string>>>"


def anchor_fields(body_base64: Column | str) -> Column:
    """struct(data_sha256, signature, public_key, format) of a log entry; null unless it is complete."""
    e = F.from_json(F.try_to_binary(col(body_base64), F.lit("base64")).cast("string"), ENTRY)
    digest, sig = e["spec"]["data"]["hash"], e["spec"]["signature"]
    filled = lambda c: c.isNotNull() & (c != "")
    whole = (e["kind"] == "rekord") & (digest["algorithm"] == "sha256") & filled(digest["value"]) & filled(sig["content"]) & filled(sig["publicKey"]["content"])
    return F.when(whole, F.struct(digest["value"].alias("data_sha256"), sig["content"].alias("signature"), sig["publicKey"]["content"].alias("public_key"), sig["format"].alias("format")))


# Ledger file names by kind, with the place of the sequence number (0: none).
FILE_KINDS = (
    ("book", r"^book_(\d+)\.receipt\.json$", 0, 1),
    ("refusals", r"^refusals_(\d+)\.receipt\.json$", 0, 1),
    ("chain", r"^chain_(\d{4})\.receipt\.json$", 1, 0),
    ("witness", r"^witness_(\d{4})_(\d+)\.receipt\.json$", 1, 2),
    ("consistency", r"^consistency_\d+-\d+_(\d+)\.receipt\.json$", 0, 1),
    ("tsa", r"^tsa_(\d{4})_(\d+)\.receipt\.json$", 1, 2),
    ("observation", r"^obs_(\d{4})_(\d+)\.observation\.json$", 1, 2),
    ("gossip", r"^gossip_(\d{4})_(\d+)\.receipt\.json$", 1, 2),
)


def classify_file(name: Column | str) -> Column:
    """struct(kind, seq, ms) of a ledger file name; all null for any other name."""
    kind, seq, ms = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for k, pattern, s, m in reversed(FILE_KINDS):
        is_it = col(name).rlike(pattern)
        kind = F.when(is_it, F.lit(k)).otherwise(kind)
        if s:
            seq = F.when(is_it, F.regexp_extract(col(name), pattern, s).try_cast("bigint")).otherwise(seq)
        if m:
            ms = F.when(is_it, F.regexp_extract(col(name), pattern, m).try_cast("bigint")).otherwise(ms)
    return F.struct(kind.alias("kind"), seq.alias("seq"), ms.alias("ms"))
