"""Arrow-based helpers for what built-in expressions cannot say: canonical JSON, nested scans, proof replay, exact money."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from json.encoder import encode_basestring

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


def number_text(x: float | int) -> str:
    """A number as ECMAScript writes it."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int) and abs(x) <= 2**53:
        return str(x)
    try:
        x = float(x)  # an integer beyond 2^53 is the nearest double, as any JSON number
    except OverflowError as large:
        raise ValueError("non-finite number") from large
    if not math.isfinite(x):
        raise ValueError("non-finite number")
    if x == 0:
        return "0"
    short = repr(x)
    if "e" not in short:  # between 0.0001 and 10^16 both write the shortest digits alike
        return short.removesuffix(".0")
    digits, exp = format(Decimal(repr(x)).normalize(), "e").split("e")
    sign, digits, e = ("-" if digits.startswith("-") else ""), digits.lstrip("-").replace(".", ""), int(exp)
    if -7 < e < 21:
        if e < 0:
            return f"{sign}0.{'0' * (-e - 1)}{digits}"
        whole = digits[: e + 1].ljust(e + 1, "0")
        return f"{sign}{whole}" + (f".{digits[e + 1 :]}" if len(digits) > e + 1 else "")
    return f"{sign}{digits[0]}" + (f".{digits[1:]}" if len(digits) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"


ALONE = re.compile("[\ud800-\udfff]")


def string_text(value: str) -> str:
    """A string as ECMAScript writes it: a surrogate without its partner is escaped."""
    text = encode_basestring(value)
    return text if value.isascii() else ALONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def plain(value: object) -> str:
    """JSON text without spaces, keys in the order they came."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{string_text(k)}:{plain(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(plain, value)) + "]"
    return canonical(value)


def canonical(value: object) -> str:
    """Key-sorted JSON text without spaces; keys sort by UTF-16 units."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{string_text(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if value is None:
        return "null"
    if isinstance(value, (bool, int, float)):
        return number_text(value)
    return string_text(value)


def rewritten(text: str | None, write) -> str | None:
    try:
        return None if text is None else write(json.loads(text))
    except (ValueError, RecursionError):
        return None


FEW = 256  # texts that are Python objects at a time


def each_text(one) -> Column:
    """A function of texts that gives texts; a batch comes and goes as Arrow, and few of its texts are Python objects at once."""

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.concat_arrays([pa.array([], pa.string()), *(pa.array([one(t) for t in batch.slice(lo, FEW).to_pylist()], pa.string()) for lo in range(0, len(batch), FEW))])

    return F.arrow_udf(work, StringType())


def canonical_text(text: Column | str) -> Column:
    """Canonical text of JSON texts; null where a text is not JSON, or nested too deep to read."""
    return each_text(lambda t: rewritten(t, canonical))(text)


def digest_of(text: str | None) -> str | None:
    found = rewritten(text, canonical)
    return None if found is None else hashlib.sha256(found.encode()).hexdigest()


def number_or_name(x: float | None) -> str:
    """A number as in JSON; null as null, one that is not finite by its name, as in ``to_json``."""
    if type(x) is float and x:
        short = repr(x)
        if "e" not in short and "n" not in short:
            return short[:-2] if short[-2:] == ".0" else short
    return "null" if x is None else number_text(x) if math.isfinite(x) else '"NaN"' if x != x else '"Infinity"' if x > 0 else '"-Infinity"'


def string_or_null(value: str | None) -> str:
    return "null" if value is None else string_text(value)


def few_texts(column: pa.Array, write) -> pa.Array:
    """What ``write`` makes of each value, called once per distinct one: for columns whose values repeat."""
    found = column.dictionary_encode()
    return pc.fill_null(pa.array([write(x) for x in found.dictionary.to_pylist()], pa.string()).take(found.indices), write(None))


def number_texts(column: pa.Array) -> pa.Array:
    """``number_or_name`` of each double: Arrow writes the same digits, plainly between 1e-6 and 1e5; others are written one by one."""
    x = np.abs(column.to_numpy(zero_copy_only=False))
    odd = ~((x >= 1e-6) & (x < 1e5))
    texts = pc.cast(column, pa.string())
    if odd.any():
        rest = [number_or_name(v) for v in column.filter(pa.array(odd)).to_pylist()]
        texts = pc.replace_with_mask(texts, pa.array(odd), pa.array(rest, pa.string()))
    return texts


def quoted_texts(column: pa.Array) -> pa.Array:
    """``string_or_null`` of each string."""
    body = pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), '"', '\\"')
    texts = pc.fill_null(pc.binary_join_element_wise('"', body, '"', ""), "null")
    odd = pc.fill_null(pc.match_substring_regex(column, "[\\x00-\\x1f]"), False)
    if pc.any(odd).as_py():
        texts = pc.replace_with_mask(texts, odd, pa.array([string_or_null(v) for v in column.filter(odd).to_pylist()], pa.string()))
    return texts


def json_rows(schema: pa.Schema, kind: str):
    """A function of JSON texts, all objects on one line, that gives their fields of the ``schema`` (as DDL: ``kind``), null where absent; other texts stop the job."""
    options = pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")

    def work(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.StructArray.from_arrays([pa.array([], f.type) for f in schema], fields=list(schema))
        lines = "\n".join(texts.to_pylist()).encode()
        found = pj.read_json(pa.BufferReader(lines), pj.ReadOptions(use_threads=False, block_size=len(lines) + 1), options).select(schema.names).combine_chunks()
        if found.num_rows != len(texts):
            raise ValueError("texts are not one object each")
        return pa.StructArray.from_arrays([c.combine_chunks() for c in found.columns], fields=list(schema))

    return F.arrow_udf(work, kind)


def canonical_digest(text: Column | str) -> Column:
    """sha256 of the canonical text of a JSON text."""
    return each_text(digest_of)(text)  # no text goes back


TRUST_KEYS = frozenset(("conviction", "confidence", "trust"))


def _over(value: object, ceiling: float, path: str = "$") -> list[str]:
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            if k in TRUST_KEYS and isinstance(v, (int, float)) and not isinstance(v, bool) and v > ceiling:
                out.append(f"{path}.{k}")
            out += _over(v, ceiling, f"{path}.{k}")
        return out
    if isinstance(value, list):
        return [p for i, v in enumerate(value) for p in _over(v, ceiling, f"{path}[{i}]")]
    return []


def over_ceiling(text: Column | str, ceiling: float = 0.97) -> Column:
    """Paths of nested trust numbers above the ceiling in a JSON text."""

    @F.pandas_udf("array<string>")
    def scan(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            try:
                return _over(json.loads(t), ceiling) if t else []
            except (ValueError, RecursionError):
                return ["not JSON"]

        return texts.map(one)

    return scan(text)


def _node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def _hashes(items) -> list[bytes] | None:
    out = []
    for h in [] if items is None else items:
        try:
            b = bytes.fromhex(h)
        except (TypeError, ValueError):
            return None
        if len(b) != 32:
            return None
        out.append(b)
    return out


def _half(size: int) -> int:
    """Leaves of the left subtree: the largest power of two below the size (RFC 6962, 2.1)."""
    return 1 << (size - 1).bit_length() - 1


def tree_root(index: int, size: int, leaf: bytes, path: list[bytes]) -> bytes | None:
    """The root that PATH(index, D[size]) and a leaf hash give, by its definition; None if the path has another length.

    The last hash of a path is the root of the half that the leaf is not in.
    """
    if size == 1:
        return None if path else leaf
    if not path:
        return None
    k, (*inner, other) = _half(size), path
    within = tree_root(index, k, leaf, inner) if index < k else tree_root(index - k, size - k, leaf, inner)
    return None if within is None else _node(within, other) if index < k else _node(other, within)


def grown_roots(old: int, new: int, given: bytes | None, proof: list[bytes]) -> tuple[bytes, bytes] | None:
    """Roots of the first ``old`` and of all ``new`` leaves that SUBPROOF(old, D[new]) gives, by its definition.

    ``given`` is the root of the old tree while all of it is in view (the definition's flag is true), None otherwise; a
    proof of another length gives None.
    """
    if old == new:
        known = [given] if given is not None else proof
        return (known[0], known[0]) if len(known) == 1 and (given is None or not proof) else None
    if not proof:
        return None
    k, (*inner, other) = _half(new), proof
    if old <= k:
        both = grown_roots(old, k, given, inner)
        return None if both is None else (both[0], _node(both[1], other))
    both = grown_roots(old - k, new - k, None, inner)
    return None if both is None else (_node(other, both[0]), _node(other, both[1]))


def inclusion_problem(index: int, size: int, leaf_hex: str, path, root_hex: str) -> str | None:
    """Code of why an audit path does not lead from the leaf to the root; None if it does."""
    if pd.isna(index) or pd.isna(size) or not 0 <= index < size:
        return "index"
    hashes, ends = _hashes(path), _hashes([leaf_hex])
    if hashes is None or ends is None:
        return "hash-format"
    found = tree_root(int(index), int(size), ends[0], hashes)
    return "path-length" if found is None else None if found.hex() == root_hex else "root"


def consistency_problem(first: int, second: int, first_root: str, second_root: str, proof) -> str | None:
    """Code of why a proof does not show the first tree to be a prefix of the second; None if it does."""
    if pd.isna(first) or pd.isna(second) or not 1 <= first <= second < 2**53:
        return "sizes"
    roots, hashes = _hashes([first_root, second_root]), _hashes(proof)
    if roots is None or hashes is None:
        return "hash-format"
    found = grown_roots(int(first), int(second), roots[0], hashes)
    if found is None:
        return "proof-length"
    return "old-root" if found[0] != roots[0] else "new-root" if found[1] != roots[1] else None


@F.pandas_udf(StringType())
def check_inclusion(index: pd.Series, size: pd.Series, leaf: pd.Series, path: pd.Series, root: pd.Series) -> pd.Series:
    return pd.Series([inclusion_problem(*row) for row in zip(index, size, leaf, path, root, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def check_consistency(first: pd.Series, second: pd.Series, first_root: pd.Series, second_root: pd.Series, proof: pd.Series) -> pd.Series:
    return pd.Series([consistency_problem(*row) for row in zip(first, second, first_root, second_root, proof, strict=True)], dtype=object)


def exact_micro(x: float) -> int:
    """Integer millionths of the exact binary value, half away from zero."""
    return int(Decimal(x).quantize(Decimal("0.000001"), ROUND_HALF_UP) * 1_000_000)


@F.pandas_udf(LongType())
def to_micro_usd_exact(x: pd.Series) -> pd.Series:
    """Like ``to_micro_usd``, but rounding the exact binary value rather than its shortest text."""
    return pd.Series([None if pd.isna(v) or math.isinf(v) else exact_micro(v) for v in x], dtype="Int64")
