"""Column expressions: guarded ratios, intervals, set similarity, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def _rounded(x: Column, digits: int, whole) -> Column:
    """The value times 10^digits, rounded to a whole number: a sum of decimals that ends in a 5 is a tie, though its double may lie just off it."""
    x, scale = x.cast("double"), 10.0**digits
    return F.when(F.abs(x) < 1e300 / scale, whole(x * scale, 0) / scale).otherwise(x)


def half_even(x: Column, digits: int = 6) -> Column:
    return _rounded(x, digits, F.bround)


def half_up(x: Column, digits: int = 6) -> Column:
    return _rounded(x, digits, F.round)


def ratio(num: Column, den: Column) -> Column:
    """Null where the denominator is zero or null: unknown is not zero."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval for k of n, within 0 and 1; null for n = 0."""
    kd, nd = k.cast("double"), n.cast("double")
    p = kd / nd
    base = 1 + F.lit(z * z) / nd
    mid = p + F.lit(z * z) / (2 * nd)
    half = F.lit(z) * F.sqrt((p * (1 - p) + F.lit(z * z) / (4 * nd)) / nd)
    low, high = F.greatest(F.lit(0.0), (mid - half) / base), F.least(F.lit(1.0), (mid + half) / base)
    return F.when(nd > 0, half_even(low)), F.when(nd > 0, half_even(high))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 if one is empty, to six digits."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(half_even(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))))


def token_similarity(a: Column, b: Column) -> Column:
    """1 for equal sets, 0 for fewer than two shared tokens, else Jaccard."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.array_sort(a) == F.array_sort(b), F.lit(1.0)).when(shared < 2, F.lit(0.0)).otherwise(half_even(shared / F.size(F.array_union(a, b))))


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a time with or without zone; UTC where none is named."""
    return F.unix_micros(at.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000)


def digest(*parts: Column, sep: str = "|", null: str = "None") -> Column:
    """SHA-256 of the parts' text joined by sep; a null part is written out, not skipped."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit(null)) for p in parts]), 256)


def set_digest(values: Column, sep: str = "|") -> Column:
    """SHA-256 of the sorted values of a group."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(values)), sep), 256)


def canonical_json(entries: Column) -> Column:
    """A string map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest by two nested digests over padded keys."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
