"""House numbers: what a number text covers, and whether a rule covers it.

A cover is lo, hi, step instead of a set: step 2 for a range of one parity, else 1; null lo is the empty set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardcraft.functions.text import safe_int, ustrip

_RANGE = r"^(?U)\s*(\d+)\s*[-–]\s*(\d+)\s*\z"


def housenumber_cover(c: Column) -> Column:
    """struct lo, hi, step, inferred (odd, even or null), is_range of a house-number text."""
    s = ustrip(c)
    one = F.regexp_extract(s, r"^(\d+)", 1).try_cast("bigint")
    a, b = (F.regexp_extract(s, _RANGE, k).try_cast("bigint") for k in (1, 2))
    ranged = s.rlike(_RANGE) & a.isNotNull() & b.isNotNull()
    same = a % 2 == b % 2
    lo = F.when(ranged, F.least(a, b)).otherwise(one)
    return F.struct(
        lo.alias("lo"),
        F.when(ranged, F.greatest(a, b)).otherwise(one).alias("hi"),
        F.when(lo.isNotNull(), F.when(ranged & same, 2).otherwise(1)).alias("step"),
        F.when(ranged & same, F.when(a % 2 == 0, "even").otherwise("odd")).alias("inferred"),
        F.coalesce(ranged, F.lit(False)).alias("is_range"),
    )


def housenumber_int(c: Column) -> Column:
    """The first run of digits anywhere, or null."""
    return F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("bigint")


def _overlaps(cover: Column, a: Column, b: Column) -> Column:
    """Whether a covered number lies in [a, b], whichever end is first; not if an end is null."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    up = F.when(lo > cover["lo"], ((lo - cover["lo"] + cover["step"] - 1) / cover["step"]).cast("bigint") * cover["step"]).otherwise(F.lit(0))
    return a.isNotNull() & b.isNotNull() & (cover["lo"] + up <= F.least(cover["hi"], hi))


def covers(cover: Column, parity: Column, ranges: Column, singles: Column) -> Column:
    """Whether a numbers spec takes a cover. Parity, ranges and singles are tested one by one, each against the whole cover.

    Unparsable range ends void their range, and a spec all of whose ranges are void takes nothing; unparsable
    singles are dropped, and without any left they don't restrict.
    """
    both = (cover["step"] == 1) & (cover["hi"] > cover["lo"])
    has = lambda r: both | (cover["lo"] % 2 == r)
    in_range = F.exists(ranges, lambda r: F.coalesce(_overlaps(cover, safe_int(r["start"]), safe_int(r["end"])), F.lit(False)))
    numbers = F.filter(F.transform(singles, safe_int), lambda n: n.isNotNull())
    hit = F.exists(numbers, lambda n: (n >= cover["lo"]) & (n <= cover["hi"]) & ((n - cover["lo"]) % cover["step"] == 0))
    ok = (
        cover["lo"].isNotNull()
        & ~((cover["inferred"] == "even").eqNullSafe(True) & parity.eqNullSafe("odd"))
        & ~((cover["inferred"] == "odd").eqNullSafe(True) & parity.eqNullSafe("even"))
        & (~parity.eqNullSafe("odd") | has(1))
        & (~parity.eqNullSafe("even") | has(0))
        & (F.coalesce(F.size(ranges), F.lit(0)).cast("int").isin(0, -1) | in_range)
        & (F.coalesce(F.size(numbers), F.lit(0)).isin(0, -1) | hit)
    )
    return F.coalesce(ok, F.lit(False))
