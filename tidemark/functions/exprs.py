"""Column functions that the operators share. All are built-in expressions; there is no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
#: Trailing windows of the velocity features, in microseconds.
SPANS = {"1h": HOUR, "6h": 6 * HOUR, "24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}


def clip_lo(x: Column, b) -> Column:
    """Lower clip that keeps null (``greatest`` would return the bound)."""
    return F.when(x < b, F.lit(b) if not isinstance(b, Column) else b).otherwise(x)


def clip_hi(x: Column, b) -> Column:
    return F.when(x > b, F.lit(b) if not isinstance(b, Column) else b).otherwise(x)


def nz(x: Column, default) -> Column:
    return F.coalesce(x, default if isinstance(default, Column) else F.lit(default))


def micros(ts: Column) -> Column:
    """Microseconds of a naive timestamp; the session's time zone is UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def flag(p: Column) -> Column:
    """A predicate as 0 or 1; null counts as false."""
    return F.coalesce(p, F.lit(False)).cast("int")


def arith_hash(id_: Column, seed: int = 42) -> Column:
    """A hash that every SQL engine can compute: (id * 2654435761 + seed * 40503) modulo 2^32, of ids of any size and sign.

    The id is multiplied in halves of 16 bits, so that no product leaves 64 bits.
    """
    low = F.pmod(id_.cast("long"), F.lit(1 << 32))
    half = lambda x: x * F.lit(2654435761)
    upper = F.pmod(half(F.shiftright(low, 16)), F.lit(1 << 32)) * F.lit(1 << 16)
    return F.pmod(upper + half(F.pmod(low, F.lit(1 << 16))) + F.lit(seed * 40503), F.lit(1 << 32))


def day_hash(id_: Column, day: Column, seed: int = 42) -> Column:
    """``arith_hash`` of id * 1000 + day of the year."""
    return arith_hash(F.pmod(id_.cast("long"), F.lit(1 << 32)) * 1000 + F.dayofyear(day), seed)


def iso_weekday(ts: Column) -> Column:
    """1 (Monday) to 7."""
    return F.weekday(ts) + 1


def entropy_bits(n: Column, total: Column) -> Column:
    """Shannon entropy of counts n that sum to total: an aggregate."""
    return F.log2(total) - F.sum(n * F.log2(n)) / total


def avg_rank(x: Column, *by: str, desc: bool = False) -> Column:
    """Ranks from 1, ties share their mean rank."""
    w = W.partitionBy(*by).orderBy(x.desc() if desc else x.asc())
    same = W.partitionBy(*by, x)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2


def r4(x: Column) -> Column:
    """Float results are compared at four decimals; the nudge makes ties round alike in every engine."""
    return F.round(x + 1e-9, 4)


def r6(x: Column) -> Column:
    return F.round(x + 1e-9, 6)
