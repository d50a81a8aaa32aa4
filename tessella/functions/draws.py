"""Random numbers as Columns of a seed and a counter: the same at every run, on any partitioning, and in SQL.

A draw is named by a seed and any further columns (a key, a stream, an attempt); its number is the MD5 hash of that name."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of one number, all that a double holds exactly.
DIGITS = 13
#: Draws after which a truncated deviate that never fell between its bounds is moved to the nearer one.
TRIES = 32


def _name(seed: str, keys: tuple) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce((k if isinstance(k, Column) else F.lit(k)).cast("string"), F.lit("")) for k in keys]))


def _number(name: Column, at: int) -> Column:
    return F.conv(F.substring(name, 1 + DIGITS * at, DIGITS), 16, 10).cast("long") / F.lit(float(1 << 4 * DIGITS))


def uniform(seed: str, *keys: Column | str | int) -> Column:
    """From 0 up to but not 1."""
    return _number(_name(seed, keys), 0)


def uniform_pair(seed: str, *keys: Column | str | int) -> tuple[Column, Column]:
    """Two independent numbers of one name."""
    name = _name(seed, keys)
    return _number(name, 0), _number(name, 1)


def normal(seed: str, *keys: Column | str | int) -> Column:
    """A standard normal deviate by the method of Box and Muller."""
    u, v = uniform_pair(seed, *keys)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


def truncated(mean: Column, deviation: Column, low: Column, high: Column, seed: str, *keys: Column | str | int) -> Column:
    """A normal deviate between two bounds (in deviations from the mean): the first of TRIES draws that lies there; later ones aren't drawn."""
    ok = lambda j: F.get(F.filter(F.array(normal(seed, *keys, j)), lambda x: x.between(low, high)), F.lit(0))
    inside = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), lambda z, j: F.when(z.isNotNull(), z).otherwise(ok(j)))
    return mean + deviation * F.coalesce(inside, F.least(F.greatest(normal(seed, *keys, 0), low), high))


def poisson(rate: Column, u: Column) -> Column:
    """The count of a Poisson process by inversion: the number of counts whose summed probability isn't above u.  For rates up to some
    700, beyond which the probability of 0 is none in doubles."""
    pair = lambda p, c, k: F.struct(p.alias("p"), c.alias("c"), k.alias("k"))

    def count(x: Column) -> Column:
        rate, u = x["rate"], x["u"]
        last, none = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int"), F.exp(-rate)
        step = lambda s, i: F.when(s["c"] > u, s).otherwise(pair(s["p"] * rate / i, s["c"] + s["p"] * rate / i, i))
        return F.aggregate(F.sequence(F.lit(1), last), pair(none, none, F.lit(0)), step, lambda s: s["k"])

    # bound to a name, as a step would otherwise work them out anew
    return F.get(F.transform(F.array(F.struct(rate.alias("rate"), u.alias("u"))), count), F.lit(0))
