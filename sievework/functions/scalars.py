"""Column expressions: keyed randomness, time and amount parts, geography, bits, vectors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cumulative probabilities of Poisson(1) at 0, 1, 2, ...; the last one leaves less than 2^-32.
POISSON_CUTS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
EARTH_KM = 6371.0


def keyed_uniform(seed, draw, row_id) -> Column:
    """A number in [0, 1) that depends on (seed, draw, row id) alone, not on order, batch or partition."""
    text = F.concat_ws(":", *(_column(x).cast("string") for x in (seed, draw, row_id)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def keyed_poisson(seed, draw, row_id) -> Column:
    """Poisson(1) weight: how many cumulative probabilities lie at or below the keyed uniform."""
    # the uniform is bound once, so that its hash is not taken again for every comparison
    counted = F.transform(F.array(keyed_uniform(seed, draw, row_id)), lambda u: reduce(lambda a, b: a + b, [(u >= c).cast("int") for c in POISSON_CUTS]))
    return F.get(counted, 0)


def keyed_normal(seed, draw, row_id) -> Column:
    """N(0, 1) by Box-Muller from two keyed uniforms; the first is moved off zero by 2^-33."""
    u, v = keyed_uniform(seed, draw, row_id), keyed_uniform(seed, F.concat(_column(draw).cast("string"), F.lit("'")), row_id)
    return F.sqrt(-2 * F.ln(u + 2.0**-33)) * F.cos(2 * math.pi * v)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hour_of(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / 3600), F.lit(24)).cast("int")


def weekday_of(seconds: Column) -> Column:
    """Day of a seven-day cycle that starts at second 0."""
    return F.pmod(F.floor(seconds / 86400), F.lit(7)).cast("int")


def cyclic_hour(hours: Column) -> tuple[Column, Column]:
    return F.sin(2 * math.pi * hours / 24), F.cos(2 * math.pi * hours / 24)


def fraction(x: Column) -> Column:
    return x - F.floor(x)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle km; rounding errors outside [0, 1] are clipped before the arc sine."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def token(salt: str, row_id: Column) -> Column:
    """First 16 hex digits of SHA-256 of salt:id."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), row_id.cast("string")), 256), 1, 16)


def bit(index: Column, place: int) -> Column:
    return F.shiftright(index, place).bitwiseAND(1)


def parity(index: Column, mask: Column) -> Column:
    """1 where an odd number of the bits in mask are set in index."""
    return F.bit_count(index.bitwiseAND(mask)) % 2


def binary(index: Column, width: int) -> Column:
    return F.lpad(F.bin(index.cast("long")), width, "0")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def normalised(v: Column) -> Column:
    """v by its sum; v and the sum are each bound once, not computed again for every entry."""
    shares = lambda a: F.get(F.transform(F.array(total(a)), lambda t: F.transform(a, lambda x: x / t)), 0)
    return F.get(F.transform(F.array(v), shares), 0)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def argmax(v: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def no_nan(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def sentinel(x: Column, value: float = -1.0) -> Column:
    return F.coalesce(no_nan(x), F.lit(value))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def product_kernel(u: list[Column], v: list[Column], scale: float = 1.0) -> Column:
    """Product over coordinates of cos^2(scale * pi * (u - v) / 2)."""
    return reduce(lambda a, b: a * b, [F.pow(F.cos(scale * math.pi * (a - b) / 2), 2) for a, b in zip(u, v, strict=True)])


def rbf_kernel(u: list[Column], v: list[Column], gamma: float) -> Column:
    return F.exp(-gamma * reduce(lambda a, b: a + b, [(a - b) * (a - b) for a, b in zip(u, v, strict=True)]))
