"""Doubles in Columns exactly as Python rounds and spells them.

Both rest on an error-free product: for doubles a and b, the rounded product p and the residual e = a * b - p, which is a
double too and comes from splitting a and b in halves.  So a value scaled by a power of ten is known as p + e without any loss.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPLIT = float(2**27 + 1)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once however often ``then`` mentions it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def halves(value: float) -> tuple[float, float]:
    """A double as the sum of two of at most 26 bits."""
    high = _SPLIT * value
    high = high - (high - value)
    return high, value - high


def residual(a: Column, high: Column | float, low: Column | float, product: Column) -> Column:
    """a * (high + low) - product, exactly, if none of it leaves the range of doubles."""
    return let(a * _SPLIT - (a * _SPLIT - a), lambda top: ((top * high - product) + top * low + (a - top) * high) + (a - top) * low)


def half_even(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` places by its exact binary value, ties to the even digit, as Python's ``round``.

    Values from 2 ** 52 on are whole; below, the whole part and the rest are apart, and the rest is scaled.
    """
    if not 0 <= digits <= 15:
        raise ValueError("between 0 and 15 digits")
    return let(value, lambda v: _half_even(v, digits))


def _half_even(value: Column, digits: int) -> Column:
    power = float(10**digits)
    high, low = halves(power)
    size = F.abs(value)

    def nearest(rest: Column) -> Column:
        """rest * power as a whole number: at exactly a half of the rounded product the residual decides, then evenness."""
        return let(rest * power, lambda p: let(F.floor(p), lambda n: n + F.when(p - n < 0.5, 0).when(p - n > 0.5, 1).otherwise(let(residual(rest, high, low, p), lambda e: F.when(e > 0, 1).when(e < 0, 0).otherwise(n % 2)))))

    small = nearest(size) / F.lit(power)
    exact = (F.floor(size).cast("decimal(17,0)") + nearest(size - F.floor(size)).cast("decimal(17,0)") * F.lit(Decimal(1).scaleb(-digits))).cast("double")
    rounded = F.when(size < 2.0**52 / power, small).when(size < 2.0**52, exact).otherwise(size)
    return F.when(value.cast("string").startswith("-"), -rounded).otherwise(rounded)


# --- spelling --------------------------------------------------------------------------------------------------

#: Exponents of ten of the least and the largest double.
_LEAST, _MOST = -324, 308
#: Beyond this many digits before or after the point, values are brought near 1 by two to the power of _SHIFT.
_FAR, _SHIFT = 100, 300
#: The least double of full precision.
_NORMAL = 2.0**-1022
_DIGITS = 17
#: No two decimals of so many digits are one double, so a text of no more that reads back is the only one.
_FEW = 15


def _table(values: list[float]) -> Column:
    """Doubles as one constant, which the optimizer reads once from their text."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def _nearest_double(value: Fraction) -> float:
    return value.numerator / value.denominator  # Python divides whole numbers with one rounding


def _shift(exponent: int) -> int:
    return _SHIFT if exponent < -_FAR else -_SHIFT if exponent > _FAR else 0


@cache
def _scales() -> tuple[list[float], list[float]]:
    """For each exponent, what makes a value of that exponent one of seventeen digits, as the sum of two doubles."""
    exact = [Fraction(10) ** (_DIGITS - 1 - e) * Fraction(2) ** -_shift(e) for e in range(_LEAST, _MOST + 1)]
    tops = [_nearest_double(x) for x in exact]
    return tops, [_nearest_double(x - Fraction(t)) for x, t in zip(exact, tops, strict=True)]


def _scaled(size: Column, exponent: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then`` of (whole part, rest in 0..1) of size * 10 ** (16 - exponent), a number of seventeen digits."""
    near = size * F.when(exponent < -_FAR, 2.0**_SHIFT).when(exponent > _FAR, 2.0**-_SHIFT).otherwise(1.0)
    tops, rests = _scales()
    top, rest = (F.get(_table(t), (exponent - _LEAST).cast("int")) for t in (tops, rests))

    def product(x: Column) -> Column:
        a, t = x["a"], x["t"]
        high = t * _SPLIT - (t * _SPLIT - t)
        return let(F.struct(a.alias("a"), t.alias("t"), x["r"].alias("r"), high.alias("h"), (a * t).alias("p")), lambda y: F.struct(
            y["p"].alias("p"), (residual(y["a"], y["h"], y["t"] - y["h"], y["p"]) + y["a"] * y["r"]).alias("e")))

    def parted(x: Column) -> Column:
        return F.struct(F.floor(x["p"]).cast("long").alias("n"), (x["p"] - F.floor(x["p"]) + x["e"]).alias("e"))

    def carried(x: Column) -> Column:
        return F.struct((x["n"] + F.floor(x["e"])).alias("n"), (x["e"] - F.floor(x["e"])).alias("f"))

    known = F.struct(near.alias("a"), top.alias("t"), rest.alias("r"))
    return let(let(let(let(known, product), parted), carried), lambda x: then(x["n"], x["f"]))


def _exponent(size: Column) -> Column:
    """The power of ten of the first digit."""
    powers = _table([_nearest_double(Fraction(10) ** e) for e in range(_LEAST, _MOST + 1)])
    guess = F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), F.floor(F.log10(size)).cast("int")))
    above = lambda g: F.coalesce(F.get(powers, g - _LEAST + 1) <= size, F.lit(False)).cast("int")
    below = lambda g: (F.get(powers, g - _LEAST) > size).cast("int")
    return let(guess, lambda g: (g + above(g) - below(g)).cast("int"))


def _shortest(size: Column) -> Column:
    """struct(digits, point: where the decimal point stands from the first digit) of the shortest text that reads back.

    Fifteen to seventeen digits are tried, and fewer for the smallest values, which have fewer."""

    def told(exponent: Column) -> Column:
        def of(n: Column, f: Column) -> Column:
            def rounded(digits: Column) -> Column:
                """The value in that many digits, if it reads back.  Twice what is cut off is held against the unit; exactly a half goes to the even digit."""
                unit = F.pow(F.lit(10.0), _DIGITS - digits).cast("long")
                power = exponent - digits + 1

                def whole(x: Column) -> Column:
                    above = F.when(x["twice"] > x["unit"], 1).when(x["twice"] < x["unit"] - 1, -1).otherwise((x["twice"] - x["unit"]) + 2 * f)
                    return x["quotient"] + F.when(above > 0, 1).when(above < 0, 0).otherwise(x["quotient"] % 2)

                def read(text: Column) -> Column:
                    reads = F.concat(text, F.lit("e"), power.cast("string")).try_cast("double") == size
                    return F.when(reads, F.struct(F.rtrim(text, F.lit("0")).alias("digits"), (F.length(text) + power).cast("int").alias("point")))

                cut = let(unit, lambda u: F.struct(u.alias("unit"), F.call_function("div", n, u).alias("quotient"), ((n % u) * 2).alias("twice")))
                return let(let(cut, whole).cast("string"), read)

            tried = F.sequence(F.when(size < _NORMAL, 1).otherwise(15), F.lit(_DIGITS))
            return F.aggregate(tried, F.lit(None).cast("struct<digits: string, point: int>"), lambda found, digits: F.when(found.isNull(), rounded(digits)).otherwise(found))

        return _scaled(size, exponent, of)

    return let(_exponent(size), told)


@F.arrow_udf(StringType())
def told_by_python(values: pa.Array) -> pa.Array:
    """Doubles as Python itself spells them, in Arrow batches: for whole columns, where digits are many and rows too.  Within a
    lambda no such function may stand; ``python_text`` may."""
    if values.null_count:
        return pa.array([None if v is None else repr(v) for v in values.to_pylist()], pa.string())
    return pa.array(map(repr, values.to_numpy(zero_copy_only=False).tolist()), pa.string())


def python_text(value: Column) -> Column:
    """``value``, a double, as Python's ``repr`` spells it: the shortest digits that read back, with an exponent below
    1e-04 and from 1e+16 on."""

    def spelled(x: Column) -> Column:
        digits, point = x["digits"], x["point"]
        count = F.length(digits)
        fixed = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= count, F.concat(digits, F.repeat(F.lit("0"), point - count), F.lit(".0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, count)))
        )
        power = point - 1
        exponent = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
        rest = F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count))).otherwise(F.lit(""))
        return F.when((power >= -4) & (power < 16), fixed).otherwise(F.concat(F.substring(digits, 1, 1), rest, exponent))

    sign = F.when(value > 0, F.lit("")).when((value < 0) | value.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    size = F.abs(value)
    told = size.cast("string")  # by the JVM: it reads back, but older ones spend a digit too many
    digits = F.replace(F.substring_index(told, "E", 1), F.lit("."), F.lit(""))
    few = (F.length(F.ltrim(digits, F.lit("0"))) <= _FEW) & (size >= _NORMAL)
    parts = F.struct(F.rtrim(digits, F.lit("0")).alias("digits"), (F.substring_index(told, "E", -1).cast("int") + 1).alias("point"))
    number = (
        F.when(size == 0, F.lit("0.0")).when(size == float("inf"), F.lit("inf"))
        .when(few & (size >= 1e-3) & (size < 1e7), told).when(few, let(parts, spelled))
        .otherwise(let(_shortest(size), spelled))
    )
    return F.when(F.isnan(value), F.lit("nan")).when(value.isNotNull(), F.concat(sign, number))


def python_points(polygon: Column) -> Column:
    """Points as Python spells a tuple of pairs of doubles."""
    pairs = F.transform(polygon, lambda p: F.concat(F.lit("("), F.array_join(F.transform(F.array(p["x"], p["y"]), python_text), ", "), F.lit(")")))
    return F.concat(F.lit("("), F.array_join(pairs, ", "), F.when(F.size(polygon) == 1, F.lit(",)")).otherwise(F.lit(")")))
