"""Column expressions shared by every layer.

All helpers return JVM-side ``Column`` expressions (no UDFs), so they stay
inside whole-stage codegen.  Each one pins down a semantic detail where a
plain Spark expression would disagree with the warehouse's SQL semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- text

def clean_text(c: ColumnOrName) -> Column:
    """Lower-cased text without the spaces at its ends (other white space stays)."""
    return F.lower(F.trim(_col(c)))


def clean_text_or(c: ColumnOrName, default: str) -> Column:
    """Cleaned text, NULL replaced by ``default`` (an empty string stays '')."""
    return F.coalesce(clean_text(c), F.lit(default))


def capitalize(c: ColumnOrName) -> Column:
    """First character upper-case, the rest lower-case (Python ``str.capitalize``)."""
    c = _col(c)
    return F.concat(F.upper(c.substr(1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


# ---------------------------------------------------------------- numeric casts

def to_double(c: ColumnOrName) -> Column:
    """Lenient cast to double: unparsable text becomes NULL instead of failing."""
    return _col(c).try_cast("double")


def to_int_rounded(c: ColumnOrName) -> Column:
    """Cast to int rounding to nearest (half to even), not truncating.

    ``'2.7'::integer`` and ``2.7::integer`` are 3 in the warehouse SQL, while a
    Spark cast truncates to 2.
    """
    return F.rint(to_double(c)).cast("int")


def to_bool_flag(c: ColumnOrName) -> Column:
    """True for 1 and for true as text; false for anything else, NULL included."""
    text_bool = _col(c).cast("string").try_cast("boolean")
    return F.coalesce(to_double(c) == F.lit(1.0), text_bool, F.lit(False))


# ------------------------------------------------------------------- rounding

def round_half_away(c: ColumnOrName, digits: int = 2) -> Column:
    """Rounds a double by scaling the binary value, halves away from zero.

    Spark's ``round(x, 2)`` rounds the decimal text of ``x`` (1.005 -> 1.01);
    the warehouse SQL scales in binary first (1.005 -> 1.0).
    """
    scale = float(10 ** digits)
    return F.round(_col(c) * F.lit(scale), 0) / F.lit(scale)


def cents(c: ColumnOrName) -> Column:
    """Money value as exact integer cents (bigint)."""
    return F.round(_col(c) * F.lit(100.0), 0).cast("bigint")


def money_from_cents(c: ColumnOrName) -> Column:
    """Integer cents back to a double money value."""
    return _col(c).cast("double") / F.lit(100.0)


#: A double inside the limbs' range is a sum of whole multiples below 2**LIMB_BITS of 2**(LOWEST + LIMB_BITS * i).
LIMBS, LIMB_BITS, LOWEST = 9, 22, -99


def _limbs(x: Column) -> list[Column]:
    """Signed limbs of a double, lowest first; NULL where it is NULL, not finite or at least 2^99.

    Scaling by a power of two, cutting off the fraction and the difference of
    both are exact in double arithmetic, so the limbs hold every bit of ``x``
    down to 2^-99 (all bits where |x| is 2^-46 or more, or 0).
    """
    held = F.when(F.abs(x) < F.lit(2.0 ** (LOWEST + LIMBS * LIMB_BITS)), x)
    size, sign = F.abs(held), F.signum(held)

    def whole(i: int) -> Column:  # |x| in units of limb i, without the fraction
        scaled = size * F.lit(2.0 ** -(LOWEST + LIMB_BITS * i))
        return F.rint(scaled) - F.when(F.rint(scaled) > scaled, F.lit(1.0)).otherwise(F.lit(0.0))

    wholes = [whole(i) for i in range(LIMBS)]
    above = [w * F.lit(2.0 ** LIMB_BITS) for w in wholes[1:]] + [F.lit(0.0)]
    return [(sign * (w - a)).cast("bigint") for w, a in zip(wholes, above, strict=True)]


def exact_sum(c: ColumnOrName, times: ColumnOrName | None = None) -> Column:
    """Aggregate: the sum of a double column as integer limbs, to be read by ``exact_total`` or added up by ``merged_sum``.

    The result does not depend on the order of rows.  Each limb is a sum of
    integers below 2^22 in a bigint, which is safe for 2 * 10^12 rows (times
    their weight, a small count in ``times``).  What the limbs cannot hold (not
    finite, or 2^99 and more) is summed beside them as doubles.
    """
    x = _col(c)
    weight = F.lit(1).cast("bigint") if times is None else _col(times).cast("bigint")
    limbs = _limbs(x) if times is None else [limb * weight for limb in _limbs(x)]
    beyond = F.when(~(F.abs(x) < F.lit(2.0 ** (LOWEST + LIMBS * LIMB_BITS))), x * weight.cast("double"))
    return F.struct(F.array(*[F.sum(limb) for limb in limbs]).alias("limbs"), F.sum(beyond).alias("beyond"))


def merged_sum(c: ColumnOrName, times: ColumnOrName | None = None) -> Column:
    """Aggregate: exact sums added up, each ``times`` over."""
    s = _col(c)
    weight = F.lit(1).cast("bigint") if times is None else _col(times).cast("bigint")
    limbs = [s["limbs"][i] if times is None else s["limbs"][i] * weight for i in range(LIMBS)]
    return F.struct(F.array(*[F.sum(limb) for limb in limbs]).alias("limbs"),
                    F.sum(s["beyond"] * weight.cast("double")).alias("beyond"))


def _carried(limbs: Column) -> Column:
    """(carry, limbs): every limb brought into [0, 2^22), the signed rest carried on."""
    mask = (1 << LIMB_BITS) - 1
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("limbs"))
    return F.aggregate(limbs, start, lambda at, limb: F.struct(
        F.shiftright(at["carry"] + limb, LIMB_BITS).alias("carry"),
        F.concat(at["limbs"], F.array((at["carry"] + limb).bitwiseAND(F.lit(mask).cast("bigint")))).alias("limbs")))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _nearest(digits: Column, top: Column) -> Column:
    """The double nearest to a whole number in base 2^22, lowest digit first, from its four highest digits.

    These make two whole numbers below 2^44; the last bit of the second one is
    set if more follows, so that a single addition rounds once and rightly.
    """
    of = lambda back: F.get(digits, top - back)
    first = of(0) * F.lit(1 << LIMB_BITS) + of(1)
    more = F.exists(F.slice(digits, F.lit(1), top - 3), lambda d: d != 0)
    second = (of(2) * F.lit(1 << LIMB_BITS) + of(3)).bitwiseOR(F.when(more, 1).otherwise(0).cast("bigint"))
    unit = F.pow(F.lit(2.0), (F.lit(LIMB_BITS) * (top - 7) + F.lit(LOWEST)).cast("double"))
    return (first.cast("double") * F.lit(2.0 ** (2 * LIMB_BITS)) + second.cast("double")) * unit


def _magnitude(carried: Column) -> Column:
    """The double nearest to a carried sum that is not negative."""
    carry, mask = carried["carry"], F.lit((1 << LIMB_BITS) - 1).cast("bigint")
    high = [F.shiftright(carry, LIMB_BITS * i).bitwiseAND(mask) for i in range(3)]
    digits = F.concat(F.array(*[F.lit(0).cast("bigint")] * 4), carried["limbs"], F.array(*high))
    places = F.sequence(F.lit(0), F.lit(4 + LIMBS + len(high) - 1))

    def read(d: Column) -> Column:
        top = F.aggregate(places, F.lit(-1), lambda at, i: F.when(F.get(d, i) != 0, i).otherwise(at))
        return _bound(top, lambda at: F.when(at < 0, F.lit(0.0)).otherwise(_nearest(d, F.greatest(at, F.lit(4)))))

    return _bound(digits, read)


def exact_total(c: ColumnOrName) -> Column:
    """The correctly rounded double of an exact sum; NULL if nothing was summed."""
    s = _col(c)
    limbs, beyond = s["limbs"], s["beyond"]

    def signed(up: Column) -> Column:
        below = _magnitude(_carried(F.transform(limbs, lambda limb: -limb)))
        return F.when(up["carry"] < 0, -below).otherwise(_magnitude(up))

    held = _bound(_carried(limbs), signed) + F.coalesce(beyond, F.lit(0.0))
    return F.when(limbs[0].isNull(), beyond).otherwise(held)


def money(sum_: ColumnOrName) -> Column:
    """An exact sum of money, rounded to cents once."""
    return round_half_away(exact_total(sum_))


def money_mean(sum_: ColumnOrName, n: ColumnOrName) -> Column:
    """The average of an exact sum of money over ``n`` rows, rounded to cents once."""
    return round_half_away(F.try_divide(exact_total(sum_), _col(n).cast("double")))


# ---------------------------------------------------------------------- rates

def pct(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """Percentage as a double: the numerator is scaled before the division; NULL on a zero denominator."""
    return F.try_divide(_col(numerator).cast("double") * F.lit(100.0), _col(denominator).cast("double"))


def pct_rounded(numerator: ColumnOrName, denominator: ColumnOrName, digits: int = 2) -> Column:
    """That percentage, rounded on its binary value."""
    return round_half_away(pct(numerator, denominator), digits)


def share_pct(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """Percentage of the reports: divided first, then scaled; NULL on a zero denominator.

    It may differ from ``pct`` in the last bit.
    """
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double")) * F.lit(100.0)


def pct_or_zero(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """That percentage of the reports, 0 on a zero denominator."""
    return F.coalesce(share_pct(numerator, denominator), F.lit(0.0))


# ---------------------------------------------------------------------- dates

def month_start(c: ColumnOrName) -> Column:
    """First day of the month as a DATE (zone-free, also for timestamps)."""
    return F.trunc(_col(c).cast("date"), "month")


def month_diff(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Month boundaries between two dates, as bigint."""
    s, e = _col(start), _col(end)
    return ((F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))).cast("bigint")


def month_label(c: ColumnOrName) -> Column:
    """``yyyy-MM`` label of a date or timestamp (pandas period 'M')."""
    return F.date_format(_col(c).cast("date"), "yyyy-MM")


# ------------------------------------------------------------------ null-safe

def not_equal_keep_null(c: ColumnOrName, value) -> Column:
    """pandas ``s != value``: NULL rows are kept (SQL ``<>`` would drop them)."""
    return ~_col(c).eqNullSafe(F.lit(value))


def nullif(c: ColumnOrName, value) -> Column:
    return F.nullif(_col(c), F.lit(value))
