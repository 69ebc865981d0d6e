"""Scalar column expressions (JVM-side, codegen friendly).

All functions take and return ``Column`` objects so they compose inside
``select``/``withColumn`` and stay in whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's output labels.
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
ANONYMOUS = "Anonymous"
# Characters removed by the text sanitiser and its default length cap.
SANITIZE_REMOVE = "[;<>]"
SANITIZE_MAX_LEN = 255
# Whitespace stripped by `strip`: what Python's str.strip removes, no-break and other Unicode spaces included.
_WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- strings

def strip(c) -> Column:
    """Remove leading/trailing whitespace (Spark's trim only removes spaces)."""
    return F.btrim(_c(c), F.lit(_WS))


def not_blank(c) -> Column:
    """Whether the text has more than whitespace; looks no further than its first other character."""
    return F.ltrim(_c(c), F.lit(_WS)) != ""


def blank_to_null(c) -> Column:
    s = strip(c)
    return F.when(s == "", F.lit(None)).otherwise(s)


def sanitize(c, max_length: int | None = SANITIZE_MAX_LEN) -> Column:
    """strip -> cap length (``None``: keep the whole text) -> drop `;<>`."""
    s = strip(c)
    if max_length is not None:
        s = F.substring(s, 1, max_length)
    return F.regexp_replace(s, SANITIZE_REMOVE, "")


def first_truthy(*cols) -> Column:
    """First value that is neither NULL nor blank (string columns)."""
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in cols])


def display_name(c, fallback: str = ANONYMOUS) -> Column:
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(fallback))


def role_label(flag) -> Column:
    return F.when(_c(flag), F.lit("Admin")).otherwise(F.lit("User"))


def kg_label(c) -> Column:
    """'%.2f kg' formatting."""
    return F.format_string("%.2f kg", _c(c))


# ---------------------------------------------------------------- dates (H5-H9)

def weekday_mon0(d) -> Column:
    """Monday=0 .. Sunday=6 (pandas dayofweek / datetime.weekday)."""
    return F.weekday(_c(d)).cast("int")


def weekday_sun0(d) -> Column:
    """Sunday=0 .. Saturday=6 (SQLite strftime %w)."""
    return (F.dayofweek(_c(d)) - 1).cast("int")


def week_of_year_monday(d) -> Column:
    """strftime %W: week number with Monday as first day, days before the
    first Monday are week 0."""
    d = _c(d)
    return F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")


def week_label(d) -> Column:
    """strftime('%Y-W%W')."""
    d = _c(d)
    return F.concat(F.year(d).cast("string"), F.lit("-W"),
                    F.lpad(week_of_year_monday(d).cast("string"), 2, "0"))


def month_label(d) -> Column:
    """strftime('%Y-%m')."""
    return F.date_format(_c(d), "yyyy-MM")


def day_name(dow_sun0) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in DAY_NAMES]), _c(dow_sun0) + 1)


def month_name(month) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in MONTH_NAMES]), _c(month))


def parse_date_flexible(c) -> Column:
    """ISO first, then day-first forms; unparsable -> NULL."""
    s = strip(c)
    return F.coalesce(
        F.try_to_date(s, "yyyy-M-d"),
        F.try_to_date(s, "d/M/yyyy"),
        F.try_to_date(s, "d-M-yyyy"),
    )


def parse_date_strict(c) -> Column:
    """strptime('%Y-%m-%d') equivalent: accepts non-padded month/day."""
    return F.try_to_date(strip(c), "yyyy-M-d")


# ---------------------------------------------------------------- numbers

def to_cents(c) -> Column:
    """Money/weight value with two decimals as exact integer hundredths."""
    return (_c(c).cast("decimal(18,2)") * 100).cast("decimal(38,0)")


# Type that doubles are summed in: six decimals, exact for values up to 10^22.
EXACT = "decimal(28,6)"


def exact_sum(c) -> Column:
    """Order-independent sum of a double column, to six decimals (as double)."""
    return F.sum(_c(c).cast(EXACT)).cast("double")


def exact_avg(c) -> Column:
    """Mean from the exact decimal sum; NULL for an all-NULL group."""
    c = _c(c)
    return F.sum(c.cast(EXACT)).cast("double") / F.count(c)


def half_up_div(num, den) -> Column:
    """Integer division rounded half away from zero (exact, any engine)."""
    num = _c(num).cast("decimal(38,0)")
    den = _c(den).cast("decimal(38,0)")
    a = F.abs(num) * 2 + F.abs(den)
    b = F.abs(den) * 2
    # a - pmod(a, b) is a multiple of b, so the decimal quotient is exact
    q = ((a - F.pmod(a, b)) / b).cast("decimal(38,0)")
    sign = F.signum(num).cast("decimal(38,0)") * F.signum(den).cast("decimal(38,0)")
    return F.when(den == 0, F.lit(None)).otherwise((sign * q).cast("decimal(38,0)"))


def round2_avg_from_cents(sum_cents, n) -> Column:
    """round(avg, 2) HALF_UP computed exactly from integer cents."""
    return half_up_div(sum_cents, n).cast("double") / F.lit(100.0)


def pct_change(old, new) -> Column:
    """calc_change: 100 if old == 0 and new > 0, 0 if old == 0, otherwise the
    percentage rounded to one decimal.  ``old``/``new`` are exact integers
    (counts or cents) so the result does not depend on float order."""
    old, new = _c(old), _c(new)
    tenths = half_up_div((new - old) * 1000, old)
    return (F.when(old == 0, F.when(new > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
            .otherwise(tenths.cast("double") / F.lit(10.0)))


def clamp_non_negative(c) -> Column:
    return F.greatest(F.lit(0.0), _c(c))


def min_max_scale(c, lo, hi) -> Column:
    c, lo, hi = _c(c), _c(lo), _c(hi)
    return (c - lo) / F.nullif(hi - lo, F.lit(0.0))


def try_double(c) -> Column:
    """float(x) with default 0.0; NaN/Infinity are also mapped to 0.0."""
    v = strip(_c(c).cast("string")).try_cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def all_of(*conds) -> Column:
    """AND of optional predicates (``None`` entries are skipped)."""
    conds = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, conds, F.lit(True))
