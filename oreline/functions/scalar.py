"""Column expressions of the data model: keys, months, null facts, decimals.

All are pure ``Column -> Column`` functions over built-ins, so they stay inside
generated code and reach the scan as pushed filters where Spark allows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REPORTED, REPORTED_ZERO, NO_REPORT, WITHHELD = "reported", "reported_zero", "no_report", "withheld"
ADMITTED = (REPORTED, REPORTED_ZERO)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def absent_if_blank(c: str | Column) -> Column:
    """Blank text is an absence on read."""
    return F.nullif(_col(c), F.lit(""))


def trimmed_right(c: str | Column) -> Column:
    """Drop the padding of fixed-width text; leading spaces are data."""
    return F.nullif(F.rtrim(_col(c)), F.lit(""))


def null_fact(value: str | Column, withheld: Column | None = None) -> Column:
    """Which of the four facts a measure states."""
    v = _col(value)
    hidden = F.coalesce(withheld, F.lit(False)) if withheld is not None else F.lit(False)
    return F.when(v.isNull(), F.when(hidden, WITHHELD).otherwise(NO_REPORT)).when(v == 0, REPORTED_ZERO).otherwise(REPORTED)


def admitted(fact: str | Column) -> Column:
    return _col(fact).isin(*ADMITTED)


def identity_key(c: str | Column, digits: int, start: int, stop: int, separators: str = "-") -> Column:
    """Strip separators, demand an exact digit count, cut ``[start, stop)``; else null."""
    plain = F.translate(F.trim(_col(c)), separators, "")
    return F.when(plain.rlike(f"^[0-9]{{{digits}}}$"), F.substring(plain, start + 1, stop - start))


def composite_key(parts: list[tuple[str | Column, int]], charset: str = "0-9", min_width: int = 1) -> Column:
    """Padded parts side by side; null if any is null, empty, too wide or ill-spelt.

    The width is checked first because ``lpad`` would cut what is too wide.
    """
    cells = []
    for c, width in parts:
        value = F.trim(_col(c).cast("string"))
        fits = (F.length(value) >= min_width) & (F.length(value) <= width) & value.rlike(f"^[{charset}]+$")
        cells.append(F.when(fits, F.lpad(value, width, "0")))
    return F.concat(*cells)


def scaled(c: str | Column, factor: str, scale: int, mode: str = "half_up") -> Column:
    """``value * factor`` in decimals, rounded half up, half even or towards zero."""
    exact = _col(c).cast("decimal(20,6)") * F.lit(factor).cast("decimal(18,9)")
    if mode == "half_up":
        return F.round(exact, scale)
    if mode == "half_even":
        return F.bround(exact, scale)
    if mode != "down":
        raise ValueError(f"unknown rounding {mode!r}")
    shift = F.lit(10**scale).cast("decimal(10,0)")
    whole = F.floor(F.abs(exact) * shift) / shift
    return F.when(exact < 0, -whole).otherwise(whole).cast(f"decimal(28,{scale})")


def month_of(c: str | Column) -> Column:
    """First of the month from a serial day number, ``YYYYMM``, ``YYYY-MM`` or a date's text."""
    t = F.trim(_col(c).cast("string"))
    serial = F.when(t.rlike("^[0-9]{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), F.try_to_number(t, F.lit("99999")).cast("int")))
    packed = F.when(t.rlike("^[0-9]{6}$"), F.try_to_timestamp(F.concat(t, F.lit("01")), F.lit("yyyyMMdd")).cast("date"))
    short = F.when(t.rlike("^[0-9]{4}-[0-9]{2}$"), F.try_to_timestamp(F.concat(t, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"))
    dated = F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))
    return F.trunc(F.coalesce(serial, packed, short, dated), "MM")


def month_from_parts(year: str | Column, month: str | Column) -> Column:
    y, m = _col(year).cast("int"), _col(month).cast("int")
    return F.when(m.between(1, 12) & y.between(1, 9999), F.make_date(y, m, F.lit(1)))


def month_number(c: str | Column) -> Column:
    """Months since year zero, for gaps and numeric range frames."""
    return F.year(_col(c)) * 12 + F.month(_col(c)) - 1


def months_apart(later: str | Column, earlier: str | Column) -> Column:
    return month_number(later) - month_number(earlier)


def half_year(c: str | Column) -> Column:
    return F.concat(F.year(_col(c)).cast("string"), F.when(F.month(_col(c)) <= 6, "-h1").otherwise("-h2"))


def plausible_days(days: str | Column, month: str | Column) -> Column:
    """Day count of a month, null where it can't be; the row stays."""
    d = _col(days)
    return F.when(d.between(0, F.dayofmonth(F.last_day(_col(month)))), d)


def length_band(c: str | Column, cuts: tuple[float, ...], closed_top: float) -> Column:
    """Half-open bands below the cuts, one closed band, and what lies above it."""
    v = _col(c)
    labels = [f"under_{cuts[0]:g}", *(f"{a:g}_to_{b:g}" for a, b in zip(cuts, cuts[1:])), f"{cuts[-1]:g}_to_{closed_top:g}", f"over_{closed_top:g}"]
    chain = reduce(lambda acc, cl: acc.when(v < cl[0], cl[1]), list(zip(cuts, labels))[1:], F.when(v < cuts[0], labels[0]))
    return F.when(v.isNotNull(), chain.when(v <= closed_top, labels[-2]).otherwise(labels[-1]))


def coordinate_fact(lon: str | Column, lat: str | Column, sentinels: tuple[float, ...] = (0.0,)) -> Column:
    """Whether a pair can be placed, is absent, or holds a stand-in value."""
    x, y = _col(lon), _col(lat)
    stand_in = x.isin(*sentinels) & y.isin(*sentinels)
    return F.when(x.isNull() | y.isNull(), "coordinate_absent").when(stand_in, "coordinate_sentinel").otherwise("promote")


def ratio_or_reason(top: str | Column, bottom: str | Column, fact: Column, low: float, high: float) -> tuple[Column, Column]:
    """A ratio, or the reason why there is none, as two parallel columns."""
    t, b = _col(top), _col(bottom)
    value = t / F.nullif(b, F.lit(0))
    reason = (
        F.when(fact.isin(NO_REPORT, WITHHELD), fact)
        .when(b.isNull(), "length_unavailable")
        .when(b <= 0, "length_implausible")
        .when((value < low) | (value > high), "out_of_range")
    )
    return F.when(reason.isNull(), value), reason


def contains_text(c: str | Column, needle: str) -> Column:
    """Case-blind substring test; the needle's wildcards are literal."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return _col(c).ilike(f"%{escaped}%")


def slug(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def selector_terms(c: str | Column) -> Column:
    """``k=v&k=v`` as a map; null where the text is not of that form or names a key twice."""
    t = _col(c)
    again = "(^|.*&)([a-z_]+)=[^=&]*&(.*&)?\\2=.*"
    return F.when(t.rlike("^[a-z_]+=[^=&]*(&[a-z_]+=[^=&]*)*$") & ~t.rlike("^(?s:" + again + ")$"), F.str_to_map(t, F.lit("&"), F.lit("=")))


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of the row's fields as JSON in name order; null fields are written."""
    fields = F.struct(*(F.col(c) for c in sorted(columns)))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def outer_verdict(ci_low: str | Column, ci_high: str | Column, n: str | Column, floor: int = 50) -> Column:
    """Which side a confidence interval favours."""
    return F.when(_col(n) < floor, "insufficient").when(_col(ci_high) < 0, "first_better").when(_col(ci_low) > 0, "second_better").otherwise("tie")


def freshness(last_success: Column, now: Column, every_days: Column, failed_since: Column | None = None) -> Column:
    """State of a source by its poll interval and the evidence of attempts."""
    age = F.datediff(now, last_success)
    failing = F.coalesce(failed_since, F.lit(False)) if failed_since is not None else F.lit(False)
    return F.when(last_success.isNull(), "never_fetched").when(failing & (age > every_days), "failing").when(age > 2 * every_days, "stale").when(age > every_days, "due").otherwise("fresh")
