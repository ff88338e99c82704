"""Scalar derivations as column expressions. Missing stays missing: a null input never turns into a number.

All are built-in functions, so they stay inside whole-stage code generation. Column arguments take names or columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that stand for "no value".
PLACEHOLDERS = ("", "-", "(-)", "n.a.", "na", "nan", "none", "null", "not available", "not reported", "not published", "unknown")
# Right-closed size bounds (amounts), stage bounds (share of planned time), left-closed delay bounds (days).
SIZE4 = ((500, "small"), (2000, "medium"), (10000, "large"), (None, "mega"))
SIZE3 = ((500, "Small"), (5000, "Medium"), (None, "Large"))
STAGES = ((0.30, "early"), (0.60, "mid"), (0.90, "late"), (None, "very_late"))
RISKS = ((90, "LOW"), (365, "MEDIUM"), (730, "HIGH"), (None, "CRITICAL"))


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x) -> Column:
    """A double from text: commas and brackets dropped, placeholders and anything unreadable null."""
    bare = F.regexp_replace(F.trim(c(x)), r"[,\[\](){}]", "")
    return F.when(~is_placeholder(x), bare.try_cast("double"))


def timestamp_or_null(x, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(c(x), F.lit(fmt))


def is_placeholder(x) -> Column:
    return F.lower(F.trim(c(x))).isin(*PLACEHOLDERS)


def available(x, kind: str = "string") -> Column:
    """Neither null nor, for numbers, not finite, nor, for strings, a placeholder; never null itself."""
    x = c(x)
    ok = x.isNotNull()
    if kind in ("double", "float"):
        ok &= ~F.isnan(x) & (F.abs(x) != float("inf"))
    elif kind == "string":
        ok &= ~is_placeholder(x)
    return F.coalesce(ok, F.lit(False))


def finite(x) -> Column:
    x = c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def pct_change(base, value) -> Column:
    """100 * (value - base) / base for a positive base."""
    return F.when(c(base) > 0, (c(value) - c(base)) / c(base) * 100)


def ratio(top, bottom) -> Column:
    return F.when(c(bottom) > 0, c(top) / c(bottom))


def days(later, earlier) -> Column:
    return F.datediff(c(later), c(earlier))


def delay_days(actual, planned) -> Column:
    """Days late, at least 0; null if either date is."""
    d = days(actual, planned)
    return F.when(d.isNotNull(), F.greatest(F.lit(0), d))


def clamp(x, low, high) -> Column:
    """Into [low, high]; null stays null (``greatest`` alone would skip it)."""
    x = c(x)
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def band(x, bounds, closed: str = "right") -> Column:
    """The label of the first bound that x does not pass."""
    x, out = c(x), None
    for bound, label in bounds:
        test = x.isNotNull() if bound is None else (x <= bound if closed == "right" else x < bound)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def risk_label(delay) -> Column:
    return band(delay, RISKS, "left")


def risk_code(delay) -> Column:
    """0 to 3; a missing delay counts as the worst."""
    d = c(delay)
    return F.when(d < 90, 0).when(d < 365, 1).when(d < 730, 2).otherwise(3)


def priority_score(delay, overrun, exposure) -> Column:
    """0 to 100 from a delay in days, an overrun in per cent and a share of exposure; missing parts count 0."""
    part = lambda x: F.coalesce(clamp(x, 0.0, 1.0), F.lit(0.0))
    total = 0.45 * part(c(delay) / 730) + 0.35 * part(c(overrun) / 40) + 0.20 * F.coalesce(c(exposure), F.lit(0.0))
    return clamp(100 * total, 0.0, 100.0)


def priority_level(score) -> Column:
    s = c(score)
    return F.when(s >= 80, "critical").when(s >= 65, "high").when(s >= 45, "medium").when(s.isNotNull(), "low")


def completeness(*columns) -> Column:
    """Share of the columns that are not null."""
    return sum((c(x).isNotNull().cast("int") for x in columns), F.lit(0)) / len(columns)


def log1p_positive(x) -> Column:
    return F.when(c(x) > 0, F.log1p(c(x)))


def expm1_clipped(x, low: float = -20.0, high: float = 20.0) -> Column:
    return F.expm1(clamp(x, low, high))


def signed_log(x) -> Column:
    return F.signum(c(x)) * F.log1p(F.abs(c(x)))


def signed_exp(z) -> Column:
    return F.signum(c(z)) * F.expm1(F.abs(c(z)))


def month_gap(later, earlier) -> Column:
    """Whole calendar months, at least 0; 0 becomes null, so that it can divide."""
    a, b = c(later), c(earlier)
    gap = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    return F.nullif(F.when(gap.isNotNull(), F.greatest(F.lit(0), gap)), F.lit(0))


def quarter_label(date) -> Column:
    d = c(date)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def fiscal_year(date) -> Column:
    """'2019-20' for a date from April 2019 to March 2020."""
    y = F.year(F.add_months(c(date), -3))
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


def fiscal_month_end(label, month) -> Column:
    """The last day of a month (a number) of a fiscal year that starts in April; January to March fall in the next year."""
    start = F.substring(c(label), 1, 4).try_cast("int")
    year = start + F.when(c(month) <= 3, 1).otherwise(0)
    return F.last_day(F.make_date(year, c(month), F.lit(1)))


def name_key(x) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one blank, trimmed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", " ")), F.lit(""))


def fallback_key(entity_id, name, agency) -> Column:
    """The id, or else a key made from name and agency."""
    made = F.concat(F.lit("legacy:"), F.substring(F.sha1(F.concat_ws("|", F.coalesce(name_key(name), F.lit("")), F.coalesce(name_key(agency), F.lit("")))), 1, 16))
    return F.coalesce(c(entity_id), made)


def bucket_by_pattern(x, patterns, other: str = "Other") -> Column:
    """The label of the first pattern found in the lower-cased text."""
    low, out = F.lower(c(x)), None
    for pattern, label in patterns:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return out.otherwise(other)


def accuracy_pct(predicted, actual) -> Column:
    p, a = c(predicted), c(actual)
    return clamp(100 - F.abs(p - a) / F.when(F.abs(a) < 1, 1.0).otherwise(F.abs(a)) * 100, 0.0, 100.0)


def improvement_pct(baseline, value) -> Column:
    """100 * (baseline - value) / baseline; of a zero baseline 0 if nothing changed, else null."""
    b, v = c(baseline), c(value)
    return F.when(b != 0, (b - v) / b * 100).when((b == 0) & (v == 0), 0.0)


def bounded_correction(base, correction, cap) -> Column:
    b = c(base)
    return F.when(b.isNotNull() & c(correction).isNotNull(), F.greatest(F.lit(0.0), b + F.least(c(cap), F.greatest(-c(cap), c(correction)))))


def blend(weights) -> Column:
    """The weighted sum of (column, weight) pairs."""
    return sum((c(x) * w for x, w in weights), F.lit(0.0))


def repaired_quantiles(low, mid, high) -> Column:
    """Three quantile predictions in rising order."""
    return F.array_sort(F.array(c(low), c(mid), c(high)))


def widened(low, mid, high, scale) -> Column:
    """(low, high) moved away from mid by a factor."""
    return F.struct((c(mid) - (c(mid) - c(low)) * scale).alias("low"), (c(mid) + (c(high) - c(mid)) * scale).alias("high"))


def late_from_remaining(remaining, snapshot, planned) -> Column:
    """Days late if ``remaining`` days are left at the snapshot."""
    total = c(remaining) + days(snapshot, planned)
    return F.when(total.isNotNull(), F.greatest(F.lit(0.0), total.cast("double")))


def run_key(x) -> Column:
    """'monthly-2001-2015' and the like as '2001_2015'."""
    return F.regexp_replace(F.regexp_extract(c(x), r"(\d{4}[-_]\d{4})", 1), "-", "_")


def amount_label(x) -> Column:
    """An amount for people: thousands and up as 'x.x k', below with two digits."""
    x = c(x)
    return F.when(x >= 1000, F.concat(F.format_number(x / 1000, 1), F.lit(" k"))).otherwise(F.format_number(x, 2))


def span_label(d) -> Column:
    """Days for people: years from 365, months from 30."""
    d = c(d)
    return F.when(d >= 365, F.concat(F.round(d / 365, 1).cast("string"), F.lit(" years"))).when(d >= 30, F.concat(F.round(d / 30, 1).cast("string"), F.lit(" months"))).otherwise(
        F.concat(d.cast("string"), F.lit(" days"))
    )


def part_number(x) -> Column:
    """1 to 5 from an Arabic or Roman number after the word part."""
    found = F.upper(F.regexp_extract(c(x), r"(?i)part[\s-]*([ivx]+|\d+)", 1))
    roman = F.create_map(*(F.lit(v) for pair in (("I", 1), ("II", 2), ("III", 3), ("IV", 4), ("V", 5)) for v in pair))
    return F.coalesce(found.try_cast("int"), F.when(found.isin("I", "II", "III", "IV", "V"), roman[found]))


def progress_shortfall(expected, physical) -> Column:
    """How far progress lags behind what was expected, the negative of the deviation; null if either is."""
    return c(expected) - c(physical)


def complexity(amount, duration_ratio, revisions, milestones) -> Column:
    """A tenth of the log amount, plus the share of time used, a quarter a revision and a tenth a late milestone; missing or
    negative parts count 0, a missing amount makes it null."""
    part = lambda x: F.greatest(F.coalesce(c(x).cast("double"), F.lit(0.0)), F.lit(0.0))
    return log1p_positive(amount) / 10 + part(duration_ratio) + 0.25 * part(revisions) + 0.1 * part(milestones)


def mentions_delay(text) -> Column:
    """1 where a status speaks of delay, 0 where not or unknown."""
    return F.coalesce(c(text).rlike("(?i)delay|late|overdue|slip").cast("int"), F.lit(0))


def remaining_target(completion, snapshot, planned) -> Column:
    """The logarithm of one plus the days that are left, for rows before completion that have a planned date."""
    left = days(completion, snapshot)
    return F.when((left > 0) & c(planned).isNotNull(), F.log1p(left.cast("double")))


def all_known(names) -> Column:
    """Whether none of a set of columns is null; true for no columns."""
    known = F.lit(True)
    for name in names:
        known = known & F.col(name).isNotNull()
    return known


def first_known(*names) -> Column:
    """The name of the first of several columns that isn't null."""
    return F.coalesce(*(F.when(F.col(n).isNotNull(), n) for n in names))


def keyed(key: dict) -> Column:
    """Whether a row has a composite key; a null part is met by null only."""
    same = F.lit(True)
    for name, value in key.items():
        same = same & F.col(name).eqNullSafe(F.lit(value))
    return same


def clamped_limit(limit: int, most: int) -> int:
    """A caller's limit into [1, most]."""
    return max(1, min(int(limit), most))
