"""Per-row rules driven by small ordered tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.functions.text import let, strip


def _chain(cases: list[tuple[Column, Column]], default: Column) -> Column:
    if not cases:
        return default
    first, *rest = cases
    start = F.when(*first)
    return reduce(lambda acc, case: acc.when(*case), rest, start).otherwise(default)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def to_number(value: Column) -> Column:
    """Double, or NULL when the value is no number (NaN counts as missing)."""
    given = F.trim(value.cast("string"))
    # The cast alone would also take suffixes such as 5d and hexadecimal forms.
    plain = given.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return nan_to_null(F.when(plain, given).try_cast("double"))


def first_contained(
    text: Column, rules: list[tuple[str, str]], default: str
) -> Column:
    """Label of the first rule whose key occurs in the lower-case text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _chain([(F.contains(low, F.lit(k)), F.lit(v)) for k, v in rules], F.lit(default))


def brand(title: Column, rules=None, default: str = lx.BRAND_DEFAULT) -> Column:
    return first_contained(title, lx.BRAND_RULES if rules is None else rules, default)


def zone(
    lat: Column, lng: Column, rules=None, missing_label: str = lx.ZONE_MISSING
) -> Column:
    """First zone whose latitude and longitude bounds lie above the point."""
    rules = lx.ZONE_RULES if rules is None else rules
    la, lo = nan_to_null(lat), nan_to_null(lng)
    cases = [(la.isNull() | lo.isNull(), F.lit(missing_label))]
    default = F.lit(None).cast("string")
    for label, below_lat, below_lng in rules:
        test = F.lit(True)
        if below_lat is not None:
            test = test & (la < below_lat)
        if below_lng is not None:
            test = test & (lo < below_lng)
        cases.append((test, F.lit(label)))
    return _chain(cases, default)


def station_category(category: Column) -> Column:
    is_cng = F.contains(F.lower(F.coalesce(category, F.lit(""))), F.lit(lx.CNG_MARK))
    return F.when(is_cng, F.lit(lx.CNG_CATEGORY)).otherwise(F.lit(lx.PETROL_CATEGORY))


def fuel_type(category: Column) -> Column:
    is_cng = F.contains(F.lower(F.coalesce(category, F.lit(""))), F.lit(lx.CNG_MARK))
    return F.when(is_cng, F.lit(lx.CNG_FUEL)).otherwise(F.lit(lx.PETROL_FUEL))


def band(
    value: Column, bands: list[tuple[float, str]], above: str, missing: str | None
) -> Column:
    """Label of the first band whose upper bound is not exceeded."""
    v = nan_to_null(value.cast("double"))
    cases = [(v.isNull(), F.lit(missing).cast("string"))]
    cases += [(v <= bound, F.lit(label)) for bound, label in bands]
    return _chain(cases, F.lit(above))


def rating_sentiment(rating: Column, bands=None) -> Column:
    return band(
        rating, lx.RATING_BANDS if bands is None else bands, lx.POSITIVE, lx.UNKNOWN
    )


def star_sentiment(star: Column) -> Column:
    return band(star, lx.STAR_BANDS, lx.POSITIVE, None)


def severity(
    negative_pct: Column,
    thresholds: tuple[float, float],
    labels: tuple[str, str, str] = ("high", "moderate", "low"),
) -> Column:
    """Three bands on a percentage; both thresholds are exclusive."""
    high, middle = thresholds
    return (
        F.when(negative_pct > high, labels[0])
        .when(negative_pct > middle, labels[1])
        .otherwise(labels[2])
    )


def city_band(mean_rating: Column, low: float = lx.CITY_LOW, high: float = lx.CITY_HIGH):
    return (
        F.when(mean_rating >= high, "above").when(mean_rating < low, "below").otherwise("at")
    )


def marker_weight(review_count: Column) -> Column:
    return F.log1p(review_count) * 2 + 5


def floor_count(value: Column) -> Column:
    """Missing counts become 1 and no count is below 1."""
    return F.greatest(F.coalesce(to_number(value), F.lit(1.0)), F.lit(1.0))


def star_from_label(label: Column) -> Column:
    """Number before the word star, else the first number, else NULL."""
    number = r"\d+(?:\.\d+)?"
    before_star = F.regexp_extract(label, rf"(?i)({number})\s*star", 1)
    anywhere = F.regexp_extract(label, rf"({number})", 1)
    return F.coalesce(
        F.nullif(before_star, F.lit("")), F.nullif(anywhere, F.lit(""))
    ).try_cast("double")


def _digits(match: Column) -> Column:
    """Matched digits as a number; an empty match is skipped, a failing cast is slow."""
    return F.nullif(match, F.lit("")).try_cast("int")


def months_back(relative: Column) -> Column:
    """Months before the reference date named by a relative date, or NULL."""

    def parse(s: Column) -> Column:
        months = _digits(F.regexp_extract(s, r"^(\d+)\s+month", 1))
        years = _digits(F.regexp_extract(s, r"^(\d+)\s+year", 1))
        return (
            F.when(F.contains(s, F.lit("week")), F.lit(0))
            .when(F.startswith(s, F.lit("a month")), F.lit(1))
            .when(F.startswith(s, F.lit("a year")), F.lit(12))
            .otherwise(F.coalesce(months, years * 12))
        )

    # "edited " is removed wherever it occurs, then the ends are stripped.
    return let(strip(F.replace(F.lower(relative), F.lit("edited "), F.lit(""))), parse)


def relative_month(relative: Column, reference: str = lx.REFERENCE_MONTH) -> Column:
    """First day of the month a relative date falls in, or NULL."""
    ref = F.lit(reference).cast("date")
    return F.trunc(F.add_months(ref, -months_back(relative)), "month")


def record_id(name: Column, lat: Column, lng: Column, author: Column, text: Column):
    """md5 over the identifying fields; coordinates in their shortest decimal form.

    Shortest form is what existing ids were made of: 19.076, 72.0, and 1e-05 or 1e+16
    beyond plain notation.
    """
    def shortest(x: Column) -> Column:
        text = x.cast("double").cast("string")
        digits = F.regexp_replace(F.regexp_extract(text, r"^-?([\d.]+)E", 1), r"\.0$", "")
        sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
        power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
        flat = F.replace(digits, F.lit("."), F.lit(""))
        plain = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), flat)).otherwise(
            F.concat(F.rpad(flat, power + 1, "0"), F.lit("."),
                     F.when(F.length(flat) > power + 1, F.substring(flat, power + 2, F.length(flat)))
                     .otherwise("0")))
        far = F.concat(digits, F.lit("e"), F.when(power < 0, "-").otherwise("+"),
                       F.lpad(F.abs(power).cast("string"), F.greatest(
                           F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        odd = F.concat(sign, F.when(power.between(-4, 15), plain).otherwise(far))
        return F.when(F.contains(text, F.lit("E")), odd).otherwise(text)
    parts = [name, shortest(lat), shortest(lng), author, text]
    return F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in parts]))


def station_key(title: Column, idx: Column) -> Column:
    """Zero-padded index plus a 40-character slug of the title."""
    number = idx.cast("string")
    padded = F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))
    slug = F.regexp_replace(F.lower(title), "[^a-z0-9]", "_")
    return F.concat(padded, F.lit("_"), F.substring(slug, 1, 40))


def clean_address(address: Column) -> Column:
    """Trim, put the address on one line, drop the U+E0C8 icon."""
    flat = F.replace(strip(address), F.lit("\n"), F.lit(" "))
    return strip(F.replace(flat, F.lit("\ue0c8"), F.lit("")))


def topic_label(top_words: Column, table=None, default: str = lx.TOPIC_DEFAULT) -> Column:
    """Named word set with the largest overlap; ties go to the earlier set."""
    table = lx.TOPIC_WORDS if table is None else table
    scored = [
        F.struct(
            F.size(F.array_intersect(top_words, F.array(*map(F.lit, ws)))).alias("n"),
            F.lit(-i).alias("o"),
            F.lit(name).alias("name"),
        )
        for i, (name, ws) in enumerate(table.items())
    ]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit(default))
