"""Numbers, sizes, lists and durations in words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the powers of ten.
POWERS = [
    (3, "thousand"), (6, "million"), (9, "billion"), (12, "trillion"), (15, "quadrillion"), (18, "quintillion"), (21, "sextillion"),
    (24, "septillion"), (27, "octillion"), (30, "nonillion"), (33, "decillion"), (100, "googol"),
]
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_RAISED = ("0123456789-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁻")


def fixed(x: Column, digits: int) -> Column:
    """Decimal text of the exact binary value, ties to even, without grouping."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    last, two = F.abs(n) % 10, F.abs(n) % 100
    ending = F.when(two.between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def intcomma(n: Column, digits: int | None = None) -> Column:
    """A number with commas every three digits; with ``digits`` rounded to that many decimals."""
    if digits is not None:
        return F.format_number(n.cast("double"), digits)
    text = n.cast("string")
    whole, rest = F.regexp_extract(text, r"^-?([0-9]+)", 1), F.regexp_extract(text, r"^-?[0-9]+(.*)$", 1)
    grouped = F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")
    return F.concat(F.when(text.startswith("-"), "-").otherwise(""), grouped, rest)


def intword(n: Column) -> Column:
    """1.2 million; a value that rounds up to the next power is named by that power."""
    v = F.abs(n.cast("double"))
    sign = F.when(n < 0, "-").otherwise("")
    out = None
    steps = [(10.0**e, name) for e, name in POWERS]
    for i in range(len(steps) - 1, -1, -1):
        power, name = steps[i]
        text_of = fixed(v / power, 1)
        shown = text_of.cast("double")
        if i + 1 < len(steps):
            up, up_name = steps[i + 1]
            text = F.when(shown * power == up, F.lit(f"1.0 {up_name}")).otherwise(F.concat(text_of, F.lit(f" {name}")))
        else:
            text = F.concat(text_of, F.lit(f" {name}"))
        out = F.when(v >= power, text) if out is None else out.when(v >= power, text)
    return F.concat(sign, out.otherwise(F.abs(n).cast("bigint").cast("string")))


def digit_word(n: Column) -> Column:
    """Words for 0 to 9, digits for everything else."""
    return F.coalesce(*[F.when(n == i, F.lit(w)) for i, w in enumerate(DIGIT_WORDS)], n.cast("string"))


def naturalsize(n: Column, binary: bool = False) -> Column:
    """Bytes as 1.0 kB, or 1.0 KiB by powers of 1024."""
    base = 1024.0 if binary else 1000.0
    units = ["KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB"] if binary else ["kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]
    v = F.abs(n.cast("double"))
    out = F.when(v == 1, F.concat(n.cast("bigint").cast("string"), F.lit(" Byte"))).when(v < base, F.concat(n.cast("bigint").cast("string"), F.lit(" Bytes")))
    for i, unit in enumerate(units):
        text = F.concat(fixed(n.cast("double") / base ** (i + 1), 1), F.lit(f" {unit}"))
        out = out.when(v < base ** (i + 2), text) if i + 1 < len(units) else out.otherwise(text)
    return out


def metric(n: Column, unit: str = "") -> Column:
    """Three significant digits with an SI prefix: 1.50 k, 230 M."""
    v = n.cast("double")
    exponent = F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(v)))).cast("int")
    group = F.floor(exponent / 3).cast("int")
    scaled = v / F.pow(F.lit(10.0), group * 3)
    places = F.lit(2) - (exponent - group * 3)
    shown = F.when(places == 2, fixed(scaled, 2)).when(places == 1, fixed(scaled, 1)).otherwise(fixed(scaled, 0))
    prefix = F.element_at(F.array(*map(F.lit, "qryzafpnµm")), group + 11)
    prefix = F.when(group < 0, prefix).when(group == 0, "").otherwise(F.element_at(F.array(*map(F.lit, "kMGTPEZYRQ")), F.greatest(group, F.lit(1))))
    tail = F.concat(prefix, F.lit(unit))
    return F.when(tail == "", shown).otherwise(F.concat(shown, F.lit(" "), tail))


def scientific(n: Column, digits: int = 2) -> Column:
    """1.23 x 10³ with raised digits."""
    v = n.cast("double")
    exponent = F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(v)))).cast("int")
    mantissa = fixed(v / F.pow(F.lit(10.0), exponent), digits).cast("double")
    over = F.abs(mantissa) >= 10
    mantissa, exponent = F.when(over, mantissa / 10).otherwise(mantissa), F.when(over, exponent + 1).otherwise(exponent)
    return F.concat(fixed(mantissa, digits), F.lit(" x 10"), F.translate(exponent.cast("string"), *_RAISED))


def clamp(n: Column, floor: float | None = None, ceil: float | None = None) -> Column:
    """The number, or <floor or >ceil where it lies outside."""
    text = n.cast("string")
    out = F.when(F.lit(floor is not None) & (n < F.lit(floor)), F.lit(f"<{floor}"))
    return out.when(F.lit(ceil is not None) & (n > F.lit(ceil)), F.lit(f">{ceil}")).otherwise(text)


def natural_list(items: Column) -> Column:
    """a; a and b; a, b and c."""
    head = F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), ", ")
    return F.when(F.size(items) == 0, "").when(F.size(items) == 1, items[0]).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def naturaldelta(seconds: Column) -> Column:
    """A duration in its largest fitting unit: a moment, 5 minutes, an hour, 2 days, a month, 1 year and 3 months."""
    s = F.abs(seconds.cast("double"))
    days = F.floor(s / 86400)
    years, left = F.floor(days / 365), days % 365
    months = F.floor(left / 30.5)

    def count(n: Column, word: str) -> Column:
        return F.concat(n.cast("bigint").cast("string"), F.lit(f" {word}s"))

    over_a_year = (
        F.when((months == 0) & (left == 0), "a year").when(months == 0, F.concat(F.lit("1 year, "), F.when(left == 1, "1 day").otherwise(count(left, "day"))))
        .when(months == 1, "1 year, 1 month").otherwise(F.concat(F.lit("1 year, "), count(months, "month")))
    )
    return (
        F.when(s < 1, "a moment").when(s < 2, "a second").when(s < 60, count(F.floor(s), "second")).when(s < 120, "a minute")
        .when(s < 3600, count(F.floor(s / 60), "minute")).when(s < 7200, "an hour").when(days < 1, count(F.floor(s / 3600), "hour"))
        .when((days < 2), "a day").when((years < 1) & (months < 1), count(days, "day")).when((years < 1) & (months < 2), "a month")
        .when(years < 1, count(months, "month")).when(years < 2, over_a_year).otherwise(count(years, "year"))
    )


def fraction(value: float | None, limit: int = 1000) -> str | None:
    """0.3333333 as 1/3, 1.25 as 1 1/4."""
    from fractions import Fraction

    if value is None or value != value or value in (float("inf"), float("-inf")):
        return None if value is None else str(value)
    whole = int(value)
    part = Fraction(abs(value) - abs(whole)).limit_denominator(limit)
    if part == 1:
        return str(whole + (1 if value > 0 else -1))
    if not part:
        return str(whole)
    if not whole:
        return ("-" if value < 0 else "") + f"{part.numerator}/{part.denominator}"
    return f"{whole} {part.numerator}/{part.denominator}"
