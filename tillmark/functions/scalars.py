"""Column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000

# Ordinal rank of each credit rating; NR has no rank.
CREDIT_RATING_RANKS = {
    "AAA": 20,
    "AA+": 19,
    "AA": 18,
    "AA-": 17,
    "A+": 16,
    "A": 15,
    "A-": 14,
    "BBB+": 13,
    "BBB": 12,
    "BBB-": 11,
    "BB+": 10,
    "BB": 9,
    "BB-": 8,
    "B+": 7,
    "B": 6,
    "B-": 5,
    "CCC+": 4,
    "CCC": 3,
    "CCC-": 2,
    "CC": 1,
    "C": 1,
    "D": 0,
}

# Which region each store serves.
STORE_REGIONS = {0: "Nottingham", 1: "Birmingham", 2: "London", 3: "London"}


def lookup(key: Column, table: dict) -> Column:
    """Literal dictionary lookup; keys outside the table give null."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods between two instants (not calendar days)."""
    return F.floor((micros(end) - micros(start)) / F.lit(float(DAY_MICROS)))


def parse_currency(text: Column) -> Column:
    """`£1,234.50` to an exact amount; anything unreadable becomes null."""
    return F.regexp_replace(text, "[£,]", "").try_cast("decimal(18,2)")


def currency_text(amount: Column) -> Column:
    return F.concat(F.lit("£"), F.format_number(amount, 2))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double, 0 where it is undefined."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double, null where it is undefined."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def rounded_ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """Half-up rounding of an exact decimal quotient."""
    exact = F.try_divide(numerator.cast("decimal(22,2)"), denominator.cast("decimal(12,0)"))
    return F.round(exact, digits).cast("double")


def quarter_end(label: Column) -> Column:
    """`2023Q1` to the last day of that quarter; malformed labels give null."""
    text = F.trim(label)
    well_formed = text.rlike("^[0-9]{4}Q[1-4]$")
    year = F.when(well_formed, F.substring(text, 1, 4).try_cast("int"))
    month = F.when(well_formed, F.substring(text, 6, 1).try_cast("int") * 3)
    return F.last_day(F.make_date(year, month, F.lit(1)))


def credit_rating_rank(rating: Column) -> Column:
    return lookup(rating, CREDIT_RATING_RANKS)


def finite_or_null(value: Column) -> Column:
    """NaN and the infinities become null."""
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(~bad, value)


def top_k_sum(columns: Sequence[Column], k: int) -> Column:
    """Sum of the k largest values of a row."""
    ranked = F.slice(F.sort_array(F.array(*columns), asc=False), 1, k)
    zero = F.lit(0).cast("decimal(28,2)")
    return F.aggregate(ranked, zero, lambda acc, x: (acc + F.coalesce(x, zero)).cast("decimal(28,2)"))


def row_sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def is_weekend(ts: Column) -> Column:
    """Saturday or Sunday."""
    return F.weekday(ts) >= 5


def is_morning(ts: Column, first: int = 6, last: int = 12) -> Column:
    """Hour band, both ends included."""
    return F.hour(ts).between(first, last)


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal for z >= 0.

    Polynomial 26.2.17 of Abramowitz and Stegun, absolute error below 7.5e-8.
    """
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    # The published coefficients b1 to b5.
    coefficients = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    poly = F.lit(0.0)
    for b in reversed(coefficients):
        poly = (poly + F.lit(b)) * t
    density = F.exp(-z * z / 2.0) / F.lit(2.5066282746310002)
    return density * poly


def hash_fraction(*parts: Column) -> Column:
    """Repeatable uniform number in [0, 1) derived from the given values."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_bucket(n: int, *parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(n)
