"""Column functions of round levels, returns and ranges. NULL is the only missing value; every function keeps it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVEL_STEP = 50.0
NEAR_THRESHOLDS = (2, 3, 5, 10)
MAIN_THRESHOLD = 5


def round_half_up_to_step(price: Column, step: float = LEVEL_STEP) -> Column:
    """Nearest level; a price half way between two levels belongs to the higher one."""
    return F.lit(float(step)) * F.floor(price / F.lit(float(step)) + F.lit(0.5)).cast("double")


def signed_distance(price: Column, step: float = LEVEL_STEP) -> Column:
    return price - round_half_up_to_step(price, step)


def distance_to_level(price: Column, step: float = LEVEL_STEP) -> Column:
    return F.abs(signed_distance(price, step))


def side(signed: Column) -> Column:
    return F.when(signed < 0, "below").when(signed > 0, "above").when(signed == 0, "at_level")


def near(distance: Column, threshold: float) -> Column:
    """1 up to and including the threshold, 0 beyond, NULL without a distance."""
    return F.when(distance.isNotNull(), (distance <= F.lit(float(threshold))).cast("int"))


def log_return(price: Column, before: Column) -> Column:
    return F.when((price > 0) & (before > 0), F.ln(price / before))


def parkinson_valid(high: Column, low: Column) -> Column:
    return F.coalesce((high > 0) & (low > 0) & (high >= low), F.lit(False))


def parkinson_variance(high: Column, low: Column) -> Column:
    return F.when(parkinson_valid(high, low), F.pow(F.ln(high / low), F.lit(2.0)) / (F.lit(4.0) * F.ln(F.lit(2.0))))


def log_volume(volume: Column) -> Column:
    """ln(1 + v) of days with trading; zero volume is no observation."""
    return F.when(volume > 0, F.log1p(volume))


def intraday_range(high: Column, low: Column, close: Column) -> Column:
    return F.when((high > 0) & (low > 0) & (close > 0), (high - low) / close)


def weekdays_between(before: Column, day: Column) -> Column:
    """Mondays to Fridays in [before, day) less one: weekdays skipped between two records, -1 for the same day."""
    monday = F.lit("1970-01-05").cast("date")

    def upto(d: Column) -> Column:
        e = F.datediff(d, monday)
        return F.lit(5) * F.floor(e / F.lit(7)) + F.least(F.pmod(e, F.lit(7)), F.lit(5))

    return (upto(day) - upto(before) - F.lit(1)).cast("long")


def unit_bin(distance: Column, step: float = LEVEL_STEP, open_last: bool = False) -> Column:
    """Unit-wide bin of a distance. The last bin is closed; with ``open_last`` the greatest distance falls out."""
    bins = int(step / 2)
    b = F.floor(distance).cast("int")
    return F.when(b < bins, b) if open_last else F.least(b, F.lit(bins - 1))


def bin_label(b: Column) -> Column:
    return F.concat(F.lit("["), b.cast("string"), F.lit(","), (b + 1).cast("string"), F.lit(")"))


def without_volume_tokens(flags: Column) -> Column:
    """Flags of a ``;`` list that don't speak of volume."""
    return F.array_join(F.filter(F.split(flags, ";"), lambda t: (t != "") & ~F.contains(F.lower(t), F.lit("volume"))), ";")


def parse_date(raw: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "d/M/yyyy", "yyyy/M/d")) -> Column:
    """The first format that fits, day before month where both could stand; NULL if none does."""
    return F.coalesce(*[F.try_to_date(F.trim(raw), f) for f in formats])


def parse_number(raw: Column) -> Column:
    """Numbers as the usual parsers read them (signs, exponents, infinities); blanks, text and NaN are NULL."""
    t = F.trim(raw)
    plain = t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$") | t.rlike(r"^[+-]?(?i:inf|infinity)$")
    return F.when(plain, t.try_cast("double"))


def is_blank(raw: Column) -> Column:
    return F.trim(F.coalesce(raw, F.lit(""))) == ""
