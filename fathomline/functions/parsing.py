"""Reading numbers, dates and names from loosely written text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean a missing number.
MISSING = ["", "-", "na", "n/a", "nan", "none", "null"]
#: Date formats tried after ISO.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "MM/dd/yyyy", "dd/MM/yyyy"]
#: Confidence words.
CONFIDENCE = {"high": 0.9, "medium": 0.65, "low": 0.35}


def safe_number(text: Column) -> Column:
    """A double from text with thousands commas, a dollar sign or a percent sign (divided by 100); null where missing, unreadable or not finite."""
    plain = F.trim(F.regexp_replace(text.cast("string"), "[,$]", ""))
    percent = F.endswith(plain, F.lit("%"))
    value = F.trim(F.regexp_replace(plain, "%$", "")).try_cast("double")
    value = F.when(percent, value / 100.0).otherwise(value)
    good = ~F.lower(plain).isin(*MISSING) & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(F.coalesce(good, F.lit(False)), value)


def safe_date(text: Column) -> Column:
    """A timestamp without zone from ISO text (with Z or an offset, read as UTC) or one of DATE_FORMATS; null where unreadable."""
    plain = F.trim(text.cast("string"))
    zoned = F.when(plain.rlike(r"(?:[Zz]|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(plain)).cast("timestamp_ntz")
    iso = F.when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), plain.try_cast("timestamp_ntz"))
    return F.coalesce(zoned, iso, *(F.try_to_timestamp(plain, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS))


def canonical(name: str) -> str:
    """Lower-case letters and digits of a column's name."""
    return "".join(c for c in name.lower() if c.isalnum())


def confidence(text: Column) -> Column:
    """high, medium and low as numbers, or a number from 0 to 1; null otherwise."""
    word = F.lower(F.trim(text.cast("string")))
    value = word.try_cast("double")
    out = F.when(value.between(0, 1), value)
    for name, level in CONFIDENCE.items():
        out = F.when(word == name, F.lit(level)).otherwise(out)
    return out
