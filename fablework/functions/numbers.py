"""Number formatting and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_string(c: Column) -> Column:
    """A double without exponent, digits as in its shortest form: ``1e-05`` → ``0.00001``."""
    text = c.cast("string")
    mantissa = F.regexp_extract(text, r"^-?([0-9.]+)", 1)
    exponent = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.split_part(mantissa, F.lit("."), F.lit(1))
    part = F.regexp_replace(F.split_part(mantissa, F.lit("."), F.lit(2)), r"^0$", "")
    digits = F.concat(whole, part)
    shifted = (
        F.when(
            exponent < 0,
            F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - F.length(whole)), digits),
        )
        .when(
            exponent >= F.length(part),
            F.concat(digits, F.repeat(F.lit("0"), exponent - F.length(part))),
        )
        .otherwise(
            F.concat(
                F.substr(digits, F.lit(1), F.length(whole) + exponent),
                F.lit("."),
                F.substr(digits, F.length(whole) + exponent + 1),
            )
        )
    )
    return F.when(exponent == 0, text).otherwise(F.concat(sign, shifted))


def scientific_string(c: Column) -> Column:
    """A double as ``1e-5``: shortest digits, exponent without padding or plus sign."""
    text = F.abs(c).cast("string")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    shown = F.split_part(text, F.lit("E"), F.lit(1))
    shown_exponent = F.coalesce(F.nullif(F.split_part(text, F.lit("E"), F.lit(2)), F.lit("")).cast("int"), F.lit(0))
    whole = F.split_part(shown, F.lit("."), F.lit(1))
    part = F.split_part(shown, F.lit("."), F.lit(2))
    digits = F.regexp_replace(F.concat(whole, part), r"^0+", "")
    kept = F.regexp_replace(digits, r"0+$", "")
    lead = F.length(F.concat(whole, part)) - F.length(digits)
    exponent = shown_exponent + F.length(whole) - F.lit(1) - lead
    mantissa = F.concat(
        F.substr(kept, F.lit(1), F.lit(1)),
        F.when(F.length(kept) > 1, F.concat(F.lit("."), F.substr(kept, F.lit(2)))).otherwise(F.lit("")),
    )
    return F.when(c == 0, F.lit("0e0")).otherwise(
        F.concat(sign, mantissa, F.lit("e"), exponent.cast("string"))
    )


def cosine_schedule(
    step: Column,
    base: Column | float,
    warmup: int,
    decay_end: int,
    floor: float = 0.0,
    scheduled: bool = True,
) -> Column:
    """Learning rate at ``step``: linear warm-up, cosine decay, then the floor."""
    rate = base if isinstance(base, Column) else F.lit(float(base))
    if not scheduled:
        return rate
    ratio = (step - F.lit(warmup)) / F.lit(float(decay_end - warmup))
    decayed = F.lit(floor) + F.lit(0.5) * (F.lit(1.0) + F.cos(F.pi() * ratio)) * (rate - F.lit(floor))
    value = F.when(step > F.lit(decay_end), F.lit(floor)).otherwise(decayed)
    if warmup > 0:
        value = F.when(step < F.lit(warmup), rate * step / F.lit(float(warmup))).otherwise(value)
    return value
