"""Values as the text a prompt shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom import fixed


def _double_text(c: Column) -> Column:
    """Shortest digits; with an exponent below 1e-4 and from 1e6 on.

    Spark's own text has the shortest digits but switches at 1e-3 and 1e7, so the two
    ranges in between are rewritten.
    """
    raw = F.abs(c).cast("string")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    has_power = F.contains(raw, F.lit("E"))
    power = F.when(has_power, F.regexp_extract(raw, r"E(-?\d+)$", 1)).otherwise("6").cast("int")
    digits = F.rtrim(
        F.replace(F.regexp_replace(raw, r"E.*$", ""), F.lit("."), F.lit("")), F.lit("0")
    )
    mantissa = F.concat(
        F.substring(digits, 1, 1),
        F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(
            F.lit("")
        ),
    )
    scientific = F.concat(
        mantissa,
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")),
    )
    small = F.concat(F.lit("0.000"), digits)  # 1e-4 up to 1e-3
    return (
        F.when(F.isnan(c), F.lit("NaN"))
        .when(c == float("inf"), F.lit("+Inf"))
        .when(c == float("-inf"), F.lit("-Inf"))
        .when(c == 0, F.lit("0"))
        .when((F.abs(c) >= 1e6) | (F.abs(c) < 1e-4), F.concat(sign, scientific))
        .when(has_power, F.concat(sign, small))
        .otherwise(F.concat(sign, F.regexp_replace(raw, r"\.0$", "")))
    )


def value_text(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = _double_text(c)
    elif isinstance(data_type, T.DateType):
        text = F.concat(c.cast("string"), F.lit(" 00:00:00 +0000 UTC"))
    elif isinstance(data_type, T.TimestampType):
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
        text = F.concat(utc.cast("string"), F.lit(" +0000 UTC"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(fixed.NULL_TEXT))
