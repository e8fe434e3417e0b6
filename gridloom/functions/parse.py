"""What a cell text is (type tests) and what it is worth (typed values).

Formats are recognised by length and shape first, rewritten to ISO order with
substrings, and left to ``try_cast``: no formatter objects, no exceptions, and the
whole chain stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import fixed
from gridloom.functions.text import trim_ws

# Fixed formats: accepted shapes of dates and times.
#   dates       2024-01-31  31.01.2024  01/31/2024  2024/01/31  31 Jan 2024  Jan 31, 2024  31-Jan-2024
#   timestamps  date as yyyy-mm-dd with a space or T, dd.mm.yyyy or mm/dd/yyyy with a space;
#               H:mm:ss, optional fraction; a zone (Z or +hh:mm) only in the T form
# In a date shape 0 stands for any digit and a for any letter.
DATE_ISO = "0000-00-00"
DATE_DOT = "00.00.0000"
DATE_US = "00/00/0000"
DATE_SLASH = "0000/00/00"
DATE_DAY_MON = "00 aaa 0000"
DATE_MON_DAY = "aaa 00, 0000"
DATE_DASH_MON = "00-aaa-0000"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"
STAMP_ISO = rf"^\d{{4}}-\d{{2}}-\d{{2}}(?: {CLOCK}|T{CLOCK}(?:Z|[+-]\d{{2}}:\d{{2}})?)$"
STAMP_DOT = rf"^\d{{2}}\.\d{{2}}\.\d{{4}} {CLOCK}$"
STAMP_US = rf"^\d{{2}}/\d{{2}}/\d{{4}} {CLOCK}$"

INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = (
    r"^[+-]?(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?$"
)
HEX_FLOAT = r"^[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+$"
NOT_FINITE = r"^(?i:[+-]?inf(?:inity)?|nan)$"
# With a line end, which ``$`` lets pass.
LONGEST_NOT_FINITE = len("+infinity\r\n")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_number(c: Column | str) -> Column:
    """Drop currency signs, percent signs and, next to a decimal point, commas."""
    return _without_commas(bare_number(c))


def bare_number(c: Column | str) -> Column:
    """A text without signs around it. Most begin and end in visible ASCII that is no sign, and
    pass through untouched."""
    v = _col(c)
    first, last = F.ascii(v), F.ascii(F.right(v, F.lit(1)))
    clean = first.between(33, 126) & (first != ord("$")) & last.between(33, 126) & (last != ord("%"))
    signs_off = F.rtrim(F.ltrim(v, F.lit(fixed.NUMBER_PREFIX_CHARS)), F.lit(fixed.NUMBER_SUFFIX_CHARS))
    return F.when(clean, v).otherwise(trim_ws(signs_off))


def _without_commas(bare: Column) -> Column:
    return F.when(F.contains(bare, F.lit(".")), F.replace(bare, F.lit(","), F.lit(""))).otherwise(bare)


def date_shape(c: Column | str) -> Column:
    """Digits as 0 and letters as a, for texts as long as a date; NULL for all others."""
    v = _col(c)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.when(
        F.length(v).between(10, 12),
        F.translate(F.lower(v), "123456789" + letters, "0" * 9 + "a" * len(letters)),
    )


def as_boolean(c: Column | str) -> Column:
    """True for the true-words, false for any other non-empty text."""
    v = _col(c)
    return F.when(v != "", F.lower(v).isin(*fixed.BOOLEAN_TRUE))


def as_long(c: Column | str, lenient_prefix: bool = False) -> Column:
    v = _col(c)
    if lenient_prefix:
        head = F.regexp_extract(v, r"^[+-]?[0-9]+", 0)
        return F.when(head != "", head.try_cast("bigint"))
    return F.when(v.rlike(INTEGER), v.try_cast("bigint"))


def as_double(c: Column | str, lenient_prefix: bool = False) -> Column:
    return cleaned_as_double(clean_number(c), lenient_prefix)


def cleaned_as_double(v: Column, lenient_prefix: bool = False) -> Column:
    """The value of a text that went through ``clean_number``."""
    if lenient_prefix:
        head = F.regexp_extract(
            v, r"^(?i:nan|[+-]?inf|[+-]?(?:\d[\d_]*\.?\d*|\.\d+)(?:e[+-]?\d+)?)", 0
        )
        return F.when(head != "", F.replace(head, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(_in_range(v), _number_text(v).try_cast("double")).when(
        v.rlike(NOT_FINITE), v.try_cast("double")
    )


def _number_text(v: Column) -> Column:
    return F.when(v.rlike(DECIMAL), F.replace(v, F.lit("_"), F.lit(""))).when(v.rlike(HEX_FLOAT), v)


def _in_range(v: Column) -> Column:
    """A finite number; the first character rules most other texts out."""
    finite = F.abs(_number_text(v).try_cast("double")) < F.lit(float("inf"))
    return F.ascii(v).between(43, 57) & F.coalesce(finite, F.lit(False))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.concat(y, F.lit("-"), m, F.lit("-"), d)


def _part(v: Column, start: int, length: int) -> Column:
    return F.substring(v, start, length)


def _month(name: Column) -> Column:
    at = F.instr(F.lit(MONTHS), F.lower(name))
    return F.when(
        (at > 0) & ((at - 1) % 3 == 0), F.lpad((F.floor((at - 1) / 3) + 1).cast("string"), 2, "0")
    )


def date_text(c: Column | str, shape: Column | None = None) -> Column:
    """A text in a date format in ISO order, or NULL; the day may still not exist."""
    v = _col(c)
    like = date_shape(v) if shape is None else shape
    return (
        F.when(like == DATE_ISO, v)
        .when(like == DATE_DOT, _ymd(_part(v, 7, 4), _part(v, 4, 2), _part(v, 1, 2)))
        .when(like == DATE_US, _ymd(_part(v, 7, 4), _part(v, 1, 2), _part(v, 4, 2)))
        .when(like == DATE_SLASH, F.translate(v, "/", "-"))
        .when(
            like.isin(DATE_DAY_MON, DATE_DASH_MON),
            _ymd(_part(v, 8, 4), _month(_part(v, 4, 3)), _part(v, 1, 2)),
        )
        .when(like == DATE_MON_DAY, _ymd(_part(v, 9, 4), _month(_part(v, 1, 3)), _part(v, 5, 2)))
    )


def as_date(c: Column | str) -> Column:
    return date_text(c).try_cast("date")


def stamp_text(c: Column | str) -> Column:
    """A text in a date-time format as ISO text with a zone, or NULL; without one it is UTC."""
    v = _col(c)
    day = (
        F.when(v.rlike(STAMP_ISO), _part(v, 1, 10))
        .when(v.rlike(STAMP_DOT), _ymd(_part(v, 7, 4), _part(v, 4, 2), _part(v, 1, 2)))
        .when(v.rlike(STAMP_US), _ymd(_part(v, 7, 4), _part(v, 1, 2), _part(v, 4, 2)))
    )
    clock = F.translate(F.substring(v, F.lit(12), F.length(v)), ",", ".")
    hour = F.when(_part(v, 13, 1) == ":", F.lit("T0")).otherwise(F.lit("T"))
    zone = F.when(clock.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), F.lit("")).otherwise(F.lit("Z"))
    return F.when((F.length(v) >= 18) & F.contains(v, F.lit(":")), F.concat(day, hour, clock, zone))


def as_timestamp(c: Column | str) -> Column:
    return stamp_text(c).try_cast("timestamp")


def with_parsed(df: DataFrame, value: Column) -> DataFrame:
    """Add what the type tests look at: the trimmed text ``_v``, its number text ``_num``,
    and its ISO date and date-time texts ``_day`` and ``_stamp``.

    As columns of their own these are computed once per cell. Inlined into the tests they
    would be repeated dozens of times, and the generated method would grow past the 8000
    bytes up to which the JVM compiles one (a test keeps it below).
    """
    return (
        df.withColumn("_v", trim_ws(value))
        .withColumn("_shape", date_shape("_v"))
        .withColumn("_bare", bare_number("_v"))
        .withColumn("_num", _without_commas(F.col("_bare")))
        .withColumn("_day", date_text("_v", F.col("_shape")))
        .withColumn("_stamp", stamp_text("_v"))
    )


def cell_kind() -> Column:
    """The narrowest type of one cell from ``with_parsed``; NULL if it is empty.

    The tests exclude one another except that every integer is also a double, so one
    lazily evaluated chain replaces five independent tests per value.
    """
    v, num, day, stamp = F.col("_v"), F.col("_num"), F.col("_day"), F.col("_stamp")
    longest = max(map(len, fixed.BOOLEAN_TRUE + fixed.BOOLEAN_FALSE))
    words = (F.length(v) <= longest) & F.lower(v).isin(*fixed.BOOLEAN_TRUE, *fixed.BOOLEAN_FALSE)
    return (
        F.when(v == "", F.lit(None).cast("string"))
        .when(F.ascii(v).between(43, 57) & as_long(v).isNotNull(), F.lit("INTEGER"))
        .when(words, F.lit("BOOLEAN"))
        .when(_in_range(num) | ((F.length(num) <= LONGEST_NOT_FINITE) & num.rlike(NOT_FINITE)), F.lit("DOUBLE"))
        .when(day.isNotNull() & day.try_cast("date").isNotNull(), F.lit("DATE"))
        .when(stamp.isNotNull() & stamp.try_cast("timestamp").isNotNull(), F.lit("TIMESTAMP"))
        .otherwise(F.lit("VARCHAR"))
    )


SPARK_TYPES = {
    "BOOLEAN": "boolean",
    "INTEGER": "bigint",
    "DOUBLE": "double",
    "DATE": "date",
    "TIMESTAMP": "timestamp",
    "VARCHAR": "string",
}


def parsed_value(column_type: str, lenient_prefix: bool = False) -> Column:
    """A cell from ``with_parsed`` as a value of one type; empty or unreadable is NULL."""
    v = F.col("_v")
    return {
        "BOOLEAN": lambda: as_boolean(v),
        "INTEGER": lambda: as_long(v, lenient_prefix),
        "DOUBLE": lambda: cleaned_as_double(F.col("_num"), lenient_prefix),
        "DATE": lambda: F.col("_day").try_cast("date"),
        "TIMESTAMP": lambda: F.col("_stamp").try_cast("timestamp"),
        "VARCHAR": lambda: F.when(v != "", v),
    }[column_type]()


def typed_value(c: Column | str, column_type: str, lenient_prefix: bool = False) -> Column:
    """A trimmed cell as a value of one inferred type; empty or unreadable is NULL."""
    v = _col(c)
    if column_type == "BOOLEAN":
        return as_boolean(v)
    if column_type == "INTEGER":
        return as_long(v, lenient_prefix)
    if column_type == "DOUBLE":
        return as_double(v, lenient_prefix)
    if column_type == "DATE":
        return as_date(v)
    if column_type == "TIMESTAMP":
        return as_timestamp(v)
    return F.when(v != "", v)
