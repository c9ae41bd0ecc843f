"""Cell channels: which of number, text or date a typed column feeds, and its value there."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NULL_TEXT
from .draws import as_col

NUM, TEXT, DATE, TIME = "num", "text", "date", "time"

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def kind_of(dtype, declared=None):
    """Channel of a Spark type. ``declared='time'`` marks a column holding a time of day."""
    if declared is not None:
        return declared
    if isinstance(dtype, _NUMBERS):
        return NUM
    if isinstance(dtype, _DATES):
        return DATE
    return TEXT


def kinds(schema, times=()):
    """Channel of every column of a schema; names in ``times`` are declared times of day."""
    return {f.name: kind_of(f.dataType, TIME if f.name in times else None) for f in schema.fields}


def is_nested(dtype):
    return isinstance(dtype, _NESTED)


def finite(x):
    """The value if it is a finite number, else null."""
    inf = float("inf")
    return F.when(~F.isnan(x) & (x != F.lit(inf)) & (x != F.lit(-inf)), x)


_TIME_PATTERN = "^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]+)?$"


def _number_sql(c, dtype):
    """Double; NaN as null, no negative zero. Infinite values stay."""
    x = f"cast({c} as double)"
    if not isinstance(dtype, (T.FloatType, T.DoubleType)):
        return x
    return f"case when isnan({x}) then null when {x} = 0 then 0D else {x} end"


def _time_sql(c, dtype):
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return f"cast(hour({c}) * 3600 + minute({c}) * 60 + extract(second from {c}) as double)"
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return f"case when {c} >= 0 and {c} < 86400000000 then {c} / 1000000D end"
    part = [f"try_cast(split_part({c}, ':', {i}) as double)" for i in (1, 2, 3)]
    total = f"{part[0]} * 3600 + {part[1]} * 60 + {part[2]}"
    return f"case when {c} rlike '{_TIME_PATTERN}' then {total} end"


def _text_sql(c, dtype):
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return f"initcap(cast({c} as string))"
    if is_nested(dtype):
        return f"to_json({c})"
    return f"cast({c} as string)"


def quoted(name):
    return "`" + name.replace("`", "``") + "`"


def channel_sql(name, dtype, kind):
    """SQL text of a column's null-preserving channel value: double, string or timestamp_ntz.

    Text keeps one expression per column in the plan of wide tables, where building column
    objects one by one would dominate.
    """
    c = quoted(name)
    if kind == NUM:
        return _number_sql(c, dtype)
    if kind == TIME:
        return _time_sql(c, dtype)
    if kind == DATE:
        return f"cast({c} as timestamp_ntz)"
    return _text_sql(c, dtype)


def channel_value(name, dtype, kind):
    return F.expr(channel_sql(name, dtype, kind))


def time_seconds(name, dtype):
    """Seconds in the day with fraction; a value that is no time of day becomes null.

    Takes ``HH:mm:ss[.f]`` strings, timestamps, or whole microseconds since midnight.
    """
    return channel_value(name, dtype, TIME)


def text(name, dtype):
    """Text of a value; null is spelled out. Booleans read ``True``/``False``, nested values as
    JSON."""
    return F.coalesce(channel_value(name, dtype, TEXT), F.lit(NULL_TEXT))


def date_codes(ts):
    """Codes (y, m, d, w) of a timestamp column; 0 means no date."""
    t = as_col(ts)
    year = F.least(F.greatest(F.year(t), F.lit(2000)), F.lit(2050)) - 2000
    code = lambda part: F.coalesce(F.when(t.isNotNull(), part + 1), F.lit(0)).cast("int")
    return {
        "y": code(year),
        "m": code(F.month(t) - 1),
        "d": code(F.dayofmonth(t) - 1),
        "w": code(F.weekday(t)),
    }
