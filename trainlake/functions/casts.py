"""Typed conversions whose results follow the source system's rules.

Spark's own double-to-integer cast truncates; here integers are rounded.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)

# Accepted spellings of a human-written start time, tried in turn.
HUMAN_TIME_FORMATS = (
    "MMM d, yyyy, h:mm:ss a",
    "MMM d, yyyy h:mm:ss a",
    "MMM d, yyyy, H:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy H:mm",
    "MMM d, yyyy",
    "yyyy-MM-dd",
    "M/d/yyyy",
)
# The order in which an ISO-like date argument is read.
DATE_ARGUMENT_FORMATS = ("%Y-%m-%d", "%Y-%d-%m")


def _integral(expr: str, source: T.DataType, target: str) -> str:
    if isinstance(source, _INTEGRAL + (T.BooleanType,)):
        return f"CAST({expr} AS {target})"
    if isinstance(source, T.StringType):
        # Plain integers stay exact; the detour over double only serves "42.0".
        return (
            f"CASE WHEN {expr} RLIKE '^ *[+-]?[0-9]+ *$' THEN CAST({expr} AS {target})"
            f" ELSE CAST(round(CAST({expr} AS DOUBLE)) AS {target}) END"
        )
    return f"CAST(rint(CAST({expr} AS DOUBLE)) AS {target})"


def _boolean(expr: str, source: T.DataType) -> str:
    if not isinstance(source, T.StringType):
        return f"CAST({expr} AS BOOLEAN)"
    return (
        f"CASE WHEN lower(trim({expr})) IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n')"
        f" THEN CAST({expr} AS BOOLEAN) ELSE CAST({expr} AS DOUBLE) <> 0D END"
    )


def _wall_clock(expr: str, source: T.DataType) -> str:
    if isinstance(source, T.TimestampNTZType):
        return expr
    return f"CAST(CAST({expr} AS TIMESTAMP) AS TIMESTAMP_NTZ)"


def convert(expr: str, source: T.DataType, target: str, name: str | None = None) -> Column:
    """Convert a column (or SQL expression) of type ``source`` to one of the contract types.

    ``int`` and ``bigint`` round: doubles half to even, text half away from zero;
    text that is not a number fails.  ``timestamp`` gives a zone-less timestamp.
    """
    if target in ("int", "bigint"):
        sql = _integral(expr, source, target)
    elif target == "boolean":
        sql = _boolean(expr, source)
    elif target == "timestamp":
        sql = _wall_clock(expr, source)
    elif target in ("double", "date"):
        sql = f"CAST({expr} AS {target})"
    elif target == "asis":
        sql = expr
    else:
        raise ValueError(f"unknown contract type {target!r}")
    return F.expr(f"{sql} AS `{name}`" if name else sql)


def epoch_ms(col: Column) -> Column:
    """Epoch milliseconds -> zone-less timestamp on the UTC clock."""
    return F.timestamp_millis(col.cast("bigint")).cast("timestamp_ntz")


def epoch_ms_frac(col: Column) -> Column:
    """Like ``epoch_ms`` for fractional milliseconds, kept to the microsecond."""
    return F.timestamp_micros(F.rint(col.cast("double") * F.lit(1000.0)).cast("bigint")).cast("timestamp_ntz")


def micros(col: Column) -> Column:
    """Zone-less timestamp -> microseconds since the epoch."""
    return F.unix_micros(col.cast("timestamp"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column."""
    swaps = {
        f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, _FLOATING)
    }
    return df.withColumns(swaps) if swaps else df


def parse_human_time(col: Column, strict: bool = True) -> Column:
    """Parse a human-written start time; month comes first when ambiguous."""
    text = F.trim(col)
    missing = col.isNull() | F.lower(text).isin("", "nan", "nat")
    # U+202F/U+00A0 occur between time and AM/PM in some exports.
    clean = F.translate(text, "\u202f\u00a0", "  ")
    parsed = F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in HUMAN_TIME_FORMATS])
    if strict:
        failure = F.raise_error(F.concat(F.lit("unreadable start time: "), col)).cast("timestamp")
        parsed = F.coalesce(parsed, failure)
    return F.when(~missing, parsed).cast("timestamp_ntz")


def repair_date_argument(value: str | date | None, name: str = "date") -> date | None:
    """Read ``Y-m-d``, else ``Y-d-m``, else fail. Empty means no bound."""
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    for fmt in DATE_ARGUMENT_FORMATS:
        try:
            return datetime.strptime(value, fmt).date()
        except ValueError:
            pass
    raise ValueError(f"{name} is no date: {value!r} (expected like 2026-01-31)")


def repair_date_column(col: Column) -> Column:
    """The column form of ``repair_date_argument``; unreadable text becomes NULL."""
    return F.coalesce(
        F.try_to_timestamp(col, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(col, F.lit("yyyy-dd-MM")),
    ).cast("date")
