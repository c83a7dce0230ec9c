"""Column-level helpers: all built-in expressions, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS_GAP = 1e-3      # denominators of gap ratios
EPS_STAT = 1e-5     # denominators of group-stat ratios


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI mode would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def finite(x) -> Column:
    """NaN and +-inf become NULL."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def epoch_millis(ts) -> Column:
    """Integer milliseconds since epoch, floored from microseconds (timestamp_ntz)."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) div 1000")


def parse_tags(s) -> Column:
    """'12 61 105' -> array<int>; NULL stays NULL."""
    return F.transform(F.split(col(s), " "), lambda x: x.cast("int"))


def pad_left(arr, width: int, pad) -> Column:
    """Left-pad an array with ``pad`` up to ``width`` (longer arrays are kept whole)."""
    arr = col(arr)
    n = F.greatest(F.lit(width) - F.size(arr), F.lit(0))
    return F.concat(F.array_repeat(F.lit(pad), n), arr)


def array_text(arr, fmt: str = "int") -> Column:
    """Array -> comma text, the stable form used for oracle comparison."""
    if fmt == "int":
        return F.array_join(F.transform(col(arr), lambda x: x.cast("bigint").cast("string")), ",")
    return F.array_join(F.transform(col(arr), lambda x: F.format_string("%.6f", F.round(x.cast("double"), 6))), ",")


def nan_key(c) -> Column:
    """String form of a key where a missing value is its own group 'nan'."""
    return F.coalesce(col(c).cast("string"), F.lit("nan"))
