"""Comparable values and rows."""

import math


def plain(value):
    """One comparable text per value."""
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if hasattr(value, "as_tuple"):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
