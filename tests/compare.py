"""Rows of both engines in one form, to be compared without regard to order."""

import math
from decimal import Decimal

import pandas as pd


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    if isinstance(x, Decimal) or type(x).__module__ == "numpy" or isinstance(x, (int, float)):
        return repr(float(x))
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))
