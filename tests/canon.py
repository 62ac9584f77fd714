"""Frames of two engines in one form."""

import pandas as pd


def say(x):
    if hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return str(list(x))
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.6g}"
    return str(x)


def canonical(frame):
    """Column names, and rows as sorted tuples of strings."""
    names = sorted(frame.columns)
    return names, sorted(tuple(say(v) for v in row) for row in frame[names].itertuples(index=False))
