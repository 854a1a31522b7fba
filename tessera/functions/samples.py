"""A small extension module: vectorised integer functions for CREATE EXTENSION."""

from __future__ import annotations

import pandas as pd


def add_ints(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sum of two integer columns; null where either is null."""
    return (a.astype("Int64") + b.astype("Int64")).astype("Int32")


def square(a: pd.Series) -> pd.Series:
    return (a.astype("Int64") ** 2).astype("Int32")
