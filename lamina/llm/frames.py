"""Small help with pandas batches."""

from __future__ import annotations

import pandas as pd


def ids(column: pd.Series) -> list:
    """The values of an id column; pandas makes floats of whole numbers beside nulls, which is undone."""
    if column.dtype.kind == "f":
        return [None if pd.isna(x) else int(x) for x in column.astype(object)]
    return column.tolist()


def frame_of(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Rows that need not have every column; values stay the objects they are."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})
