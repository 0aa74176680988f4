"""Measures of small brightness grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

MEASURES = StructType([StructField(n, DoubleType()) for n in ("sharpness", "luminance", "clipped")])


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Brightness of a pixel."""
    return 0.2126 * red + 0.7152 * green + 0.0722 * blue


@F.pandas_udf(MEASURES)
def frame_measures(grids: pd.Series, widths: pd.Series) -> pd.DataFrame:
    """Mean edge strength, mean brightness and clipped share of row-major brightness grids."""
    rows = []
    for grid, width in zip(grids, widths):
        g = np.asarray([] if grid is None else grid, dtype=float).reshape(-1, max(1, int(width or 1)))
        inner = np.abs(4 * g[1:-1, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:] - g[:-2, 1:-1] - g[2:, 1:-1])
        rows.append((inner.mean() if inner.size else 0.0, g.mean() if g.size else 0.0, ((g < 12) | (g > 245)).mean() if g.size else 0.0))
    return pd.DataFrame(rows, columns=["sharpness", "luminance", "clipped"])
