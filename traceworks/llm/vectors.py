"""What the operators on vectors share: which vectors take part, and their entries as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    broken = F.exists(vector, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return vector.isNotNull() & ~broken


def whole_steps(vector: Column, scale: float, most: int) -> Column:
    """floor(scale * entry) of every entry as double; entries beyond ``most`` on either side count as that."""
    limit = F.lit(float(most))
    return F.transform(vector, lambda e: F.floor(F.least(F.greatest(e.cast("double") * scale, -limit), limit)).cast("long"))


def matrix(column: pa.ListArray | pa.ChunkedArray, dims: int, kind=np.int64) -> np.ndarray:
    """Rows of a list column as a matrix of ``dims`` columns; shorter rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), kind)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out
