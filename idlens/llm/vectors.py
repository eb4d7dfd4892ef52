"""What the two vector operators share: which vectors count, and unit rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: str) -> Column:
    """False for vectors that are null, empty or zero, or hold null or non-finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows) -> np.ndarray:
    """Rows of length one, in double precision."""
    m = np.stack([np.asarray(r, np.float64) for r in rows])
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
