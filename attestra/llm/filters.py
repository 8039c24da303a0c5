"""A filter of fixed size for the hashes in a column, to be sent to tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
SLOTS = 20  # the filter has 2 ** SLOTS longs


class Filter:
    """Which hashes may be in a column (long): never wrong about those that are. Its size does not depend on theirs.

    Where it is full it tells nothing and all rows pass; what it lets through is always matched exactly afterwards.
    """

    def __init__(self, keys: DataFrame, column: str = "key"):
        slot, bit = F.shiftrightunsigned(column, 64 - SLOTS), F.expr(f"shiftleft(1L, cast({column} & 63 AS INT))")
        rows = keys.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2 ** SLOTS rows at most
        self.bits = np.zeros(1 << SLOTS, U)
        self.bits[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(U)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        return (self.bits[keys >> U(64 - SLOTS)] >> (keys & U(63)) & U(1)).astype(bool)
