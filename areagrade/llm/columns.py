"""Keep a caller's columns apart from those an operator works with."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Apart:
    """The columns of ``docs`` under names of their position, which no operator uses for its own.

    ``added`` are the columns that the operator adds; those of ``docs`` with such a name, in upper
    or lower case, are replaced: they can be read, but do not come back.
    """

    def __init__(self, docs: DataFrame, added: Collection[str]):
        self.names = docs.columns
        self.rows = docs.toDF(*(f"kept{i}" for i in range(len(self.names))))
        taken = {c.lower() for c in added}
        self.kept = {f"kept{i}": c for i, c in enumerate(self.names) if c.lower() not in taken}

    def of(self, name: str) -> str:
        """Where a column of ``docs`` is now."""
        return f"kept{self.names.index(name)}"

    def back(self) -> list[Column]:
        """The kept columns under their own names."""
        return [F.col(k).alias(c) for k, c in self.kept.items()]
