"""Input columns under names of their own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Given:
    """The input columns that are kept, renamed by position while an operator works, so that none of them clashes with a working name, whatever it is called."""

    def __init__(self, docs: DataFrame, keep: Iterable[str]):
        self.names = list(keep)
        self.columns = [F.col(f"`{c}`").alias(f"given_{i}") for i, c in enumerate(self.names)]
        self.df = docs.select(*self.columns)

    def name(self, column: str) -> str:
        return f"given_{self.names.index(column)}"

    def back(self) -> list[Column]:
        """The columns under the names that they came with."""
        return [F.col(f"given_{i}").alias(c) for i, c in enumerate(self.names)]
