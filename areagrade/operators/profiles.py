"""Profiles that are kept and added to: counts and sums of one period merge with those of others."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areagrade.sources.files import Folder

PERIOD = "period"


def merged(profiles: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row per combination of the other columns, NULLs included, with the sums of the measures.

    The profile of all records is the merged profiles of any parts of them.
    """
    keys = [name for name in profiles.columns if name not in measures]
    return profiles.groupBy(*keys).agg(*(F.sum(name).alias(name) for name in measures)).select(*profiles.columns)


class ProfileTable:
    """Profiles by period in a folder, each a table of its own.

    ``add`` writes a period's profile under another name and puts it in place when it is whole, so
    a run that dies adds nothing, and adding a period again replaces it. No record that was
    counted is read again: statistics start from ``read``, whose size is that of the profiles.
    """

    def __init__(self, spark: SparkSession, path: str, measures: Sequence[str]):
        self.spark, self.measures = spark, list(measures)
        self._folder = Folder(spark, path)

    def periods(self) -> list[str]:
        mark = f"{PERIOD}="
        return [name.removeprefix(mark) for name in self._folder.names() if name.startswith(mark)]

    def add(self, period: str, profile: DataFrame) -> None:
        if not period.replace("-", "").isalnum():
            raise ValueError(f"a period is letters, digits and dashes, not {period!r}")
        draft = self._folder.child(f"_draft-{uuid.uuid4().hex}")
        try:
            profile.write.parquet(draft.path)
            self.remove(period)
            draft.move_to(self._folder.child(f"{PERIOD}={period}"))
        finally:
            draft.delete()

    def remove(self, period: str) -> None:
        self._folder.child(f"{PERIOD}={period}").delete()

    def read(self, *periods: str) -> DataFrame:
        """The merged profile of these periods, or of all."""
        wanted = periods or self.periods()
        if missing := set(wanted) - set(self.periods()) or not wanted:
            raise KeyError(f"no profile of {missing}" if wanted else "no profile yet")
        rows = self.spark.read.parquet(*(self._folder.child(f"{PERIOD}={period}").path for period in wanted))
        return merged(rows, self.measures)
