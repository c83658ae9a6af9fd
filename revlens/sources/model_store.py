from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from revlens.sources.day_table import DayTable
from revlens.sources.files import COMPRESSION, drop_old_versions, is_complete, new_version, versions


class ModelStore:
    """Where built models live: Parquet tables below one folder, plus temp views.

    A refresh writes beside what is there. Readers see a new version, or new days, once
    they are complete, so a crash or a running refresh never leaves them without a table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def view(self, name: str, frame: DataFrame) -> DataFrame:
        """A lazy model: recomputed by every reader."""
        frame.createOrReplaceTempView(name)
        return frame

    def table(self, name: str, frame: DataFrame, day: str | None = None, basis: dict[str, str] | None = None) -> DataFrame:
        """Full refresh of a stored model, by ``day`` if it has one; returns the stored rows.

        ``basis`` notes the states of the tables that it was made from.
        """
        if day:
            table = DayTable(self.spark, self.path(name), day)
            table.publish_all(table.stage(frame), basis)
            return table.read()
        version = new_version()
        frame.write.parquet(f"{self.path(name)}/{version}", compression=COMPRESSION)
        drop_old_versions(self.spark, self.path(name))
        return self.spark.read.parquet(f"{self.path(name)}/{version}").select(*frame.columns)

    def replace_days(self, name: str, frame: DataFrame, days: Iterable[date | None],
                     basis: dict[str, str] | None = None) -> DataFrame:
        """Swap some days of a table stored by day for the rows of ``frame``; other days' files stay."""
        table = DayTable(self.spark, self.path(name))
        table.publish_days(table.stage(frame), days, basis)
        return table.read()

    def has_days(self, name: str) -> bool:
        """Whether the model is stored by day."""
        return DayTable(self.spark, self.path(name), "any").exists()

    def basis(self, name: str) -> dict[str, str]:
        """The states of the tables that a table by day was last made from."""
        return DayTable(self.spark, self.path(name)).snapshot().basis

    def state(self, name: str) -> str | None:
        """What names a stored model's present rows."""
        table = DayTable(self.spark, self.path(name))
        found = [str(table.snapshot().number)] if table.exists() else versions(self.spark, self.path(name))
        return found[-1] if found else None

    def changed_days(self, name: str, state: str) -> set[date | None] | None:
        """Days of a table by day that have changed since a state; None when that is not known any more."""
        return DayTable(self.spark, self.path(name)).changed_days(int(state))

    def read(self, name: str, state: str | None = None) -> DataFrame:
        """The latest committed rows, or an older version's of a model that is not stored by day."""
        if state is None and self.has_days(name):
            return DayTable(self.spark, self.path(name)).read()
        found = versions(self.spark, self.path(name)) if state is None else [state]
        if not found or not is_complete(self.spark, f"{self.path(name)}/{found[-1]}"):
            raise LookupError(f"no stored table {name} below {self.root}")
        return self.spark.read.parquet(f"{self.path(name)}/{found[-1]}")
