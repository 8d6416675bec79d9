"""Snapshots: sets of tables that never change, and a pointer to the newest.

Tables are written to new folders first; then one small file with the next number names them, with the pointers that go with
them (the search generation). That file can be made only once, so of two writers that began from the same snapshot one
fails; what a failed writer wrote is never named. A reader takes one number and reads the tables that it names, whatever is
published meanwhile.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class PublicationConflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    paths: dict[str, list[str]]
    pointers: dict[str, str]

    @property
    def name(self) -> str:
        return f"snapshot-{self.number}"


class Snapshots:
    """The snapshots below ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def newest(self) -> Snapshot:
        """The newest snapshot; number 0 without tables, where nothing is published."""
        folder = self._path("pointer")
        if not self._fs.exists(folder):
            return Snapshot(0, {}, {})
        numbers = sorted((int(f.getPath().getName().removesuffix(".json")) for f in self._fs.listStatus(folder)), reverse=True)
        for number in numbers:
            text = "".join(r[0] for r in self.spark.read.text(f"{self.root}/pointer/{number}.json", wholetext=True).collect())
            if text.endswith("}\n"):  # else its writer hasn't ended
                held = json.loads(text)
                return Snapshot(number, held["paths"], held["pointers"])
        return Snapshot(0, {}, {})

    def read(self, snapshot: Snapshot) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(*paths) for name, paths in snapshot.paths.items()}

    def publish(self, base: Snapshot, changed: dict[str, DataFrame], added: dict[str, DataFrame] | None = None, **pointers: str) -> Snapshot:
        """``base`` with other tables, with rows ``added`` to some, and with other pointers as the next snapshot; all of it or nothing."""
        paths = dict(base.paths)
        for name, df in changed.items():
            paths[name] = [self._written(name, df)]
        for name, df in (added or {}).items():
            paths[name] = [*paths.get(name, []), self._written(name, df)]
        number, held = base.number + 1, base.pointers | pointers
        try:
            out = self._fs.create(self._path("pointer", f"{number}.json"), False)  # fails where the file is there
        except Exception as error:
            raise PublicationConflict(f"snapshot {number} is there already") from error
        out.write(bytearray((json.dumps({"paths": paths, "pointers": held}) + "\n").encode()))
        out.close()
        return Snapshot(number, paths, held)

    def _written(self, name: str, df: DataFrame) -> str:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path
