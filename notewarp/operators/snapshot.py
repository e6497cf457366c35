"""Several tables as one version: written to a folder of their own, put in force by one rename of a manifest."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class Manifests:
    """Numbered manifests below a folder; the greatest is in force, and a number is given once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_classes = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._fs_classes.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self, folder: str = "", before: str = "manifest-") -> list[int]:
        """The numbers that follow `before` in the names of a folder, in order."""
        if not self._fs.exists(self._at(folder)):
            return []
        named = [re.fullmatch(rf"{re.escape(before)}(\d+)(?:\.json)?", s.getPath().getName()) for s in self._fs.listStatus(self._at(folder))]
        return sorted(int(m.group(1)) for m in named if m)

    def newest(self) -> int:
        return max(self.numbers(), default=0)

    def read(self) -> dict:
        """The manifest in force; empty before the first."""
        number = self.newest()
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{number}.json", wholetext=True).first()[0]) if number else {}

    def publish(self, number: int, manifest: dict) -> None:
        """Put `manifest` in force as `number`; raises, and changes nothing, if that number is taken."""
        staged = self._at(f".staged-{uuid.uuid4().hex}")
        stream = self._fs.create(staged, False)
        stream.write(bytearray(json.dumps({"version": number, **manifest}).encode()))
        stream.close()
        rename = getattr(self._fs_classes, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        context = self._fs_classes.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(self._at(f"manifest-{number}.json")), never_over)
        except Exception as error:
            self._fs.delete(staged, False)
            raise RuntimeError(f"version {number} was published by another run") from error


class Snapshot:
    """Tables below `path`. A commit writes changed tables to a new version; others keep pointing to theirs."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = Manifests(spark, self.path)

    def manifest(self) -> dict:
        """{"version", "schema_version", "tables"} in force; version 0 and no tables before the first commit."""
        return self._manifests.read() or {"version": 0, "schema_version": 0, "tables": {}}

    def has(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.manifest()['tables'][name]}")

    def commit(self, tables: dict[str, DataFrame], *, schema_version: int | None = None, expected: int | None = None) -> int:
        """Write `tables` and put them in force together; raises if another commit came first. Before the rename nothing is visible.

        `expected` is the version that the tables were computed from.
        """
        base = self.manifest()
        if expected is not None and base["version"] != expected:
            raise RuntimeError(f"version {base['version']} is in force, the tables were computed from {expected}")
        version, named = base["version"] + 1, dict(base["tables"])
        attempt = f"v{version}-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{self.path}/{attempt}/{name}")
            named[name] = f"{attempt}/{name}"
        self._manifests.publish(version, {"schema_version": base["schema_version"] if schema_version is None else schema_version, "tables": named})
        return version

    def migrate(self, steps: list) -> int:
        """Apply the schema steps that are newer than the version in force, one commit each; a step maps tables to changed tables."""
        for number, step in enumerate(steps, 1):
            if number > self.manifest()["schema_version"]:
                current = {name: self.table(name) for name in self.manifest()["tables"]}
                self.commit(step(current), schema_version=number)
        return self.manifest()["schema_version"]


def discover_steps(steps: dict[str, Callable]) -> list[Callable]:
    """Schema steps by name (`001_first`) in the order of their numbers; a bad name, a gap or a number given twice is an error."""
    numbered = {}
    for name, step in steps.items():
        shaped = re.fullmatch(r"(\d{3})_[a-z0-9_]+", Path(name).stem)
        if not shaped or int(shaped.group(1)) in numbered:
            raise ValueError(f"bad name of a schema step: {name}")
        numbered[int(shaped.group(1))] = step
    if sorted(numbered) != list(range(1, len(numbered) + 1)):
        raise ValueError("schema steps must be numbered from 1 without a gap")
    return [numbered[n] for n in sorted(numbered)]
