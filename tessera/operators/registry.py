"""Rankers by name: register once, promote, resolve; an unknown name is an error.

The registry is a log: a folder of numbered entries, each written whole and put in its
place only where none is. What holds is the fold of the entries in their order. A writer
whose number has been taken reads on, checks its entry against what it finds and takes the
next number; a writer that dies leaves nothing or a whole entry.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.session import list_names, put_if_absent, read_text

SCHEMA = "name string, kind string, path string, base_model string, metrics map<string,double>, notes string, champion boolean"
BASELINE = {"name": "baseline", "kind": "fusion_order", "path": None, "base_model": None, "metrics": {}, "notes": "order of fusion"}
TRIES = 100


class RegistryError(LookupError):
    """An unknown ranker, or one that is registered twice."""


class Registry:
    """A log in any file system that Spark reaches; without one, the baseline is champion."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.champion, self.entries, self.version = "baseline", {"baseline": BASELINE}, 0
        self.refresh()

    def _place(self, version: int) -> str:
        return f"{self.path}/{version:010d}.json"

    def refresh(self) -> None:
        """Read the entries that came since."""
        names = set(list_names(self.spark, self.path))
        while f"{self.version + 1:010d}.json" in names:
            self._apply(json.loads(read_text(self.spark, self._place(self.version + 1))))
            self.version += 1

    def _apply(self, entry: dict) -> None:
        if "promote" in entry:
            self.champion = entry["promote"]
        else:
            self.entries[entry["register"]["name"]] = entry["register"]

    def _append(self, entry: dict, check) -> None:
        entry = {**entry, "id": uuid.uuid4().hex}
        for _ in range(TRIES):
            self.refresh()
            check()
            if put_if_absent(self.spark, self._place(self.version + 1), json.dumps(entry, sort_keys=True)):
                self.refresh()
                return
        raise OSError(f"{self.path}: too many writers")

    def register(self, name: str, **entry) -> None:
        def check() -> None:
            if name in self.entries:
                raise RegistryError(f"{name!r} is registered already; entries are never replaced")

        self._append({"register": BASELINE | {"notes": "", **entry, "name": name}}, check)

    def promote(self, name: str) -> None:
        self._append({"promote": name}, lambda: self.get(name))

    def get(self, name: str | None = None) -> dict:
        """The entry of a name (none: the champion); never another one instead."""
        name = name or self.champion
        if name not in self.entries:
            raise RegistryError(f"unknown ranker {name!r}; known: {sorted(self.entries)}")
        return self.entries[name]

    def table(self) -> DataFrame:
        rows = [(e["name"], e["kind"], e["path"], e["base_model"], e["metrics"], e["notes"], e["name"] == self.champion) for e in self.entries.values()]
        return self.spark.createDataFrame(sorted(rows, key=lambda r: r[0]), SCHEMA)
