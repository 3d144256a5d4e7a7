"""A commit log: what a folder holds is said by the newest of its numbered manifests.

Data are written to fresh folders first, which nobody reads. A manifest that names them is then written beside the
others and renamed to the next number, so all of a step becomes visible at once or not at all. Folders that no kept
manifest names (of an interrupted step, or replaced since) are swept. Manifests have the size of the run grid.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from driftwell.session import file_system

#: Manifests that stay readable, so that a frame of the state before the last commit still finds its files.
KEPT = 2


class CommitConflict(RuntimeError):
    """Another run has committed to the same folder since this one read it."""


@dataclass
class CommitLog:
    """Manifests under ``path``/commits, data under ``path``/data; names in manifests are relative to ``path``."""

    spark: SparkSession
    path: str

    def _names(self, folder: str) -> list[str]:
        fs, path = file_system(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("commits") if n.endswith(".json") and n[:-5].isdigit()]

    def _manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/commits/{number:012d}.json", wholetext=True).head()[0])

    def newest(self) -> tuple[int, dict]:
        """Number and content of the newest manifest; 0 and nothing before the first."""
        number = max(self.numbers(), default=0)
        return (number, self._manifest(number)) if number else (0, {})

    def fresh(self) -> str:
        """Name of a data folder of its own; part of nothing until a manifest names it."""
        return f"data/{uuid.uuid4().hex}"

    def exists(self, name: str) -> bool:
        fs, path = file_system(self.spark, f"{self.path}/{name}")
        return bool(fs.exists(path))

    def commit(self, content: dict, after: int) -> int:
        """Make ``content`` the manifest that follows number ``after``."""
        fs, draft = file_system(self.spark, f"{self.path}/commits/{uuid.uuid4().hex}.draft")
        _, final = file_system(self.spark, f"{self.path}/commits/{after + 1:012d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        if max(self.numbers(), default=0) != after or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise CommitConflict(f"{self.path} is no longer at commit {after}")
        return after + 1

    def sweep(self) -> None:
        """Delete data, drafts and manifests that no kept manifest needs. Only for the run that writes."""
        kept = sorted(self.numbers())[-KEPT:]
        named = json.dumps([self._manifest(n) for n in kept])
        for name in self._names("data"):
            if name not in named:
                self._delete(f"data/{name}")
        for name in self._names("commits"):
            if name.endswith(".draft") or (name.endswith(".json") and int(name[:-5]) not in kept):
                self._delete(f"commits/{name}")

    def _delete(self, name: str) -> None:
        fs, path = file_system(self.spark, f"{self.path}/{name}")
        fs.delete(path, True)
