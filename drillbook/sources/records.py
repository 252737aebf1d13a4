"""A log of small numbered records, each put there once and whole.

Record N holds the state that a change led to. Whoever wants to change it reads
the latest record, writes whatever data the next state names, and puts record
N+1; if another has put that number meanwhile, the change is refused and can be
made again from the new state. Data that no record names was never published,
so a job that died before its record has changed nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class RecordTaken(Exception):
    """Another writer has put this record; nothing of this change is visible."""


class Folder:
    """The file operations the stores need, on whatever file system holds them."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, below: str = "") -> list[str]:
        """Names right under a folder; nothing deeper is listed."""
        path = self._path(below)
        if not self.system.exists(path):
            return []
        return sorted(item.getPath().getName() for item in self.system.listStatus(path))

    def delete(self, name: str) -> None:
        self.system.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self.system.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a small file unless it is there already.

        It is written aside and renamed, so it is seen whole or not at all; a
        rename does not replace a file that another writer has put there.
        """
        aside, final = self._path(f".{uuid.uuid4().hex}"), self._path(name)
        stream = self.system.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.system.exists(final) and self.system.rename(aside, final):
            return True
        self.system.delete(aside, False)
        return False


class Records:
    """The record log of one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)

    def numbers(self) -> list[int]:
        return [int(name[:-5]) for name in self.folder.names() if name.endswith(".json") and name[0] != "."]

    def read(self, number: int) -> dict:
        return json.loads(self.folder.read(self._name(number)))

    def latest(self) -> tuple[int, dict] | None:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def put(self, number: int, state: dict) -> None:
        if not self.folder.put(self._name(number), json.dumps(state)):
            raise RecordTaken(f"record {number} of {self.folder.root} is taken")

    def forget(self, keep: int) -> list[tuple[int, dict]]:
        """Drop all but the last `keep` records; returns those that stay."""
        numbers = self.numbers()
        for number in numbers[:-keep]:
            self.folder.delete(self._name(number))
        return [(number, self.read(number)) for number in numbers[-keep:]]

    @staticmethod
    def _name(number: int) -> str:
        return f"{number:012d}.json"
