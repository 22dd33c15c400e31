"""A polled source: what a command or a function answers at a moment, as a stream that can start again.

What is polled cannot be read twice, so every answer is put into a journal before Spark hears of it. An
offset counts journal entries; a batch reads entries again from the journal, wherever and however often its
tasks run. After a restart the stream goes on from its checkpoint: an entry that was journaled but not yet
processed is part of the next batch, and none is read twice."""

from __future__ import annotations

import importlib
import json
import subprocess
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "entry bigint, item int, polled double, body string"


def run_command(options: dict, n: int) -> list[str]:
    """What the command in option `command` (a JSON list) prints, as one snapshot."""
    done = subprocess.run(json.loads(options["command"]), capture_output=True, text=True, timeout=float(options.get("timeout", "30")), check=True)
    return [done.stdout]


def next_lines(options: dict, n: int) -> list[str]:
    """The next `lines` lines of the files in a folder, for replays: the n-th poll goes on after the one before."""
    size, at, out = int(options.get("lines", "1")), 0, []
    files, root = fs.FileSystem.from_uri(options["file"])
    for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
        if not info.base_name.startswith(("_", ".")):
            with files.open_input_stream(info.path) as stream:
                for line in stream.read().decode().splitlines():
                    out += [line] if n * size <= at < (n + 1) * size else []
                    at += 1
    return out


class Journal:
    """Entries in a folder of any file system, one file each, numbered without gaps."""

    def __init__(self, uri: str):
        self.files, self.root = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.root, recursive=True)

    def path(self, n: int) -> str:
        return f"{self.root}/{n:012d}.json"

    def size(self) -> int:
        found = [f.base_name for f in self.files.get_file_info(fs.FileSelector(self.root)) if f.base_name.endswith(".json")]
        return len(found)

    def append(self, n: int, bodies: list[str]) -> None:
        tmp = f"{self.root}/{n:012d}.writing"
        with self.files.open_output_stream(tmp) as out:
            out.write(json.dumps({"polled": time.time(), "bodies": bodies}).encode())
        self.files.move(tmp, self.path(n))

    def read(self, n: int) -> dict:
        with self.files.open_input_stream(self.path(n)) as entry:
            return json.loads(entry.read())


class Entry(InputPartition):
    def __init__(self, n: int):
        super().__init__(n)
        self.n = n


class Poller(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.last = 0.0

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        journal, every = Journal(self.options["journal"]), float(self.options.get("every", "0"))
        n = journal.size()
        if time.time() - self.last >= every:
            self.last = time.time()
            module, name = self.options.get("poll", "millrace.streaming.snapshots:run_command").split(":")
            if bodies := getattr(importlib.import_module(module), name)(self.options, n):
                journal.append(n, bodies)
                n += 1
        return {"entries": n}

    def partitions(self, start: dict, end: dict) -> list[Entry]:
        return [Entry(n) for n in range(start["entries"], end["entries"])]

    def read(self, partition: Entry) -> Iterator[tuple]:
        entry = Journal(self.options["journal"]).read(partition.n)
        for i, body in enumerate(entry["bodies"]):
            yield partition.n, i, entry["polled"], body

    def commit(self, end: dict) -> None:
        """The journal stays: it is the only copy of what was polled."""


class PolledSnapshots(DataSource):
    """Options: journal (a folder that all executors share), poll (module:function of options and the number
    of polls before, giving snapshots), every (seconds between polls), and what the function reads."""

    @classmethod
    def name(cls) -> str:
        return "polled_snapshots"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> Poller:
        return Poller(self.options)


def polled(spark: SparkSession, **options: str):
    """A stream of (entry, item, polled, body)."""
    spark.dataSource.register(PolledSnapshots)
    return spark.readStream.format("polled_snapshots").options(**options).load()
