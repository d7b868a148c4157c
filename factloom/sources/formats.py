"""Formats for ``spark.read`` and ``spark.readStream``: members of archives, and golden suites.

``register(spark)`` makes them known. Paths may lie in any store that pyarrow's file systems reach. Archives are
read by parts of their members, each part a partition: its task opens the archive and reads these members alone.
As a stream, a folder gives the archives that came since the last offset, by time of change and name.
"""

from __future__ import annotations

import fnmatch
import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from factloom.sources.readers import MAX_BYTES, SUFFIXES

#: Members and bytes of one partition, about.
PART_MEMBERS, PART_BYTES = 64, 64 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _listed(path: str, suffix: str) -> list[tuple[float, str]]:
    """(time of change, path) of the files below a folder, or of the file itself."""
    store, inner = _store(path)
    info = store.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
    root = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((f.mtime.timestamp() if f.mtime else 0.0, root + f.path) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix) and not f.base_name.startswith((".", "_")))


def _opened(path: str) -> zipfile.ZipFile:
    store, inner = _store(path)
    return zipfile.ZipFile(io.BufferedReader(store.open_input_file(inner), 1 << 20))


def _wanted(m: zipfile.ZipInfo) -> bool:
    return not m.is_dir() and "__MACOSX" not in m.filename and not m.filename.rsplit("/", 1)[-1].startswith(".") and m.filename.lower().endswith(SUFFIXES) and m.file_size <= MAX_BYTES


@dataclass
class Members(InputPartition):
    archive: str
    members: tuple[str, ...]


def _row(archive: str, member: str) -> dict:
    return {"archive": archive, "filename": member.replace("/", "__"), "appears_at": f"upload://{archive.rsplit('/', 1)[-1]}/{member}"}


def _parts(archive: str, chosen: str) -> list[Members]:
    out, held, size = [], [], 0
    with _opened(archive) as z:
        for m in z.infolist():
            if not _wanted(m) or not fnmatch.fnmatchcase(m.filename, chosen):
                continue
            if held and (len(held) >= PART_MEMBERS or size + m.file_size > PART_BYTES):
                out.append(Members(archive, tuple(held)))
                held, size = [], 0
            held.append(m.filename)
            size += m.file_size
    return out + [Members(archive, tuple(held))] * bool(held)


def _read(partition: Members) -> Iterator[tuple]:
    with _opened(partition.archive) as z:
        for name in partition.members:
            row = _row(partition.archive, name)
            raw = z.read(name)
            yield row["archive"], row["filename"], row["appears_at"], len(raw), raw


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, chosen: str):
        self.path, self.chosen = path, chosen

    def partitions(self) -> list[Members]:
        return [p for _, archive in _listed(self.path, ".zip") for p in _parts(archive, self.chosen)]

    def read(self, partition: Members) -> Iterator[tuple]:
        return _read(partition)


class ArchiveStream(DataSourceStreamReader):
    def __init__(self, path: str, chosen: str):
        self.path, self.chosen = path, chosen

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1.0, "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = _listed(self.path, ".zip")
        return {"time": found[-1][0], "name": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Members]:
        low, high = ((o["time"], o["name"]) for o in (start, end))
        return [p for at in _listed(self.path, ".zip") if low < at <= high for p in _parts(at[1], self.chosen)]

    def read(self, partition: Members) -> Iterator[tuple]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        pass


class Archives(DataSource):
    """Text-like members of the zip files at ``path``; the option ``members``, a pattern as of a shell, says which are read at all.

    Conditions aren't taken from queries: the reader of one DataFrame would keep those of its first query for all later ones.
    """

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "archive string, filename string, appears_at string, size long, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("members", "*"))

    def streamReader(self, schema) -> ArchiveStream:  # noqa: N802
        return ArchiveStream(self.options["path"], self.options.get("members", "*"))


@dataclass
class Suite(InputPartition):
    path: str


class SuiteReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Suite]:
        return [Suite(p) for _, p in _listed(self.path, ".json")]

    def read(self, partition: Suite) -> Iterator[tuple]:
        store, inner = _store(partition.path)
        with store.open_input_file(inner) as f:
            suite = json.loads(f.read())
        for place, case in enumerate(suite.get("cases") or []):
            many = lambda k: [str(x) for x in case.get(k) or []]  # noqa: E731,B023
            yield str(suite.get("suite_id") or ""), str(suite.get("agent_name") or ""), place, str(case.get("id") or ""), case.get("question"), (case.get("expect_decision") or "answer").lower(), many("must_any"), many("forbid_any"), many("citation_any"), case.get("source_url")


class GoldenSuites(DataSource):
    """Cases of the golden suites at ``path``, a partition for each file; names that start with _ or a dot are left out."""

    @classmethod
    def name(cls) -> str:
        return "golden_suites"

    def schema(self) -> str:
        return "suite_id string, agent_name string, place int, id string, question string, expect string, must_any array<string>, forbid_any array<string>, citation_any array<string>, source_url string"

    def reader(self, schema) -> SuiteReader:
        return SuiteReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (Archives, GoldenSuites):
        spark.dataSource.register(source)
