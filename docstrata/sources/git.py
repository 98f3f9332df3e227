"""Files and tags of local Git repositories, as a Spark data source."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Objects and bytes that one partition reads.
OBJECTS, BYTES = 256, 32 << 20
_POINTER = b"version https://git-lfs.github.com/spec/"


def _git(repository: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repository, *args], input=data, capture_output=True, check=False, timeout=600)
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout


def check_ref(ref: str) -> str:
    if not ref or ref.startswith("-") or re.search(r"[\s~^:?*\[\\\0]|\.\.|@\{", ref):
        raise ValueError(f"not a branch, tag or commit: {ref!r}")
    return ref


class _Objects(InputPartition):
    def __init__(self, entries: list[tuple[str, str]]):
        self.entries = entries


class _Files(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repository, self.ref = options["path"], check_ref(options.get("ref", "HEAD"))
        self.commit = _git(self.repository, "rev-parse", "--verify", f"{self.ref}^{{commit}}").decode().strip()

    def partitions(self) -> list[InputPartition]:
        """Regular files of the commit, in groups of bounded number and size; links and submodules are left out."""
        groups: list[list[tuple[str, str]]] = [[]]
        total = 0
        for entry in _git(self.repository, "ls-tree", "-r", "-l", "-z", self.commit).split(b"\0"):
            if not entry:
                continue
            meta, path = entry.split(b"\t", 1)
            mode, kind, name, size = meta.split()
            if kind != b"blob" or mode == b"120000":
                continue
            if groups[-1] and (len(groups[-1]) >= OBJECTS or total + int(size) > BYTES):
                groups.append([])
                total = 0
            groups[-1].append((name.decode(), path.decode("utf-8", "surrogateescape")))
            total += int(size)
        return [_Objects(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.entries:
            return
        names = "".join(f"{name}\n" for name, _ in partition.entries).encode()
        out, at = _git(self.repository, "cat-file", "--batch", data=names), 0
        for _, path in partition.entries:
            end = out.index(b"\n", at)
            size = int(out[at:end].split()[2])
            content = out[end + 1 : end + 1 + size]
            at = end + 2 + size
            pointer = content.startswith(_POINTER)
            yield path, None if pointer else content, size, self.commit, "LFS_POINTER" if pointer else None


class _Tags(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repository = options["path"]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        shown = "%(refname:short)%00%(objectname)%00%(*objectname)"
        for line in _git(self.repository, "for-each-ref", f"--format={shown}", "refs/tags").decode("utf-8", "replace").splitlines():
            name, tagged, peeled = line.split("\0")
            yield name, peeled or tagged


class GitSource(DataSource):
    """``spark.read.format("git").option("ref", "v1").load(repository)``: ``path, content, length, commit, error_code``;
    with ``option("table", "tags")``: ``name, commit``. Contents are those of the resolved commit, whatever moves later.
    The repository must be readable from every executor.
    """

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        if self.options.get("table") == "tags":
            return "name string, commit string"
        return "path string, content binary, length long, commit string, error_code string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Tags(self.options) if self.options.get("table") == "tags" else _Files(self.options)
