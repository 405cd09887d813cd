"""Files that Python tasks read and write themselves, by paths or addresses that pyarrow's file systems know."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark takes for it, so that tasks open the same one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); it goes when the process ends.

    Where none is named, a temporary one is taken, in local sessions only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(named or tempfile.mkdtemp(prefix='tidewater-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_gone, path)
    return path


def _gone(path: str) -> None:
    system, inside = opened(path)
    with contextlib.suppress(OSError):
        system.delete_dir(inside)


def listed(path: str, endings: tuple[str, ...]) -> tuple[pafs.FileSystem, list[str], bool]:
    """The files of a folder and its subfolders by their endings in any case, or the one file; whether it is one file.

    FileNotFoundError where there is neither.
    """
    system, inside = opened(path)
    info = system.get_file_info(inside)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return system, [inside], True
    found = system.get_file_info(pafs.FileSelector(inside, recursive=True))
    return system, sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.lower().endswith(endings)), False


class Staged:
    """Files that a task writes beside their place; they get their names when all tasks are done, or go."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), f".pending-{uuid.uuid4().hex}"

    def begin(self) -> None:
        """This attempt's own folder, so that no two attempts of a task meet."""
        self.system, self.root = opened(self.path)
        self.own = f"{self.root}/{self.job}/{uuid.uuid4().hex}"
        self.names: list[str] = []
        self.folders: set[str] = set()
        self.system.create_dir(self.own, recursive=True)

    def file(self, name: str, folder: str | None = None):  # noqa: ANN201
        """A file to write to; it goes to the folder of that name, if one is given."""
        for part in (name,) if folder is None else (folder, name):
            if "/" in part or part in ("", ".", ".."):
                raise ValueError(f"no name for a file: {part!r}")
        if folder is not None and folder not in self.folders:
            self.system.create_dir(f"{self.own}/{folder}")
            self.folders.add(folder)
        self.names.append(name if folder is None else f"{folder}/{name}")
        return self.system.open_output_stream(f"{self.own}/{self.names[-1]}")

    def done(self) -> tuple[str, list[str]]:
        return self.own, self.names

    def settle(self, made: list[tuple[str, list[str]]]) -> None:
        """Give the files their names; two tasks' files of one name are refused before any is moved."""
        system, root = opened(self.path)
        names = [n for _, own in made for n in own]
        if len(set(names)) < len(names):
            raise ValueError("two rows have the same file name")
        for folder in {n.rsplit("/", 1)[0] for n in names if "/" in n}:
            system.create_dir(f"{root}/{folder}")
        for folder, own in made:
            for name in own:
                system.move(f"{folder}/{name}", f"{root}/{name}")
        self.drop()

    def drop(self) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.job}").type != pafs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")
